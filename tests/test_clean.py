"""Literal-row tests for the cleaning parsers (traps T1–T4, T10, T13)."""

from pyspark.sql import functions as F

from pertinax.functions import clean as C


def _col(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def _apply(spark, values, fn, dtype="string"):
    df = _col(spark, values, dtype)
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parse_decimal(spark):
    values = ["36,5", "1.234,56", "1,234.56", "98%", " 7.1 ", "", "null", "nan", "ND", "5d",
              "Infinity", None, "NaN", "none"]
    got = _apply(spark, values, C.parse_decimal)
    assert got[:5] == [36.5, 1234.56, 1.23456, 98.0, 7.1]   # T13: US thousands parse to 1.23456
    assert got[5:] == [None] * 9                             # T2: no '5d', no inf, no NaN


def test_to_number_rejects_spark_only_literals(spark):
    got = _apply(spark, ["5d", "nan", "Infinity", "1e3", "-2.5", ".5", "7."], C.to_number)
    assert got == [None, None, None, 1000.0, -2.5, 0.5, 7.0]


def test_comma_to_dot_and_fio2(spark):
    assert _apply(spark, ["36,5", "1,2,3", "40"], C.comma_to_dot) == [36.5, None, 40.0]
    assert _apply(spark, [50.0, 0.4, 1.0, None], C.fio2_fraction, "double") == [0.5, 0.4, 1.0, None]


YES_NO = ["Si", "SI", "Sí", " sí ", "s", "x", "true", "1", "1.0", "2", "No", "NO", "n", "0", "", None]


def test_yes_no_parsers_disagree_as_documented(spark):
    bin_map = _apply(spark, YES_NO, C.bin_map)
    assert bin_map == [1, 1, 1, 1, 1, None, None, 1, None, None, 0, 0, 0, 0, None, None]
    assert _apply(spark, YES_NO, C.bin_map_zero) == [0 if v is None else v for v in bin_map]
    exact = _apply(spark, YES_NO, C.bin_exact)
    assert exact == [1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]   # T10: "SI" -> 0
    to_bool = _apply(spark, YES_NO, C.to_bool)
    assert to_bool == [True, True, True, True, True, True, True, True, False, False,
                       False, False, False, False, False, False]


def test_numeric_yes_no(spark):
    assert _apply(spark, [0.0, 1.0, 2.0, None, float("nan")], lambda c: C.to_bool(c, numeric=True),
                  "double") == [False, True, True, False, False]
    assert _apply(spark, ["0", "1", "2", None], lambda c: C.bin_exact(c, numeric=True)) == [0, 1, 2, 0]


def test_flags_null_is_zero_and_nan_never_enters(spark):
    # A comparison on a missing value gives 0, not NULL
    got = _apply(spark, [None, 89.0, 90.0], lambda c: C.flag(c < 90), "double")
    assert got == [0, 1, 0]
    # Division by zero is NULL, not an error and not inf
    df = spark.createDataFrame([(1.0, -1.0), (2.0, 1.0)], "a double, b double")
    r = df.select(C.safe_div(F.col("a"), F.col("b") + 1).alias("x")).collect()
    assert r[0]["x"] is None and r[1]["x"] == 1.0


def test_pct_round_is_half_even(spark):
    # T4: numpy rounds half to even
    assert _apply(spark, [0.00125, 0.00135], C.pct_round, "double") == [0.12, 0.14]


def test_text_cleaning(spark):
    got = _apply(spark, ["Neumonía: disnea", "Niño CON fiebre", None, "Ñandú ß"], C.clean_text)
    assert got == ["neumonia  disnea", "nino con fiebre", "", "nandu  "]
    assert _apply(spark, ["Éxito ñandú"], C.strip_accents) == ["Exito nandu"]
    assert _apply(spark, ["  Presión   Arterial  "], C.normalize_key) == ["presion arterial"]


def test_normalize_name_single_pass(spark):
    # one pass of double -> single blank, like str.replace
    assert _apply(spark, ["PA__Sistólica°", "a    b"], C.normalize_name) == ["pa sistólica", "a  b"]


def test_join_key(spark):
    assert _apply(spark, ["  ep12 ", "EP12", None], C.join_key) == ["EP12", "EP12", None]


def test_month_range_keeps_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(
        C.month_range("o_orderdate", 1998, 10))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderdate" in plan
    assert all(r["o_orderdate"].month == 10 for r in df.collect())


def test_infinite_values_become_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.5,)], "x double")
    assert [r["y"] for r in df.select(C.finite("x").alias("y")).collect()] == [None, None, 1.5]
