"""Exactness and skew behaviour of the distributed helpers (stats, rank, split, joins)."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pertinax.operators import joins as J
from pertinax.operators import order, prep, stats
from pertinax.operators import aggregate as A


def test_exact_median_and_mode_with_a_hot_value(spark):
    random.seed(7)
    vals = [random.gauss(50, 20) for _ in range(3000)] + [42.0] * 1500   # one value = 1/3
    vals += [float(i % 17) for i in range(501)]
    rows = [("a", v) for v in vals] + [("b", float(i)) for i in range(10)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, value double")
    counts = stats.value_counts(df, ["k"])
    med = {r["k"]: r["median"] for r in stats.exact_median(counts, ["k"], cells=16).collect()}
    assert med["a"] == pytest.approx(statistics.median(vals))
    assert med["b"] == pytest.approx(4.5)
    assert "c" not in med
    mode = {r["k"]: r["mode"] for r in stats.exact_mode(counts, ["k"]).collect()}
    assert mode["a"] == 42.0 and mode["b"] == 0.0      # ties -> smallest


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_median_small_groups(spark, n):
    df = spark.createDataFrame([("x", float(i * 3 % 11)) for i in range(n)], "k string, value double")
    got = stats.exact_median(stats.value_counts(df, ["k"]), ["k"], cells=8).first()["median"]
    assert got == pytest.approx(statistics.median([float(i * 3 % 11) for i in range(n)]))


HOSTILE = {
    "spread": [2.0 ** i for i in range(-1074, 1024, 3)] + [-(2.0 ** i) for i in range(-1074, 1000, 7)],
    "far": [1e300, -1e300] + [i / 997 for i in range(900)],
    "ends": [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0],
    "tiny": [i * 5e-324 for i in range(301)],
    "close": [1.0 + i * 2.0 ** -52 for i in range(500)],
    "infinite": [float("inf")] * 5 + [1.0, 2.0] + [float("-inf")] * 2,
    "two": [3.0] * 400 + [3.0000000000000004] * 400,
    "hot": [7.5] * 1001 + [7.5 + i * 1e-9 for i in range(1, 400)] + [7.5 - i * 1e-9 for i in range(1, 300)],
    None: [4.0, 1.0],
}


@pytest.mark.parametrize("counted", [True, False])
def test_radix_median_on_hostile_values(spark, counted):
    rows = [(k, x) for k, xs in HOSTILE.items() for x in xs] + [("spread", None), ("far", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, value double")
    source = stats.value_counts(df, ["k"]) if counted else df
    got = stats.exact_median(source, ["k"], c="c" if counted else None, cells=8, local_rows=5)
    assert {r["k"]: r["median"] for r in got.collect()} == {k: statistics.median(xs) for k, xs in HOSTILE.items()}


def test_radix_median_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, value double")
    assert stats.exact_median(df, ["k"], c=None).collect() == []


def test_distinct_counts_by_words(spark):
    cases = {
        "dense": [float(i % 1000 - 500) for i in range(5000)],
        "sparse": [float(i * 10 ** 9) for i in range(-200, 200)],
        "fractions": [i / 8 for i in range(-100, 100)] * 2,
        "zero": [0.0, -0.0, 1.0, -1.0, 63.0, 64.0, -64.0, -65.0],
        "large": [2.0 ** 53 - 1, 2.0 ** 53, 2.0 ** 53 + 2, -(2.0 ** 53), 1e300, float("inf"), float("-inf")],
        # a word's number is a value of its own as well
        "clash": [0.5, 32.0, 1.5, 96.0, 1.0, 2.0 ** 59, 2.0 ** 53],
    }
    rows = [(k, x) for k, xs in cases.items() for x in xs] + [("dense", None), ("zero", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r["k"]: (r["n"], r["n_distinct"], r["min"], r["max"]) for r in stats.distinct_count(df, ["k"]).collect()}
    assert got == {k: (len(xs), len(set(xs)), min(xs), max(xs)) for k, xs in cases.items()}


def test_distinct_counts_shuffle_words_not_values(spark):
    df = spark.range(640_000, numPartitions=4).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("value"))
    got = stats.distinct_count(df, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert got.first()["n_distinct"] == 640_000


def test_plans_of_ranks_and_medians_do_not_grow_with_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(20_000).select("id", ((F.col("id") * 7919) % 1009).cast("double").alias("v"), F.lit("x").alias("k"))
    sizes = []
    try:
        for n in (8, 2000):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            frames = [order.global_rank(df, [("v", "desc"), "id"]), stats.exact_median(df, ["k"], "v", None)]
            plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in frames]
            sizes.append([(len(p.splitlines()), len(p) // 1000) for p in plans])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sizes[0] == sizes[1]


def test_column_stats_matches_python(spark):
    df = spark.createDataFrame([(1.0, "3"), (2.0, "x"), (2.0, None), (None, "5")], "a double, b string")
    s = {r["column"]: r for r in A.column_stats(df, ["a", "b"]).collect()}
    assert (s["a"]["n"], s["a"]["n_distinct"], s["a"]["median"], s["a"]["numeric"]) == (3, 2, 2.0, True)
    assert s["b"]["numeric"] is False and s["b"]["median"] == 4.0


def test_global_rank_is_dense_and_ordered(spark):
    rows = [(i, float((i * 7919) % 101)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = order.global_rank(df, [("v", "desc"), "id"], buckets=5).collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    by_rank = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1, 2001))
    assert [(r["id"], r["v"]) for r in by_rank] == expected


def test_exact_stratified_split_counts_with_skewed_class(spark):
    rows = [(i, "big" if i % 10 < 8 else ("mid" if i % 10 < 9 else "small")) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, cls string")
    out = prep.stratified_split(df, "id", "cls", 0.2, exact=True)
    got = {(r["cls"], r["is_test"]): r["n"] for r in out.groupBy("cls", "is_test").count()
           .withColumnRenamed("count", "n").collect()}
    assert got[("big", True)] == 800 and got[("mid", True)] == 100 and got[("small", True)] == 100
    assert out.count() == 5000


def test_hash_split_threshold_matches_fixture_rule(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    got = df.select(prep.hash_split_flag("k").alias("t"),
                    (F.substring(F.md5(F.concat(F.col("k").cast("string"), F.lit("42"))), 1, 8)
                     < "33333333").alias("ref")).collect()
    assert all(r["t"] == r["ref"] for r in got)


def test_attach_validation_keys_fanout_and_dedupe(spark):
    clin = spark.createDataFrame([("  ep1 ",), ("EP2",), (None,)], "ep string")
    val = spark.createDataFrame([("EP1", "2025-10-01", "PERTINENTE"), ("ep1", "2025-10-05", "NO PERTINENTE"),
                                 (None, "2025-10-02", "PERTINENTE")], "key string, d string, v string")
    fan = J.attach_validation(clin, val, "ep", "key", ["d", "v"])
    assert fan.count() == 4                           # T19: duplicates fan out, null keys never match
    assert fan.where(F.col("ep").isNull()).first()["v"] is None
    latest = J.attach_validation(clin, val, "ep", "key", ["d", "v"], dedupe="latest", order_col="d")
    r = {(x["ep"] or "").strip(): x["v"] for x in latest.collect()}
    assert r["ep1"] == "NO PERTINENTE" and latest.count() == 3
    only = J.attach_validation(clin, val, "ep", "key", ["d", "v"], validated_only=True, label="v")
    assert only.count() == 2


def test_median_impute_and_standardize(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "x double")
    imp = [r["x"] for r in prep.median_impute(df, ["x"]).collect()]
    assert sorted(imp) == [1.0, 3.0, 3.0, 10.0]
    z = [r["x"] for r in prep.standardize(spark.createDataFrame([(1.0,), (3.0,)], "x double"), ["x"]).collect()]
    assert z == [-1.0, 1.0]                           # population sigma = 1
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["x"] for r in prep.standardize(const, ["x"]).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_global_rank_with_payload_whatever_the_exchange_reuse(spark, reuse):
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        n = 2_000_000
        df = spark.range(n, numPartitions=16).select(
            "id", ((F.col("id") * 7919) % 1009).cast("double").alias("v"),
            F.concat(F.lit("payload "), F.col("id")).alias("payload"))
        got = order.global_rank(df, [("v", "desc"), "id"], buckets=50)
        r = got.agg(F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
                    F.count("payload").alias("p")).first()
        assert (r["d"], r["lo"], r["hi"], r["p"]) == (n, 1, n, n)
        first = got.where("rank <= 3").orderBy("rank").collect()
        assert [(x["v"], x["id"] * 7919 % 1009) for x in first] == [(1008.0, 1008)] * 3
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_global_rank_orders_strings_dates_and_nulls(spark):
    rows = [("b", 1), ("ba", 2), ("a", 3), (None, 4), ("", 5), ("é", 6)]
    df = spark.createDataFrame(rows, "s string, id int")
    up = [r["id"] for r in order.global_rank(df, ["s", "id"], buckets=3).orderBy("rank").collect()]
    down = [r["id"] for r in order.global_rank(df, [("s", "desc"), "id"], buckets=3).orderBy("rank").collect()]
    assert up == [5, 3, 1, 2, 6, 4] and down == [6, 2, 1, 3, 5, 4]


def test_exact_median_without_exchange_reuse(spark):
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(300_000, numPartitions=8).select(
            F.explode(F.create_map(F.lit("a"), F.col("id") * 1.0, F.lit("b"), F.col("id") * -3.0)).alias("k", "value"))
        med = {r["k"]: r["median"] for r in stats.exact_median(
            stats.value_counts(df, ["k"]), ["k"], cells=40).collect()}
        assert med == {"a": 149999.5, "b": -449998.5}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_weights_and_exact_split_never_shuffle_rows_by_label(spark):
    from pertinax.operators.metrics import with_class_weights
    df = spark.range(1000).select("id", (F.col("id") % 2).cast("int").alias("label"), F.lit("x").alias("payload"))
    for out in (with_class_weights(df, "label"), prep.stratified_split(df, "id", "label", exact=True)):
        plan = out._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        assert "Join" not in plan and "hashpartitioning(label" not in plan
    with pytest.raises(ValueError):
        from pertinax.operators.models import ModelSpec, classifier
        classifier(ModelSpec("deep", "forest", {"maxDepth": 31}))
