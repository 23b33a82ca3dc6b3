"""Nearest-neighbour join and imputation against all pairs, with missing values, ties and hot rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertinax.operators import nearest

COLS = ["a", "b", "c"]
SCHEMA = "row_id long, a double, b double, c double"


def some(n, seed, missing=0.25, start=0):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 12, (n, 3)).astype(float) + rng.choice([0, 0.1], (n, 3))
    return [(start + i, *[None if rng.random() < missing else float(x) for x in r]) for i, r in enumerate(v)]


def distance(x, y):
    both = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
    total = 0.0
    for a, b in both:
        total += (a - b) * (a - b)
    return total * len(x) / len(both) if both else None


def brute(left, right, k, skip=False, need=None):
    out = {}
    for i, *x in left:
        found = sorted((d, j, y) for j, *y in right if (need is None or y[need] is not None)
                       and (d := distance(x, y)) is not None and not (skip and i == j))
        out[i] = found[:k]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearest, "GROUP_BITS", 1)


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_join_is_exact(spark, small_blocks, missing):
    left, right = some(120, 1, missing), some(500, 2, missing, 1000)
    right += [(5000 + i, 3.0, 3.0, 3.0) for i in range(250)]            # a third of the rows are one point
    odd = [(7000, None, None, None), (7001, float("nan"), 2.0, None), (7002, float("inf"), None, 4.0)]
    clean = lambda rows: [(i, *[None if v is None or not np.isfinite(v) else v for v in r]) for i, *r in rows]
    df = lambda rows: spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS need", "2 AS pattern", "3 AS rank").repartition(4)
    got = {}
    for r in nearest.nearest_join(df(left + odd), df(right + odd), COLS, 4, "row_id", "row_id").collect():
        got.setdefault(r["row_id"], {})[r["rank"]] = (r["distance"] ** 2, r["row_id_near"])
    want = brute(clean(left + odd), clean(right + odd), 4)
    assert set(got) == {i for i, w in want.items() if w}
    for i, places in got.items():
        assert [places[k][1] for k in sorted(places)] == [w[1] for w in want[i]]
        assert [places[k][0] for k in sorted(places)] == pytest.approx([w[0] for w in want[i]])


def test_self_join_and_few_rows(spark, small_blocks):
    rows = some(90, 5, 0.1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest.nearest_join(df, df, COLS, 2, "row_id", "row_id", skip_same=True).orderBy("row_id", "rank").collect():
        got.setdefault(r["row_id"], []).append(r["row_id_near"])
    assert got == {i: [w[1] for w in b] for i, b in brute(rows, rows, 2, skip=True).items() if b}
    few = nearest.nearest_join(df, df.limit(1), COLS, 5, "row_id", "row_id")
    assert few.groupBy("row_id").count().where("count > 1").count() == 0
    assert nearest.nearest_join(df, df.limit(0), COLS, 5, "row_id", "row_id").count() == 0
    assert nearest.nearest_join(df.limit(0), df, COLS, 5, "row_id", "row_id").count() == 0


def test_blocks_that_cannot_matter_are_not_read(spark, small_blocks):
    right = [(i, float(i), 0.0, 0.0) for i in range(2000)]
    left = [(i, 700.0 + i * 0.3, 0.0, 0.0) for i in range(20)]
    donors = nearest.Donors(spark.createDataFrame(right, SCHEMA), COLS, "row_id")
    rows = nearest._points(spark.createDataFrame(left, SCHEMA), F.col("row_id"), COLS, F.lit(-1))
    blocks = nearest._blocks(rows, donors.ranks, "left")
    pairs = nearest._candidates(blocks, donors.blocks, 3, 2).count()
    assert 0 < pairs < 0.2 * blocks.count() * donors.blocks.count()


def test_impute(spark, small_blocks):
    rows = some(300, 9, 0.3) + [(900, None, None, None)] + [(1000 + i, 5.0, None, 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit("kept")).repartition(3)
    got = {r["row_id"]: (r["a"], r["b"], r["c"]) for r in nearest.knn_impute(df, COLS, 3).collect()}
    means = [np.mean([r[1 + i] for r in rows if r[1 + i] is not None]) for i in range(3)]
    for need in range(3):
        lack = [r for r in rows if r[1 + need] is None]
        want = brute(lack, rows, 3, need=need)
        for r in rows:
            exact = r[1 + need] if r[1 + need] is not None else (
                np.mean([w[2][need] for w in want[r[0]]]) if want[r[0]] else means[need])
            assert got[r[0]][need] == pytest.approx(exact)


def test_impute_keeps_rows_and_empty_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None, None), (1, 1.0, None, 2.0), (None, None, None, 4.0), (3, None, None, None)], SCHEMA)
    out = nearest.knn_impute(df, COLS, 2).collect()
    assert len(out) == 4 and all(r["b"] is None for r in out) and all(r["a"] == 1.0 for r in out)
    fitted = nearest.KnnImputer(COLS, 1).fit(df)
    assert fitted.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="fit"):
        nearest.KnnImputer(COLS).transform(df)


def test_equal_donors_are_packed_as_often_as_they_can_be_found(spark, small_blocks):
    """A point that most rows share costs no more than k rows; the smallest ids of it are found, null ids last."""
    rows = [(None, 5.0, 5.0, 1.0)] * 3 + [(i, 5.0, 5.0, 1.0) for i in range(400, 0, -1)]
    rows += [(2, 5.0, 5.0, 1.0), (900, 5.0, 5.0, None), (901, 5.0, None, None), (902, 6.0, 5.0, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    fitted = nearest.KnnImputer(COLS, 3).fit(df)
    assert fitted.donors.blocks.agg(F.sum("n")).first()[0] == 3 + 3         # of 404 equal rows three, and three others
    assert {r["row_id"]: r["c"] for r in fitted.transform(df.where("row_id >= 900")).collect()} == {900: 1.0, 901: 1.0, 902: 3.0}
    one = spark.createDataFrame([(7, 5.0, 5.0, 1.0)], SCHEMA)
    found = nearest.nearest_join(one, df, COLS, 5, "row_id", "row_id").orderBy("rank").collect()
    assert [r["row_id_near"] for r in found] == [1, 2, 2, 3, 4]
    with pytest.raises(ValueError, match="skip no pairs"):
        fitted.donors.search(one, F.col("row_id"), 4)
