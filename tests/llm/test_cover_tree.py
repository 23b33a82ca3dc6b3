"""Exact top-k against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertinax.llm import cover_tree


def brute(queries, query_ids, data, ids, k):
    out = []
    for q, qid in zip(queries, query_ids):
        scores = [(-int(np.dot(q.astype(object), d.astype(object))), int(i)) for d, i in zip(data, ids) if i != qid]
        out.append([(i, -s) for s, i in sorted(scores)[:k]])
    return out


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "zeros", "huge"])
def test_search_is_exact(kind):
    rng = np.random.default_rng(3)
    data = {"spread": rng.integers(-200, 200, (900, 16)), "ties": rng.integers(-1, 2, (900, 4)),
            "clusters": (rng.integers(-300, 300, (12, 16))[rng.integers(0, 12, 900)] + rng.integers(-4, 5, (900, 16))),
            "zeros": np.zeros((300, 3), int), "huge": rng.integers(-2 ** 29, 2 ** 29, (300, 6))}[kind].astype(np.int64)
    ids = rng.permutation(len(data))
    rows = rng.choice(len(data), 40, replace=False)
    row, score, found = cover_tree.search(data[rows], ids[rows], data, ids, 5)
    got = [[] for _ in rows]
    for r, s, i in sorted(zip(row.tolist(), (-score).tolist(), found.tolist())):
        got[r].append((i, -s))
    assert got == brute(data[rows], ids[rows], data, ids, 5)


def test_tree_covers_and_separates():
    points = np.random.default_rng(1).normal(size=(500, 3))
    tree = cover_tree.Tree(points)
    for node, rows in enumerate(tree.rows):
        center = points[tree.center[node]]
        assert np.linalg.norm(points[rows] - center, axis=1).max() <= tree.radius[node] + 1e-9
        below = np.concatenate([tree.loose[node], *(tree.rows[c] for c in tree.children[node])]) \
            if tree.children[node] else tree.loose[node]
        assert sorted(below) == sorted(rows)                  # nothing is lost on the way down
        if tree.children[node]:
            centers = points[[tree.center[c] for c in tree.children[node]] + list(tree.loose[node])]
            gaps = np.linalg.norm(centers[:, None] - centers[None], axis=2) + np.eye(len(centers)) * 1e9
            assert gaps.min() > tree.radius[node] / 2
            assert tree.center[node] in {*[tree.center[c] for c in tree.children[node]], *tree.loose[node]}


def test_clustered_data_is_pruned():
    rng = np.random.default_rng(2)
    data = (rng.integers(-3000, 3000, (30, 8))[rng.integers(0, 30, 4000)] + rng.integers(-3, 4, (4000, 8)))
    seen = []
    add = cover_tree.Best.add
    cover_tree.Best.add = lambda self, rows, scores, ids: (seen.append(scores.size), add(self, rows, scores, ids))[1]
    try:
        cover_tree.search(data[:10], np.arange(10), data, np.arange(4000), 3)
    finally:
        cover_tree.Best.add = add
    assert sum(seen) < 0.7 * 10 * 4000


def test_top_k_on_spark(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 64)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(5)
    vec = rng.normal(0, 0.3, (700, 8)).round(3)
    vec[100:350] = vec[100]                                  # a third of all rows is one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vec)]
    odd = [(1000, None), (1050, [0.1, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8),
           (None, [9.0] * 8), (650, rows[650][1]), (1200, [0.5, 0.25]), (1250, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 AS rank", "2 AS pivot", "3 AS block", "4 AS floor").repartition(6)
    got = cover_tree.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect()
    data = [(i, v) for i, v in rows] + [(1200, [0.5, 0.25] + [0.0] * 6), (1250, [0.0] * 8)]
    ids = np.array([i for i, _ in data])
    ints = np.floor(256 * np.array([v for _, v in data])).astype(np.int64)
    mine = [k for k, i in enumerate(ids) if i % 50 == 0]
    want = brute(ints[mine], ids[mine], ints, ids, 5)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert {q: [v[k] for k in sorted(v)] for q, v in by.items()} == {int(ids[m]): w for m, w in zip(mine, want)}
    assert all(sorted(v) == list(range(1, 6)) for v in by.values())


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 7, -65536)]
    assert cover_tree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert cover_tree.top_k(df.where("vec_id = 7"), F.col("vec_id") % 50 == 0).count() == 0


def test_rows_that_share_an_id(spark, monkeypatch):
    """All rows of a repeated id take part, as the SQL of the query says; a hot id fills many blocks."""
    import duckdb

    from pertinax.llm.catalog import OP5_SQL

    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 32)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(9)
    rows = [(0, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [9.0, 0.0]), (8, [3.0, 0.0]), (7, [9.0, 0.0]), (50, [0.5, -1.0]), (50, [-0.5, 1.0])]
    rows += [(100 + int(i % 60), [float(x) for x in rng.normal(0, 1, 2).round(2)]) for i in range(200)]
    rows += [(33, [float(x) for x in rng.normal(0, 1, 2).round(2)]) for _ in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") % 50 == 0, k=5).select(
        "query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    embeddings = df.toPandas()  # noqa: F841
    assert got == sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({OP5_SQL})").fetchall())
    assert [(r[2], r[3]) for r in got if r[0] == 0][:2] == [(7, 589824), (7, 589824)]
