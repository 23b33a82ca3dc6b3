"""Exact top-k inner products by dual-tree search over cover trees.

A cover tree splits the points around a centre into children of half the radius: children cover
all points, their centres are further apart than that radius, and the centre is one of them.  For
a query node (centre ``a``, radius ``R``) and a data node (centre ``b``, radius ``S``) no inner
product of their points exceeds ``<a,b> + R|b| + S|a| + RS``.  A pair of nodes below the worst
k-th score among the queries of its query node is pruned; ties are kept, as a smaller id wins.

On Spark:

1. Pivots, at most MAX_PIVOTS and drawn by hash, are the roots: every vector goes to its nearest
   one.  A pivot's vectors are dealt to blocks of about DATA_BLOCK rows by a hash of their id, so a
   vector that a third of all rows share fills many blocks.  Queries get blocks the same way.
2. Every query block meets one block of the pivot it points to most: that gives each query a first
   k-th score and each query pivot its worst one.
3. Pairs of pivots whose bound, with the covering radii over all their vectors, is below that are
   never joined.  A data block goes to one task, where its tree is built once, and the query blocks
   that it may have something for pass by it as a stream, each packed into one row; both are searched
   tree against tree, starting from the scores of step 2.  Each query's best ``k`` of all are its result.

All vectors are indexed; the bound of the sample concerns where the pivots stand, not what is found.
Scores are computed on integers, so they are exact (64 bit).

Defined results: a vector that is null, or has a null or non-finite component, takes no part, nor
does a row without id; rows that share an id are candidates each for itself, but not for a query of
that id, and as queries they have one result together (equal rows ask once); a shorter vector counts as followed by zeros; other columns are ignored whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertinax.llm.common import col
from pertinax.session import written

MAX_PIVOTS = 256
DATA_BLOCK = QUERY_BLOCK = 4096
LEAF = 64
#: Scores computed at a time.
TILE = 1 << 18


class Tree:
    """A cover tree over the rows of ``points``; nodes are numbered, the root is 0."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.norm = np.linalg.norm(points, axis=1)
        self.center: list[int] = []      # row of the centre
        self.radius: list[float] = []    # covering radius
        self.rows: list[np.ndarray] = []  # all rows below
        self.loose: list[np.ndarray] = []  # rows that are children by themselves
        self.children: list[list[int]] = []
        if len(points):
            self._build(np.arange(len(points)), 0)

    def _distance(self, row: int, rows: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.points[rows] - self.points[row], axis=1)

    def _build(self, rows: np.ndarray, center: int) -> None:
        todo = [(rows, center, None)]
        while todo:
            rows, center, parent = todo.pop()
            distance = self._distance(center, rows)
            node, radius = len(self.center), float(distance.max())
            self.center.append(center)
            self.radius.append(radius)
            self.rows.append(rows)
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if len(rows) <= LEAF or radius == 0:
                self.loose.append(rows)
                continue
            loose = []
            while len(rows):
                near = distance <= radius / 2
                if near.sum() == 1:
                    loose.append(center)
                else:
                    todo.append((rows[near], center, node))
                rows = rows[~near]
                if len(rows):
                    center = int(rows[0])
                    distance = self._distance(center, rows)
            self.loose.append(np.array(loose, np.int64))


class Best:
    """The best k scores of each query so far, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray):
        self.query_ids, self.k = query_ids, k
        self.score = np.empty(0, np.int64)
        self.row, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        #: What a score has to reach: the k-th so far.
        self.kth = floor.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (rows) with some vectors (columns)."""
        fit = (scores >= self.kth[rows, None]) & (ids[None] != self.query_ids[rows, None])
        r, c = np.nonzero(fit)
        if not len(r):
            return
        found = scores[r, c]
        found = found if found.dtype == np.int64 else np.rint(found).astype(np.int64)
        touched = np.zeros(len(self.kth), bool)
        touched[rows[r]] = True
        old = touched[self.row]
        row = np.concatenate([self.row[old], rows[r]])
        score = np.concatenate([self.score[old], found])
        id_ = np.concatenate([self.id[old], ids[c]])
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        full = row[rank == self.k - 1]
        self.kth[full] = np.maximum(self.kth[full], score[rank == self.k - 1])
        top = rank < self.k
        self.row = np.concatenate([self.row[~old], row[top]])
        self.score = np.concatenate([self.score[~old], score[top]])
        self.id = np.concatenate([self.id[~old], id_[top]])


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int,
           floor: np.ndarray | None = None, d_tree: Tree | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, score, id)`` of each query's best k; scores below its ``floor`` may miss.
    ``d_tree``: the tree of ``data``, if there is one already."""
    best = Best(query_ids, k, np.full(len(queries), -np.inf) if floor is None else floor)
    if not len(queries) or not len(data):
        return best.row, best.score, best.id
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * data.shape[1]
    exact = largest < 2 ** 53  # then sums of products are whole numbers in floating point too
    q_tree = Tree(queries.astype(np.float64))
    d_tree = Tree(data.astype(np.float64)) if d_tree is None else d_tree

    def compare(q_rows: np.ndarray, d_rows: np.ndarray) -> None:
        step = max(1, TILE // len(q_rows))
        for lo in range(0, len(d_rows), step):
            some = d_rows[lo:lo + step]
            scores = (q_tree.points[q_rows] @ d_tree.points[some].T if exact
                      else queries[q_rows].astype(np.int64) @ data[some].astype(np.int64).T)
            best.add(q_rows, scores, ids[some])

    def bound(q: int, d_rows: np.ndarray, radii: np.ndarray) -> np.ndarray:
        center, radius = q_tree.center[q], q_tree.radius[q]
        top = (d_tree.points[d_rows] @ q_tree.points[center] + radius * d_tree.norm[d_rows]
               + radii * q_tree.norm[center] + radius * radii)
        return top + 1e-9 * np.abs(top) + 1e-6  # rounding never prunes

    def singles(rows: np.ndarray, d: int) -> None:
        """Queries that are nodes by themselves (radius 0), each with its own bound."""
        stack = [(rows, d)]
        while stack:
            rows, d = stack.pop()
            nodes = np.array([d, *d_tree.children[d]], np.int64)
            centers = np.array([d_tree.center[n] for n in nodes])
            radii = np.array([d_tree.radius[n] for n in nodes])
            tops = q_tree.points[rows] @ d_tree.points[centers].T + q_tree.norm[rows][:, None] * radii
            tops += 1e-9 * np.abs(tops) + 1e-6
            alive = tops >= best.kth[rows][:, None]
            near = rows[alive[:, 0]]
            if len(near) and len(d_tree.loose[d]):
                compare(near, d_tree.loose[d])
            for k in np.argsort(tops[:, 1:].max(axis=0)) + 1:  # the most promising child comes first
                if (some := alive[:, 0] & alive[:, k]).any():
                    stack.append((rows[some], int(nodes[k])))

    todo = [(0, 0, np.inf)]
    while todo:
        q, d, top = todo.pop()
        q_rows = q_tree.rows[q]
        if top < best.kth[q_rows].min():
            continue
        if q_tree.radius[q] > 0 and (q_tree.radius[q] > d_tree.radius[d] or not d_tree.children[d]):
            for child in q_tree.children[q]:
                todo.append((child, d, float(bound(child, np.array([d_tree.center[d]]), np.array([d_tree.radius[d]]))[0])))
            if len(q_tree.loose[q]):
                singles(q_tree.loose[q], d)
            continue
        loose = d_tree.loose[d]
        if len(loose):
            near = loose[bound(q, loose, np.zeros(len(loose))) >= best.kth[q_rows].min()]
            if len(near):
                compare(q_rows, near)
        children = np.array(d_tree.children[d], np.int64)
        if len(children):
            centers = np.array([d_tree.center[c] for c in children])
            tops = bound(q, centers, np.array([d_tree.radius[c] for c in children]))
            for j in np.argsort(tops):  # the most promising child is searched first
                todo.append((q, int(children[j]), float(tops[j])))
    return best.row, best.score, best.id


# -- on Spark -----------------------------------------------------------------------------------


def integers(vector: Column) -> Column:
    """floor(256 x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vec, row`` of the rows that take part, ``row`` a number of its own; written once."""
    v = col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = rows.where(col(id_col).isNotNull() & v.isNotNull() & finite)
    return written(usable.select(col(id_col).cast("long").alias("vec_id"), integers(v).alias("vec"),
                                 F.monotonically_increasing_id().alias("row")), "vectors")


def _matrix(vecs, width: int | None = None) -> np.ndarray:
    width = max(map(len, vecs), default=0) if width is None else width
    if all(len(v) == width for v in vecs):
        return np.array([np.asarray(v, np.int64) for v in vecs], np.int64).reshape(len(vecs), width)
    out = np.zeros((len(vecs), width), np.int64)
    for k, v in enumerate(vecs):
        out[k, :len(v)] = v
    return out


def _blocks(points: DataFrame, block: int, name: str) -> tuple[DataFrame, pd.DataFrame, np.ndarray]:
    """Points with ``pivot, block``; per pivot: its size, its number of blocks and covering radius;
    the pivots."""
    n = points.count()
    pivots = (points.orderBy(F.xxhash64("vec_id", "row"), "row")
              .limit(min(MAX_PIVOTS, max(1, -(-n // block)))).collect())
    center = _matrix([r["vec"] for r in pivots]).astype(np.float64)

    def nearest(batches):
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            x = _matrix(vecs, max([center.shape[1], *map(len, vecs)])).astype(np.float64)
            c = np.pad(center, ((0, 0), (0, x.shape[1] - center.shape[1])))
            which = ((c ** 2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            distance = np.linalg.norm(x - c[which], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(which.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "vec", "row", "pivot", "distance"])

    placed = written(points.select("vec_id", "vec", "row").mapInArrow(
        nearest, "vec_id long, vec array<long>, row long, pivot int, distance double"), name)
    facts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.max("distance").alias("radius"))
    facts = facts.toPandas().sort_values("pivot").reset_index(drop=True)
    facts["blocks"] = -(-facts["size"] // block)
    spark = points.sparkSession
    dealt = spark.createDataFrame([(int(p), int(b)) for p, b in zip(facts["pivot"], facts["blocks"])],
                                  "pivot int, blocks int")
    placed = placed.join(F.broadcast(dealt), "pivot").select(
        "vec_id", "vec", "row", "pivot", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"))
    return placed, facts, center


_PACKED = "pivot int, block int, ids binary, rows binary, floors binary, vecs binary, width int"


def _packed(placed: DataFrame) -> DataFrame:
    """One row a block: ids, rows, floors and vectors as bytes; written.  A block is bounded."""

    def run(rows: pa.Table) -> pa.Table:
        vecs = rows.column("vec").to_pylist()
        x = _matrix(vecs)
        floor = np.array([-np.inf if f is None else f for f in rows.column("floor").to_pylist()], np.float64)
        return pa.table({"pivot": rows.column("pivot")[:1], "block": rows.column("block")[:1],
                         "ids": pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()),
                         "rows": pa.array([rows.column("row").to_numpy().tobytes()], pa.binary()),
                         "floors": pa.array([floor.tobytes()], pa.binary()), "vecs": pa.array([x.tobytes()], pa.binary()),
                         "width": pa.array([x.shape[1]], pa.int32())})

    if "floor" not in placed.columns:
        placed = placed.withColumn("floor", F.lit(None).cast("double"))
    rows = placed.select("pivot", "block", "vec_id", "row", "floor", "vec")
    return written(rows.groupBy("pivot", "block").applyInArrow(run, _PACKED), "packed-blocks")


class _Block:
    """A packed block, unpacked."""

    def __init__(self, ids: bytes, rows: bytes, floors: bytes, vecs: bytes, width: int):
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.floor = np.frombuffer(floors, np.float64)
        self.x = np.frombuffer(vecs, np.int64).reshape(len(self.ids), width)

    def padded(self, width: int) -> np.ndarray:
        return np.pad(self.x, ((0, 0), (0, width - self.x.shape[1]))) if width > self.x.shape[1] else self.x


def _search_pairs(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``query_row, query_id, vec_id, score`` of each query's best k in each listed pair of packed
    blocks (``q_pivot, q_block, d_pivot, d_block``)."""
    names = ["ids", "rows", "floors", "vecs", "width"]
    key = ["d_pivot", "d_block"]
    wanted = pairs.select(*key).distinct()
    hosts = data.withColumnsRenamed({"pivot": "d_pivot", "block": "d_block"}).join(wanted, key).select(
        *key, F.lit(-1).alias("q_pivot"), F.lit(-1).alias("q_block"), *names)
    guests = pairs.join(queries.withColumnsRenamed({"pivot": "q_pivot", "block": "q_block"}), ["q_pivot", "q_block"]).select(
        *key, "q_pivot", "q_block", *names)
    stream = hosts.unionByName(guests).repartition(*key).sortWithinPartitions(*key, "q_pivot", "q_block")

    def run(batches):
        host = tree = None
        for batch in batches:
            for i in range(len(batch)):
                block = _Block(*(batch.column(j)[i].as_py() for j in range(4, 9)))
                if batch.column(2)[i].as_py() < 0:
                    host, tree = block, Tree(block.x.astype(np.float64))
                    continue
                width = max(host.x.shape[1], block.x.shape[1])
                same = width == host.x.shape[1]
                row, score, ids = search(block.padded(width), block.ids, host.padded(width), host.ids, k,
                                         block.floor.copy(), tree if same else None)
                yield pa.RecordBatch.from_arrays([pa.array(block.rows[row]), pa.array(block.ids[row]), pa.array(ids), pa.array(score)],
                                                 names=["query_row", "query_id", "vec_id", "score"])

    return stream.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")


def top_k(rows: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the best k other vectors of each query.  ``query`` is a
    condition on ``vec_id``."""
    spark = rows.sparkSession
    points = vectors(rows, id_col, vector_col)
    data, facts, center = _blocks(points, DATA_BLOCK, "data-blocks")
    asked = points.where(query).groupBy("vec_id", "vec").agg(F.min("row").alias("row")).select("vec_id", "vec", "row")
    queries, q_facts, q_center = _blocks(written(asked, "queries"), QUERY_BLOCK, "query-blocks")
    shape = "q_pivot int, q_block int, d_pivot int, d_block int"
    if not len(facts) or not len(q_facts):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    width = max(center.shape[1], q_center.shape[1])
    c = np.pad(center, ((0, 0), (0, width - center.shape[1])))[facts["pivot"]]
    q = np.pad(q_center, ((0, 0), (0, width - q_center.shape[1])))[q_facts["pivot"]]
    towards = q @ c.T
    r, s = q_facts["radius"].to_numpy()[:, None], facts["radius"].to_numpy()[None]
    norm = np.linalg.norm
    bounds = towards + r * norm(c, axis=1)[None] + s * norm(q, axis=1)[:, None] + r * s
    bounds += 1e-9 * np.abs(bounds) + 1e-6

    # a first block for every query block: one of the pivot that its centre points to most
    first = {int(p): int(facts["pivot"][j]) for p, j in zip(q_facts["pivot"], towards.argmax(axis=1))}
    seeds = [(int(p), b, first[int(p)], 0) for p, n in zip(q_facts["pivot"], q_facts["blocks"]) for b in range(n)]
    packed = _packed(data)
    seeded = written(_search_pairs(_packed(queries), packed, spark.createDataFrame(seeds, shape), k), "first-scores")
    floors = (seeded.groupBy("query_row").agg(F.min("score").cast("double").alias("floor"),
                                             F.count(F.lit(1)).alias("found"))
              .select("query_row", F.when(F.col("found") == k, F.col("floor")).alias("floor")))
    queries = written(queries.join(floors, F.col("row") == F.col("query_row"), "left").drop("query_row"), "floors")
    worst = {r["pivot"]: r["worst"] for r in queries.groupBy("pivot").agg(
        F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("worst")).collect()}

    kept = [(int(p), int(d)) for i, p in enumerate(q_facts["pivot"]) for j, d in enumerate(facts["pivot"])
            if bounds[i, j] >= worst.get(int(p), -np.inf)]
    if kept:
        dealt = lambda f, name: spark.createDataFrame(
            [(int(p), int(n)) for p, n in zip(f["pivot"], f["blocks"])], f"{name}_pivot int, {name}_blocks int")
        pairs = (spark.createDataFrame(kept, "q_pivot int, d_pivot int")
                 .join(F.broadcast(dealt(q_facts, "q")), "q_pivot").join(F.broadcast(dealt(facts, "d")), "d_pivot")
                 .withColumn("q_block", F.explode(F.expr("sequence(0, q_blocks - 1)")))
                 .withColumn("d_block", F.explode(F.expr("sequence(0, d_blocks - 1)")))
                 .select("q_pivot", "q_block", "d_pivot", "d_block")
                 .join(F.broadcast(spark.createDataFrame(seeds, shape)),
                       ["q_pivot", "q_block", "d_pivot", "d_block"], "left_anti"))
        seeded = seeded.unionByName(_search_pairs(_packed(queries), packed, pairs, k))
    # first each query row's best, then those of rows that share an id
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (seeded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
