"""Tree ensembles trained and scored as Spark jobs.

* **One binned table.**  Every row becomes one byte per feature (quantile bounds from one aggregate of
  bounded sketches), written once and read by all trees, folds and configurations.
* **Many models in one job.**  A member (configuration or fold) is one more key: the trees of all forests
  are dealt to groups together, boosted members advance round by round together.  A fold is left out
  by drawing none of its rows.
* **Trees in groups.**  A group holds so many trees that at most ``GROUP_ROWS`` drawn rows travel; its
  nodes are written before the next begins.  Task closures and histograms stay bounded whatever the
  number of trees.
* **Upper levels by histograms, subtrees in one task.**  While a node has more than ``LOCAL_ROWS`` drawn
  rows, tasks add up (tree, node, feature, bin) histograms, Spark sums them by tree and node, and the best split of each
  node comes back to the driver (at most ``JOB_NODES`` at a time).  Rows of a smaller node are sent to one task, packed, which grows all that is
  below it.  So no task holds more than ``LOCAL_ROWS`` rows of a tree.  A table that is within that bound
  as a whole goes to each task once; the task grows its share of the trees, or all rounds of a boosted member.
  It holds the bins as one member sees them at a time.
* **A model is a node table.**  ``(tree, node, feature, bound, value)``, in Parquet by group.  Scoring reads
  it group by group into broadcasts; nothing grows with the model in a closure.

A missing value takes its feature's median bin among the member's own training rows, so a fold's
preparation never sees the fold.  Draws depend on the row's key, the tree and the seed alone:
reruns, retries and other partitions give the same trees.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pertinax.operators import trees as T
from pertinax.operators.trees import MAX_BINS, MISSING, TreeSpec
from pertinax.session import scratch_dir, written

#: Rows of one tree that a single task may hold: at 35 columns 63 bytes each as they arrive and some 200 while trees
#: grow, so up to 1 GB of its Python worker.
LOCAL_ROWS = 9 << 19
#: Rows from which on a table goes to two tasks a core, not four.
MANY_ROWS = 1 << 20
#: Drawn rows that the trees of one group send in all.
GROUP_ROWS = 48_000_000
#: Nodes whose histograms one job adds up (up to 25 kB each in a task).
JOB_NODES = 1_024
#: Groups of a model that are packed for scoring at a time.
READERS = 4
#: Rounds of boosting between two rewritings of the margins.
REWRITE = 20

NODE_SCHEMA = "tree int, node long, feature int, bin int, bound double, value double, n long"
_NODE_NAMES = ["tree", "node", "feature", "bin", "bound", "value", "n"]
_NODE_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]


@dataclass(frozen=True)
class Member:
    """One model of a job; ``without`` names the fold that it must not see."""
    name: str
    spec: TreeSpec
    weighted: bool = False
    without: int | None = None


@dataclass
class Features:
    """Columns of the feature vector: numbers, 0/1 columns, and one 0/1 column per category."""
    numeric: list[str]
    binary: list[str] = field(default_factory=list)
    categories: dict[str, list[str]] = field(default_factory=dict)

    def vector(self) -> Column:
        number = lambda c: F.col(f"`{c}`").cast("double")
        plain = [number(c) for c in [*self.numeric, *self.binary]]
        hot = [(F.col(f"`{c}`") == v).cast("double") for c, values in self.categories.items() for v in values]
        return F.array(*plain, *[F.coalesce(h, F.lit(0.0)) for h in hot])

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.binary) + sum(map(len, self.categories.values()))


def categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The values of each categorical column, sorted: a vocabulary, one slot a value."""
    return {c: sorted(r[0] for r in df.select(c).distinct().collect() if r[0] is not None) for c in columns}


# ------------------------------------------------------------------ the binned table

def bounds(vectors: DataFrame, p: int, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature the values that bins end at: quantiles, each once."""
    share = [k / bins for k in range(1, bins)]
    value = lambda i: F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i)))
    row = vectors.agg(*[F.percentile_approx(value(i), share, 10_000).alias(f"q{i}") for i in range(p)]).first()
    return [np.unique(np.array(row[i] or [], np.float64)) for i in range(p)]


def to_bins(x: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, e in enumerate(ends):
        out[:, i] = np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(e, x[:, i], "left"))
    return out


def _matrix(lists: pa.Array, p: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), p)


TABLE = "row long, y double, w double, fold int, x binary, margin binary"
_TABLE = pa.schema([("row", pa.int64()), ("y", pa.float64()), ("w", pa.float64()), ("fold", pa.int32()),
                    ("x", pa.binary()), ("margin", pa.binary())])


def binned(df: DataFrame, features: Features, key: Column, label: str = "label", weight: str | None = None,
           fold: str | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """The binned table and the bounds of its bins."""
    p = features.width
    rows = df.where(F.col(label).isNotNull()).select(
        key.cast("long").alias("row"), F.col(label).cast("double").alias("y"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"), features.vector().alias("x"))
    rows = written(rows, "vectors")
    ends = bounds(rows, p)

    def run(batches):
        for batch in batches:
            x = to_bins(_matrix(batch.column(4), p), ends)
            flat = [x[i].tobytes() for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(flat, pa.binary()),
                                              pa.array([b""] * len(flat), pa.binary())], schema=_TABLE)

    return written(rows.mapInArrow(run, TABLE), "binned"), ends


def bin_counts(table: DataFrame, p: int) -> dict[int, np.ndarray]:
    """Per fold: rows by feature and bin (a row of 256 counts a feature)."""
    def run(batches):
        seen: dict = {}
        for batch in batches:
            x, folds = _bytes(batch.column(4), p), batch.column(3).to_numpy()
            for f in np.unique(folds):
                h = seen.setdefault(int(f), np.zeros((p, 256), np.int64))
                for i in range(p):
                    h[i] += np.bincount(x[folds == f, i], minlength=256)
        for f, h in seen.items():
            i, b = np.nonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f), pa.int32()), pa.array(i, pa.int32()),
                                              pa.array(b, pa.int32()), pa.array(h[i, b], pa.int64())],
                                             names=["fold", "feature", "bin", "n"])

    out: dict = {}
    cells = table.mapInArrow(run, "fold int, feature int, bin int, n long").groupBy("fold", "feature", "bin").agg(F.sum("n").alias("n"))
    for f, i, b, n in cells.collect():       # folds x features x bins
        out.setdefault(f, np.zeros((p, 256), np.int64))[i, b] = n
    return out


def medians(counts: dict[int, np.ndarray], without: int | None) -> np.ndarray:
    """The median bin of each feature over all folds but one."""
    have = sum((h for f, h in counts.items() if f != without), np.zeros_like(next(iter(counts.values()))))[:, :MISSING]
    below = np.cumsum(have, axis=1)
    return (below * 2 >= below[:, -1:]).argmax(axis=1).astype(np.uint8)


def _bytes(column: pa.Array, p: int) -> np.ndarray:
    """The rows of a column of ``p`` bytes each, without a copy of every value."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in filter(len, chunks):
        starts = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)
        parts.append(np.frombuffer(c.buffers()[2], np.uint8)[starts[c.offset]:][:len(c) * p])
    return np.concatenate(parts).reshape(-1, p) if parts else np.zeros((0, p), np.uint8)


# ------------------------------------------------------------------ growing

class Work:
    """What a task needs to know of the trees that grow now."""

    def __init__(self, members: list[Member], fills: list[np.ndarray], ends: list[np.ndarray], base: list[float]):
        self.members, self.fills, self.ends, self.base = members, fills, ends, base
        self.p = len(ends)
        self.trees: list[tuple[int, int, int]] = []           # (id, member, number in the member)
        self.upper: dict[int, tuple[np.ndarray, ...]] = {}    # id -> split nodes, features, bins
        self.done: dict[int, np.ndarray] = {}                 # id -> leaves among the upper nodes
        self.recent: dict[int, T.Packed | None] = {}          # member -> trees newer than the stored margins

    def drawn(self, batch: pa.RecordBatch):
        """Per tree: its id, member and, of the rows drawn for it, number, bins and both sums."""
        row, y, w, fold = (batch.column(i).to_numpy() for i in range(4))
        x = _bytes(batch.column(4), self.p)
        filled, margin = {}, {}
        for tree, m, number in self.trees:
            member = self.members[m]
            if m not in filled:
                filled[m] = np.where(x == MISSING, self.fills[m], x)
                if member.spec.kind == "boost":
                    margin[m] = self.margins(batch, m, filled[m])
            d = T.draws(row, member.spec, number)
            if member.without is not None:
                d = d * (fold != member.without)
            take = np.flatnonzero(d)
            d, weight = d[take], (w[take] if member.weighted else 1.0)
            if member.spec.kind == "forest":
                a, b = d * weight * (y[take] == 0), d * weight * (y[take] == 1)
            else:
                q = T.sigmoid(margin[m][take])
                a, b = d * weight * (q - y[take]), d * weight * q * (1 - q)
            yield tree, member.spec, number, row[take], filled[m][take], a, b

    def margins(self, batch: pa.RecordBatch, m: int, x: np.ndarray) -> np.ndarray:
        stored = batch.column(5).to_pylist()
        width = len(self.members) * 8
        out = (np.frombuffer(b"".join(stored), np.float64).reshape(-1, len(self.members))[:, m].copy()
               if stored and len(stored[0]) == width else np.full(len(x), self.base[m]))
        recent = self.recent.get(m)
        return out + recent.sums(x) if recent is not None else out

    def node_batch(self, tree: int, grown: T.Nodes) -> pa.RecordBatch:
        start = np.cumsum([0, *map(len, self.ends)])[:-1]
        inner, bound = grown.feature >= 0, np.zeros(len(grown.node))
        if inner.any():
            bound[inner] = np.concatenate(self.ends)[start[grown.feature[inner]] + grown.bin[inner]]
        columns = [np.full(len(bound), tree), grown.node, grown.feature, grown.bin, bound, grown.value, grown.n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_TYPES)], names=_NODE_NAMES)


def _histograms(table: DataFrame, work, active: dict[int, np.ndarray]) -> list:
    """The best split of every active node, from histograms added up over all tasks."""
    def run(batches):
        w, sums = work.value, {}
        w.trees = [t for t in w.trees if t[0] in active]
        for batch in batches:
            for tree, spec, number, _, x, a, b in w.drawn(batch):
                nodes = active[tree]
                at = T.route(x, *w.upper[tree])
                k = np.searchsorted(nodes, at)
                k[k == len(nodes)] = 0
                mine = np.flatnonzero(nodes[k] == at)
                k, xs = k[mine], x[mine]
                if tree not in sums:
                    chosen = T.columns(spec, number, nodes, w.p)
                    sums[tree] = chosen, np.zeros((3, len(nodes), chosen.shape[1], MAX_BINS))
                chosen, h = sums[tree]
                for j in range(chosen.shape[1]):
                    cell = k * MAX_BINS + xs[np.arange(len(k)), chosen[k, j]]
                    for s, v in enumerate((a[mine], b[mine], None)):
                        h[s, :, j] += np.bincount(cell, v, len(nodes) * MAX_BINS).reshape(-1, MAX_BINS)
        for tree, (chosen, h) in sums.items():
            node, j, bin_ = np.nonzero(h[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(node), tree), pa.int32()), pa.array(active[tree][node], pa.int64()),
                 pa.array(chosen[node, j], pa.int32()), pa.array(bin_, pa.int32()),
                 *[pa.array(h[s, node, j, bin_], pa.float64()) for s in range(3)]],
                names=["tree", "node", "feature", "bin", "a", "b", "n"])

    def decide(cells: pa.Table) -> pa.Table:
        w = work.value
        tree, node = cells.column("tree")[0].as_py(), cells.column("node")[0].as_py()
        spec = next(w.members[m].spec for t, m, _ in w.trees if t == tree)
        feature, bin_, a, b, n = (cells.column(c).to_numpy() for c in ("feature", "bin", "a", "b", "n"))
        fs, k = np.unique(feature, return_inverse=True)
        h = np.zeros((3, len(fs), MAX_BINS))
        for s, v in enumerate((a, b, n)):
            np.add.at(h[s], (k, bin_), v)
        total = h[:, 0].sum(axis=1)
        cut, score = T.best_bins(*h, spec)
        best = int(np.argmax(score))
        depth = int(node).bit_length() - 1
        ok = (T.worth(score[best], total[0], total[1], spec) > -np.inf
              and not T.final(total[0], total[1], total[2], depth, spec))
        left = float(h[2, best, :cut[best] + 1].sum())
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()),
                         "feature": pa.array([int(fs[best]) if ok else -1], pa.int32()),
                         "bin": pa.array([int(cut[best]) if ok else 0], pa.int32()),
                         "value": pa.array([float(T.leaf_value(total[0], total[1], spec))], pa.float64()),
                         "n": pa.array([int(total[2])], pa.int64()), "left": pa.array([left], pa.float64())})

    cells = table.mapInArrow(run, "tree int, node long, feature int, bin int, a double, b double, n double")
    summed = cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "abn"])
    return summed.groupBy("tree", "node").applyInArrow(
        decide, "tree int, node long, feature int, bin int, value double, n long, left double").collect()


def _upper(table: DataFrame, work: Work) -> list[tuple]:
    """Split every node that has more than LOCAL_ROWS drawn rows; returns those nodes' rows."""
    spark, out = table.sparkSession, []
    none = np.zeros(0, np.int64)
    work.upper = {t: (none, none, none) for t, _, _ in work.trees}
    work.done = {t: none for t, _, _ in work.trees}
    active = {t: np.array([1], np.int64) for t, _, _ in work.trees}
    while active:
        found, following = [], {}
        todo = [(t, n) for t, nodes in active.items() for n in nodes.tolist()]
        for k in range(0, len(todo), JOB_NODES):
            some: dict = {}
            for t, n in todo[k:k + JOB_NODES]:
                some.setdefault(t, []).append(n)
            sent = spark.sparkContext.broadcast(work)
            found += _histograms(table, sent, {t: np.array(sorted(v), np.int64) for t, v in some.items()})
            sent.unpersist()
        for tree, node, feature, cut, value, n, left in found:
            bound = float(work.ends[feature][cut]) if feature >= 0 else 0.0
            out.append((tree, node, feature, cut, bound, value, n))
            if feature < 0:
                work.done[tree] = np.sort(np.append(work.done[tree], node))
                continue
            splits = [np.append(old, new) for old, new in zip(work.upper[tree], (node, feature, cut))]
            order = np.argsort(splits[0])
            work.upper[tree] = tuple(s[order] for s in splits)
            following.setdefault(tree, []).extend(
                c for c, size in ((2 * node, left), (2 * node + 1, n - left)) if size > LOCAL_ROWS)
        active = {t: np.array(sorted(v), np.int64) for t, v in following.items() if v}
    return out


_BLOCK = "tree int, root long, first long, x binary, a binary, b binary"


def _blocks(table: DataFrame, work) -> DataFrame:
    """The drawn rows below the upper nodes, packed by tree, root and batch."""
    def run(batches):
        w = work.value
        for batch in batches:
            rows = []
            for tree, _, _, row, x, a, b in w.drawn(batch):
                if not len(x):
                    continue
                if tree not in w.upper or not len(w.upper[tree][0]):
                    if 1 not in w.done.get(tree, ()):
                        rows.append((tree, 1, int(row.min()), x.tobytes(), a.tobytes(), b.tobytes()))
                    continue
                at = T.route(x, *w.upper[tree])
                for root in np.unique(at):
                    if tree in w.done and root in w.done[tree]:
                        continue
                    k = at == root
                    rows.append((tree, int(root), int(row[k].min()), x[k].tobytes(), a[k].tobytes(), b[k].tobytes()))
            for s in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s:s + 64]), [
                    pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])],
                    names=["tree", "root", "first", "x", "a", "b"])

    return table.mapInArrow(run, _BLOCK)


def _unpack(blocks: pa.Table, p: int):
    order = np.argsort(blocks.column("first").to_numpy(), kind="stable")
    part = lambda c, kind: np.frombuffer(b"".join(
        blocks.column(c).take(pa.array(order)).to_pylist()), kind)
    return part("x", np.uint8).reshape(-1, p), part("a", np.float64), part("b", np.float64)


def _parts(spark: SparkSession, keys: int) -> int:
    return max(1, min(keys, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))


def _subtrees(table: DataFrame, work: Work, parts: int) -> DataFrame:
    """All nodes below the upper ones: one task a (tree, root)."""
    sent = table.sparkSession.sparkContext.broadcast(work)

    def run(blocks: pa.Table) -> pa.Table:
        w = sent.value
        tree, root = blocks.column("tree")[0].as_py(), blocks.column("root")[0].as_py()
        m, number = next((m, k) for t, m, k in w.trees if t == tree)
        grown = T.grow(*_unpack(blocks, w.p), w.members[m].spec, number, root)
        return pa.Table.from_batches([w.node_batch(tree, grown)])

    return _blocks(table, sent).repartition(parts, "tree", "root").groupBy("tree", "root").applyInArrow(run, NODE_SCHEMA)


def _grow_forests(table: DataFrame, work: Work, trees: list[tuple[int, int, int]], n: int, path: str) -> None:
    """Group by group, each written before the next."""
    spark = table.sparkSession
    size = max(1, min(1024, GROUP_ROWS // max(n, 1)))
    for g in range(0, len(trees), size):
        work.trees = trees[g:g + size]
        work.upper, work.done = {}, {}
        top = _upper(table, work)
        roots = max(len(work.trees), 2 * n // LOCAL_ROWS * len(work.trees))
        nodes = _subtrees(table, work, _parts(spark, roots))
        if top:
            nodes = nodes.unionByName(spark.createDataFrame(top, NODE_SCHEMA))
        nodes.write.parquet(f"{path}/group={g}")


def _grow_whole(table: DataFrame, work: Work, trees: list[tuple[int, int, int]], ids: dict[int, int], n: int, path: str) -> None:
    """Where one task may hold the table: it goes to each task once, packed, and a task draws and grows its
    trees from it, or all rounds of one boosted member."""
    spark = table.sparkSession
    tasks = min(len(trees), (4 if n < MANY_ROWS else 2) * spark.sparkContext.defaultParallelism)
    boosted = sorted(ids, key=lambda m: -work.members[m].spec.trees)           # the long ones start first
    deals: list = [[(m, ids[m])] for m in boosted] + [trees[k::tasks] for k in range(tasks)]
    sent = spark.sparkContext.broadcast((work, deals, len(boosted)))
    size = max(1, GROUP_ROWS // max(n, 1))

    def pack(batches):
        for batch in batches:
            if len(batch):
                row, y, w = (batch.column(i).to_numpy() for i in range(3))
                fold = batch.column(3).fill_null(-1).to_numpy()
                values = [int(row.min()), row, y, w, fold, _bytes(batch.column(4), sent.value[0].p)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v if i == 0 else np.ascontiguousarray(v).tobytes()], t.type) for i, (v, t) in enumerate(zip(values, _PACKED))],
                    schema=_PACKED)

    def run(batches):
        w, deals, of_boosted = sent.value
        parts: dict = {}
        for batch in batches:
            for g, part in zip(batch.column(0).to_pylist(), zip(*(batch.column(i + 1).to_pylist() for i in range(6)))):
                parts.setdefault(g, []).append(part)
        for g in sorted(parts):
            rows = Rows(w, parts.pop(g))
            for grown in (rows.rounds(*deals[g][0]) if g < of_boosted else map(rows.tree, deals[g])):
                yield grown

    blocks = table.mapInArrow(pack, "first long, row binary, y binary, w binary, fold binary, x binary")
    dealt = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(len(deals) - 1))).alias("deal"), "*").repartitionById(len(deals), F.col("deal"))
    nodes = dealt.mapInArrow(run, NODE_SCHEMA)
    nodes.withColumn("group", F.floor(F.col("tree") / size)).write.partitionBy("group").parquet(path)


_PACKED = pa.schema([("first", pa.int64()), *[(c, pa.binary()) for c in ("row", "y", "w", "fold", "x")]])


class Rows:
    """The rows of a table that one task holds, in order of their keys."""

    def __init__(self, work: Work, parts: list[tuple]):
        self.work = work
        held = list(zip(*sorted(parts, key=lambda p: p[0])))[1:]
        parts.clear()
        row = np.frombuffer(b"".join(held[0]), np.int64)
        order = np.argsort(row, kind="stable")
        self.row, held[0] = row[order], None
        # column by column; what came is let go as it is put in order
        take = lambda i, kind, *width: np.frombuffer(b"".join(held[i]), kind).reshape(-1, *width)[order]
        self.x, held[4] = take(4, np.uint8, work.p), None
        self.y, held[1] = take(1, np.float64), None
        self.w, held[2] = take(2, np.float64), None
        self.fold, held[3] = take(3, np.int32), None
        self.filled, self.bits = {}, {}

    def fill(self, m: int) -> np.ndarray:
        """The bins as a member sees them; those of one member at a time."""
        fills = self.work.fills
        key = fills[m].tobytes()
        if key not in self.filled:
            self.filled, self.bits = {}, {}
            if all(f.tobytes() == key for f in fills):
                for s in range(0, len(self.x), 65_536):
                    part = self.x[s:s + 65_536]
                    np.copyto(part, fills[m], where=part == MISSING)
                self.filled[key] = self.x
            else:
                self.filled[key] = np.where(self.x == MISSING, fills[m], self.x)
        return self.filled[key]

    def tree(self, of: tuple[int, int, int]) -> pa.RecordBatch:
        """One tree of a forest."""
        tree, m, number = of
        member = self.work.members[m]
        d = T.draws(self.row, member.spec, number)
        if member.without is not None:
            d = d * (self.fold != member.without)
        take = np.flatnonzero(d)
        d = d[take] * (self.w[take] if member.weighted else 1.0)
        y = self.y[take]
        x = self.fill(m)
        key = self.work.fills[m].tobytes()
        if key not in self.bits:
            self.bits[key] = T.Bits(x)
        return self.work.node_batch(tree, T.grow(x, d * (y == 0), d * (y == 1), member.spec, number, rows=take, bits=self.bits[key]))

    def rounds(self, m: int, first: int):
        """All rounds of a boosted member."""
        w, member = self.work, self.work.members[m]
        spec, weight = member.spec, self.w if member.weighted else np.ones(len(self.y))
        seen = weight > 0
        if member.without is not None:
            seen = seen & (self.fold != member.without)
        row, y, weight, x = self.row[seen], self.y[seen], weight[seen], self.fill(m)[seen]
        table, margin = T.Columns(x), np.full(len(y), w.base[m])
        for k in range(spec.trees):
            d = T.draws(row, spec, k)
            take, rest = np.flatnonzero(d), np.flatnonzero(d == 0)
            q = T.sigmoid(margin[take])
            grown, value = T.grow_boosted(table, take, weight[take] * (q - y[take]), weight[take] * q * (1 - q), spec, k)
            margin[take] += value
            if len(rest):
                margin[rest] += T.Packed(np.zeros(len(grown.node), int), grown.node, grown.feature, grown.bin, grown.value).sums(x[rest])
            yield w.node_batch(first + k, grown)


def _grow_boosted(table: DataFrame, work: Work, ids: dict[int, int], n: int, path: str) -> None:
    """All boosted members, a round at a time; the margins are stored every REWRITE rounds."""
    spark = table.sparkSession
    recent: dict[int, list] = {m: [] for m in ids}
    held: list = []
    last = max(work.members[m].spec.trees for m in ids)
    for k in range(last):
        work.trees = [(ids[m] + k, m, k) for m in ids if k < work.members[m].spec.trees]
        work.upper, work.done = {}, {}
        top = _upper(table, work)
        rows = [tuple(r) for r in _subtrees(table, work, _parts(spark, 2 * n // LOCAL_ROWS * len(work.trees))).collect()] + top
        held += rows
        for tree, m, _ in work.trees:
            recent[m] += [r for r in rows if r[0] == tree]
            if recent[m]:
                t, node, feature, cut, _, value, _ = (np.array(c) for c in zip(*recent[m]))
                work.recent[m] = T.Packed(t, node, feature, cut, value)
        if (k + 1) % REWRITE == 0 or k + 1 == last:
            spark.createDataFrame(held, NODE_SCHEMA).write.parquet(f"{path}/group=b{k}")
            held = []
            if k + 1 < last:
                table = _with_margins(table, work)
                work.recent, recent = {}, {m: [] for m in ids}


def _with_margins(table: DataFrame, work: Work) -> DataFrame:
    sent = table.sparkSession.sparkContext.broadcast(work)

    def run(batches):
        w = sent.value
        for batch in batches:
            x = _bytes(batch.column(4), w.p)
            all_ = np.stack([w.margins(batch, m, np.where(x == MISSING, w.fills[m], x)) if w.members[m].spec.kind == "boost"
                             else np.zeros(len(x)) for m in range(len(w.members))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([r.tobytes() for r in all_], pa.binary())],
                                             schema=_TABLE)

    return written(table.mapInArrow(run, TABLE), "margins")


def fit(train: DataFrame, features: Features, members: list[Member], key: Column, label: str = "label",
        weight: str | None = None, fold: str | None = None) -> dict[str, "Ensemble"]:
    """Train all members on one binned table; returns the models by name."""
    spark = train.sparkSession
    if not members:
        return {}
    if any(not 0 < m.spec.depth <= T.MAX_DEPTH for m in members):
        raise ValueError(f"trees have 1 to {T.MAX_DEPTH} levels")
    if any(m.weighted for m in members) and not weight:
        raise ValueError("a weighted member needs a weight column")
    table, ends = binned(train, features, key, label, weight, fold)
    counts = bin_counts(table, features.width)
    if not counts:
        raise ValueError("no labelled rows to train on")
    n = int(sum(h[0].sum() for h in counts.values()))
    fills = [medians(counts, m.without) for m in members]
    work = Work(members, fills, ends, _base(table, members))
    path = scratch_dir(spark, f"ensemble-{uuid.uuid4().hex}")
    first, forests, boosted = 0, [], {}
    out = {}
    for m, member in enumerate(members):
        count = member.spec.trees
        if member.spec.kind == "forest":
            forests += [(first + k, m, k) for k in range(count)]
        else:
            boosted[m] = first
        values = [float(e[b]) if b < len(e) else (float("inf") if len(e) else 0.0) for e, b in zip(ends, fills[m])]
        out[member.name] = Ensemble(path, member.spec, features, values, work.base[m], first, count)
        first += count
    if n <= LOCAL_ROWS:
        _grow_whole(table, work, forests, boosted, n, path)
        return out
    if forests:
        _grow_forests(table, work, forests, n, path)
    if boosted:
        _grow_boosted(table, work, boosted, n, path)
    return out


def _base(table: DataFrame, members: list[Member]) -> list[float]:
    """Log odds of class 1 among each member's training rows."""
    sums = []
    for m in members:
        w = F.col("w") if m.weighted else F.lit(1.0)
        if m.without is not None:
            w = F.when(F.col("fold") != m.without, w).otherwise(0.0)
        sums += [F.sum(w * F.col("y")), F.sum(w)]
    row = table.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    out = []
    for i in range(len(members)):
        one, all_ = row[2 * i] or 0.0, row[2 * i + 1] or 0.0
        share = min(max(one / all_ if all_ else 0.5, 1e-6), 1 - 1e-6)
        out.append(float(np.log(share / (1 - share))))
    return out


# ------------------------------------------------------------------ scoring

class Ensemble:
    """A trained model: a node table and what is needed to read it."""

    def __init__(self, path: str, spec: TreeSpec, features: Features, fill: list[float], base: float,
                 first: int, count: int, prefix: str = ""):
        self.path, self.spec, self.features, self.fill, self.base = path, spec, features, fill, base
        self.first, self.count, self.prefix = first, count, prefix
        self._sent: list | None = None

    def nodes(self, spark: SparkSession) -> DataFrame:
        table = spark.read.option("basePath", self.path).parquet(f"{self.path}/group=*")
        return table.where(F.col("tree").between(self.first, self.first + self.count - 1))

    def sent(self, spark: SparkSession) -> list:
        """The node table as broadcasts, read group by group, a few groups at a time."""
        if self._sent is None:
            nodes = self.nodes(spark).withColumn("group", F.col("group").cast("string"))
            groups = sorted(r[0] for r in nodes.select("group").distinct().collect())

            def pack(g: str):
                part = nodes.where(F.col("group") == g).select("tree", "node", "feature", "bound", "value").toArrow()
                return spark.sparkContext.broadcast(T.Packed(*(part.column(i).to_numpy() for i in range(5))))

            with ThreadPoolExecutor(READERS) as pool:
                self._sent = list(pool.map(pack, groups))
        return self._sent

    def score(self, spark: SparkSession, x: Column) -> Column:
        """P(class 1) from the feature vector."""
        return _scorer([self], spark)(x, F.lit(0))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (vector) and ``prediction``; a tie is class 0."""
        from pyspark.ml.functions import array_to_vector

        p = f"__{self.prefix}p"
        out = df.withColumn(p, self.score(df.sparkSession, self.features.vector()))
        return out.withColumns({f"{self.prefix}probability": array_to_vector(F.array(1 - F.col(p), F.col(p))),
                                f"{self.prefix}prediction": F.when(F.col(p) > 0.5, 1.0).otherwise(0.0)}).drop(p)

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and description under ``path``; the description is written last."""
        self.nodes(spark).write.partitionBy("group").parquet(f"{path}/nodes")
        about = dict(spec=asdict(self.spec), features=asdict(self.features), fill=self.fill, base=self.base,
                     first=self.first, count=self.count, prefix=self.prefix)
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/ensemble")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Ensemble":
        a = json.loads(spark.read.text(f"{path}/ensemble").first()["value"])
        return Ensemble(f"{path}/nodes", TreeSpec(**a["spec"]), Features(**a["features"]), a["fill"], a["base"],
                        a["first"], a["count"], a["prefix"])


def _scorer(models: list[Ensemble], spark: SparkSession):
    """A function of the feature vector and the number of the model to ask: P(class 1)."""
    from pyspark.sql.functions import arrow_udf

    facts = [(m.sent(spark), np.array(m.fill, np.float64), m.spec.kind, m.base, m.count) for m in models]
    p = models[0].features.width

    @arrow_udf("double")
    def score(x: pa.Array, which: pa.Array) -> pa.Array:
        rows, ask = _matrix(x, p), which.to_numpy(zero_copy_only=False)
        out = np.zeros(len(rows))
        for m in np.unique(ask):
            groups, fill, kind, base, count = facts[int(m)]
            mine = ask == m
            values = np.where(np.isnan(rows[mine]), fill, rows[mine])
            total = sum((g.value.sums(values) for g in groups), np.zeros(len(values)))
            out[mine] = total / max(count, 1) if kind == "forest" else T.sigmoid(base + total)
        return pa.array(out, pa.float64())

    return score


def score_each(df: DataFrame, models: list[Ensemble], which: Column, out: str = "p_pert") -> DataFrame:
    """Every row scored by the one model that ``which`` numbers (its own fold's, say)."""
    return df.withColumn(out, _scorer(models, df.sparkSession)(models[0].features.vector(), which.cast("int")))
