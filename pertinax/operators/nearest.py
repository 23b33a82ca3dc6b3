"""Nearest-neighbour join and imputation (J7, M3): exact, with missing values.

The distance of two rows is ``sqrt(p / n * sum of squared differences)`` over the ``n`` of ``p`` columns
that both have; without a common column there is none.  It is no metric, as each pair of rows may
compare other columns.  But rows with equal presence *patterns* compare equal columns, and there
ordinary box bounds hold.

1. Rows of a side are sorted by (pattern, Morton code of their quantile ranks) and packed into blocks of at
   most ``BLOCK_ROWS`` rows of one pattern, with the box they lie in.  Equal rows fill as many blocks as
   they need, so a hot value is spread.  Blocks are the fitted state; they stay in a written table.
2. Patterns that share a column are found by an equi-join on that column.  From these pairs the search goes down
   two trees at once, partitions, groups of blocks, blocks: the farthest corners of a node with ``k`` rows
   bound how far the kth neighbour can be, and pairs whose nearest corners are farther are dropped.
   Only boxes take part, by equi-joins on the parents' numbers.
3. The blocks that are left for a left block pass by it in order of their bounds, as a stream, while each
   left row keeps its best ``k``; a block beyond the worst of these is skipped.

Right rows with equal values are equally far from any row, and ties go to the smaller id: of a point that very many
rows share, only the ``k`` smallest ids can be found, so no more of them are packed.  Which these are is decided
over all rows, by a window whose limit works on the map side.

So no pair of rows is formed outside a pair of blocks that may matter, and no task holds more than one left
and one right block.  Ties go to the smaller id.  Numbers that are not finite count as missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertinax.session import written

BLOCK_ROWS = 512
#: Bits of a block's number that count the blocks of a partition, and those of a group of blocks.
PART_BITS, GROUP_BITS = 32, 4
NO_ID = 2 ** 63 - 1
_SLACK = 1 - 1e-9


def _finite(c: Column) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _points(df: DataFrame, row: Column, columns: list[str], need: Column) -> DataFrame:
    """``id, need, pattern, v`` of every row: values with nulls, and the bit set of those present."""
    v = F.array(*[_finite(F.col(f"`{c}`")) for c in columns])
    df = df.select(row.cast("long").alias("id"), need.cast("int").alias("need"), v.alias("v"))
    pattern = sum((F.when(F.get("v", F.lit(i)).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(columns))),
                  F.lit(0))
    return df.select("id", "need", pattern.cast("long").alias("pattern"), "v")


def _ranks(points: DataFrame, p: int) -> list[list[float]]:
    """Quantiles of each column, for the Morton code: one aggregate of bounded sketches."""
    steps = 1 << max(1, min(4, 60 // p))
    share = [k / steps for k in range(1, steps)]
    row = points.agg(*[F.percentile_approx(F.get("v", F.lit(i)), share, 1000).alias(f"q{i}") for i in range(p)]).first()
    return [list(q) if q else [0.0] * (steps - 1) for q in row]


def _code(ranks: list[list[float]]) -> tuple[Column, Column]:
    """The ranks of a row's values, and the code made of them: their bits in turn, highest first."""
    bits, p = (len(ranks[0]) + 1).bit_length() - 1, len(ranks)
    place = [F.coalesce(sum((F.when(F.get("v", F.lit(i)) > q, 1).otherwise(0) for q in qs), F.lit(0)), F.lit(0)).cast("long")
             for i, qs in enumerate(ranks)]
    code = F.lit(0).cast("long")
    for b in range(bits):
        for i in range(p):
            code = code + F.shiftleft(F.shiftright(F.get("r", F.lit(i)), b).bitwiseAND(F.lit(1).cast("long")), b * p + i)
    return F.array(*place), code


_BLOCKS = ("block long, need int, pattern long, n int, ids binary, v binary, lo array<double>, hi array<double>")


def _blocks(points: DataFrame, ranks: list[list[float]], name: str) -> DataFrame:
    """Packed blocks of neighbouring rows of one (need, pattern); written."""
    p, limit = len(ranks), BLOCK_ROWS
    place, code = _code(ranks)
    key = ["need", "pattern", "code", "id"]
    dealt = points.withColumn("r", place).withColumn("code", code).drop("r").repartitionByRange(*key).sortWithinPartitions(*key)

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, key = TaskContext.get().partitionId(), 0, [], None

        def flush():
            nonlocal seq, held
            ids, v = (np.concatenate(c) for c in zip(*held))
            box = lambda f: [[float(x) if key[1] >> i & 1 else None for i, x in enumerate(f(v, axis=0))]]
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << PART_BITS) + seq], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()),
                 pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()),
                 pa.array(box(np.min), pa.list_(pa.float64())), pa.array(box(np.max), pa.list_(pa.float64()))],
                names=["block", "need", "pattern", "n", "ids", "v", "lo", "hi"])
            seq, held = seq + 1, []
            return out

        for batch in batches:
            ids, need, pattern = (batch.column(i).to_numpy() for i in range(3))
            v = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), p)
            cuts = np.flatnonzero((np.diff(need) != 0) | (np.diff(pattern) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(ids)]):
                if start == end:
                    continue
                mine = (int(need[start]), int(pattern[start]))
                if held and mine != key:
                    yield flush()
                key = mine
                while start < end:
                    take = min(end - start, limit - sum(len(i) for i, _ in held))
                    held.append((ids[start:start + take], v[start:start + take]))
                    start += take
                    if sum(len(i) for i, _ in held) >= limit:
                        yield flush()
        if held:
            yield flush()

    return written(dealt.select("id", "need", "pattern", "v").mapInArrow(run, _BLOCKS), name)


def _nodes(blocks: DataFrame, p: int, bits: int, side: str) -> DataFrame:
    """Boxes of all nodes of a level: blocks that agree but for the last ``bits`` of their number."""
    lows = [F.min(F.get("lo", F.lit(i))).alias(f"lo{i}") for i in range(p)]
    highs = [F.max(F.get("hi", F.lit(i))).alias(f"hi{i}") for i in range(p)]
    out = blocks.groupBy("need", "pattern", F.shiftright("block", bits).alias("node")).agg(
        F.sum("n").alias("n"), *lows, *highs)
    return out.select(F.col("need").alias(f"{side}need"), F.col("pattern").alias(f"{side}pattern"), F.col("node").alias(f"{side}node"),
                      F.col("n").alias(f"{side}n"), F.array(*[f"lo{i}" for i in range(p)]).alias(f"{side}lo"),
                      F.array(*[f"hi{i}" for i in range(p)]).alias(f"{side}hi"))


def _bound(p: int, far: bool) -> Column:
    """Least (or greatest) squared distance of rows in the two boxes; null without a common column."""
    total, common = F.lit(0.0), F.lit(0)
    for i in range(p):
        a, b, c, d = (F.get(x, F.lit(i)) for x in ("llo", "lhi", "rlo", "rhi"))
        gap = F.greatest(b - c, d - a) if far else F.greatest(c - b, a - d, F.lit(0.0))
        both = a.isNotNull() & c.isNotNull()
        total = total + F.when(both, gap * gap).otherwise(0.0)
        common = common + F.when(both, 1).otherwise(0)
    return F.when(common > 0, total * p / common)


def _pattern_pairs(left: DataFrame, right: DataFrame, p: int) -> DataFrame:
    """Patterns with a common column, and the needed one present on the right: at most 4^p small rows."""
    bits = F.explode(F.array(*[F.lit(i) for i in range(p)]))
    has = lambda c: F.call_function("shiftright", c, F.col("bit")).bitwiseAND(F.lit(1).cast("long")) == 1
    ls = left.select("need", "pattern").distinct().select("need", "pattern", bits.alias("bit")).where(has(F.col("pattern")))
    rs = right.select("pattern").distinct().select(F.col("pattern").alias("rpattern"), bits.alias("bit")).where(has(F.col("rpattern")))
    pairs = ls.join(rs, "bit").select(F.col("need").alias("lneed"), F.col("pattern").alias("lpattern"), "rpattern").distinct()
    needed = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest("lneed", F.lit(0)))
    return pairs.where((F.col("lneed") < 0) | (F.col("rpattern").bitwiseAND(needed) != 0))


def _candidates(left: DataFrame, right: DataFrame, p: int, k: int) -> DataFrame:
    """``lnode, rnode, near``: pairs of blocks that may hold one of the k nearest."""
    pairs = None
    for bits in (PART_BITS, GROUP_BITS, 0):
        ls, rs = _nodes(left, p, bits, "l"), _nodes(right, p, bits, "r").drop("rneed")
        if pairs is None:
            both = ls.join(_pattern_pairs(left, right, p), ["lneed", "lpattern"]).join(rs, "rpattern").withColumn(
                "radius", F.lit(None).cast("double"))
        else:
            step = above - bits
            ls = ls.withColumn("lup", F.shiftright("lnode", step))
            rs = rs.withColumn("rup", F.shiftright("rnode", step))
            both = pairs.join(ls, ["lneed", "lpattern", "lup"]).join(rs, ["rpattern", "rup"])
        measured = both.select("lneed", "lpattern", "lnode", "rpattern", "rnode", "rn", "radius",
                               _bound(p, False).alias("near"), _bound(p, True).alias("far")).where("near IS NOT NULL")
        measured = written(measured, "nearest-pairs")
        reach = measured.groupBy("lneed", "lpattern", "lnode").agg(
            F.least(F.min("radius"), F.min(F.when(F.col("rn") >= k, F.col("far")))).alias("reach"))
        kept = measured.join(reach, ["lneed", "lpattern", "lnode"]).where(
            F.col("reach").isNull() | (F.col("near") * _SLACK <= F.col("reach")))
        if bits == 0:
            return kept.select("lnode", "rnode", "near")
        pairs = kept.select("lneed", "lpattern", F.col("lnode").alias("lup"), "rpattern", F.col("rnode").alias("rup"),
                            F.col("reach").alias("radius"))
        above = bits


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two blocks of one pattern each."""
    p = a.shape[1]
    total, common = np.zeros((len(a), len(b))), 0
    for i in range(p):
        if np.isnan(a[0, i]) or np.isnan(b[0, i]):
            continue
        d = a[:, i, None] - b[None, :, i]
        total += d * d
        common += 1
    return total * p / common


class _Best:
    """The k nearest of each row of a left block so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, need: int, k: int):
        self.ids, self.v, self.need, self.k = ids, v, need, k
        self.row = self.other = np.zeros(0, np.int64)
        self.d = self.value = np.zeros(0)
        self.kth = np.full(len(ids), np.inf)

    def add(self, ids: np.ndarray, v: np.ndarray, skip_same: bool) -> None:
        d = _distances(self.v, v)
        close = d <= self.kth[:, None]
        if skip_same:
            close &= self.ids[:, None] != ids[None, :]
        row, at = np.nonzero(close)
        value = v[at, self.need] if self.need >= 0 else np.zeros(len(at))
        row, d, other, value = (np.concatenate(c) for c in zip(
            (self.row, self.d, self.other, self.value), (row, d[row, at], ids[at], value)))
        order = np.lexsort((other, d, row))
        row, d, other, value = row[order], d[order], other[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.d, self.other, self.value = row[keep], d[keep], other[keep], value[keep]
        full = place[keep] == self.k - 1
        self.kth[self.row[full]] = self.d[full]

    def result(self) -> pa.RecordBatch:
        place = np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.row]), pa.array(np.full(len(place), self.need), pa.int32()), pa.array(place, pa.int32()),
             pa.array(self.other), pa.array(np.sqrt(self.d)), pa.array(self.value)],
            names=["id", "need", "rank", "other", "distance", "value"])


_FOUND = "id long, need int, rank int, other long, distance double, value double"


def _search(left: DataFrame, right: DataFrame, pairs: DataFrame, p: int, k: int, skip_same: bool) -> DataFrame:
    """``id, need, rank, other, distance, value`` (the needed column's) of every left row's k nearest."""
    mine = left.select(F.col("block").alias("lnode"), F.lit(-1.0).alias("near"), F.lit(-1).cast("long").alias("rnode"), "need", "ids", "v")
    theirs = pairs.join(right.select(F.col("block").alias("rnode"), "ids", "v"), "rnode").select(
        "lnode", "near", "rnode", F.lit(-1).alias("need"), "ids", "v")
    stream = mine.unionByName(theirs).repartition("lnode").sortWithinPartitions("lnode", "near", "rnode")

    def run(batches):
        now = None
        for batch in batches:
            node, near, other, need = (batch.column(i).to_numpy() for i in range(4))
            for i in range(len(node)):
                ids = np.frombuffer(batch.column(4)[i].as_py(), np.int64)
                if other[i] < 0:
                    if now is not None and len(now.row):
                        yield now.result()
                    now = _Best(ids, np.frombuffer(batch.column(5)[i].as_py()).reshape(-1, p), int(need[i]), k)
                elif near[i] * _SLACK <= now.kth.max():
                    now.add(ids, np.frombuffer(batch.column(5)[i].as_py()).reshape(-1, p), skip_same)
        if now is not None and len(now.row):
            yield now.result()

    return stream.mapInArrow(run, _FOUND)


class Donors:
    """The right side of the join, packed: fitted state, in a written table.

    ``most``: the greatest ``k`` of a search that skips no pairs; of equal rows, so many are packed."""

    def __init__(self, df: DataFrame, columns: list[str], id_col: str, most: int | None = None):
        self.columns = list(columns)
        points = _points(df, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), self.columns, F.lit(-1))
        points, self.most = points.where("pattern <> 0"), most
        if most is not None:
            place = F.row_number().over(Window.partitionBy("pattern", "v").orderBy("id"))
            points = points.withColumn("place", place).where(F.col("place") <= most).drop("place")
        points = written(points, "nearest-rows")
        self.ranks = _ranks(points, len(self.columns))
        self.blocks = _blocks(points, self.ranks, "nearest-right")

    def search(self, rows: DataFrame, row: Column, k: int, need: Column | None = None, skip_same: bool = False) -> DataFrame:
        """The k nearest donors of every row; ``need``: the number of a column that a donor must have."""
        if self.most is not None and (skip_same or k > self.most):
            raise ValueError(f"these donors were packed for searches of up to {self.most} that skip no pairs")
        p = len(self.columns)
        points = _points(rows, row, self.columns, need if need is not None else F.lit(-1)).where("pattern <> 0")
        left = _blocks(points, self.ranks, "nearest-left")
        pairs = _candidates(left, self.blocks, p, k + 1 if skip_same else k)
        return _search(left, self.blocks, pairs, p, k, skip_same)


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], k: int, left_id: str, right_id: str,
                 skip_same: bool = False) -> DataFrame:
    """``left_id, rank, right_id, distance`` of the k nearest right rows of every left row.

    Ids are whole numbers; ties go to the smaller right id.  A left row without a value, or without a
    right row that shares one, has no rows.  ``skip_same`` leaves out pairs with equal ids (a table
    joined to itself); rows without an id come last among ties."""
    found = Donors(right, on, right_id, None if skip_same else k).search(left.where(F.col(f"`{left_id}`").isNotNull()), F.col(f"`{left_id}`"), k,
                                               skip_same=skip_same)
    other = F.when(F.col("other") != NO_ID, F.col("other"))
    return found.select(F.col("id").alias(left_id), "rank", other.alias(right_id if right_id != left_id else f"{right_id}_near"),
                        "distance")


class KnnImputer:
    """M3: a missing number takes the mean of the ``k`` nearest rows that have it; without any
    distance, the column's mean.  A column that has no value at all stays as it is."""

    def __init__(self, columns: list[str], k: int = 5, id_col: str = "row_id"):
        self.columns, self.k, self.id_col = list(columns), k, id_col
        self.donors: Donors | None = None

    def fit(self, df: DataFrame) -> "KnnImputer":
        self.donors = Donors(df, self.columns, self.id_col, self.k)
        means = df.agg(*[F.avg(_finite(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(self.columns)]).first()
        self.means = list(means)              # one number a column
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.donors is None:
            raise ValueError("fit the imputer first")
        own, filled = "__row", "__filled"
        numbered = written(df.withColumn(own, F.monotonically_increasing_id()), "impute-rows")
        gaps = F.filter(F.array(*[F.when(_finite(F.col(f"`{c}`")).isNull(), i) for i, c in enumerate(self.columns)]),
                        lambda x: x.isNotNull())
        lacking = numbered.select(own, *[F.col(f"`{c}`") for c in self.columns], F.explode(gaps).alias("__need"))
        found = self.donors.search(lacking, F.col(own), self.k, F.col("__need"))
        mean = found.groupBy("id", "need").agg(F.avg("value").alias("value"))
        per_row = mean.groupBy(F.col("id").alias("__id")).agg(
            F.map_from_entries(F.collect_list(F.struct("need", "value"))).alias(filled))    # one entry a column
        out = numbered.join(per_row, F.col(own) == F.col("__id"), "left")
        value = {c: F.coalesce(_finite(F.col(f"`{c}`")), F.try_element_at(filled, F.lit(i)), F.lit(m).cast("double"))
                 for i, (c, m) in enumerate(zip(self.columns, self.means))}
        return out.withColumns(value).select(*[F.col(f"`{c}`") for c in df.columns])


def knn_impute(df: DataFrame, columns: list[str], k: int = 5, id_col: str = "row_id",
               fit_on: DataFrame | None = None) -> DataFrame:
    """M3 in one go: fit on ``fit_on`` (or ``df`` itself), fill ``df``."""
    return KnnImputer(columns, k, id_col).fit(fit_on if fit_on is not None else df).transform(df)
