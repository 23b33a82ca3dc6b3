"""Sort, rank, top-k (O1–O3).

``global_rank`` numbers rows 1..n in a total order without a single-partition window.  The rows are
range-partitioned by the order, sorted and numbered inside their partition and written once, each
with its partition and its place; a table with one row per partition then shifts them.  Partition
and place are data of the written row, so the counts and the rows agree however often, and in
whatever shape, Spark evaluates the rest, and planning does not depend on the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertinax.session import written

#: ``monotonically_increasing_id`` holds the partition above this bit and the place below it.
PLACE_BITS = 33


def global_rank(df: DataFrame, order: list[str | tuple[str, str]], out: str = "rank",
                buckets: int | None = None) -> DataFrame:
    """Row numbers 1..n in a total order: column names or ``(name, "desc")``, nulls last.  Include
    a unique tie-breaker: it tells equal keys apart and lets them spread over partitions.

    The rows are written once under the shared folder when the plan is built."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [(c, "asc") if isinstance(c, str) else c for c in order]
    by = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in names]
    placed = written(df.repartitionByRange(n, *by).sortWithinPartitions(*by)
                     .withColumn("__id", F.monotonically_increasing_id()), "global-rank")
    placed = placed.withColumn("__bucket", F.shiftright("__id", PLACE_BITS))
    sizes = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    w = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__size").over(w), F.lit(0)).alias("__offset"))
    place = F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    # one row per partition: a proven size bound, so broadcast it
    return (placed.join(F.broadcast(offsets), "__bucket")
            .withColumn(out, (F.col("__offset") + place).cast("long"))
            .drop("__id", "__bucket", "__offset"))


def leaderboard(results: DataFrame, metric: str, name: str, descending: bool = True,
                gap_of: tuple[str, str] | None = None) -> DataFrame:
    """O1: sort by metric (desc), rank 1..n (ties by name), optional gap = a − b.

    ``results`` is a summary with one row per model or source, so its rows are numbered in one
    task; a table of unknown size takes :func:`global_rank`."""
    first = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    out = results.withColumn("rank", F.row_number().over(Window.orderBy(first, name)).cast("long"))
    if gap_of:
        out = out.withColumn("gap", F.col(gap_of[0]) - F.col(gap_of[1]))
    return out


def top_k(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """O2: best row / top k (a per-partition top-k then one small merge)."""
    return df.orderBy(*order).limit(k)


def preview(df: DataFrame, n: int = 10, order_by: str = "row_id") -> DataFrame:
    """O3: first ``n`` rows in row-id order."""
    return df.orderBy(F.col(order_by).asc_nulls_last()).limit(n)
