"""Exact order statistics that never pull a whole group into one task.

Spark's ``median``/``percentile``/``mode`` aggregates keep every distinct value of a group
in one hash map on one task; for a column of a 100 TB table that is unbounded.  These
helpers compute the same exact answers from distributed steps instead:

* ``value_counts``: ``(keys, value) -> c`` — one hash aggregate with map-side combine, so a
  hot value (a third of all rows) collapses to one row before the shuffle.
* ``distinct_count``: whole numbers as bits of 64-bit words, so one row stands for up to 64 values.
* ``exact_mode``: ``min(struct(-c, value))`` per key — algebraic, partial-aggregated.
* ``exact_median``: radix selection.  Every pass counts rows by cells of a key's interval, and the
  interval shrinks to the cell that holds the middle rank.  Rows are not shuffled, only counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertinax.session import written

#: Cells a key's interval is cut into in one pass of the median.
CELLS = 4096
#: An interval with at most so many rows is ranked row by row.
LOCAL_ROWS = 65_536


def value_counts(long_df: DataFrame, keys: list[str], value: str = "value",
                 out: str = "c") -> DataFrame:
    v = F.col(value)
    clean = long_df.where(v.isNotNull() & ~F.isnan(v)) if dict(long_df.dtypes)[value] in (
        "double", "float") else long_df.where(v.isNotNull())
    return clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(out))


def distinct_count(rows: DataFrame, keys: list[str], value: str = "value", out: str = "n_distinct") -> DataFrame:
    """Per key ``(n, n_distinct, min, max)`` of a numeric column, all exact, nulls and NaN left out.

    A whole number below 2^53 is one bit of the word ``floor(value / 64)``, and words are combined
    by ``bit_or`` before and after the shuffle; any other value is a word of its own.  So at most
    one row a word and task is shuffled, never more than distinct values, and the aggregate stays
    in generated code.
    """
    v = F.col(value).cast("double")
    whole = (F.abs(v) < F.lit(2.0 ** 53)) & (v == F.floor(v))
    word = F.floor(v / 64)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (v - word * 64).cast("int"))
    words = (rows.where(v.isNotNull() & ~F.isnan(v))
             .groupBy(*keys, whole.alias("__whole"), F.when(whole, word.cast("double")).otherwise(v).alias("__word"))
             .agg(F.bit_or(F.when(whole, bit).otherwise(F.lit(1).cast("long"))).alias("__bits"),
                  F.count(F.lit(1)).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max")))
    return words.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.sum(F.bit_count("__bits").cast("long")).alias(out),
        F.min("__min").alias("min"), F.max("__max").alias("max"))


def exact_mode(counts: DataFrame, keys: list[str], value: str = "value", c: str = "c",
               out: str = "mode") -> DataFrame:
    """Most frequent value per key, smallest value on ties (sklearn/Spark semantics)."""
    best = F.min(F.struct((-F.col(c)).alias("neg"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.getField("v").alias(out))


def exact_median(rows: DataFrame, keys: list[str], value: str = "value", c: str | None = "c",
                 out: str = "median", cells: int = CELLS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Exact median per key of a numeric column (mean of the two middle values when n is even).

    ``c`` is the column that says how often a row counts (``value_counts``), or None for plain rows.
    Nulls and NaN are left out; a key without a value gives no row; null keys are a key.

    A pass joins each row to the interval of its key, counts rows, least and greatest value by
    cell, and keeps the cell with the middle rank; the greatest count below it and the next value
    above it are carried along.  Cells are equal steps of the value, or of its logarithm where the
    interval spans more than a factor of four, so a few passes reach any two doubles.  The first
    pass reads ``rows``; if an interval still holds more than ``local_rows`` rows, the rows inside
    the intervals are written, equal ones as one, and read by the next.  Intervals are one row a
    key in a written table, which Spark broadcasts only if its files are small.
    """
    v = F.col("__v")
    rows = rows.select(*keys, F.col(value).cast("double").alias("__v"),
                       (F.col(c) if c else F.lit(1)).cast("long").alias("__c")).where(v.isNotNull() & ~F.isnan(v))
    finite = F.when(F.abs(v) < F.lit(float("inf")), v)
    state = written(rows.groupBy(*keys).agg(
        F.sum("__c").alias("__n"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi"),
        F.lit(0).cast("long").alias("__before"), F.lit(None).cast("double").alias("__next")), "median")
    state = written(_narrow(_with_state(rows, state, keys), keys, cells), "median")
    settled = []
    while (state.agg(F.max(F.when(F.col("__lo") < F.col("__hi"), F.col("__left")))).first()[0] or 0) > local_rows:
        settled.append(state.where("__lo = __hi"))
        state = state.where("__lo < __hi")
        rows = written(_inside(rows, state, keys).groupBy(*keys, "__v").agg(F.sum("__c").alias("__c")), "median")
        state = written(_narrow(_with_state(rows, state, keys), keys, cells), "median")
    settled.append(state.where("__lo = __hi"))
    upper = F.expr("__n div 2 + 1")
    single = [s.select(*keys, F.when(F.col("__before") + F.col("__inside") >= upper, F.col("__lo"))
                       .otherwise((F.col("__lo") + F.col("__next")) / 2.0).alias(out)) for s in settled]
    # at most local_rows rows of a key are left to rank
    kept = ["__n", "__before", "__next"]
    ranked = (_inside(rows, state.where("__lo < __hi"), keys, kept).groupBy(*keys, *kept, "__v").agg(F.sum("__c").alias("__c"))
              .withColumn("__cum", F.col("__before") + F.sum("__c").over(
                  Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))))
    low = F.min(F.when(F.col("__cum") >= F.expr("(__n + 1) div 2"), v))
    high = F.coalesce(F.min(F.when(F.col("__cum") >= upper, v)), F.max("__next"))
    return reduce(DataFrame.unionByName, single, ranked.groupBy(*keys).agg(((low + high) / 2.0).alias(out)))


def _with_state(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the interval of their key; null keys meet null keys."""
    right = state.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                         *[x for x in state.columns if x not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return rows.join(right, same).drop(*[f"__k{i}" for i in range(len(keys))])


def _inside(rows: DataFrame, state: DataFrame, keys: list[str], kept: list[str] | None = None) -> DataFrame:
    joined = _with_state(rows, state, keys).where("__v between __lo and __hi")
    return joined.select(*keys, "__v", "__c", *(kept or []))


def _narrow(joined: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """One pass: the cell of each key that holds its lower middle rank, as its new interval."""
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    wide = ((lo < 0) & (hi > 0)) | (F.greatest(F.abs(lo), F.abs(hi)) > 4 * F.least(F.abs(lo), F.abs(hi)))

    def scale(x: Column) -> Column:
        # 746: the logarithm of every double is greater than -746
        return F.when(wide, F.coalesce(F.signum(x) * (F.ln(F.abs(x)) + 746), F.lit(0.0))).otherwise(x)

    # lo falls into the first cell and hi into the last, so every pass shortens an interval
    share = F.coalesce(F.try_divide(scale(v) - scale(lo), scale(hi) - scale(lo)), F.lit(0.0))
    cell = (F.when(v == float("inf"), cells).when(v == float("-inf"), -1)
            .otherwise(F.least(F.floor(share * cells), F.lit(cells - 1))))
    by_cell = joined.groupBy(*keys, "__n", "__before", "__next", cell.alias("__cell")).agg(
        F.sum("__c").alias("__inside"), F.count(F.lit(1)).alias("__left"),
        F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    w = Window.partitionBy(*keys).orderBy("__cell")   # at most cells + 2 rows a key
    end = F.col("__before") + F.sum("__inside").over(w.rowsBetween(Window.unboundedPreceding, 0))
    middle = F.expr("(__n + 1) div 2")
    return (by_cell.withColumns({"__end": end, "__after": F.lead("__least").over(w)})
            .where((F.col("__end") >= middle) & (F.col("__end") - F.col("__inside") < middle))
            .select(*keys, "__n", (F.col("__end") - F.col("__inside")).alias("__before"),
                    F.coalesce("__after", "__next").alias("__next"), "__inside", "__left",
                    F.col("__least").alias("__lo"), F.col("__most").alias("__hi")))


def to_long(df: DataFrame, cols: list[str], name: str = "column", value: str = "value",
            cast: str | None = "double", keep: list[str] | None = None) -> DataFrame:
    """Columns-as-rows: ``(keep..., column, value)`` via ``inline`` (one pass, no union)."""
    def v(c):
        return F.col(c).cast(cast) if cast else F.col(c)
    rows = F.array(*[F.struct(F.lit(c).alias(name), v(c).alias(value)) for c in cols])
    return df.select(*(keep or []), F.inline(rows))
