"""Aggregations and profiling counts.

Wide-then-reshape: counts over many columns are computed as ONE aggregate row (one scan,
partial aggregation) and reshaped into report rows with ``inline``; value-level statistics
go through the skew-safe helpers in :mod:`pertinax.operators.stats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertinax.functions.clean import comma_to_dot, month_period, to_number
from pertinax.operators import stats

MISSING_COLUMN = "COLUMNA NO EXISTE"


def class_distribution(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """A1: counts per value (NULL excluded), most frequent first, ties by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
            .orderBy(F.desc(out), F.asc(col)))


def class_share(df: DataFrame, col: str) -> DataFrame:
    """A2: counts and % of all rows of the set (NULLs count in the denominator).

    The total is a scalar subquery (computed once, inlined as a literal) — no cross join.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", F.col("n") * 100.0 / total))


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """A3: ``(column, present, non_null, total, pct)``; absent columns are reported."""
    present = [c for c in cols if c in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("__total"),
                 *[F.count(F.col(c)).alias(f"__nn{i}") for i, c in enumerate(present)])
    rows = []
    for c in cols:
        if c in present:
            nn = F.col(f"__nn{present.index(c)}")
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(True).alias("present"),
                                 nn.alias("non_null"), F.col("__total").alias("total"),
                                 F.try_divide(nn * 100.0, F.col("__total")).alias("pct")))
        else:
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(False).alias("present"),
                                 F.lit(None).cast("long").alias("non_null"),
                                 F.col("__total").alias("total"),
                                 F.lit(None).cast("double").alias("pct")))
    return agg.select(F.inline(F.array(*rows)))


def missingness(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """A4: % NULL per mapped column ``(variable, column, status, pct_null)``; an absent
    source column reports ``COLUMNA NO EXISTE``."""
    comp = completeness(df, list(dict.fromkeys(mapping.values())))
    m = df.sparkSession.createDataFrame(list(mapping.items()), "variable string, column string")
    return (m.join(comp, "column", "left")  # both sides have one row per mapped column
            .select("variable", "column",
                    F.when(F.col("present"), F.lit("ok")).otherwise(F.lit(MISSING_COLUMN)).alias("status"),
                    (100.0 - F.col("pct")).alias("pct_null")))


def completeness_by_class(df: DataFrame, cls: str, value, cols: list[str],
                          max_missing: float = 50.0) -> DataFrame:
    """A5: within one class, the columns with less than ``max_missing`` % missing."""
    comp = completeness(df.where(F.col(cls) == F.lit(value)), cols)
    return comp.where(F.col("present") & ((100.0 - F.col("pct")) < max_missing))


def binary_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, each distinct value (NULL included) and its count."""
    long = stats.to_long(df, cols, cast="string")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def class_means(df: DataFrame, cls: str, pos, neg, cols: list[str],
                coerce: bool = True) -> DataFrame:
    """Mean and n per class for each column (comma -> dot coercion first); only the
    columns where both classes have at least one value."""
    out = []
    aggs = []
    for i, c in enumerate(cols):
        x = comma_to_dot(c) if coerce else F.col(c).cast("double")
        for tag, v in (("pos", pos), ("neg", neg)):
            sel = F.when(F.col(cls) == F.lit(v), x)
            aggs += [F.avg(sel).alias(f"m_{tag}{i}"), F.count(sel).alias(f"n_{tag}{i}")]
        out.append(F.struct(F.lit(c).alias("column"), F.col(f"m_pos{i}").alias("mean_pos"),
                            F.col(f"n_pos{i}").alias("n_pos"), F.col(f"m_neg{i}").alias("mean_neg"),
                            F.col(f"n_neg{i}").alias("n_neg")))
    return (df.agg(*aggs).select(F.inline(F.array(*out)))
            .where((F.col("n_pos") > 0) & (F.col("n_neg") > 0)))


def group_mean_diff(df: DataFrame, group_a: Column, group_b: Column, cols: list[str],
                    coerce: bool = True) -> DataFrame:
    """``(column, mean_a, mean_b, diff)`` with diff = mean_a − mean_b, only when both
    means exist."""
    aggs, rows = [], []
    for i, c in enumerate(cols):
        x = comma_to_dot(c) if coerce else F.col(c).cast("double")
        aggs += [F.avg(F.when(group_a, x)).alias(f"a{i}"), F.avg(F.when(group_b, x)).alias(f"b{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("mean_a"),
                             F.col(f"b{i}").alias("mean_b"),
                             (F.col(f"a{i}") - F.col(f"b{i}")).alias("diff")))
    return (df.agg(*aggs).select(F.inline(F.array(*rows)))
            .where(F.col("mean_a").isNotNull() & F.col("mean_b").isNotNull()))


def binary_share_by_group(df: DataFrame, group_a: Column, group_b: Column, cols: list[str],
                          yes: str = "Sí") -> DataFrame:
    """% of rows equal to ``yes`` in group a and in group b (0 for an empty group)."""
    aggs = [F.count_if(group_a).alias("na"), F.count_if(group_b).alias("nb")]
    rows = []
    for i, c in enumerate(cols):
        hit = F.coalesce(F.col(c) == F.lit(yes), F.lit(False))
        aggs += [F.count_if(group_a & hit).alias(f"a{i}"), F.count_if(group_b & hit).alias(f"b{i}")]
        rows.append(F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.try_divide(F.col(f"a{i}") * 100.0, F.col("na")), F.lit(0.0)).alias("pct_a"),
            F.coalesce(F.try_divide(F.col(f"b{i}") * 100.0, F.col("nb")), F.lit(0.0)).alias("pct_b")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def monthly_counts(df: DataFrame, ts: str, out: str = "month") -> DataFrame:
    """A10: rows per calendar month, ascending (unparsable dates excluded)."""
    return (df.where(F.col(ts).isNotNull()).groupBy(month_period(ts).alias(out))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(out))


def validator_counts(df: DataFrame, cols: list[str], pos: str = "PERTINENTE",
                     neg: str = "NO PERTINENTE") -> DataFrame:
    """Per label column ``(column, n, n_pos, n_neg, is_best)``; best = max n
    (first column on ties)."""
    aggs, rows = [], []
    for i, c in enumerate(cols):
        x = F.upper(F.trim(F.col(c)))
        aggs += [F.count(F.col(c)).alias(f"n{i}"), F.count_if(x == pos).alias(f"p{i}"),
                 F.count_if(x == neg).alias(f"q{i}")]
    best = F.greatest(*[F.col(f"n{i}") for i in range(len(cols))]) if len(cols) > 1 else F.col("n0")
    first_best = None
    for i in reversed(range(len(cols))):
        first_best = F.when(F.col(f"n{i}") == best, F.lit(i)) if first_best is None else \
            F.when(F.col(f"n{i}") == best, F.lit(i)).otherwise(first_best)
    for i, c in enumerate(cols):
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"),
                             F.col(f"p{i}").alias("n_pos"), F.col(f"q{i}").alias("n_neg"),
                             (first_best == i).alias("is_best")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column ``(column, n, n_distinct, min, max, median, numeric)``.

    Numbers are parsed with C1 (so string columns work too); ``numeric`` says whether every
    non-null value parsed.  The median is exact and skew-safe (see ``stats``).
    """
    parsed = df.select(*[(F.col(c).cast("double") if dict(df.dtypes)[c] != "string"
                          else to_number(c)).alias(c) for c in cols],
                       *[F.col(c).isNotNull().alias(f"__raw{i}") for i, c in enumerate(cols)])
    numeric = parsed.agg(*[F.count_if(F.col(f"__raw{i}") & F.col(c).isNull()).alias(f"bad{i}")
                           for i, c in enumerate(cols)])
    numeric = numeric.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(f"bad{i}") == 0).alias("numeric"))
        for i, c in enumerate(cols)])))
    long = stats.to_long(parsed, cols)
    base = stats.distinct_count(long, ["column"])
    med = stats.exact_median(long, ["column"], c=None)
    # all three inputs have one row per column: the joins are over a handful of rows
    return numeric.join(base, "column", "left").join(med, "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "min", "max", "median", "numeric")
