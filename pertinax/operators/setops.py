"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def combine(*frames: DataFrame) -> DataFrame:
    """Row concatenation by column name; missing columns -> NULL; duplicates kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _names(spark: SparkSession, cols: list[str], side: str) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(cols)],
                                 f"column string, {side}_pos int")


def _non_null(df: DataFrame, side: str) -> DataFrame:
    """``(column, non_null_<side>)`` for every column of ``df`` — one aggregate pass."""
    from pertinax.operators.aggregate import completeness
    return completeness(df, df.columns).select("column", F.col("non_null").alias(f"non_null_{side}"))


def schema_overlap(a: DataFrame, b: DataFrame, with_counts: bool = True) -> DataFrame:
    """Column names as rows, full-outer joined: ``(column, in_a, in_b, status)`` plus,
    with ``with_counts``, the non-null count of the column in each table (one aggregate pass
    per table; the joins are over one row per column name).

    status is ``common``, ``missing`` (in a, the reference, not in b) or ``extra``.
    """
    spark = a.sparkSession
    j = _names(spark, a.columns, "a").join(_names(spark, b.columns, "b"), "column", "full")
    out = j.select("column", F.col("a_pos").isNotNull().alias("in_a"),
                   F.col("b_pos").isNotNull().alias("in_b"),
                   F.when(F.col("a_pos").isNotNull() & F.col("b_pos").isNotNull(), F.lit("common"))
                   .when(F.col("a_pos").isNotNull(), F.lit("missing"))
                   .otherwise(F.lit("extra")).alias("status"))
    if with_counts:
        out = out.join(_non_null(a, "a"), "column", "left").join(_non_null(b, "b"), "column", "left")
    return out


def schema_identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(identical, sym_diff, rows_a, rows_b)`` — set equality of the column names,
    else the size of the symmetric difference, with the row count of each table."""
    o = schema_overlap(a, b, with_counts=False)
    agg = o.agg(F.count_if(F.col("status") != "common").alias("sym_diff"))
    return agg.select((F.col("sym_diff") == 0).alias("identical"), "sym_diff",
                      a.select(F.count(F.lit(1))).scalar().alias("rows_a"),
                      b.select(F.count(F.lit(1))).scalar().alias("rows_b"))


def unique(df: DataFrame, col: str) -> DataFrame:
    """U4: distinct non-null values."""
    return df.where(F.col(col).isNotNull()).select(col).distinct()
