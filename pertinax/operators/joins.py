"""Joins (J1–J6).

Physical strategy is left to Spark: with AQE on, a validation side that turns out small at
runtime is broadcast, a large one is sort-merge joined, and skewed key partitions are split
(``spark.sql.adaptive.skewJoin``).  No side is broadcast on a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions.clean import join_key

KEY = "__join_key"


def latest_per_key(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """One row per key: the row with the greatest ``order_col`` (ties: greatest row).

    ``max_by`` is a partial aggregate, so a hot key collapses on each executor before the
    shuffle instead of sorting all its rows in one task as a window would.
    """
    cols = [c for c in df.columns]
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.withColumn(KEY, key).groupBy(KEY)
            .agg(F.max_by(packed, F.struct(F.col(order_col), packed)).alias("__r"))
            .select(KEY, *[F.col("__r")[c].alias(c) for c in cols]))


def attach_validation(clin: DataFrame, val: DataFrame, clin_key: str, val_key: str,
                      val_cols: list[str], dedupe: str | None = None,
                      order_col: str | None = None, validated_only: bool = False,
                      label: str | None = None) -> DataFrame:
    """Left equi-join on ``upper(trim(str(key)))``; every clinical row is kept.

    Duplicate keys on the validation side fan out (original behaviour) unless
    ``dedupe='latest'`` keeps the newest validation per key.  NULL keys never match.
    ``validated_only`` then keeps rows whose ``label`` is not NULL.
    """
    right = val.select(join_key(val_key).alias(KEY), *val_cols)
    if dedupe == "latest":
        right = latest_per_key(val.select(val_key, *val_cols), join_key(val_key), order_col)
        right = right.select(KEY, *val_cols)
    elif dedupe is not None:
        raise ValueError(f"unknown dedupe {dedupe!r}")
    out = clin.withColumn(KEY, join_key(clin_key)).join(right, on=KEY, how="left").drop(KEY)
    if validated_only:
        out = out.where(F.col(label).isNotNull())
    return out


def training_set(clin: DataFrame, val: DataFrame, clin_key: str, val_key: str,
                 val_cols: list[str]) -> DataFrame:
    """Inner equi-join on the normalised key; duplicates fan out."""
    right = val.select(join_key(val_key).alias(KEY), *val_cols)
    return clin.withColumn(KEY, join_key(clin_key)).join(right, on=KEY, how="inner").drop(KEY)


def join_rate(df: DataFrame, label: str) -> DataFrame:
    """``(total, with_label, without_label, pct_with)`` in one aggregate."""
    agg = df.agg(F.count(F.lit(1)).alias("total"), F.count(F.col(label)).alias("with_label"))
    return agg.select("total", "with_label",
                      (F.col("total") - F.col("with_label")).alias("without_label"),
                      F.coalesce(F.try_divide(F.col("with_label") * 100.0, F.col("total")),
                                 F.lit(0.0)).alias("pct_with"))


def attach_scores(all_rows: DataFrame, scored: DataFrame, cols: list[str],
                  row_id: str = schema.ROW_ID) -> DataFrame:
    """Write predictions back by row identity; unscored rows get NULLs."""
    return all_rows.join(scored.select(row_id, *cols), on=row_id, how="left")


def lookup(c: Column | str, mapping: dict) -> Column:
    """Value lookup through a literal map (unmapped -> NULL)."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    x = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(F.create_map(*items), x)


def restrict_to_labelled(pred: DataFrame, truth: DataFrame, row_id: str = schema.ROW_ID,
                         label: str | None = None) -> DataFrame:
    """Semi join — keep predicted rows that have a (non-null) true label."""
    t = truth if label is None else truth.where(F.col(label).isNotNull())
    return pred.join(t.select(row_id), on=row_id, how="left_semi")
