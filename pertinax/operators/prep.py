"""ML preparation (M1, M2, M4–M8).

Fitted state (medians, modes, means, standard deviations, vocabularies) is a handful of
numbers per column: it is computed by distributed aggregates and only that small result
reaches the driver, exactly like a Spark ML ``Model``.  Applying it is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertinax.operators import stats

HASH_BUCKET_BITS = 16


def _hash32(key_cols: list[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols] + [F.lit(str(seed))]
    return F.substring(F.md5(F.concat(*parts)), 1, 8)


def hash_split_flag(key: str | list[str], frac: float = 0.2, seed: int = 42) -> Column:
    """M1 (map-only): True for the ~``frac`` share whose md5(key‖seed) prefix is below the
    threshold.  Deterministic, no shuffle; stratification holds in expectation."""
    keys = [key] if isinstance(key, str) else list(key)
    threshold = format(int(frac * 2 ** 32), "08x")
    return _hash32(keys, seed) < F.lit(threshold)


def stratified_split(df: DataFrame, key: str | list[str], label: str, frac: float = 0.2,
                     seed: int = 42, exact: bool = False, out: str = "is_test") -> DataFrame:
    """M1: 80/20 split by class.

    ``exact=False``: the map-only hash threshold.  ``exact=True``: exactly
    ``round(frac · n_c)`` rows of each class, those with the smallest (hash, key).  The
    exact variant never sorts a whole class in one task: rows are bucketed by the top hash
    bits, per-(class, bucket) counts locate the one boundary bucket per class, and only that
    bucket (≈ n_c / 65536 rows, whatever the class skew) is ranked.  ``key`` should identify
    a row (e.g. ``row_id``) so that hash buckets stay balanced.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not exact:
        return df.withColumn(out, hash_split_flag(keys, frac, seed))
    h = F.conv(_hash32(keys, seed), 16, 10).cast("long")
    tmp = df.withColumn("__h", h).withColumn("__b", F.shiftright("__h", 32 - HASH_BUCKET_BITS))
    per_bucket = tmp.where(F.col(label).isNotNull()).groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__bc"))
    w = Window.partitionBy(label).orderBy("__b")
    per_bucket = (per_bucket
                  .withColumn("__before", F.coalesce(F.sum("__bc").over(
                      w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                  .withColumn("__n", F.sum("__bc").over(Window.partitionBy(label)))
                  .withColumn("__k", F.round(F.col("__n") * frac, 0).cast("long")))
    # per class: the one bucket in which the test share ends, and how many rows it still takes
    edge = per_bucket.where((F.col("__before") < F.col("__k"))
                            & (F.col("__k") <= F.col("__before") + F.col("__bc")))
    edges = edge.agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(label), F.struct(F.col("__b").alias("b"),
                               (F.col("__k") - F.col("__before")).alias("need")))))).scalar()
    mine = F.try_element_at(edges, F.col(label))
    # the cut inside that bucket: only its rows are ranked, then one row per class remains
    order = F.struct(F.col("__h"), *[F.col(k) for k in keys])
    inside = tmp.withColumn("__e", mine).where(F.col("__b") == F.col("__e.b"))
    cut = (inside.withColumn("__rn", F.row_number().over(Window.partitionBy(label).orderBy(order)))
           .where(F.col("__rn") == F.col("__e.need")).select(label, order.alias("__cut")))
    cuts = cut.agg(F.map_from_entries(F.collect_list(F.struct(label, "__cut")))).scalar()
    # one entry per class, looked up by every row: the table itself is never shuffled
    is_test = F.coalesce(order <= F.try_element_at(cuts, F.col(label)), F.lit(False))
    return tmp.select(*df.columns, is_test.alias(out))


# ------------------------------------------------------------------ imputation

def fit_median(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """M4 fit: exact median per column (distributed; one small row per column returned).  The rows
    are read as they are: only counts by cell are shuffled."""
    med = stats.exact_median(stats.to_long(df, cols), ["column"], c=None)
    got = {r["column"]: r["median"] for r in med.collect()}
    return {c: got.get(c) for c in cols}


def fit_mode(df: DataFrame, cols: list[str], cast: str = "string") -> dict:
    """M5 fit: most frequent value per column, smallest on ties."""
    long = stats.to_long(df, cols, cast=cast)
    mode = stats.exact_mode(stats.value_counts(long, ["column"]), ["column"])
    got = {r["column"]: r["mode"] for r in mode.collect()}
    return {c: got.get(c) for c in cols}


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    """Fill NULLs with fitted per-column values (one projection)."""
    conv = {c: F.coalesce(F.col(c), F.lit(v).cast(dict(df.dtypes)[c]))
            for c, v in values.items() if v is not None and c in df.columns}
    return df.withColumns(conv) if conv else df


def median_impute(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """M4: numeric NULL -> exact median of the fitting set."""
    return apply_fill(df, fit_median(fit_on if fit_on is not None else df, cols))


def mode_impute(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """M5: categorical/binary NULL -> most frequent value (smallest on ties)."""
    src = fit_on if fit_on is not None else df
    kinds = dict(src.dtypes)
    values = {}
    for kind in sorted({kinds[c] for c in cols}):   # one pass per type
        values.update(fit_mode(src, [c for c in cols if kinds[c] == kind], cast=kind))
    return apply_fill(df, values)


def constant_impute(df: DataFrame, cols: list[str], value=0) -> DataFrame:
    """M6: NULL -> constant."""
    return df.na.fill(value, subset=[c for c in cols if c in df.columns])


def fit_standardize(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """M7 fit: mean and *population* standard deviation per column (σ = 0 or undefined -> 1)."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        out[c] = (row[f"m{i}"], s if s not in (None, 0.0) else 1.0)
    return out


def apply_standardize(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    conv = {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items() if m is not None}
    return df.withColumns(conv) if conv else df


def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """M7: (x − μ) / σ with population σ."""
    return apply_standardize(df, fit_standardize(fit_on if fit_on is not None else df, cols))


# ------------------------------------------------------------------ Spark ML stages

def one_hot_stages(cols: list[str], prefix: str = ""):
    """M8: StringIndexer + OneHotEncoder per column, one slot per training category.

    The indexer keeps an index for unseen categories and the encoder drops exactly that last
    slot, so an unseen or missing value has no hot slot (``handle_unknown='ignore'``).
    """
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = [StringIndexer(inputCol=c, outputCol=f"{prefix}{c}__idx", handleInvalid="keep",
                         stringOrderType="alphabetAsc") for c in cols]
    ohe = OneHotEncoder(inputCols=[f"{prefix}{c}__idx" for c in cols],
                        outputCols=[f"{prefix}{c}__ohe" for c in cols], dropLast=True)
    return idx + [ohe]
