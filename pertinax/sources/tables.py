"""Table scans.

Extracts land as STRING columns (no schema inference on CSV): typed parsing is the job of
the cleaning expressions, so a bad cell never fails a scan and the same plan works for every
format.  Parquet keeps its own schema and gets projection + predicate pushdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pertinax import schema

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan a table.  CSV keeps the header row and lands every column as STRING."""
    fmt = fmt.lower()
    if fmt == "csv":
        reader = spark.read.option("header", True).option("inferSchema", False)
        reader = reader.option("encoding", options.pop("encoding", "UTF-8"))
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.csv(path)
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(fmt).load(path)


def sample_head(df: DataFrame, n: int = 1000, order_by: str = schema.ROW_ID) -> DataFrame:
    """S3: the first ``n`` rows in a deterministic order (top-k, not a full sort)."""
    return df.orderBy(F.col(order_by).asc_nulls_last()).limit(n)


def first_line(exc: Exception) -> str:
    """The first line of an error's text; its type's name if the text is empty."""
    lines = str(exc).strip().splitlines()
    return lines[0] if lines else type(exc).__name__


def read_whole(df: DataFrame) -> int:
    """Read every column of every row in one job, keeping nothing; the number of rows.  Raises
    what any later read of the same files would raise."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


def scan_existing(spark: SparkSession, paths: list[str], fmt: str = "parquet",
                  source_col: str = "source_name", **options) -> tuple[DataFrame | None, DataFrame]:
    """Union the sources that exist and read cleanly; report every source.

    Returns ``(data, status)``: ``data`` is the by-name union of the readable sources with
    a ``source_name`` column (missing columns -> NULL), ``status`` has one row per
    requested path ``(source_name, status, error, rows)``.  A source is ``ok`` if one job of its
    own has read all its columns, so a bad page or column chunk fails that source only.  The
    rows stay distributed.
    """
    from pyspark.errors import AnalysisException
    frames, status = [], []
    for path in paths:
        try:
            df = read_table(spark, path, fmt, **options)
            rows = read_whole(df)  # a corrupt header or page is reported here, not later
            frames.append(df.withColumn(source_col, F.lit(path)))
            status.append((path, "ok", None, rows))
        except AnalysisException as exc:  # a missing or bad file must not stop the others
            missing = (exc.getCondition() or "").startswith("PATH_NOT_FOUND")
            status.append((path, "missing" if missing else "failed",
                           None if missing else first_line(exc), None))
        except Exception as exc:
            status.append((path, "failed", first_line(exc), None))
    data = None
    for df in frames:
        data = df if data is None else data.unionByName(df, allowMissingColumns=True)
    return data, spark.createDataFrame(
        status, f"{source_col} string, status string, error string, rows long")
