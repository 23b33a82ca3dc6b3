"""Sinks (S5, S6, S8): distributed writes only — nothing is gathered on the driver."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pertinax.sources.tables import first_line, read_table

ERROR_TEXT_CHARS = 40


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                      partition_by: list[str] | None = None) -> None:
    """Every row with its prediction columns."""
    write_table(df, path, fmt, mode, partition_by)


def write_errors(df: DataFrame, real: str, pred: str, path: str, cols: list[str],
                 fmt: str = "csv") -> bool:
    """Only mis-classified rows, a few columns; nothing is written when there is no
    error.  Returns whether a file was written (the emptiness probe is a LIMIT 1 job)."""
    errs = df.where(F.col(real) != F.col(pred)).select(*cols)
    if errs.isEmpty():
        return False
    write_table(errs, path, fmt)
    return True


def _list_files(spark: SparkSession, src_dir: str, ext: str) -> list[str]:
    # folder listing through the Hadoop FileSystem of the session (any storage scheme)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(src_dir)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.lower().endswith("." + ext.lower()):
            out.append(st.getPath().toString())
    return sorted(out)


def convert_files(spark: SparkSession, src_dir: str, dst_dir: str, from_fmt: str = "csv",
                  to_fmt: str = "parquet", ext: str | None = None, at_once: int = 4) -> DataFrame:
    """Convert every ``*.ext`` under ``src_dir`` to ``to_fmt`` under ``dst_dir``, keeping the
    file stem.  Each file is its own distributed read+write job, ``at_once`` of them run side by
    side, and the written rows are counted; a failing file is recorded and the others
    continue.  Returns ``(file, ok, rows, error)`` with the error text cut to 40 characters."""
    ext = ext or from_fmt

    def convert(path: str) -> tuple:
        name = path.rsplit("/", 1)[-1]
        try:
            target = f"{dst_dir.rstrip('/')}/{name[:-(len(ext) + 1)]}.{to_fmt}"
            write_table(read_table(spark, path, from_fmt), target, to_fmt)
            return name, True, spark.read.format(to_fmt).load(target).count(), None
        except Exception as exc:  # keep converting the other files
            return name, False, None, first_line(exc)[:ERROR_TEXT_CHARS]

    with ThreadPoolExecutor(at_once) as pool:
        results = list(pool.map(convert, _list_files(spark, src_dir, ext)))
    return spark.createDataFrame(results, "file string, ok boolean, rows long, error string")
