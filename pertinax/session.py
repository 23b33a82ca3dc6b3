"""Session helpers.

The library never creates a session implicitly inside an operator; plans receive one.
``get_spark`` is for scripts, tests and the benchmark.  Cluster deployments keep their
own configuration: every setting below is applied only when the key is unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this library wants; cluster-provided values always win.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pertinax") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir`` (scheme kept).

    On a cluster the folder must be configured: a per-machine temporary folder would split
    intermediate tables over the nodes, so an unset folder raises there.  Only a local
    master (tests, a laptop) gets a private folder for this process.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all "
                             "executors share; intermediate tables are written there")
        configured = tempfile.mkdtemp(prefix="pertinax-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for intermediate tables.  The URI
    scheme is kept, so an explicit ``file:`` folder stays on that file system."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/" + name


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly, two tasks a core: for work that costs far more a row than moving the row.
    A scan alone has no more busy tasks than its files have row groups.  Takes scans and streams, as the
    number of partitions is asked of the plan."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts if df.isStreaming else max(parts, df.rdd.getNumPartitions()))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and return a scan of it.

    This is how the library cuts lineage: the rows are computed a single time, later steps
    read files that outlive any executor, and Catalyst sees a plain scan."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
