"""Scoring of arriving encounter records with Structured Streaming.

The original scored one record typed into a form: range checks (P14), features (F1),
clinical alerts (F7), model (D1) and the confidence threshold (D2).  Here every arriving
record of a file-based stream goes through the same stateless transforms.  The plan has no
state, so there is no watermark to keep and each micro-batch is independent; progress and
exactly-once output rely on the checkpoint location (which must be on shared storage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pertinax.functions.rules import clinical_alerts
from pertinax.operators import score as D
from pertinax.operators.project import validate_ranges
from pertinax.session import spread
from pertinax.sources import model_store


def score_records(df: DataFrame, model, threshold: float = 65.0,
                  pas="PA_Sistolica", pad="PA_Diastolica", temp="Temperatura",
                  triage="Triage") -> DataFrame:
    """Stateless per-record scoring, usable on a batch or a streaming DataFrame."""
    df = validate_ranges(df, pas=pas, pad=pad, temp=temp)
    df = df.withColumn("alerts", F.array_join(
        clinical_alerts(pas=pas, pad=pad, temp=temp, triage=F.col(triage).cast("double")), ","))
    df = D.apply_threshold(D.predict(df, model), threshold)
    # a record out of range is rejected: it keeps its reasons and gets no score
    return df.withColumns({c: F.when(F.col("valid"), F.col(f"`{c}`")) for c in
                           ("Prediccion_Modelo", "Confianza_%", "Prediccion", "p_pert", "p_no_pert")})


def score_stream(spark: SparkSession, source_dir: str, schema: StructType, prepare, model,
                 sink_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                 keep: list[str] | None = None, available_now: bool = True,
                 max_files_per_trigger: int | None = None):
    """Start the stream ``source_dir`` (files) -> ``prepare`` -> :func:`score_records` ->
    ``sink_dir`` (parquet, append).  Returns the ``StreamingQuery``.

    ``prepare`` maps the raw extract to the model's input columns (e.g. the clinical
    preparation plus label encoding); ``available_now`` processes what is there and stops.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = score_records(prepare(spread(reader.load(source_dir))), model)     # a batch may be one file
    cols = (keep or []) + ["valid", "reject_reasons", "alerts", "Prediccion_Modelo", "Confianza_%",
                           "Prediccion"]
    out = scored.select(*cols).withColumn("reject_reasons", F.array_join("reject_reasons", ","))
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_dir).option("path", sink_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _pinned(spark: SparkSession, store: str, pins: str, batch: int) -> str:
    """The model version of a micro-batch: the latest when it first ran, then always that one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pins}/{batch}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    complete = model_store.versions(spark, store)
    if not fs.exists(path):
        if not complete:
            raise FileNotFoundError(f"no model saved under {store}")
        # the version is in a folder's name: it is there whole or not at all
        fs.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pins}/{batch}/{complete[-1]}"))
    # a retry that stopped between two such folders would see both: the oldest counts
    return sorted(st.getPath().getName() for st in fs.listStatus(path))[0]


def score_stream_from_store(spark: SparkSession, source_dir: str, schema: StructType, prepare, store: str,
                            sink_dir: str, checkpoint_dir: str, fmt: str = "parquet", keep: list[str] | None = None,
                            available_now: bool = True, max_files_per_trigger: int | None = None):
    """:func:`score_stream` with the models of a store (S9) instead of one fixed model.

    Each micro-batch takes the version that is the latest when it first runs, so a new version is used
    without a restart.  The choice is pinned under the checkpoint by batch id, and a batch is written to
    a folder of its own, overwritten if it runs again: after a failure the same rows get the same
    scores, once.  Adds ``model_version`` and the partition column ``batch``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    cols = (keep or []) + ["valid", "reject_reasons", "alerts", "Prediccion_Modelo", "Confianza_%", "Prediccion"]
    models: dict = {}

    def score(batch: DataFrame, number: int) -> None:
        version = _pinned(spark, store, f"{checkpoint_dir}/model-versions", number)
        if version not in models:
            models.clear()                     # one version at a time is kept loaded
            models[version] = model_store.load_model(spark, store, version)[0]
        out = score_records(prepare(spread(batch)), models[version]).select(*cols, F.lit(version).alias("model_version"))
        out.withColumn("reject_reasons", F.array_join("reject_reasons", ",")).write.mode("overwrite").parquet(
            f"{sink_dir}/batch={number}")

    writer = reader.load(source_dir).writeStream.foreachBatch(score).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
