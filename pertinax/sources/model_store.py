"""Model persistence (S9): the model and a one-row metadata table per version.

Layout under ``path``::

    v<yyyymmdd_HHMMSS_ffffff>/model/      the fitted PipelineModel, or an ensemble's node table
    v<yyyymmdd_HHMMSS_ffffff>/metadata/   JSON, one row: dates, counts, accuracies, features,
                                          parameters, label mapping

Nothing is ever overwritten.  A version is complete once its metadata, written last, has its
``_SUCCESS`` marker; the latest version is the greatest complete one.  So a reader sees a whole
model at any time, and earlier versions stay available (the original kept the previous model
under a timestamp).
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import SparkSession

from pertinax.operators.ensembles import Ensemble


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions under ``path``, oldest first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(folder)]
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{path}/{n}/metadata/_SUCCESS"))
    return sorted(n for n in names if n.startswith("v") and done(n))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _write_json(spark: SparkSession, obj: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(obj, ensure_ascii=False, default=str),)], "value string") \
        .coalesce(1).write.text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save_model(spark: SparkSession, model, path: str, metadata: dict) -> str | None:
    """Persist ``model`` and ``metadata`` as a new version; returns the folder of the
    version that was current before (kept as is), or ``None`` for the first save."""
    base = path.rstrip("/")
    previous = versions(spark, base)
    version = "v" + _dt.datetime.now().strftime("%Y%m%d_%H%M%S_%f")
    if isinstance(model, Ensemble):
        model.save(spark, f"{base}/{version}/model")
    else:
        model.write().save(f"{base}/{version}/model")
    meta = dict(metadata)
    meta.setdefault("saved_at", _dt.datetime.now().isoformat(timespec="seconds"))
    meta["version"] = meta.get("version", version)
    _write_json(spark, meta, f"{base}/{version}/metadata")
    return f"{base}/{previous[-1]}" if previous else None


def load_model(spark: SparkSession, path: str, version: str | None = None):
    """Return ``(model, metadata dict)`` for ``version`` (default: latest)."""
    from pyspark.ml import PipelineModel
    base = path.rstrip("/")
    if version is None:
        complete = versions(spark, base)
        if not complete:
            raise FileNotFoundError(f"no model saved under {path}")
        version = complete[-1]
    folder = f"{base}/{version}/model"
    model = Ensemble.load(spark, folder) if _exists(spark, f"{folder}/ensemble") else PipelineModel.load(folder)
    return model, _read_json(spark, f"{base}/{version}/metadata")
