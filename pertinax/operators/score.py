"""Scoring and decision.

Decisions are ``when`` chains over the model's probability column and the decree flag —
no Python callback per row.  ``score_file`` composes the whole bulk path as one lazy plan
that ends in a single distributed write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions.clean import col, pct_round, stamp
from pertinax.operators.project import decode_label
from pertinax.session import spread

THRESHOLD_CHOICES = list(range(50, 95, 5))


def predict(df: DataFrame, model, prob_col: str = "probability") -> DataFrame:
    """Model transform -> ``Prediccion_Modelo``, ``Confianza_%`` (rounded, half-even),
    ``p_pert`` / ``p_no_pert``.

    ``model`` is a fitted Spark ML ``PipelineModel`` whose last stage is a probabilistic
    binary classifier over label 0 = NO PERTINENTE, 1 = PERTINENTE.
    """
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    p = vector_to_array(F.col(prob_col))
    return out.withColumns({
        "p_no_pert": p[0],
        "p_pert": p[1],
    }).withColumns({
        "Prediccion_Modelo": decode_label(F.col("prediction").cast("int")),
        "Confianza_%": pct_round(F.greatest("p_pert", "p_no_pert")),
    })


def predict_production(df: DataFrame, model, features: list[str]) -> DataFrame:
    """D1 on a raw production extract: coerce and derive the features (F1, serving), add those the
    model was trained on and the extract lacks (P11, no value), then :func:`predict`."""
    from pertinax.functions.features import features_production
    from pertinax.operators.project import backfill
    ready = backfill(features_production(df, "serving"), features, policy="nan")
    return predict(ready.withColumns({c: F.col(c).cast("double") for c in features}), model)


def decide_one(p_pert: Column, threshold: float = schema.DEFAULT_UNDETERMINED_PCT) -> Column:
    """D2 for a single record: the threshold is compared with the unrounded confidence."""
    confidence = F.greatest(p_pert, 1 - p_pert) * 100.0
    return F.when(confidence < threshold, F.lit(schema.LABEL_UNDETERMINED)).otherwise(model_label_from_prob(p_pert))


def apply_threshold(df: DataFrame, threshold: float = schema.DEFAULT_UNDETERMINED_PCT,
                    conf_pct: str = "Confianza_%", model_label: str = "Prediccion_Modelo",
                    out: str = "Prediccion") -> DataFrame:
    """Confidence (already rounded %) below the threshold -> INDETERMINADO, else the
    model label.  The threshold is one of 50, 55, ..., 90."""
    if threshold not in THRESHOLD_CHOICES:
        raise ValueError(f"threshold must be one of {THRESHOLD_CHOICES}")
    return df.withColumn(out, F.when(F.col(conf_pct) < F.lit(float(threshold)),
                                     F.lit(schema.LABEL_UNDETERMINED))
                         .otherwise(F.col(model_label)))


def probability_columns(df: DataFrame, p_pert: str = "p_pert", p_no_pert: str = "p_no_pert",
                        now: str | None = None) -> DataFrame:
    """D3: ``Prob_PERTINENTE_%``, ``Prob_NO_PERTINENTE_%`` (half-even, 2 decimals) and the
    ``Fecha_Prediccion`` stamp (pass ``now`` for a deterministic literal)."""
    return df.withColumns({"Prob_PERTINENTE_%": pct_round(p_pert),
                           "Prob_NO_PERTINENTE_%": pct_round(p_no_pert),
                           "Fecha_Prediccion": stamp(now)})


def hybrid_decision(df: DataFrame, conf: str = "conf", model_label: str = "Prediccion_Modelo",
                    rule: str = "CUMPLE_CRITERIO_DECRETO",
                    threshold: float = schema.HYBRID_CONFIDENCE,
                    out: str = "Prediccion") -> DataFrame:
    """Confidence >= 0.55 -> model label; else decree hit -> PERTINENTE; else
    NO PERTINENTE.  Adds ``Confianza_ML`` = confidence·100 rounded half-even.  Without a
    rule column the model label is used as is."""
    c = F.col(conf)
    if rule in df.columns:
        decision = (F.when(c >= threshold, F.col(model_label))
                    .when(F.coalesce(F.col(rule).cast("boolean"), F.lit(False)), F.lit(schema.LABEL_POS))
                    .otherwise(F.lit(schema.LABEL_NEG)))
    else:
        decision = F.col(model_label)
    return df.withColumns({out: decision, "Confianza_ML": pct_round(c)})


def decision_method(df: DataFrame, conf: str = "conf", model_label: str = "Prediccion_Modelo",
                    rule: str = "CUMPLE_CRITERIO_DECRETO",
                    threshold: float = schema.HYBRID_CONFIDENCE) -> DataFrame:
    """``Decision_Final`` and ``Metodo_Decision`` (ML alta confianza / Decreto 34 /
    ML conservador; ``ML puro`` when there is no rule column)."""
    if rule not in df.columns:
        return df.withColumns({"Decision_Final": F.col(model_label),
                               "Metodo_Decision": F.lit(schema.METHOD_PURE)})
    c, r = F.col(conf), F.coalesce(F.col(rule).cast("boolean"), F.lit(False))
    return df.withColumns({
        "Decision_Final": F.when(c >= threshold, F.col(model_label))
        .when(r, F.lit(schema.LABEL_POS)).otherwise(F.lit(schema.LABEL_NEG)),
        "Metodo_Decision": F.when(c >= threshold, F.lit(schema.METHOD_HIGH_CONF))
        .when(r, F.lit(schema.METHOD_DECREE)).otherwise(F.lit(schema.METHOD_CONSERVATIVE)),
    })


def decision_shares(df: DataFrame, decision: str = "Prediccion") -> DataFrame:
    """Counts and % per decision value (the summary printed after bulk scoring)."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.groupBy(decision).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", F.col("n") * 100.0 / total))


def score_file(spark, path: str, model, features: list[str], out_path: str,
               fmt: str = "csv", out_fmt: str = "parquet", binary: list[str] | None = None,
               categorical: list[str] | None = None, mode: str = "overwrite",
               required: list[str] | None = None) -> DataFrame:
    """Read -> prepare -> backfill -> predict -> hybrid decision -> drop filler
    columns -> write; returns the decision shares of what was written.

    The scored table is written once (distributed) and the summary is computed from the
    written files, so the scoring plan does not run twice and the summary survives the loss
    of executors after the write.
    """
    from pertinax.operators.project import backfill, drop_unnamed, normalize_columns
    from pertinax.plans.clinical import prepare_clinical
    from pertinax.sources.sinks import write_table
    from pertinax.sources.tables import read_table
    raw = spread(read_table(spark, path, fmt))
    missing = [c for c in required or [] if c not in normalize_columns(raw).columns]
    if missing:   # P13: nothing is scored or written
        raise ValueError(f"{path} lacks required columns: {', '.join(missing)}")
    # carry untouched copies of the input columns: the output repeats the input as read
    copies = {f"__in{i}": c for i, c in enumerate(raw.columns)}
    df = raw.select("*", *[F.col(f"`{c}`").alias(k) for k, c in copies.items()])
    df = prepare_clinical(df)
    df = backfill(df, features, policy="by_kind", binary=binary, categorical=categorical)
    # binaries enter the model as numbers (P21), as the original cast them before predicting
    num = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("double")
           for c in (binary or []) if c in df.columns}
    df = df.withColumns(num) if num else df
    df = predict(df, model)
    df = df.withColumn("conf", F.greatest("p_pert", "p_no_pert"))
    df = hybrid_decision(df)
    extra = [c for c in ("Prediccion", "Confianza_ML", "CUMPLE_CRITERIO_DECRETO",
                         "flag_resp_grave", "flag_circ_grave", "flag_neuro_grave") if c in df.columns]
    out = df.select(*[F.col(k).alias(c) for k, c in copies.items() if c not in extra], *extra)
    out = drop_unnamed(out)
    write_table(out, out_path, out_fmt, mode=mode)
    return decision_shares(spark.read.format(out_fmt).load(out_path))


def model_label_from_prob(p_pert: Column | str) -> Column:
    """Label from P(PERTINENTE): ties (0.5) go to class 0, like argmax."""
    return F.when(col(p_pert) > 0.5, F.lit(schema.LABEL_POS)).otherwise(F.lit(schema.LABEL_NEG))
