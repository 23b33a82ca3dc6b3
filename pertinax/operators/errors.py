"""Error analysis (E1–E6): every report is a filter plus conditional aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions.clean import strip_ws
from pertinax.operators import aggregate as A
from pertinax.operators import metrics as M


def errors(df: DataFrame, key: str, real: str, pred: str, conf: str | None = None,
           with_correct: bool = True) -> DataFrame:
    """Mis-classified rows ``(key, Real, Prediccion, Confianza[, Correcto])``."""
    cols = [F.col(key), F.col(real).alias("Real"), F.col(pred).alias("Prediccion")]
    if conf:
        cols.append(F.col(conf).alias("Confianza"))
    if with_correct:
        cols.append(F.lit(False).alias("Correcto"))
    return df.where(F.col(real) != F.col(pred)).select(*cols)


def error_types(df: DataFrame, real: str, pred: str, pos=schema.LABEL_POS,
                neg=schema.LABEL_NEG) -> DataFrame:
    """``(total, correct, pct_correct, false_pos, false_neg)``."""
    r, p = F.col(real), F.col(pred)
    agg = df.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(r == p).alias("correct"),
                 F.count_if((r != p) & (p == F.lit(pos))).alias("false_pos"),
                 F.count_if((r != p) & (p == F.lit(neg))).alias("false_neg"))
    return agg.select("total", "correct",
                      F.coalesce(F.try_divide(F.col("correct") * 100.0, F.col("total")),
                                 F.lit(0.0)).alias("pct_correct"),
                      "false_pos", "false_neg")


def _fn(real, pred, pos, neg):
    return (F.col(real) == F.lit(pos)) & (F.col(pred) == F.lit(neg))


def _tp(real, pred, pos):
    return (F.col(real) == F.lit(pos)) & (F.col(pred) == F.lit(pos))


def fn_profile(df: DataFrame, real: str, pred: str, numeric: list[str], binary: list[str],
               pos=schema.LABEL_POS, neg=schema.LABEL_NEG, yes: str = "Sí"):
    """False negatives vs detected positives — mean differences (A8) and % 'Sí' (A9)."""
    fn, tp = _fn(real, pred, pos, neg), _tp(real, pred, pos)
    means = A.group_mean_diff(df, fn, tp, numeric) if numeric else None
    shares = A.binary_share_by_group(df, fn, tp, binary, yes=yes) if binary else None
    return means, shares


def fn_cases(df: DataFrame, real: str, pred: str, cols: list[str], pos=schema.LABEL_POS,
             neg=schema.LABEL_NEG) -> DataFrame:
    """One row per false negative with its key vitals and procedures."""
    return df.where(_fn(real, pred, pos, neg)).select(*cols)


def correct_contrast(df: DataFrame, real: str, pred: str, cols: list[str],
                     pos=schema.LABEL_POS, neg=schema.LABEL_NEG) -> DataFrame:
    """E5: among correct predictions, mean(PERTINENTE) − mean(NO PERTINENTE) per column."""
    hit = F.col(real) == F.col(pred)
    return A.group_mean_diff(df, hit & (F.col(real) == F.lit(pos)),
                             hit & (F.col(real) == F.lit(neg)), cols)


def validate_scored(pred: DataFrame, truth: DataFrame, real: str, decision: str,
                    rule: str = "CUMPLE_CRITERIO_DECRETO", row_id: str = schema.ROW_ID):
    """After scoring, when a truth exists — join the labelled rows and report
    accuracy (A14), accuracy by origin (A17) and by label (A18).

    Labels are compared after trim + upper on both sides.
    """
    return validate_rows(pred.join(truth.select(row_id, real), row_id), real, decision, rule)


def validate_rows(scored: DataFrame, real: str, decision: str = "Prediccion",
                  rule: str = "CUMPLE_CRITERIO_DECRETO"):
    """E6 where truth and decision stand on the same row: nothing is joined.  Rows whose truth is
    null are left out."""
    j = scored.withColumns({"__real": F.upper(strip_ws(F.col(real))),
                            "__pred": F.upper(strip_ws(F.col(decision)))})
    j = j.where(F.col("__real").isNotNull())
    return (M.accuracy(j, "__real", "__pred"),
            M.accuracy_by_origin(j, "__real", "__pred", rule),
            M.accuracy_by_label(j, "__real", "__pred").withColumnRenamed("__real", "real"))
