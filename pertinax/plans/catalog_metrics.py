"""Registered queries: metrics (A13–A23), decisions (D2–D5) and error analysis.

They run on the prepared encounter extract with the deterministic stand-in score from the
fixture (``p_pert``): a trained model's output is not comparable across engines, the score
is.  The operators themselves are the same ones used on real model output.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pertinax import schema
from pertinax.operators import errors as E
from pertinax.operators import metrics as M
from pertinax.operators import score as D
from pertinax.operators.project import decode_label, encode_label
from pertinax.plans import oracle as O
from pertinax.plans.catalog_tables import _scored, rnd
from pertinax.plans.registry import register

S = O.scored_cte()
NOW = "2026-01-01 00:00:00"
POS, NEG = schema.LABEL_POS, schema.LABEL_NEG
UND = schema.LABEL_UNDETERMINED


def _r(x: str) -> str:
    return f"round({x}, 6)"


def _div0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def labelled_scores(spark, sf_dir):
    """Scored extract with text labels: ``truth_label``, ``Prediccion_Modelo`` (model)."""
    s = _scored(spark, sf_dir)
    return s.withColumns({"truth_label": decode_label("real"),
                          "Prediccion_Modelo": D.model_label_from_prob("p_pert"),
                          "Confianza_%": F.bround(F.col("conf") * 100.0, 2)})


# --------------------------------------------------------------------- A13–A16

@register("a13_confusion_matrix", oracle=S + """
SELECT g.real, g.pred, CAST(count(s.row_id) AS BIGINT) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(real, pred)
LEFT JOIN scored2 s ON s.real = g.real AND s.pred = g.pred GROUP BY g.real, g.pred""")
def a13_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_scored(spark, sf_dir), "real", "pred", (0, 1))


@register("a14_accuracy", oracle=S + """,
c AS (SELECT count(*) FILTER (WHERE real IS NOT NULL AND pred IS NOT NULL) AS n,
             count(*) FILTER (WHERE real = pred) AS hits FROM scored2)
SELECT CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, CAST(n - hits AS BIGINT) AS errors,
  """ + _r(_div0("hits", "n")) + """ AS accuracy FROM c""")
def a14_accuracy(spark, sf_dir):
    return rnd(M.accuracy(_scored(spark, sf_dir), "real", "pred"), ["accuracy"])


_COUNTS = """c AS (SELECT count(*) FILTER (WHERE real IS NOT NULL AND pred IS NOT NULL) AS total,
  count(*) FILTER (WHERE real = pred) AS hits,
  count(*) FILTER (WHERE real = 0 AND pred = 0) AS tp0, count(*) FILTER (WHERE real <> 0 AND pred = 0) AS fp0,
  count(*) FILTER (WHERE real = 0 AND pred <> 0) AS fn0,
  count(*) FILTER (WHERE real = 1 AND pred = 1) AS tp1, count(*) FILTER (WHERE real <> 1 AND pred = 1) AS fp1,
  count(*) FILTER (WHERE real = 1 AND pred <> 1) AS fn1 FROM scored2),
m AS (SELECT *, """ + _div0("tp0", "tp0 + fp0") + " AS p0, " + _div0("tp0", "tp0 + fn0") + """ AS r0,
  """ + _div0("tp1", "tp1 + fp1") + " AS p1, " + _div0("tp1", "tp1 + fn1") + """ AS r1 FROM c),
f AS (SELECT *, """ + _div0("2 * p0 * r0", "p0 + r0") + " AS f0, " + _div0("2 * p1 * r1", "p1 + r1") + """ AS f1 FROM m)"""


@register("a15_classification_report", oracle=S + ",\n" + _COUNTS + """
SELECT 'NO PERTINENTE' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(tp0 + fn0 AS BIGINT) AS support FROM f
UNION ALL SELECT 'PERTINENTE', round(p1, 6), round(r1, 6), round(f1, 6), CAST(tp1 + fn1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(""" + _div0("hits", "total") + """, 6), CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(""" + _div0("p0 * (tp0 + fn0) + p1 * (tp1 + fn1)", "total") + """, 6),
  round(""" + _div0("r0 * (tp0 + fn0) + r1 * (tp1 + fn1)", "total") + """, 6),
  round(""" + _div0("f0 * (tp0 + fn0) + f1 * (tp1 + fn1)", "total") + """, 6), CAST(total AS BIGINT) FROM f""")
def a15_classification_report(spark, sf_dir):
    rep = M.classification_report(_scored(spark, sf_dir), "real", "pred", (0, 1), [NEG, POS])
    return rnd(rep, ["precision", "recall", "f1"])


@register("a16_per_class_metrics", oracle=S + """,
c AS (SELECT count(*) FILTER (WHERE real = 0 AND pred = 0) AS vn, count(*) FILTER (WHERE real = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE real = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE real = 1 AND pred = 1) AS vp FROM scored2),
m AS (SELECT *, """ + _div0("vp", "vp + fp") + " AS pp, " + _div0("vp", "vp + fn") + """ AS rp FROM c)
SELECT CAST(vn AS BIGINT) AS vn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(vp AS BIGINT) AS vp,
  round(""" + _div0("vn", "vn + fn") + """, 6) AS precision_neg, round(""" + _div0("vn", "vn + fp") + """, 6) AS recall_neg,
  round(pp, 6) AS precision_pos, round(rp, 6) AS recall_pos, round(""" + _div0("2 * pp * rp", "pp + rp") + """, 6) AS f1_pos,
  round(""" + _div0("vn + vp", "vn + fp + fn + vp") + """, 6) AS accuracy FROM m""")
def a16_per_class_metrics(spark, sf_dir):
    out = M.per_class_metrics(_scored(spark, sf_dir), "real", "pred")
    return rnd(out, ["precision_neg", "recall_neg", "precision_pos", "recall_pos", "f1_pos", "accuracy"])


# --------------------------------------------------------------------- A17–A23

@register("a17_accuracy_by_origin", oracle=S + """,
c AS (SELECT count(*) FILTER (WHERE real IS NOT NULL AND CUMPLE_CRITERIO_DECRETO) AS n_rule,
             count(*) FILTER (WHERE real = pred AND CUMPLE_CRITERIO_DECRETO) AS h_rule,
             count(*) FILTER (WHERE real IS NOT NULL AND NOT CUMPLE_CRITERIO_DECRETO) AS n_model,
             count(*) FILTER (WHERE real = pred AND NOT CUMPLE_CRITERIO_DECRETO) AS h_model FROM scored2)
SELECT 'decree' AS origin, CAST(n_rule AS BIGINT) AS n, CAST(h_rule AS BIGINT) AS hits, round(""" + _div0("h_rule", "n_rule") + """, 6) AS accuracy FROM c
UNION ALL SELECT 'model', CAST(n_model AS BIGINT), CAST(h_model AS BIGINT), round(""" + _div0("h_model", "n_model") + """, 6) FROM c""")
def a17_accuracy_by_origin(spark, sf_dir):
    return rnd(M.accuracy_by_origin(_scored(spark, sf_dir), "real", "pred"), ["accuracy"])


@register("a18_accuracy_by_label", oracle=S + """
SELECT real, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE real = pred) AS BIGINT) AS hits,
  round(CAST(count(*) FILTER (WHERE real = pred) AS DOUBLE) / count(*) * 100.0, 6) AS pct
FROM scored2 WHERE real IS NOT NULL AND pred IS NOT NULL GROUP BY real""")
def a18_accuracy_by_label(spark, sf_dir):
    return rnd(M.accuracy_by_label(_scored(spark, sf_dir), "real", "pred"), ["pct"])


@register("a19_mean_confidence", oracle=S + """
SELECT round(avg(greatest(p_pert, 1 - p_pert)), 6) AS mean_confidence, CAST(count(*) AS BIGINT) AS n FROM scored2""")
def a19_mean_confidence(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("prob", F.array(1 - F.col("p_pert"), F.col("p_pert")))
    return rnd(M.mean_confidence(s, prob="prob"), ["mean_confidence"])


@register("a20_class_weights", oracle=S + """,
k AS (SELECT real, count(*) AS n_c FROM scored2 WHERE real IS NOT NULL GROUP BY real),
t AS (SELECT sum(n_c) AS n, count(*) AS k, sum(n_c) FILTER (WHERE real = 1) AS n_pos,
             sum(n_c) FILTER (WHERE real = 0) AS n_neg FROM k)
SELECT real, CAST(n_c AS BIGINT) AS n_c, round(CAST(t.n AS DOUBLE) / (t.k * n_c), 6) AS balanced_weight,
  round(CAST(t.n_neg AS DOUBLE) / t.n_pos, 6) AS pos_weight FROM k, t""")
def a20_class_weights(spark, sf_dir):
    return rnd(M.class_weights(_scored(spark, sf_dir), "real"), ["balanced_weight", "pos_weight"])


_D2_SQL = S + f""",
d2 AS (SELECT row_id, CASE WHEN p_pert > 0.5 THEN '{POS}' ELSE '{NEG}' END AS Prediccion_Modelo,
  round_even(conf * 100.0, 2) AS "Confianza_%" FROM scored2),
d2b AS (SELECT *, CASE WHEN "Confianza_%" < 65.0 THEN '{UND}' ELSE Prediccion_Modelo END AS Prediccion FROM d2)"""


@register("a21_score_summary", oracle=_D2_SQL + f"""
SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE Prediccion = '{POS}') AS BIGINT) AS pertinente,
  CAST(count(*) FILTER (WHERE Prediccion = '{NEG}') AS BIGINT) AS no_pertinente,
  CAST(count(*) FILTER (WHERE starts_with(Prediccion, 'INDETERMINADO')) AS BIGINT) AS indeterminado,
  round(count(*) FILTER (WHERE Prediccion = '{POS}') * 100.0 / count(*), 6) AS pct_pertinente,
  round(count(*) FILTER (WHERE Prediccion = '{NEG}') * 100.0 / count(*), 6) AS pct_no_pertinente,
  round(count(*) FILTER (WHERE starts_with(Prediccion, 'INDETERMINADO')) * 100.0 / count(*), 6) AS pct_indeterminado
FROM d2b""")
def a21_score_summary(spark, sf_dir):
    d = D.apply_threshold(labelled_scores(spark, sf_dir), 65)
    return rnd(M.score_summary(d), ["pct_pertinente", "pct_no_pertinente", "pct_indeterminado"])


@register("a22_compare_to_baseline", oracle=S + """,
c AS (SELECT count(*) FILTER (WHERE real IS NOT NULL AND pred IS NOT NULL) AS n,
             count(*) FILTER (WHERE real = pred) AS hits FROM scored2),
a AS (SELECT n, hits, n - hits AS errors, """ + _div0("hits", "n") + """ AS accuracy FROM c)
SELECT CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, CAST(errors AS BIGINT) AS errors,
  round(accuracy, 6) AS accuracy, round((accuracy - 0.6971) * 100.0, 6) AS delta_points,
  CAST(hits - 366 AS BIGINT) AS delta_cases FROM a""")
def a22_compare_to_baseline(spark, sf_dir):
    out = M.compare_to_baseline(M.accuracy(_scored(spark, sf_dir), "real", "pred"))
    return rnd(out, ["accuracy", "delta_points"])


@register("a23_row_reduce", oracle=S + """
SELECT row_id, round(greatest(1 - p_pert, p_pert), 6) AS top_prob,
  CAST(flag_resp_grave AS INTEGER) + CAST(flag_circ_grave AS INTEGER) + CAST(flag_neuro_grave AS INTEGER) AS n_flags
FROM scored2""")
def a23_row_reduce(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("prob", F.array(1 - F.col("p_pert"), F.col("p_pert")))
    out = s.select(schema.ROW_ID, M.top_probability("prob").alias("top_prob"),
                   M.flag_sum("flag_resp_grave", "flag_circ_grave", "flag_neuro_grave").alias("n_flags"))
    return rnd(out, ["top_prob"])


# --------------------------------------------------------------------- D2–D5

@register("d2_apply_threshold", oracle=_D2_SQL + "\nSELECT * FROM d2b")
def d2_apply_threshold(spark, sf_dir):
    d = D.apply_threshold(labelled_scores(spark, sf_dir), 65)
    return d.select(schema.ROW_ID, "Prediccion_Modelo", "Confianza_%", "Prediccion")


@register("d3_probability_columns", oracle=S + f"""
SELECT row_id, round_even(p_pert * 100.0, 2) AS "Prob_PERTINENTE_%",
  round_even((1 - p_pert) * 100.0, 2) AS "Prob_NO_PERTINENTE_%", '{NOW}' AS Fecha_Prediccion FROM scored2""")
def d3_probability_columns(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("p_no_pert", 1 - F.col("p_pert"))
    d = D.probability_columns(s, now=NOW)
    return d.select(schema.ROW_ID, "Prob_PERTINENTE_%", "Prob_NO_PERTINENTE_%", "Fecha_Prediccion")


_D4_SQL = S + f""",
d4 AS (SELECT row_id, CUMPLE_CRITERIO_DECRETO, Resolucion, real, CASE WHEN p_pert > 0.5 THEN '{POS}' ELSE '{NEG}' END AS Prediccion_Modelo,
  conf FROM scored2),
d4b AS (SELECT *, CASE WHEN conf >= 0.55 THEN Prediccion_Modelo WHEN CUMPLE_CRITERIO_DECRETO THEN '{POS}' ELSE '{NEG}' END AS Prediccion,
  round_even(conf * 100.0, 2) AS Confianza_ML FROM d4)"""


@register("d4_hybrid_decision", oracle=_D4_SQL + "\nSELECT row_id, Prediccion_Modelo, Prediccion, Confianza_ML FROM d4b")
def d4_hybrid_decision(spark, sf_dir):
    d = D.hybrid_decision(labelled_scores(spark, sf_dir))
    return d.select(schema.ROW_ID, "Prediccion_Modelo", "Prediccion", "Confianza_ML")


@register("d5_decision_method", oracle=S + f"""
SELECT row_id,
  CASE WHEN conf >= 0.55 THEN (CASE WHEN p_pert > 0.5 THEN '{POS}' ELSE '{NEG}' END)
       WHEN CUMPLE_CRITERIO_DECRETO THEN '{POS}' ELSE '{NEG}' END AS Decision_Final,
  CASE WHEN conf >= 0.55 THEN '{schema.METHOD_HIGH_CONF}' WHEN CUMPLE_CRITERIO_DECRETO THEN '{schema.METHOD_DECREE}'
       ELSE '{schema.METHOD_CONSERVATIVE}' END AS Metodo_Decision FROM scored2""")
def d5_decision_method(spark, sf_dir):
    d = D.decision_method(labelled_scores(spark, sf_dir))
    return d.select(schema.ROW_ID, "Decision_Final", "Metodo_Decision")


# --------------------------------------------------------------------- E1–E6

_TXT = S + f""",
t AS (SELECT *, CASE real WHEN 1 THEN '{POS}' WHEN 0 THEN '{NEG}' END AS truth_label,
             CASE WHEN p_pert > 0.5 THEN '{POS}' ELSE '{NEG}' END AS Prediccion_Modelo FROM scored2)"""


@register("e1_errors", oracle=_TXT + """
SELECT Episodio, truth_label AS Real, Prediccion_Modelo AS Prediccion, round(conf, 6) AS Confianza, false AS Correcto
FROM t WHERE truth_label <> Prediccion_Modelo""")
def e1_errors(spark, sf_dir):
    out = E.errors(labelled_scores(spark, sf_dir), "Episodio", "truth_label", "Prediccion_Modelo", "conf")
    return rnd(out, ["Confianza"])


@register("e2_error_types", oracle=_TXT + f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE truth_label = Prediccion_Modelo) AS BIGINT) AS correct,
  round(count(*) FILTER (WHERE truth_label = Prediccion_Modelo) * 100.0 / count(*), 6) AS pct_correct,
  CAST(count(*) FILTER (WHERE truth_label <> Prediccion_Modelo AND Prediccion_Modelo = '{POS}') AS BIGINT) AS false_pos,
  CAST(count(*) FILTER (WHERE truth_label <> Prediccion_Modelo AND Prediccion_Modelo = '{NEG}') AS BIGINT) AS false_neg
FROM t WHERE truth_label IS NOT NULL""")
def e2_error_types(spark, sf_dir):
    s = labelled_scores(spark, sf_dir).where(F.col("truth_label").isNotNull())
    return rnd(E.error_types(s, "truth_label", "Prediccion_Modelo"), ["pct_correct"])


_E3_NUM = ["PA_Sistolica", "SatO2", "Glasgow", "FR"]


@register("e3_fn_profile_means", oracle=_TXT + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, round(avg({c}) FILTER (WHERE truth_label = '{POS}' AND Prediccion_Modelo = '{NEG}'), 6) AS mean_a, "
    f"round(avg({c}) FILTER (WHERE truth_label = '{POS}' AND Prediccion_Modelo = '{POS}'), 6) AS mean_b, "
    f"round(avg({c}) FILTER (WHERE truth_label = '{POS}' AND Prediccion_Modelo = '{NEG}') - "
    f"avg({c}) FILTER (WHERE truth_label = '{POS}' AND Prediccion_Modelo = '{POS}'), 6) AS diff FROM t" for c in _E3_NUM))
def e3_fn_profile_means(spark, sf_dir):
    means, _ = E.fn_profile(labelled_scores(spark, sf_dir), "truth_label", "Prediccion_Modelo", _E3_NUM, [])
    return rnd(means, ["mean_a", "mean_b", "diff"])


@register("e3_fn_profile_binary", oracle=_TXT + f""",
g AS (SELECT count(*) FILTER (WHERE truth_label = '{POS}' AND Prediccion_Modelo = '{NEG}') AS na,
             count(*) FILTER (WHERE truth_label = '{POS}' AND Prediccion_Modelo = '{POS}') AS nb,
             count(*) FILTER (WHERE truth_label = '{POS}' AND Prediccion_Modelo = '{NEG}' AND dva_txt = 'Sí') AS a0,
             count(*) FILTER (WHERE truth_label = '{POS}' AND Prediccion_Modelo = '{POS}' AND dva_txt = 'Sí') AS b0
      FROM (SELECT *, CASE WHEN DVA THEN 'Sí' ELSE 'No' END AS dva_txt FROM t))
SELECT 'dva_txt' AS column, round(a0 * 100.0 / na, 6) AS pct_a, round(b0 * 100.0 / nb, 6) AS pct_b FROM g""")
def e3_fn_profile_binary(spark, sf_dir):
    s = labelled_scores(spark, sf_dir).withColumn(
        "dva_txt", F.when(F.col("DVA"), F.lit("Sí")).otherwise(F.lit("No")))
    _, shares = E.fn_profile(s, "truth_label", "Prediccion_Modelo", [], ["dva_txt"])
    return rnd(shares, ["pct_a", "pct_b"])


@register("e4_fn_cases", oracle=_TXT + f"""
SELECT row_id, Episodio, PA_Sistolica, PA_Diastolica, SatO2, Glasgow, FR, Ventilacion_Mecanica
FROM t WHERE truth_label = '{POS}' AND Prediccion_Modelo = '{NEG}'""")
def e4_fn_cases(spark, sf_dir):
    return E.fn_cases(labelled_scores(spark, sf_dir), "truth_label", "Prediccion_Modelo",
                      [schema.ROW_ID, "Episodio", "PA_Sistolica", "PA_Diastolica", "SatO2", "Glasgow",
                       "FR", "Ventilacion_Mecanica"])


@register("e5_correct_contrast", oracle=_TXT + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, round(avg({c}) FILTER (WHERE truth_label = Prediccion_Modelo AND truth_label = '{POS}'), 6) AS mean_a, "
    f"round(avg({c}) FILTER (WHERE truth_label = Prediccion_Modelo AND truth_label = '{NEG}'), 6) AS mean_b, "
    f"round(avg({c}) FILTER (WHERE truth_label = Prediccion_Modelo AND truth_label = '{POS}') - "
    f"avg({c}) FILTER (WHERE truth_label = Prediccion_Modelo AND truth_label = '{NEG}'), 6) AS diff FROM t" for c in _E3_NUM))
def e5_correct_contrast(spark, sf_dir):
    out = E.correct_contrast(labelled_scores(spark, sf_dir), "truth_label", "Prediccion_Modelo", _E3_NUM)
    return rnd(out, ["mean_a", "mean_b", "diff"])


def _e6(spark, sf_dir):
    s = labelled_scores(spark, sf_dir)
    labelled = D.hybrid_decision(s.where(encode_label("Resolucion").isNotNull()))
    return E.validate_rows(labelled, "Resolucion", "Prediccion")


_E6 = _D4_SQL + """,
v AS (SELECT upper(trim(Resolucion)) AS r, upper(trim(Prediccion)) AS p, CUMPLE_CRITERIO_DECRETO AS rule
      FROM d4b WHERE real IS NOT NULL)"""


@register("e6_validate_accuracy", oracle=_E6 + """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE r = p) AS BIGINT) AS hits,
  CAST(count(*) FILTER (WHERE r <> p) AS BIGINT) AS errors,
  round(count(*) FILTER (WHERE r = p) * 1.0 / count(*), 6) AS accuracy FROM v""")
def e6_validate_accuracy(spark, sf_dir):
    acc, _, _ = _e6(spark, sf_dir)
    return rnd(acc, ["accuracy"])


@register("e6_validate_by_origin", oracle=_E6 + """
SELECT 'decree' AS origin, CAST(count(*) FILTER (WHERE rule) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE rule AND r = p) AS BIGINT) AS hits,
  round(""" + _div0("count(*) FILTER (WHERE rule AND r = p)", "count(*) FILTER (WHERE rule)") + """, 6) AS accuracy FROM v
UNION ALL SELECT 'model', CAST(count(*) FILTER (WHERE NOT rule) AS BIGINT),
  CAST(count(*) FILTER (WHERE NOT rule AND r = p) AS BIGINT),
  round(""" + _div0("count(*) FILTER (WHERE NOT rule AND r = p)", "count(*) FILTER (WHERE NOT rule)") + """, 6) FROM v""")
def e6_validate_by_origin(spark, sf_dir):
    _, origin, _ = _e6(spark, sf_dir)
    return rnd(origin, ["accuracy"])


@register("e6_validate_by_label", oracle=_E6 + """
SELECT r AS real, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE r = p) AS BIGINT) AS hits,
  round(count(*) FILTER (WHERE r = p) * 1.0 / count(*) * 100.0, 6) AS pct FROM v GROUP BY r""")
def e6_validate_by_label(spark, sf_dir):
    _, _, by_label = _e6(spark, sf_dir)
    return rnd(by_label, ["pct"])
