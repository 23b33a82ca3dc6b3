"""Registered queries: ML preparation (M*), models (L*), scoring (D1, D6), sinks (S5, S6,
S8, S9).

The model queries train the published sizes on the whole labelled extract (a forest of 500 trees of
depth 20, 300 and 500 boosting rounds of depth 7, 5 folds, the eight configurations of the search).
``sizes`` lets tests pass smaller ones.  A trained model is not SQL, so these queries return what must hold whatever the model learned: which rows or
folds there are (hash-determined) and whether every prediction, probability and figure is
consistent; their DuckDB twins state the same.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions.features import ALERT_COLUMNS
from pertinax.operators import errors as E
from pertinax.operators import models as L
from pertinax.operators import nearest, prep
from pertinax.operators import score as D
from pertinax.operators.project import clean_label, encode_label
from pertinax.plans import oracle as O
from pertinax.plans.clinical import clinical_encounters, prepare_clinical, prepared_encounters
from pertinax.plans.fixture import FIXTURE_SCORE_SQL
from pertinax.plans.registry import register
from pertinax.session import scratch_dir, spread, written
from pertinax.sources import model_store, sinks
from pertinax.sources.tables import table

ENC = O.encounters_cte()
H = "substr(md5(CAST(o_orderkey AS VARCHAR) || '42'), 1, 8)"

NUMERIC = ["PA_Sistolica", "PA_Diastolica", "Temperatura", "SatO2", "FC", "FR", "Glasgow",
           "Hemoglobina", "FiO2"]
BINARY = ["DVA", "Ventilacion_Mecanica", "Transfusiones", "Compromiso_Conciencia", "Antecedente_HTA",
          "flag_resp_grave", "flag_circ_grave", "flag_neuro_grave"] + ALERT_COLUMNS
CATEGORICAL = ["Tipo_Cama"]
#: Sizes of the registered models.
FULL = {"forest": dict(numTrees=500, maxDepth=20, minInstancesPerNode=2, minSamplesSplit=5),
        "gbt": dict(maxIter=300, maxDepth=7, stepSize=0.05, subsamplingRate=0.8),
        "boosted": {"maxIter": 500, "maxDepth": 7, "stepSize": 0.03, "subsamplingRate": 0.8, "columnShare": 0.8,
                    "lambda": 1.0, "minChildWeight": 1.0}}
KIND = {"forest": "forest", "gbt": "boost", "boosted": "boost"}
FOLDS = 5


def model_input(prepared):
    """Prepared extract -> model input: ``label`` (0/1, NULL when unlabelled), numeric
    binaries.  Stateless, so it serves batch and streaming frames alike."""
    return prepared.withColumns({"label": encode_label("Resolucion").cast("double"),
                                 **{c: F.col(c).cast("double") for c in BINARY}})


def training_frame(spark, sf_dir):
    return model_input(prepare_clinical(spread(clinical_encounters(spark, sf_dir))))


def labelled_frame(spark, sf_dir):
    """The labelled rows and what models see of them, prepared once."""
    df = training_frame(spark, sf_dir).where(F.col("label").isNotNull())
    return written(df.select(schema.ROW_ID, "Fecha_Alta", "label", *NUMERIC, *BINARY, *CATEGORICAL), "labelled")


def _split(spark, sf_dir):
    df = labelled_frame(spark, sf_dir)
    df = prep.stratified_split(df, schema.ROW_ID, "label", 0.2, 42, exact=False)
    return df.where(~F.col("is_test")), df.where(F.col("is_test"))


#: Rows of the 20 % side of the split, on DuckDB.
LAB = ENC + f""",
lab AS (SELECT *, {O.encode_label('Resolucion')} AS label,
  substr(md5(CAST(row_id AS VARCHAR) || '42'), 1, 8) < '33333333' AS is_test FROM enc),
known AS (SELECT * FROM lab WHERE label IS NOT NULL)"""
CHECKED = LAB + """
SELECT row_id, CAST(label AS DOUBLE) AS label, true AS probability_ok, true AS prediction_ok,
  true AS beats_majority FROM known WHERE is_test"""


def _checked(model_out, prefix=""):
    """Per test row: are the probabilities in [0, 1] with sum 1, does the prediction follow them;
    and does the model beat the majority class over all test rows."""
    p = vector_to_array(F.col(f"{prefix}probability"))
    rows = model_out.select(schema.ROW_ID, "label", p[0].alias("p0"), p[1].alias("p1"),
                            F.col(f"{prefix}prediction").alias("prediction"))
    return _checks(rows)


def _checks(rows):
    rows = written(rows, "scored")       # two readers, scored once
    p0, p1 = F.col("p0"), F.col("p1")
    beats = rows.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))
                        > F.greatest(F.avg("label"), 1 - F.avg("label"))).scalar()
    return rows.select(
        schema.ROW_ID, "label",
        (p0.between(0, 1) & p1.between(0, 1) & (F.abs(p0 + p1 - 1) < 1e-9)).alias("probability_ok"),
        (F.col("prediction") == F.when(p1 > p0, 1.0).otherwise(0.0)).alias("prediction_ok"),
        beats.alias("beats_majority"))


def _run_dir(spark, name):
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:10]}")


# --------------------------------------------------------------------- M1

@register("m1_split_hash", oracle=f"""
SELECT o_orderstatus, {H} < '33333333' AS is_test, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2""")
def m1_split_hash(spark, sf_dir):
    o = prep.stratified_split(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus")
    return o.groupBy("o_orderstatus", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("m1_split_exact", oracle=f"""
WITH r AS (SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H}, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders WHERE o_orderstatus IS NOT NULL)
SELECT o_orderkey, o_orderstatus, rn <= round(n * 0.2) AS is_test FROM r
UNION ALL SELECT o_orderkey, o_orderstatus, false FROM orders WHERE o_orderstatus IS NULL""")
def m1_split_exact(spark, sf_dir):
    """Exactly round(0.2·n_c) orders per status, smallest (hash, key) first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return prep.stratified_split(o, "o_orderkey", "o_orderstatus", exact=True)


# --------------------------------------------------------------------- M4–M8

_M4 = ["FC", "SatO2", "Temperatura", "Hemoglobina"]


@register("m4_median_impute", oracle=ENC + "\nSELECT row_id, " + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM enc)) AS {c}" for c in _M4) + " FROM enc")
def m4_median_impute(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir).select(schema.ROW_ID, *_M4)
    return prep.median_impute(e, _M4)


_M3 = ["FC", "SatO2", "Temperatura", "Hemoglobina"]


def _m3_sql():
    """By brute force: every row that lacks a column against every row that has it."""
    parts, joins, out = [], [], []
    for c in _M3:
        d = " + ".join(f"coalesce((l.{x} - r.{x}) * (l.{x} - r.{x}), 0.0)" for x in _M3)
        n = " + ".join(f"CAST(l.{x} IS NOT NULL AND r.{x} IS NOT NULL AS INTEGER)" for x in _M3)
        parts.append(f"""k_{c} AS (SELECT l.row_id, list_avg(list_transform(
  min({{'d': ({d}) * {len(_M3)} / ({n}), 'i': r.row_id, 'v': r.{c}}}, 5), lambda x: x.v)) AS v
  FROM e l JOIN e r ON l.{c} IS NULL AND r.{c} IS NOT NULL AND ({n}) > 0 GROUP BY l.row_id)""")
        joins.append(f"LEFT JOIN k_{c} ON k_{c}.row_id = e.row_id")
        out.append(f"round(coalesce(e.{c}, k_{c}.v, (SELECT avg({c}) FROM e)), 6) AS {c}")
    return (ENC + ",\ne AS (SELECT row_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _M3) + " FROM enc),\n" + ",\n".join(parts)
            + "\nSELECT e.row_id, " + ", ".join(out) + " FROM e " + " ".join(joins))


@register("m3_knn_impute", oracle=_m3_sql())
def m3_knn_impute(spark, sf_dir):
    """Missing vitals take the mean of the five nearest encounters that have them."""
    e = prepare_clinical(spread(clinical_encounters(spark, sf_dir))).select(schema.ROW_ID, *_M3)
    e = written(e, "vitals")         # the search reads each column many times over
    out = nearest.knn_impute(e, _M3, 5, schema.ROW_ID)
    return out.withColumns({c: F.round(c, 6) for c in _M3})


@register("m5_mode_impute", oracle=ENC + """
SELECT row_id,
  coalesce(tc, (SELECT tc FROM (SELECT tipo_cama AS tc FROM encounters) WHERE tc IS NOT NULL GROUP BY tc ORDER BY count(*) DESC, tc LIMIT 1)) AS tipo_cama,
  coalesce(hta, (SELECT hta FROM encounters WHERE hta IS NOT NULL GROUP BY hta ORDER BY count(*) DESC, hta LIMIT 1)) AS hta
FROM (SELECT row_id, tipo_cama AS tc, hta FROM encounters)""")
def m5_mode_impute(spark, sf_dir):
    from pertinax.plans.fixture import encounters
    e = encounters(spark, sf_dir).select(schema.ROW_ID, "tipo_cama", "hta")
    return prep.mode_impute(e, ["tipo_cama", "hta"])


@register("m6_constant_impute", oracle=ENC + "\nSELECT row_id, coalesce(Glasgow, 0) AS Glasgow, coalesce(FR, 0) AS FR FROM enc")
def m6_constant_impute(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir).select(schema.ROW_ID, "Glasgow", "FR")
    return prep.constant_impute(e, ["Glasgow", "FR"], 0)


@register("m7_standardize", oracle=ENC + """,
s AS (SELECT avg(FC) AS m1, coalesce(nullif(stddev_pop(FC), 0), 1) AS s1,
             avg(Glasgow) AS m2, coalesce(nullif(stddev_pop(Glasgow), 0), 1) AS s2 FROM enc)
SELECT row_id, round((FC - m1) / s1, 6) AS FC, round((Glasgow - m2) / s2, 6) AS Glasgow FROM enc, s""")
def m7_standardize(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir).select(schema.ROW_ID, "FC", "Glasgow")
    out = prep.standardize(e, ["FC", "Glasgow"])
    return out.withColumns({c: F.round(c, 6) for c in ("FC", "Glasgow")})


@register("m8_one_hot", oracle=ENC + """
SELECT row_id, Tipo_Cama, CAST(dense_rank() OVER (ORDER BY Tipo_Cama) - 1 AS INTEGER) AS hot_index,
  CAST((SELECT count(DISTINCT Tipo_Cama) FROM enc) AS INTEGER) AS width FROM enc""")
def m8_one_hot(spark, sf_dir):
    """One-hot of the bed type: the hot slot and the vector width (one slot per category)."""
    from pyspark.ml import Pipeline
    e = prepared_encounters(spark, sf_dir).select(schema.ROW_ID, "Tipo_Cama")
    m = Pipeline(stages=prep.one_hot_stages(["Tipo_Cama"])).fit(e)
    arr = vector_to_array(F.col("Tipo_Cama__ohe"))
    return m.transform(e).select(
        schema.ROW_ID, "Tipo_Cama",
        (F.array_position(arr, 1.0) - 1).cast("int").alias("hot_index"),
        F.size(arr).cast("int").alias("width"))


@register("m2_assemble", oracle=ENC + f"""
SELECT row_id, CAST({len(NUMERIC) + len(BINARY)} + (SELECT count(DISTINCT Tipo_Cama) FROM enc) AS INTEGER) AS width FROM enc""")
def m2_assemble(spark, sf_dir):
    """Per-kind preparation and assembly into one vector per row."""
    from pyspark.ml import Pipeline
    df = training_frame(spark, sf_dir)
    stages = L.prep_stages(NUMERIC, categorical=CATEGORICAL, binary=BINARY)
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.select(schema.ROW_ID, F.size(vector_to_array("features")).alias("width"))


# --------------------------------------------------------------------- L1–L8

def _fit(train, kind="forest", weight=None, prefix="", sizes=FULL):
    spec = L.ModelSpec(kind, KIND.get(kind, kind), sizes[kind], weighted=weight is not None)
    return L.member_pipeline(spec, NUMERIC, "label", weight, prefix, CATEGORICAL, BINARY).fit(train)


def _test_predictions(model, test, prefix=""):
    p = model.transform(test)
    return p.select(schema.ROW_ID, "label",
                    F.col(f"{prefix}prediction").alias("prediction"),
                    vector_to_array(F.col(f"{prefix}probability"))[1].alias("p_pert"))


@register("l1_train_forest", oracle=CHECKED)
def l1_train_forest(spark, sf_dir, sizes=FULL):
    """Balanced forest (class weights) on the 80 % side, checked on the 20 % side."""
    from pertinax.operators.metrics import with_class_weights
    train, test = _split(spark, sf_dir)
    train = with_class_weights(train, "label", "weight")
    return _checked(_fit(train, "forest", "weight", sizes=sizes).transform(test))


@register("l2_train_gbt", oracle=CHECKED)
def l2_train_gbt(spark, sf_dir, sizes=FULL):
    """Gradient boosting: Newton leaves, no penalties."""
    train, test = _split(spark, sf_dir)
    return _checked(_fit(train, "gbt", sizes=sizes).transform(test))


@register("l3_train_boosted", oracle=CHECKED)
def l3_train_boosted(spark, sf_dir, sizes=FULL):
    """Second-order boosting with an L2 penalty, a share of the columns per tree and positive-class
    weight n_neg / n_pos."""
    train, test = _split(spark, sf_dir)
    train = L.with_pos_weight(train, "label", "weight")
    return _checked(_fit(train, "boosted", "weight", sizes=sizes).transform(test))


@register("l4_soft_vote", oracle=CHECKED)
def l4_soft_vote(spark, sf_dir, sizes=FULL):
    train, test = _split(spark, sf_dir)
    specs = {prefix: L.ModelSpec(kind, KIND[kind], sizes[kind]) for prefix, kind in (("rf_", "forest"), ("gb_", "gbt"))}
    v = L.soft_vote(L.fit_members(specs, train, NUMERIC, categorical=CATEGORICAL, binary=BINARY), test)
    mean = (vector_to_array("rf_probability")[1] + vector_to_array("gb_probability")[1]) / 2
    return _checks(v.select(schema.ROW_ID, "label", "prediction", (1 - F.col("p_pert")).alias("p0"),
                            mean.alias("p1")))


@register("l4_vote_of_scores", oracle=O.scored_cte() + """
SELECT row_id, (p_pert + CAST(row_id % 11 AS DOUBLE) / 10) / 2 AS p_vote,
  CAST(CASE WHEN (p_pert + CAST(row_id % 11 AS DOUBLE) / 10) / 2 > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM scored2""")
def l4_vote_of_scores(spark, sf_dir):
    """The vote itself, over two given scores."""
    other = (F.col(schema.ROW_ID) % 11).cast("double") / 10
    return prepared_encounters(spark, sf_dir).select(
        schema.ROW_ID, *L.vote([F.expr(FIXTURE_SCORE_SQL), other], "p_vote"))


_SETS = """
SELECT 'train' AS "set", count_if(NOT is_test) AS n FROM known UNION ALL SELECT 'test', count_if(is_test) FROM known"""


def _boosted(rounds, depth, step, share=0.8, columns=0.8, seed=42):
    return L.ModelSpec("boosted", "boost", {"maxIter": rounds, "maxDepth": depth, "stepSize": step, "subsamplingRate": share,
                                            "columnShare": columns, "lambda": 1.0, "minChildWeight": 1.0, "seed": seed}, weighted=True)


def _forest(trees, depth, split, leaf=1):
    return L.ModelSpec("forest", "forest", dict(numTrees=trees, maxDepth=depth, minSamplesSplit=split,
                                                minInstancesPerNode=leaf), weighted=True)


def _gradient(rounds, depth):
    return L.ModelSpec("gbt", "boost", dict(maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8))


def _named(spec, name):
    return replace(spec, name=name)


#: The eight configurations of the search; a vote has members of its own sizes.  Positive weight
#: n_neg / n_pos and balanced class weights differ by a factor only, so one weight column serves both.
SEARCH = [_named(_boosted(500, 7, 0.03), "boosted"), _named(_boosted(300, 10, 0.05, 0.9, 0.9), "boosted_deep"),
          _named(_forest(500, 20, 5, 2), "rf_balanced"), _named(_gradient(300, 7), "gbt"),
          L.ModelSpec("vote_boosted_rf", "vote", members=[_boosted(400, 7, 0.04), _forest(400, 20, 5)]),
          L.ModelSpec("vote_boosted_gbt", "vote", members=[_boosted(400, 7, 0.04), _gradient(300, 7)]),
          L.ModelSpec("vote_three", "vote", members=[_boosted(350, 7, 0.04), _forest(300, 18, 5), _gradient(250, 7)]),
          L.ModelSpec("vote_four", "vote", members=[
              _boosted(300, 6, 0.05), _named(_boosted(200, 5, 0.1, 0.9, 0.9, 123), "boosted_fast"), _forest(200, 15, 10, 4),
              _gradient(200, 5)])]


@register("l5_search", oracle=LAB + """,
c AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c.name}', '{c.kind}')" for c in SEARCH) + """) v(name, kind))
SELECT name, kind, (SELECT count(*) FROM known WHERE is_test AND strftime(Fecha_Alta, '%Y-%m') <> '2024-03') AS test_n,
  (SELECT count(*) FROM known WHERE strftime(Fecha_Alta, '%Y-%m') = '2024-03') AS external_n,
  true AS rank_ok, true AS gap_ok FROM c""")
def l5_search(spark, sf_dir, configurations=SEARCH):
    """Eight configurations, four of them votes, ranked by accuracy on an external set: the
    hold-out month, which neither the training nor the internal test side contains."""
    from pertinax.operators.metrics import with_class_weights
    from pertinax.operators.project import temporal_holdout
    df = temporal_holdout(labelled_frame(spark, sf_dir), "Fecha_Alta", 2024, 3)
    inner = prep.stratified_split(df.where("split <> 'valid'"), schema.ROW_ID, "label", 0.2, 42)
    train = with_class_weights(inner.where(~F.col("is_test")), "label", "weight")
    board, _ = L.search(configurations, train, inner.where("is_test"), df.where("split = 'valid'"), NUMERIC,
                        weight="weight", binary=BINARY, categorical=CATEGORICAL)
    # eight rows: each configuration's place is one more than the number of better ones
    board = board.withColumn("all", board.select(F.collect_list(F.struct("external_accuracy", "name"))).scalar())
    better = lambda o: (o["external_accuracy"] > F.col("external_accuracy")) | (
        (o["external_accuracy"] == F.col("external_accuracy")) & (o["name"] < F.col("name")))
    return board.select(
        "name", "kind", "test_n", "external_n", (F.col("rank") == F.size(F.filter("all", better)) + 1).alias("rank_ok"),
        (F.col("gap") == F.col("external_accuracy") - F.col("test_accuracy")).alias("gap_ok"))


@register("l6_cross_validate", oracle=LAB + """,
f AS (SELECT CAST((row_number() OVER (PARTITION BY label ORDER BY substr(md5(row_id || 'fold42'), 1, 8), row_id) - 1) % 5 AS INTEGER) AS fold
      FROM known)
SELECT fold, count(*) AS n, true AS accuracy_ok, true AS mean_ok FROM f GROUP BY fold""")
def l6_cross_validate(spark, sf_dir, sizes=FULL):
    """Five stratified folds: per class, fold sizes differ by at most one."""
    df = labelled_frame(spark, sf_dir)
    spec = L.ModelSpec("rf", "forest", sizes["forest"])
    cv = L.cross_validate(df, NUMERIC, spec, schema.ROW_ID, "label", k=FOLDS, binary=BINARY, categorical=CATEGORICAL)
    mean = cv.select(F.avg("accuracy")).scalar()
    return cv.select("fold", "n", (F.abs(F.col("accuracy") - F.col("hits") / F.col("n")) < 1e-12).alias("accuracy_ok"),
                     (F.abs(F.col("mean") - mean) < 1e-12).alias("mean_ok"))


@register("l7_evaluate_train_test", oracle=LAB + """
SELECT "set", CAST(n AS BIGINT) AS n, true AS counts_ok, true AS accuracy_ok FROM (""" + _SETS + ")")
def l7_evaluate_train_test(spark, sf_dir, sizes=FULL):
    """Accuracy and confusion matrix of both sides."""
    train, test = _split(spark, sf_dir)
    return _evaluation_ok(L.evaluate_train_test(_fit(train, sizes=sizes), train, test))


def _evaluation_ok(e):
    return e.select(
        "set", "n", ((F.col("tn") + F.col("tp") == F.col("hits")) & (F.col("fp") + F.col("fn") == F.col("errors"))
                     & (F.col("hits") + F.col("errors") == F.col("n"))).alias("counts_ok"),
        (F.abs(F.col("accuracy") - F.col("hits") / F.col("n")) < 1e-12).alias("accuracy_ok"))


@register("l8_train_end_to_end", oracle=LAB + """
SELECT "set", CAST(n AS BIGINT) AS n, true AS counts_ok, true AS accuracy_ok, true AS same_after_reload
FROM (""" + _SETS + " UNION ALL SELECT 'reloaded_test', count_if(is_test) FROM known)")
def l8_train_end_to_end(spark, sf_dir, sizes=FULL):
    """Whole training path: prepare -> label -> split -> fit -> evaluate -> persist -> reload
    and re-score the test side with the reloaded model."""
    train, test = _split(spark, sf_dir)
    model = _fit(train, sizes=sizes)
    acc = written(L.evaluate_train_test(model, train, test), "evaluation")     # read three times, scored once
    path = _run_dir(spark, "model")
    before = acc.where(F.col("set") == "test").first()["accuracy"]
    meta = {"features": NUMERIC + BINARY, "categorical": CATEGORICAL,
            "int_to_label": schema.INT_TO_LABEL, "params": sizes["forest"], "accuracy_test": before}
    model_store.save_model(spark, model, path, meta)
    reloaded, kept = model_store.load_model(spark, path)
    again = written(L.evaluate(reloaded, test), "reloaded").withColumn("set", F.lit("reloaded_test"))
    every = acc.unionByName(again).withColumn("same", (F.col("set") != "reloaded_test")
                                              | (F.col("accuracy") == F.lit(kept["accuracy_test"])))
    return _evaluation_ok(every).join(every.select("set", F.col("same").alias("same_after_reload")), "set")


@register("l8_train_production", oracle=LAB + """,
raw AS (SELECT e.row_id, e.validacion FROM encounters e),
p AS (SELECT row_id, """ + O.encode_label(O.clean_label("validacion")) + """ AS label,
  substr(md5(CAST(row_id AS VARCHAR) || '42'), 1, 8) < '33333333' AS is_test FROM raw)
SELECT 'train' AS "set", count_if(NOT is_test) AS n, true AS counts_ok, 17 AS features, true AS covered FROM p WHERE label IS NOT NULL
UNION ALL SELECT 'test', count_if(is_test), true, 17, true FROM p WHERE label IS NOT NULL
UNION ALL SELECT 'folds', count_if(NOT is_test), true, 17, true FROM p WHERE label IS NOT NULL
UNION ALL SELECT 'predicted', count(*), true, 17, true FROM p""")
def l8_train_production(spark, sf_dir, sizes=FULL):
    """Training on the production features: base and form union, F1, candidates, split, fit,
    report, cross-validation; then scoring of the raw extract with F1 and backfill."""
    from pertinax.plans.clinical import production_encounters
    from pertinax.plans.training import train_pipeline
    raw = spread(production_encounters(spark, sf_dir))
    even = F.col(schema.ROW_ID) % 2 == 0   # two sources that share the extract
    t = train_pipeline(raw.where(even), raw.where(~even), schema.ROW_ID,
                       L.ModelSpec("forest", "forest", sizes["forest"]), folds=FOLDS)
    folds = t.folds.agg(F.lit("folds").alias("set"), F.sum("n").alias("n"), F.lit(True).alias("counts_ok"))
    scored = D.predict_production(raw, t.model, t.features)
    done = scored.agg(F.lit("predicted").alias("set"), F.count("Prediccion_Modelo").alias("n"),
                      F.lit(True).alias("counts_ok"))
    out = _evaluation_ok(t.evaluation).select("set", "n", "counts_ok").unionByName(folds).unionByName(done)
    return out.withColumns({"features": F.lit(len(t.features)),
                            "covered": F.lit(set(t.features) <= set(scored.columns))})


# --------------------------------------------------------------------- D1, D6, S5, S6, S8, S9

@register("d1_predict", oracle=ENC + """
SELECT row_id, true AS probability_ok, true AS confidence_ok, true AS decision_ok,
  '2026-01-01 00:00:00' AS Fecha_Prediccion FROM enc""")
def d1_predict(spark, sf_dir, sizes=FULL):
    """Fit on the labelled extract, then score every encounter: model label, rounded
    confidence, both probabilities, threshold decision."""
    train, _ = _split(spark, sf_dir)
    model = _fit(train, sizes=sizes)
    df = D.predict(training_frame(spark, sf_dir), model)
    df = D.probability_columns(df, now="2026-01-01 00:00:00")
    df = D.apply_threshold(df, 65)
    yes, no, conf = F.col("`Prob_PERTINENTE_%`"), F.col("`Prob_NO_PERTINENTE_%`"), F.col("`Confianza_%`")
    label = F.when(F.col("p_pert") > F.col("p_no_pert"), schema.LABEL_POS).otherwise(schema.LABEL_NEG)
    decided = F.when(conf < 65, schema.LABEL_UNDETERMINED).otherwise(label)
    return df.select(schema.ROW_ID, (F.abs(yes + no - 100) <= 0.0101).alias("probability_ok"),
                     (conf == F.greatest(yes, no)).alias("confidence_ok"),
                     ((F.col("Prediccion") == decided) & (F.col("Prediccion_Modelo") == label)).alias("decision_ok"),
                     F.col("Fecha_Prediccion").cast("string").alias("Fecha_Prediccion"))


def _raw_extract_csv(spark, sf_dir):
    """Write the encounter extract as a CSV input with original-style headers."""
    from pertinax.plans.catalog_profile import form_extract
    path = _run_dir(spark, "extract-csv")
    sinks.write_table(form_extract(spark, sf_dir), path, "csv")
    return path


@register("d6_score_file", oracle=LAB + """
SELECT (SELECT count(*) FROM enc) AS n, (SELECT count(*) FROM enc) AS decided,
  (SELECT count(*) FROM known) AS validated, true AS shares_ok, true AS rule_ok""")
def d6_score_file(spark, sf_dir, sizes=FULL):
    """Bulk scoring of a CSV extract: refuse without the required columns, prepare -> backfill ->
    predict -> hybrid decision -> write -> validate against the labels that the file has."""
    train, _ = _split(spark, sf_dir)
    model = _fit(train, sizes=sizes)
    src = _raw_extract_csv(spark, sf_dir)
    out = _run_dir(spark, "scored")
    shares = D.score_file(spark, src, model, NUMERIC + BINARY + CATEGORICAL, out, fmt="csv",
                          binary=BINARY, categorical=CATEGORICAL, required=["FC", "FR", "SatO2", "Glasgow"])
    written = spark.read.parquet(out)
    truth = F.upper(F.trim(clean_label("Validacion")))
    labelled = written.withColumn("truth", F.when(truth.isin(schema.LABEL_POS, schema.LABEL_NEG), truth))
    accuracy, _, _ = E.validate_rows(labelled, "truth")
    by_rule = F.when(F.col("CUMPLE_CRITERIO_DECRETO"), schema.LABEL_POS).otherwise(schema.LABEL_NEG)
    low = F.col("Confianza_ML") < 55   # below the confidence the rule decides
    total = shares.select(F.sum("pct")).scalar()
    return written.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("Prediccion").isin(schema.LABEL_POS, schema.LABEL_NEG)).alias("decided"),
        F.coalesce(F.min(~low | (F.col("Prediccion") == by_rule)), F.lit(True)).alias("rule_ok")).withColumns(
            {"validated": accuracy.select("n").scalar(), "shares_ok": F.abs(total - 100) < 1e-6})


@register("s5_write_predictions", oracle=ENC + """
SELECT row_id, Episodio, CUMPLE_CRITERIO_DECRETO, Categoria_Inferida FROM enc""")
def s5_write_predictions(spark, sf_dir):
    s = training_frame(spark, sf_dir).select(schema.ROW_ID, "Episodio", "CUMPLE_CRITERIO_DECRETO",
                                             "Categoria_Inferida")
    path = _run_dir(spark, "predictions")
    sinks.write_predictions(s, path, "parquet", partition_by=["Categoria_Inferida"])
    return spark.read.parquet(path)


@register("s6_write_errors", oracle=LAB + """
SELECT CAST(row_id AS VARCHAR) AS row_id, trim(Episodio) AS Episodio, CAST(CAST(label AS DOUBLE) AS VARCHAR) AS label,
  CAST(CAST(CUMPLE_CRITERIO_DECRETO AS DOUBLE) AS VARCHAR) AS rule FROM known
WHERE label <> CAST(CUMPLE_CRITERIO_DECRETO AS INTEGER)""")
def s6_write_errors(spark, sf_dir):
    """Rule-vs-label errors written as CSV (skipped when there is none)."""
    t = training_frame(spark, sf_dir).where(F.col("label").isNotNull()).withColumn(
        "rule", F.col("CUMPLE_CRITERIO_DECRETO").cast("double"))
    path = _run_dir(spark, "errors")
    wrote = sinks.write_errors(t, "label", "rule", path, [schema.ROW_ID, "Episodio", "label", "rule"])
    out = spark.read.option("header", True).csv(path) if wrote else \
        t.limit(0).select(schema.ROW_ID, "Episodio", "label", "rule")
    return out.withColumn("Episodio", F.trim("Episodio"))


@register("s8_convert_files", oracle="""
SELECT 'customer.csv' AS file, true AS ok, count(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM customer
UNION ALL SELECT 'orders.csv', true, count(*), NULL FROM orders
UNION ALL SELECT 'supplier.csv', true, count(*), NULL FROM supplier""")
def s8_convert_files(spark, sf_dir):
    """CSV -> Parquet conversion of every file of a folder (one job per file)."""
    src = _run_dir(spark, "convert-src")
    for name in ("customer", "supplier", "orders"):
        sinks.write_table(table(spark, sf_dir, name), f"{src}/{name}.csv", "csv")
    return sinks.convert_files(spark, src, _run_dir(spark, "convert-dst"), "csv", "parquet")


@register("s9_model_store", oracle=LAB + """
SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing, 2 AS version, true AS previous_kept FROM known WHERE is_test""")
def s9_model_store(spark, sf_dir, sizes=FULL):
    """Save twice (the first version is kept under a timestamp), reload, re-score."""
    train, test = _split(spark, sf_dir)
    model = _fit(train, sizes=sizes)
    path = _run_dir(spark, "store")
    model_store.save_model(spark, model, path, {"version": 1})
    moved = model_store.save_model(spark, model, path, {"version": 2})
    reloaded, meta = model_store.load_model(spark, path)
    first = model.transform(test).select(*test.columns, F.col("probability").alias("first"))
    scores = reloaded.transform(first)
    same = vector_to_array("probability") == vector_to_array("first")
    return scores.agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("differing")).withColumns(
        {"version": F.lit(meta["version"]), "previous_kept": F.lit(moved is not None)})


@register("d7_score_stream", oracle=ENC + """,
r AS (SELECT row_id, Episodio, list_filter([
  CASE WHEN coalesce(FC <= 0, false) THEN 'fc_no_positiva' END,
  CASE WHEN coalesce(FR <= 0, false) THEN 'fr_no_positiva' END,
  CASE WHEN coalesce(PA_Sistolica <= 0 OR PA_Diastolica <= 0, false) THEN 'presion_no_positiva' END,
  CASE WHEN coalesce(SatO2 <= 0 OR SatO2 > 100, false) THEN 'sato2_fuera_de_rango' END,
  CASE WHEN coalesce(Temperatura < 30 OR Temperatura > 45, false) THEN 'temperatura_fuera_de_rango' END],
  lambda x: x IS NOT NULL) AS rr, array_to_string(list_filter([
  CASE WHEN coalesce(PA_Sistolica < 90 OR PA_Diastolica < 60, false) THEN 'hipotension' END,
  CASE WHEN coalesce(FC > 100, false) THEN 'taquicardia' END,
  CASE WHEN coalesce(Temperatura > 38, false) THEN 'fiebre' END,
  CASE WHEN coalesce(Glasgow < 13, false) THEN 'glasgow_bajo' END,
  CASE WHEN coalesce(""" + O.num("Triage") + """ <= 2, false) THEN 'triage_critico' END,
  CASE WHEN coalesce(SatO2 < 90, false) THEN 'hipoxemia' END], lambda x: x IS NOT NULL), ',') AS alerts FROM enc)
SELECT row_id, Episodio, array_to_string(rr, ',') AS reject_reasons, len(rr) = 0 AS valid, alerts, true AS decision_ok FROM r""")
def d7_score_stream(spark, sf_dir, sizes=FULL):
    """Structured Streaming: the extract lands as files; each arriving record is range
    checked and alerted; those in range are scored and thresholded; the sink is read back."""
    from pertinax.streaming.score_stream import score_stream
    train, _ = _split(spark, sf_dir)
    model = _fit(train, sizes=sizes)
    raw = clinical_encounters(spark, sf_dir)
    src, sink, ckpt = _run_dir(spark, "stream-src"), _run_dir(spark, "stream-out"), _run_dir(spark, "stream-ckpt")
    sinks.write_table(raw.repartition(4, schema.ROW_ID), src, "parquet")
    q = score_stream(spark, src, raw.schema, lambda d: model_input(prepare_clinical(d)), model,
                     sink, ckpt, keep=[schema.ROW_ID, "Episodio"], max_files_per_trigger=1)
    q.awaitTermination()
    conf, model_says = F.col("`Confianza_%`"), F.col("Prediccion_Modelo")
    decided = F.when(conf < 65, schema.LABEL_UNDETERMINED).otherwise(model_says)
    scored = model_says.isin(schema.LABEL_POS, schema.LABEL_NEG) & (F.col("Prediccion") == decided)
    none = model_says.isNull() & conf.isNull() & F.col("Prediccion").isNull()
    return spark.read.parquet(sink).select(
        schema.ROW_ID, "Episodio", "reject_reasons", "valid", "alerts",
        F.when(F.col("valid"), F.coalesce(scored, F.lit(False))).otherwise(none).alias("decision_ok"))


@register("d7_score_stream_versions", oracle=LAB + """
SELECT CAST(row_id AS BIGINT) AS row_id, CASE WHEN row_id % 2 = 0 THEN 1 ELSE 2 END AS version, true AS decision_ok FROM enc""")
def d7_score_stream_versions(spark, sf_dir, sizes=FULL):
    """A stream that scores from a store: the even rows arrive under the first version; a second is
    saved, and the odd rows, arriving after it, are scored by that one when the stream goes on."""
    from pertinax.streaming.score_stream import score_stream_from_store
    train, _ = _split(spark, sf_dir)
    store, src, sink, ckpt = (_run_dir(spark, n) for n in ("stream-store", "stream-src", "stream-out", "stream-ckpt"))
    raw, number = clinical_encounters(spark, sf_dir), {}
    for k, kind in enumerate(("gbt", "forest")):
        model_store.save_model(spark, _fit(train, kind, sizes=sizes), store, {"kind": kind})
        number[model_store.versions(spark, store)[-1]] = k + 1
        sinks.write_table(raw.where(F.col(schema.ROW_ID) % 2 == k), src, "parquet", mode="append")
        score_stream_from_store(spark, src, raw.schema, lambda d: model_input(prepare_clinical(d)), store, sink, ckpt,
                                keep=[schema.ROW_ID]).awaitTermination()
    version = F.create_map(*[x for v, k in number.items() for x in (F.lit(v), F.lit(k))])[F.col("model_version")]
    decided = F.when(F.col("`Confianza_%`") < 65, schema.LABEL_UNDETERMINED).otherwise(F.col("Prediccion_Modelo"))
    return spark.read.parquet(sink).select(
        F.col(schema.ROW_ID).cast("long").alias(schema.ROW_ID), version.cast("int").alias("version"),
        F.when(F.col("valid"), F.coalesce(F.col("Prediccion") == decided, F.lit(False))).otherwise(
            F.col("Prediccion").isNull()).alias("decision_ok"))
