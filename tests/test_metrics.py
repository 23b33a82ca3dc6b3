"""Published confusion matrices as golden input for A13–A16, plus decisions."""

import pytest
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.operators import errors as E
from pertinax.operators import metrics as M
from pertinax.operators import score as D


def matrix_rows(spark, nn, np_, pn, pp):
    """Expand a 2x2 matrix (NN, NP, PN, PP) into one row per case via range + stack."""
    base = spark.range(nn + np_ + pn + pp)
    idx = F.col("id")
    real = F.when(idx < nn + np_, 0).otherwise(1)
    pred = (F.when(idx < nn, 0).when(idx < nn + np_, 1).when(idx < nn + np_ + pn, 0).otherwise(1))
    return base.select(real.alias("real"), pred.alias("pred"))


@pytest.mark.parametrize("cells,acc", [((403, 94, 107, 551), 0.8260), ((148, 58, 44, 275), 0.8057)])
def test_published_matrices(spark, cells, acc):
    df = matrix_rows(spark, *cells)
    cm = {(r["real"], r["pred"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert [cm[(0, 0)], cm[(0, 1)], cm[(1, 0)], cm[(1, 1)]] == list(cells)
    a = M.accuracy(df).first()
    assert round(a["accuracy"], 4) == acc
    rep = {r["label"]: r for r in M.classification_report(df, names=["NO", "PERT"]).collect()}
    nn, np_, pn, pp = cells
    assert rep["PERT"]["precision"] == pytest.approx(pp / (pp + np_))
    assert rep["NO"]["recall"] == pytest.approx(nn / (nn + np_))
    assert rep["accuracy"]["f1"] == pytest.approx(a["accuracy"])
    per = M.per_class_metrics(df).first()
    assert (per["vn"], per["fp"], per["fn"], per["vp"]) == cells
    assert per["recall_pos"] == pytest.approx(pp / (pp + pn))


def test_published_precision_recall_rounding(spark):
    # test set: precision NO/PERT 79 %/85 %, recall NO/PERT 81 %/84 %
    rep = {r["label"]: r for r in
           M.classification_report(matrix_rows(spark, 403, 94, 107, 551), names=["NO", "PERT"]).collect()}
    assert (round(rep["NO"]["precision"] * 100), round(rep["PERT"]["precision"] * 100)) == (79, 85)
    assert (round(rep["NO"]["recall"] * 100), round(rep["PERT"]["recall"] * 100)) == (81, 84)


def test_empty_class_gives_zero_not_error(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "real int, pred int")
    cm = {(r["real"], r["pred"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert rep["0"]["precision"] == 0.0 and rep["0"]["support"] == 0
    per = M.per_class_metrics(df).first()
    assert per["precision_neg"] == 0.0 and per["accuracy"] == 1.0


def test_null_truth_is_excluded(spark):
    df = spark.createDataFrame([(None, 1), (1, 1), (0, 1)], "real int, pred int")
    a = M.accuracy(df).first()
    assert (a["n"], a["hits"], a["accuracy"]) == (2, 1, 0.5)


def test_compare_to_baseline(spark):
    a = M.accuracy(matrix_rows(spark, 148, 58, 44, 275))
    r = M.compare_to_baseline(a).first()
    assert r["delta_cases"] == 423 - 366
    assert r["delta_points"] == pytest.approx((423 / 525 - 0.6971) * 100)


def test_decisions(spark):
    rows = [(1, 0.90, "PERTINENTE", False), (2, 0.54, "PERTINENTE", True),
            (3, 0.54, "PERTINENTE", False), (4, 0.55, "NO PERTINENTE", True)]
    df = spark.createDataFrame(rows, "id int, conf double, Prediccion_Modelo string, "
                                     "CUMPLE_CRITERIO_DECRETO boolean")
    h = {r["id"]: r for r in D.decision_method(D.hybrid_decision(df)).collect()}
    assert [h[i]["Prediccion"] for i in (1, 2, 3, 4)] == [
        "PERTINENTE", "PERTINENTE", "NO PERTINENTE", "NO PERTINENTE"]
    assert [h[i]["Metodo_Decision"] for i in (1, 2, 3, 4)] == [
        schema.METHOD_HIGH_CONF, schema.METHOD_DECREE, schema.METHOD_CONSERVATIVE, schema.METHOD_HIGH_CONF]
    assert h[2]["Confianza_ML"] == 54.0
    pure = D.decision_method(df.drop("CUMPLE_CRITERIO_DECRETO")).first()
    assert pure["Metodo_Decision"] == schema.METHOD_PURE
    t = df.withColumn("Confianza_%", F.col("conf") * 100)
    got = [r["Prediccion"] for r in D.apply_threshold(t, 65).orderBy("id").collect()]
    assert got[0] == "PERTINENTE" and got[1] == schema.LABEL_UNDETERMINED
    with pytest.raises(ValueError):
        D.apply_threshold(t, 63)


def test_score_summary_and_errors(spark):
    df = spark.createDataFrame([("A", "PERTINENTE", "PERTINENTE"), ("B", "PERTINENTE", "NO PERTINENTE"),
                                ("C", "NO PERTINENTE", "PERTINENTE"),
                                ("D", "NO PERTINENTE", schema.LABEL_UNDETERMINED)],
                               "ep string, real string, Prediccion string")
    s = M.score_summary(df).first()
    assert (s["total"], s["pertinente"], s["no_pertinente"], s["indeterminado"]) == (4, 2, 1, 1)
    e = E.error_types(df.where(F.col("Prediccion") != schema.LABEL_UNDETERMINED), "real", "Prediccion").first()
    assert (e["false_pos"], e["false_neg"], e["correct"]) == (1, 1, 1)
    errs = E.errors(df, "ep", "real", "Prediccion").collect()
    assert sorted(r["ep"] for r in errs) == ["B", "C", "D"]


def test_validate_scored_joins_the_truth_of_another_table(spark):
    from pertinax.operators import errors as ER
    pred = spark.createDataFrame([(1, "PERTINENTE", True), (2, "NO PERTINENTE", False), (3, "PERTINENTE", False)],
                                 "row_id long, Prediccion string, CUMPLE_CRITERIO_DECRETO boolean")
    truth = spark.createDataFrame([(1, "\tpertinente "), (2, "PERTINENTE"), (3, None), (4, "PERTINENTE")],
                                  "row_id long, real string")
    acc, origin, label = ER.validate_scored(pred, truth, "real", "Prediccion")
    r = acc.first()
    assert (r["n"], r["hits"], r["errors"], r["accuracy"]) == (2, 1, 1, 0.5)
    assert {x["origin"]: (x["n"], x["hits"]) for x in origin.collect()} == {"decree": (1, 1), "model": (1, 0)}
    assert [(x["real"], x["cases"], x["hits"]) for x in label.collect()] == [("PERTINENTE", 2, 1)]
