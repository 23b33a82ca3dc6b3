"""ML invariants (the driver's check on models is rows-only): probabilities sum to 1, a
fixed seed reproduces, a learnable rule beats the majority class, pipelines persist."""

import os
import tempfile

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pertinax.operators import models as L
from pertinax.sources import model_store

FEATURES = ["x1", "x2", "noise"]


@pytest.fixture(scope="module")
def learnable(spark):
    df = spark.range(600).select(
        F.col("id").alias("row_id"),
        ((F.col("id") * 37) % 100).cast("double").alias("x1"),
        ((F.col("id") * 11) % 50).cast("double").alias("x2"),
        ((F.col("id") * 7919) % 13).cast("double").alias("noise"))
    df = df.withColumn("x2", F.when(F.col("row_id") % 9 == 0, None).otherwise(F.col("x2")))
    return df.withColumn("label", F.when(F.col("x1") > 60, 1.0).otherwise(0.0)).cache()


def _small(kind="forest"):
    return L.ModelSpec(kind, kind, dict(numTrees=10, maxDepth=4) if kind == "forest"
                       else dict(maxIter=10, maxDepth=3))


def test_forest_learns_and_probabilities_sum_to_one(spark, learnable):
    model = L.member_pipeline(_small(), FEATURES).fit(learnable)
    out = model.transform(learnable)
    p = out.select(vector_to_array("probability").alias("p"), "prediction", "label")
    sums = p.select(F.max(F.abs(F.aggregate("p", F.lit(0.0), lambda a, b: a + b) - 1))).first()[0]
    assert sums < 1e-9
    acc = p.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    majority = learnable.select(F.avg("label")).first()[0]
    assert acc > max(majority, 1 - majority) + 0.1


def test_same_seed_same_output(spark, learnable):
    a = L.member_pipeline(_small(), FEATURES).fit(learnable).transform(learnable)
    b = L.member_pipeline(_small(), FEATURES).fit(learnable).transform(learnable)
    pa = [r[0] for r in a.select(vector_to_array("probability")[1]).orderBy("row_id").collect()]
    pb = [r[0] for r in b.select(vector_to_array("probability")[1]).orderBy("row_id").collect()]
    assert pa == pb


def test_soft_vote_and_search(spark, learnable):  # a vote takes the members it names
    train = learnable.where(F.col("row_id") % 5 != 0)
    test = learnable.where(F.col("row_id") % 5 == 0)
    members = [("a_", L.member_pipeline(_small(), FEATURES, prefix="a_").fit(train)),
               ("b_", L.member_pipeline(_small("gbt"), FEATURES, prefix="b_").fit(train))]
    v = L.soft_vote(members, test)
    assert v.count() == test.count()
    assert v.where((F.col("p_pert") < 0) | (F.col("p_pert") > 1)).count() == 0
    specs = [_small(), _small("gbt"), L.ModelSpec("both", "vote", members=["forest", "gbt"])]
    board, best = L.search(specs, train, test, test, FEATURES)
    rows = board.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and best is not None
    assert {r["external_n"] for r in rows} == {test.count()}


def test_cross_validate_summary(spark, learnable):
    cv = L.cross_validate(learnable, FEATURES, _small(), "row_id", k=3).collect()
    assert len(cv) == 3 and sum(r["n"] for r in cv) == 600
    assert cv[0]["mean"] == pytest.approx(sum(r["accuracy"] for r in cv) / 3)


def test_model_store_roundtrip_keeps_previous(spark, learnable):
    model = L.member_pipeline(_small(), FEATURES).fit(learnable)
    path = os.path.join(tempfile.mkdtemp(prefix="pertinax-store-"), "m")
    assert model_store.save_model(spark, model, path, {"v": 1}) is None
    moved = model_store.save_model(spark, model, path, {"v": 2})
    assert moved is not None and os.path.isdir(moved)
    reloaded, meta = model_store.load_model(spark, path)
    assert meta["v"] == 2
    a = model.transform(learnable).select(vector_to_array("probability")[1]).collect()
    b = reloaded.transform(learnable).select(vector_to_array("probability")[1]).collect()
    assert a == b


def test_per_kind_preparation(spark):
    from pyspark.ml import Pipeline
    df = spark.createDataFrame(
        [(1.0, 1.0, "a"), (None, 1.0, "b"), (3.0, None, "a"), (10.0, 0.0, None)],
        "x double, flag double, cat string")
    stages = L.prep_stages(["x"], scale=False, binary=["flag"], categorical=["cat"])
    out = Pipeline(stages=stages).fit(df.fillna({"cat": "z"})).transform(df.fillna({"cat": "z"}))
    rows = out.select("x__imp", "flag__bin").collect()
    assert sorted(r["x__imp"] for r in rows) == [1.0, 3.0, 3.0, 10.0]      # exact median 3
    assert sorted(r["flag__bin"] for r in rows) == [0.0, 1.0, 1.0, 1.0]    # mode 1
    assert out.select(F.size(vector_to_array("features"))).first()[0] == 1 + 1 + 3


def test_stratified_folds_differ_by_at_most_one(spark):
    df = spark.range(3001).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("double").alias("label"))
    out = L.fold_column(df, "row_id", "label", k=5)
    assert out.columns == ["row_id", "label", "fold"] and out.count() == 3001
    per = out.groupBy("label").pivot("fold", list(range(5))).count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in per)


def test_rejected_records_get_no_score_and_missing_columns_refuse(spark, learnable):
    from pertinax.operators import score as D
    with tempfile.TemporaryDirectory() as folder:
        learnable.select("row_id", "x1").write.option("header", True).csv(f"{folder}/in")
        with pytest.raises(ValueError, match="Glasgow"):
            D.score_file(spark, f"{folder}/in", None, ["x1"], f"{folder}/out", required=["Glasgow"])
        assert not os.path.exists(f"{folder}/out")
    one = spark.createDataFrame([(0.6499,), (0.65,), (0.3,), (0.5,)], "p double")
    assert [r[0] for r in one.select(D.decide_one(F.col("p"), 65)).collect()] == [
        "INDETERMINADO - Requiere revisión manual", "PERTINENTE", "NO PERTINENTE",
        "INDETERMINADO - Requiere revisión manual"]


def test_registered_models_have_the_published_sizes():
    from pertinax.plans import catalog_ml as M

    forest, gbt, boosted = (L.tree_spec(L.ModelSpec(k, M.KIND[k], M.FULL[k])) for k in ("forest", "gbt", "boosted"))
    assert (forest.trees, forest.depth, forest.min_split, forest.min_leaf) == (500, 20, 5, 2) and M.FOLDS == 5
    assert (gbt.trees, gbt.depth, gbt.step, gbt.subsample, gbt.l2) == (300, 7, 0.05, 0.8, 0.0)
    assert (boosted.trees, boosted.depth, boosted.step, boosted.tree_columns, boosted.l2) == (500, 7, 0.03, 0.8, 1.0)
    assert len(M.SEARCH) == 8 and [len(c.members) for c in M.SEARCH] == [0, 0, 0, 0, 2, 2, 3, 4]
    assert [m.params["maxIter" if m.kind == "boost" else "numTrees"] for c in M.SEARCH for m in c.members] == [
        400, 400, 400, 300, 350, 300, 250, 300, 200, 200, 200]
