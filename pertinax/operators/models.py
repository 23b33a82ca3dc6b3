"""Models, ensembles, search and validation.

Forests and second-order boosting are trained by ``ensembles``; plain gradient boosting (``gbt``) is
Spark ML's.  What a model learns of its preparation (medians, bins) it learns from its own training rows,
so a fold's model knows nothing of the fold — the original fitted the preparation once before CV, which
leaks (trap T9).  All folds of a cross-validation, and all members of a search, are trained by the same jobs.
"""

from __future__ import annotations

from contextlib import contextmanager
from copy import copy
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.operators import ensembles
from pertinax.operators.ml_stages import ExactMedianImputer, PopulationStandardScaler
from pertinax.session import written

MAX_DEPTH_SPARK = 30


@contextmanager
def cached(df: DataFrame):
    """Keep a training frame materialised for the several passes a fit makes (imputer,
    scaler and indexer fits, split finding, bagging); released when the fit is done.
    MEMORY_AND_DISK spills instead of failing, and a lost block is recomputed from
    lineage, so executor loss only costs time."""
    from pyspark import StorageLevel
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


@dataclass
class ModelSpec:
    """One candidate configuration (a row of the search grid)."""
    name: str
    kind: str = "forest"            # forest | boost | gbt (Spark ML) | vote
    params: dict = field(default_factory=dict)
    weighted: bool = False           # use the class-weight column
    members: list = field(default_factory=list)   # vote: names of other configurations, or own ones


#: Parameter -> its name in a tree specification.
_SIZES = {"numTrees": "trees", "maxIter": "trees", "maxDepth": "depth", "minInstancesPerNode": "min_leaf",
          "minSamplesSplit": "min_split", "columnShare": "tree_columns", "subsamplingRate": "subsample",
          "stepSize": "step", "lambda": "l2", "alpha": "l1", "gamma": "min_gain", "minChildWeight": "min_hessian",
          "seed": "seed"}


def tree_spec(spec: ModelSpec) -> ensembles.TreeSpec:
    """The trainer's view of a forest or boosted configuration."""
    known = {_SIZES[k]: v for k, v in spec.params.items()}
    if spec.kind == "forest":
        known = {"min_split": 2, **known}
    else:
        known = {"trees": 300, "depth": 7, "min_split": 2, "min_leaf": 1, **known}
    return ensembles.TreeSpec(kind=spec.kind, **known)


def row_key(df: DataFrame) -> Column:
    """A number that the row's content decides: its id if there is one, else all plain columns."""
    if schema.ROW_ID in df.columns:
        return F.xxhash64(schema.ROW_ID)
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "<" not in kind and kind not in ("vector", "variant")])


def feature_set(df: DataFrame, numeric: list[str], categorical: list[str] | None = None,
                binary: list[str] | None = None) -> ensembles.Features:
    return ensembles.Features(list(numeric), list(binary or []), ensembles.categories(df, list(categorical or [])))


class EnsemblePipeline:
    """Fits one forest or boosted model; the counterpart of a Spark ML pipeline."""

    def __init__(self, spec: ModelSpec, features, label, weight, prefix, categorical, binary):
        self.spec, self.features, self.label, self.weight = spec, features, label, weight
        self.prefix, self.categorical, self.binary = prefix, categorical, binary

    def fit(self, df: DataFrame) -> ensembles.Ensemble:
        weighted = bool(self.spec.weighted and self.weight)
        member = ensembles.Member(self.spec.name, tree_spec(self.spec), weighted)
        model = ensembles.fit(df, feature_set(df, self.features, self.categorical, self.binary), [member],
                              row_key(df), self.label, self.weight if weighted else None)[self.spec.name]
        model.prefix = self.prefix
        return model


def classifier(spec: ModelSpec, label: str = "label", features: str = "features",
               weight: str | None = None, prefix: str = ""):
    """Spark ML's gradient boosting."""
    from pyspark.ml.classification import GBTClassifier
    if spec.kind != "gbt":
        raise ValueError(f"unknown model kind {spec.kind!r}")
    out = dict(labelCol=label, featuresCol=features, predictionCol=f"{prefix}prediction")
    if spec.weighted and weight:
        out["weightCol"] = weight
    p = dict(spec.params)
    if int(p.get("maxDepth", 0)) > MAX_DEPTH_SPARK:
        raise ValueError(f"{spec.name}: trees deeper than {MAX_DEPTH_SPARK} are not supported")
    p.setdefault("seed", 42)
    est = GBTClassifier(**out, **p)
    return est.setProbabilityCol(f"{prefix}probability").setRawPredictionCol(f"{prefix}rawPrediction")


def prep_stages(features: list[str], impute: bool = True, scale: bool = True,
                out: str = "features", prefix: str = "", categorical: list[str] | None = None,
                binary: list[str] | None = None):
    """Per-kind preparation (M2): numeric -> exact median imputation -> population scaling;
    binary -> most-frequent imputation (Spark ``Imputer(strategy='mode')``, exact, smallest
    value on ties); categorical -> one-hot; then one vector."""
    from pyspark.ml.feature import Imputer
    from pertinax.operators.prep import one_hot_stages
    stages, cols = [], list(features)
    if impute:
        imp = [f"{prefix}{c}__imp" for c in cols]
        stages.append(ExactMedianImputer(inputCols=cols, outputCols=imp))
        cols = imp
    if scale:
        sc = [f"{prefix}{c}__sc" for c in cols]
        stages.append(PopulationStandardScaler(inputCols=cols, outputCols=sc))
        cols = sc
    bins = list(binary or [])
    if bins:
        bout = [f"{prefix}{c}__bin" for c in bins]
        stages.append(Imputer(inputCols=bins, outputCols=bout, strategy="mode"))
        cols = cols + bout
    cats = list(categorical or [])
    if cats:
        stages += one_hot_stages(cats, prefix=prefix)
        cols = cols + [f"{prefix}{c}__ohe" for c in cats]
    stages.append(VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep"))
    return stages


def train_forest(train: DataFrame, features: list[str], label: str = "label",
                 weight: str | None = None, num_trees: int = 500, max_depth: int = 20,
                 min_instances: int = 2, min_split: int = 5, seed: int = 42) -> ensembles.Ensemble:
    """L1: balanced random forest (defaults: 500 trees, depth 20, split 5, leaf 2, seed 42)."""
    spec = ModelSpec("forest", "forest", dict(numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_instances,
                                              minSamplesSplit=min_split, seed=seed), weighted=weight is not None)
    return member_pipeline(spec, features, label, weight).fit(train)


def train_gbt(train: DataFrame, features: list[str], label: str = "label",
              max_iter: int = 300, max_depth: int = 7, step: float = 0.05,
              subsample: float = 0.8, weight: str | None = None) -> PipelineModel:
    """L2: Spark ML's gradient-boosted trees."""
    spec = ModelSpec("gbt", "gbt", dict(maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                                        subsamplingRate=subsample), weighted=weight is not None)
    return Pipeline(stages=prep_stages(features) + [classifier(spec, label, weight=weight)]).fit(train)


def train_boosted(train: DataFrame, features: list[str], label: str = "label", weight: str | None = None,
                  **params) -> ensembles.Ensemble:
    """L2/L3: second-order boosting; ``params`` as in a search configuration (``maxIter``, ``maxDepth``,
    ``stepSize``, ``subsamplingRate``, ``columnShare``, ``lambda``, ``alpha``, ``gamma``, ...)."""
    return member_pipeline(ModelSpec("boost", "boost", params, weighted=weight is not None), features, label, weight).fit(train)


def with_pos_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """L3: boosted members weight positives by n_neg / n_pos (scalar subqueries)."""
    t = df.select(F.struct(F.count_if(F.col(label) == 1).alias("pos"),
                           F.count_if(F.col(label) == 0).alias("neg"))).scalar()
    ratio = F.try_divide(t.getField("neg").cast("double"), t.getField("pos"))
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def positive_probability(model, df: DataFrame, prob: str = "probability",
                         out: str = "p_pert") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array(F.col(prob))[1])


def member_pipeline(spec: ModelSpec, features: list[str], label: str = "label",
                    weight: str | None = None, prefix: str = "",
                    categorical: list[str] | None = None,
                    binary: list[str] | None = None) -> Pipeline | EnsemblePipeline:
    """A complete pipeline whose every output column carries ``prefix`` (ensemble member).
    ``features`` are numeric; ``binary`` and ``categorical`` get their own preparation."""
    if spec.kind in ("forest", "boost"):
        return EnsemblePipeline(spec, features, label, weight, prefix, categorical, binary)
    return Pipeline(stages=prep_stages(features, out=f"{prefix}features", prefix=prefix,
                                       categorical=categorical, binary=binary)
                    + [classifier(spec, label, f"{prefix}features", weight, prefix)])


def fit_members(specs: dict[str, ModelSpec], train: DataFrame, features: list[str], label: str = "label",
                weight: str | None = None, categorical: list[str] | None = None, binary: list[str] | None = None) -> list[tuple]:
    """Forest and boosted members of a vote, by prefix, trained together on one binned table."""
    members = [ensembles.Member(prefix, tree_spec(s), bool(s.weighted and weight)) for prefix, s in specs.items()]
    fitted = ensembles.fit(train, feature_set(train, features, categorical, binary), members, row_key(train), label, weight)
    return [(prefix, _prefixed(fitted[prefix], prefix)) for prefix in specs]


def soft_vote(members: list[tuple], df: DataFrame) -> DataFrame:
    """L4: mean of the members' class probabilities, argmax (tie -> class 0).

    ``members`` are ``(prefix, model)`` pairs built with :func:`member_pipeline`, so their
    columns never collide: the members run one after another on the same rows as plain
    projections — no join, no shuffle.
    """
    out = df
    for prefix, m in members:
        out = m.transform(out)
    p, prediction = vote([vector_to_array(F.col(f"{prefix}probability"))[1] for prefix, _ in members], "p_pert")
    return out.withColumns({"p_pert": p, "prediction": prediction})


def vote(scores: list, out: str = "p_vote") -> list:
    """Mean of the members' scores and the class it gives (a tie is class 0)."""
    mean = sum(scores[1:], scores[0]) / len(scores)
    return [mean.alias(out), F.when(mean > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction")]


def _accuracy(predicted: DataFrame, label: str) -> DataFrame:
    """One row: ``n, hits, errors, accuracy`` and the confusion matrix ``tn, fp, fn, tp``."""
    real, pred = F.col(label).cast("int"), F.col("prediction").cast("int")
    cell = lambda r, p: F.count_if((real == r) & (pred == p))
    m = predicted.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    hits, errors = F.col("tn") + F.col("tp"), F.col("fp") + F.col("fn")
    return m.select((hits + errors).alias("n"), hits.alias("hits"), errors.alias("errors"),
                    F.try_divide(hits.cast("double"), hits + errors).alias("accuracy"), "tn", "fp", "fn", "tp")


def evaluate(model, df: DataFrame, label: str = "label") -> DataFrame:
    """L7 building block: accuracy and confusion matrix of one data set, in one aggregate."""
    return _accuracy(model.transform(df), label)


def evaluate_train_test(model, train: DataFrame, test: DataFrame,
                        label: str = "label") -> DataFrame:
    """``(set, n, hits, errors, accuracy, tn, fp, fn, tp)`` on train and test."""
    a = evaluate(model, train, label).withColumn("set", F.lit("train"))
    return a.unionByName(evaluate(model, test, label).withColumn("set", F.lit("test")))


def fold_column(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified folds: the rows of a class, in hash order, are dealt out in turn, so fold sizes
    differ by at most one per class.  The rank in a class is distributed: hash ranges hold about
    equal shares of every class, are ranked each for itself and shifted by the counts before."""
    h = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"fold{seed}"))), 1, 8)
    tmp = df.withColumns({"__h": h, "__b": F.substring(h, 1, 3)})
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # a few thousand ranges per class
    shift = tmp.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c")).select(
        F.col(label).alias("__l"), F.col("__b").alias("__of"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    inside = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)) - 1
    ranked = tmp.withColumn("__r", inside).join(
        shift, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__of")))
    return ranked.select(*df.columns, ((F.col("__r") + F.col("__s")) % k).cast("int").alias(out))


def cross_validate(df: DataFrame, features: list[str], spec: ModelSpec, key: str,
                   label: str = "label", k: int = 5, weight: str | None = None,
                   binary: list[str] | None = None, categorical: list[str] | None = None) -> DataFrame:
    """Stratified k-fold CV with preparation refitted per fold; returns one row per fold plus
    ``mean`` and ``two_std`` (population) columns over the fold accuracies.

    The folds of a forest or boosted model are members of one training on one binned table; then
    each row is scored by its own fold's model in a single pass."""
    folded = written(fold_column(df, key, label, k), "folds")
    if spec.kind in ("forest", "boost"):
        weighted = bool(spec.weighted and weight)
        members = [ensembles.Member(f"fold{i}", tree_spec(spec), weighted, i) for i in range(k)]
        models = ensembles.fit(folded, feature_set(df, features, categorical, binary), members, F.xxhash64(key), label,
                               weight if weighted else None, "fold")
        scored = ensembles.score_each(folded, [models[m.name] for m in members], F.col("fold"))
        hit = F.when(F.col("p_pert") > 0.5, 1.0).otherwise(0.0) == F.col(label)
        per = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
        return _with_summary(written(per.select("fold", "n", "hits", (F.col("n") - F.col("hits")).alias("errors"),
                                                (F.col("hits") / F.col("n")).alias("accuracy")), "fold-scores"))
    rows = []
    for i in range(k):
        model = member_pipeline(spec, features, label, weight, "", categorical, binary).fit(folded.where(F.col("fold") != i))
        rows.append((i, *evaluate(model, folded.where(F.col("fold") == i), label)
                     .select("n", "hits", "errors", "accuracy").first()))
    return _with_summary(df.sparkSession.createDataFrame(
        rows, "fold int, n long, hits long, errors long, accuracy double"))


def _with_summary(rows: DataFrame) -> DataFrame:
    """Fold rows plus mean and 2·σ_pop of the fold accuracies (scalar subqueries)."""
    mean = rows.select(F.avg("accuracy")).scalar()
    two_std = rows.select(2 * F.stddev_pop("accuracy")).scalar()
    return rows.select("fold", "n", "hits", "accuracy", mean.alias("mean"), two_std.alias("two_std"))


def search(specs: list[ModelSpec], train: DataFrame, test: DataFrame, external: DataFrame,
           features: list[str], label: str = "label", weight: str | None = None,
           binary: list[str] | None = None, categorical: list[str] | None = None):
    """Fit every configuration, score the internal test and the external set, rank by
    external accuracy (O1).  A ``vote`` has members of its own, or names other configurations.

    All forests and boosted members, those of the votes too, are trained together on one binned
    table; each set is then scored by all of them in one pass.  Returns ``(leaderboard, best)``: the
    best entry is a list of ``(prefix, model)`` for :func:`soft_vote`."""
    from pertinax.operators.order import leaderboard
    parts: dict[str, list[str]] = {}          # configuration -> names of its members
    single: dict[str, ModelSpec] = {}
    for spec in specs:
        parts[spec.name] = [spec.name]
        if spec.kind != "vote":
            single[spec.name] = spec
    for spec in specs:
        if spec.kind == "vote":
            own = {f"{spec.name}/{m.name}": m for m in spec.members if isinstance(m, ModelSpec)}
            single |= own
            parts[spec.name] = list(own) + [n for m in spec.members if isinstance(m, str) for n in parts[m]]
    joint = [ensembles.Member(name, tree_spec(m), bool(m.weighted and weight)) for name, m in single.items()
             if m.kind in ("forest", "boost")]
    fitted = ensembles.fit(train, feature_set(train, features, categorical, binary), joint, row_key(train), label, weight)
    with cached(train) as tr:
        for name, m in single.items():
            if name not in fitted:
                fitted[name] = member_pipeline(m, features, label, weight, "", categorical, binary).fit(tr)
    prefix = {name: f"m{i}_" for i, name in enumerate(single)}
    fitted = {name: _prefixed(model, prefix[name]) for name, model in fitted.items()}    # each is read once for both sets
    sets = [_accuracies(parts, fitted, prefix, d, label).first().asDict() for d in (test, external)]
    results = [(spec.name, spec.kind, sets[0]["n"], float(sets[0][f"a{i}"] or 0.0), sets[1]["n"], float(sets[1][f"a{i}"] or 0.0))
               for i, spec in enumerate(specs)]
    res = train.sparkSession.createDataFrame(
        results, "name string, kind string, test_n long, test_accuracy double, external_n long, external_accuracy double")
    board = leaderboard(res, "external_accuracy", "name", gap_of=("external_accuracy", "test_accuracy"))
    best = min(results, key=lambda r: (-r[5], r[0]))[0] if results else None
    return board, [(prefix[n], fitted[n]) for n in parts[best]] if best else None


def _prefixed(model, prefix: str):
    """An ensemble that writes its columns under a prefix; a Spark ML model is renamed as it scores."""
    if isinstance(model, ensembles.Ensemble):
        model = copy(model)
        model.prefix = prefix
        return model
    return _Renamed(model, prefix)


class _Renamed:
    """A pipeline model fitted without a prefix, whose result columns get one."""

    def __init__(self, model: PipelineModel, prefix: str):
        self.model, self.prefix = model, prefix

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *[
            F.col(c).alias(self.prefix + c) for c in ("probability", "prediction")])


def _accuracies(parts: dict[str, list[str]], fitted: dict, prefix: dict[str, str], df: DataFrame, label: str) -> DataFrame:
    """One row: ``n`` and the accuracy of every configuration, in order; models write under their prefix."""
    out, p = df, {}
    for name, model in fitted.items():
        out = model.transform(out)
        p[name] = vector_to_array(F.col(f"{prefix[name]}probability"))[1]
    hits = [(vote([p[m] for m in names])[1] == F.col(label)).cast("double") for names in parts.values()]
    names = {name: f"a{i}" for i, name in enumerate(parts)}
    return out.agg(F.count(label).alias("n"), *[F.avg(h).alias(names[c]) for c, h in zip(parts, hits)])
