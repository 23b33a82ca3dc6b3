"""Training on the production features (L8): two labelled sources to an evaluated model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions.features import features_production
from pertinax.operators import models as L
from pertinax.operators import prep
from pertinax.operators.project import (clean_label, encode_label, rename_base, rename_form,
                                        select_present)
from pertinax.session import written


@dataclass
class Trained:
    model: object            # scores by its transform()
    features: list[str]
    evaluation: DataFrame    # train and test: accuracy and confusion matrix
    folds: DataFrame         # cross-validation on the training side


def train_pipeline(base: DataFrame, form: DataFrame, key: str, spec: L.ModelSpec | None = None,
                   label: str = "Validacion", folds: int = 5, frac: float = 0.2, seed: int = 42) -> Trained:
    """Rename both sources (P1, P2), union by name (U1), coerce and derive the features (F1), keep
    the candidates that exist (P10), encode the label, split by hash (M1), fit, report, and
    cross-validate.  Default: the forest of 500 trees of depth 20."""
    spec = spec or L.ModelSpec("forest", "forest", dict(numTrees=500, maxDepth=20, minInstancesPerNode=2,
                                                       minSamplesSplit=5))
    both = rename_base(base).unionByName(rename_form(form), allowMissingColumns=True)
    ready = features_production(both, "train").withColumn(
        "label", encode_label(clean_label(label)).cast("double"))
    features = [c for c in schema.PRODUCTION_FEATURES if c in ready.columns]
    rows = select_present(ready.where(F.col("label").isNotNull()), features, [key, "label"])
    rows = rows.withColumns({c: F.col(c).cast("double") for c in features})
    rows = written(prep.stratified_split(rows, key, "label", frac, seed), "training")
    binary = [c for c in features if c in schema.PRODUCTION_BINARY]
    numeric = [c for c in features if c not in binary]
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    model = L.member_pipeline(spec, numeric, binary=binary).fit(train)
    cv = L.cross_validate(train, numeric, spec, key, k=folds, binary=binary)
    return Trained(model, features, L.evaluate_train_test(model, train, test), cv)
