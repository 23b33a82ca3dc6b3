"""Evaluation metrics.

Every metric is one global conditional aggregate (partial aggregation on each executor,
a single tiny final merge) followed by a projection that reshapes the one result row into
report rows with ``inline``: one scan, no window, no collect.  The only join is attaching the
per-class weight table (one row per class) back to the rows in ``with_class_weights``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertinax import schema


def _ratio(num: Column, den: Column) -> Column:
    """Guarded division: 0 when the denominator is 0 (sklearn ``zero_division=0``)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _both_known(real: str, pred: str) -> Column:
    return F.col(real).isNotNull() & F.col(pred).isNotNull()


def confusion_matrix(df: DataFrame, real: str = "real", pred: str = "pred",
                     classes=(0, 1)) -> DataFrame:
    """k×k counts ``(real, pred, n)``, fixed class order, zero cells kept."""
    cells = [(r, p) for r in classes for p in classes]
    counts = df.agg(*[F.count_if((F.col(real) == F.lit(r)) & (F.col(pred) == F.lit(p)))
                    .alias(f"c{i}") for i, (r, p) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(r).alias(real), F.lit(p).alias(pred), F.col(f"c{i}").alias("n"))
                     for i, (r, p) in enumerate(cells)])
    return counts.select(F.inline(rows))


def accuracy(df: DataFrame, real: str = "real", pred: str = "pred") -> DataFrame:
    """``(n, hits, errors, accuracy)`` over rows with a known truth and prediction."""
    known = _both_known(real, pred)
    agg = df.agg(F.count_if(known).alias("n"),
                 F.count_if(known & (F.col(real) == F.col(pred))).alias("hits"))
    return agg.select("n", "hits", (F.col("n") - F.col("hits")).alias("errors"),
                      _ratio(F.col("hits"), F.col("n")).alias("accuracy"))


def _class_counts(df: DataFrame, real: str, pred: str, classes) -> DataFrame:
    aggs = [F.count_if(_both_known(real, pred)).alias("total"),
            F.count_if(_both_known(real, pred) & (F.col(real) == F.col(pred))).alias("hits")]
    for i, c in enumerate(classes):
        aggs += [F.count_if((F.col(real) == F.lit(c)) & (F.col(pred) == F.lit(c))).alias(f"tp{i}"),
                 F.count_if((F.col(real) != F.lit(c)) & (F.col(pred) == F.lit(c))).alias(f"fp{i}"),
                 F.count_if((F.col(real) == F.lit(c)) & (F.col(pred) != F.lit(c))).alias(f"fn{i}")]
    return df.agg(*aggs)


def classification_report(df: DataFrame, real: str = "real", pred: str = "pred",
                          classes=(0, 1), names=None) -> DataFrame:
    """Per-class precision/recall/F1/support, then accuracy, macro and weighted avg.

    Rows ``(label, precision, recall, f1, support)``; the accuracy row carries the
    accuracy in ``f1`` and NULL precision/recall, like the text report it replaces.
    """
    names = [str(c) for c in classes] if names is None else list(names)
    k = len(classes)
    cnt = _class_counts(df, real, pred, classes)
    per = []
    for i in range(k):
        tp, fp, fn = F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")
        p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
        per.append((p, r, _ratio(2 * p * r, p + r), tp + fn))
    total = F.col("total")
    macro = [sum((x[j] for x in per), F.lit(0.0)) / k for j in range(3)]
    weighted = [_ratio(sum((x[j] * x[3] for x in per), F.lit(0.0)), total) for j in range(3)]
    rows = [F.struct(F.lit(names[i]).alias("label"), per[i][0].alias("precision"),
                     per[i][1].alias("recall"), per[i][2].alias("f1"),
                     per[i][3].alias("support")) for i in range(k)]
    rows.append(F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"),
                         _ratio(F.col("hits"), total).alias("f1"), total.alias("support")))
    rows.append(F.struct(F.lit("macro avg").alias("label"), macro[0].alias("precision"),
                         macro[1].alias("recall"), macro[2].alias("f1"), total.alias("support")))
    rows.append(F.struct(F.lit("weighted avg").alias("label"), weighted[0].alias("precision"),
                         weighted[1].alias("recall"), weighted[2].alias("f1"),
                         total.alias("support")))
    return cnt.select(F.inline(F.array(*rows)))


def per_class_metrics(df: DataFrame, real: str = "real", pred: str = "pred",
                      neg=0, pos=1) -> DataFrame:
    """Explicit VN/FP/FN/VP with guarded precision, recall, specificity, F1."""
    r, p = F.col(real), F.col(pred)
    agg = df.agg(F.count_if((r == neg) & (p == neg)).alias("vn"),
                 F.count_if((r == neg) & (p == pos)).alias("fp"),
                 F.count_if((r == pos) & (p == neg)).alias("fn"),
                 F.count_if((r == pos) & (p == pos)).alias("vp"))
    vn, fp, fn, vp = (F.col(c) for c in ("vn", "fp", "fn", "vp"))
    prec_pos, rec_pos = _ratio(vp, vp + fp), _ratio(vp, vp + fn)
    return agg.select(
        "vn", "fp", "fn", "vp",
        _ratio(vn, vn + fn).alias("precision_neg"),
        _ratio(vn, vn + fp).alias("recall_neg"),
        prec_pos.alias("precision_pos"),
        rec_pos.alias("recall_pos"),
        _ratio(2 * prec_pos * rec_pos, prec_pos + rec_pos).alias("f1_pos"),
        _ratio(vn + vp, vn + fp + fn + vp).alias("accuracy"))


def accuracy_by_origin(df: DataFrame, real: str = "real", pred: str = "pred",
                       rule: str = "CUMPLE_CRITERIO_DECRETO") -> DataFrame:
    """Rule-hit vs model-only subsets: ``(origin, n, hits, accuracy)``, 0 when empty."""
    known = _both_known(real, pred)
    hit = F.col(real) == F.col(pred)
    is_rule = F.coalesce(F.col(rule).cast("boolean"), F.lit(False))
    agg = df.agg(F.count_if(known & is_rule).alias("n_rule"),
                 F.count_if(known & is_rule & hit).alias("h_rule"),
                 F.count_if(known & ~is_rule).alias("n_model"),
                 F.count_if(known & ~is_rule & hit).alias("h_model"))
    rows = [F.struct(F.lit(name).alias("origin"), F.col(f"n_{k}").alias("n"),
                     F.col(f"h_{k}").alias("hits"),
                     _ratio(F.col(f"h_{k}"), F.col(f"n_{k}")).alias("accuracy"))
            for name, k in (("decree", "rule"), ("model", "model"))]
    return agg.select(F.inline(F.array(*rows)))


def accuracy_by_label(df: DataFrame, real: str = "real", pred: str = "pred") -> DataFrame:
    """Per real label ``(real, cases, hits, pct)``; one hash aggregate on the label."""
    known = _both_known(real, pred)
    return (df.where(known).groupBy(real)
            .agg(F.count(F.lit(1)).alias("cases"),
                 F.count_if(F.col(real) == F.col(pred)).alias("hits"))
            .withColumn("pct", _ratio(F.col("hits"), F.col("cases")) * 100.0))


def mean_confidence(df: DataFrame, prob: str | None = None, conf: str | None = None) -> DataFrame:
    """Average top-class probability (from a probability array or a confidence column)."""
    x = F.array_max(F.col(prob)) if prob else F.col(conf)
    return df.agg(F.avg(x).alias("mean_confidence"), F.count(x).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class ``(label, n_c, balanced_weight, pos_weight)``.

    balanced = n / (k · n_c); pos_weight = n_neg / n_pos (binary 0/1 labels).  The class
    table is one hash aggregate; n, k, n_pos and n_neg come from ONE scalar subquery over
    that table (a struct), so there is no cross join and no extra pass per number.
    """
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = per.select(F.struct(
        F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.when(F.col(label) == 1, F.col("n_c"))).alias("pos"),
        F.sum(F.when(F.col(label) == 0, F.col("n_c"))).alias("neg"))).scalar()
    return (per.withColumn("balanced_weight",
                           tot.getField("n").cast("double") / (tot.getField("k") * F.col("n_c")))
            .withColumn("pos_weight", F.try_divide(tot.getField("neg").cast("double"),
                                                   tot.getField("pos"))))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """A20 as a ``weightCol`` (rows without a label get NULL).

    The weights, one per class, are a map-valued scalar subquery that every row looks its
    label up in: no join, so no shuffle on a label of a few values.
    """
    weights = class_weights(df, label).agg(F.map_from_entries(F.collect_list(
        F.struct(label, "balanced_weight")))).scalar()
    return df.withColumn(out, F.try_element_at(weights, F.col(label)))


def score_summary(df: DataFrame, decision: str = "Prediccion") -> DataFrame:
    """Total, PERTINENTE, NO PERTINENTE and INDETERMINADO counts with % (0 if empty)."""
    d = F.col(decision)
    agg = df.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(d == schema.LABEL_POS).alias("pertinente"),
                 F.count_if(d == schema.LABEL_NEG).alias("no_pertinente"),
                 F.count_if(d.startswith("INDETERMINADO")).alias("indeterminado"))
    t = F.col("total")
    return agg.select("total", "pertinente", "no_pertinente", "indeterminado",
                      (_ratio(F.col("pertinente"), t) * 100.0).alias("pct_pertinente"),
                      (_ratio(F.col("no_pertinente"), t) * 100.0).alias("pct_no_pertinente"),
                      (_ratio(F.col("indeterminado"), t) * 100.0).alias("pct_indeterminado"))


def compare_to_baseline(acc: DataFrame, base_accuracy: float = schema.PREVIOUS_ACCURACY,
                        base_hits: int = schema.PREVIOUS_HITS) -> DataFrame:
    """Delta vs the previous model in accuracy points and in cases."""
    return acc.select("*",
                      ((F.col("accuracy") - F.lit(base_accuracy)) * 100.0).alias("delta_points"),
                      (F.col("hits") - F.lit(base_hits)).alias("delta_cases"))


def top_probability(prob: str) -> Column:
    """Row-wise max over the class probabilities."""
    return F.array_max(F.col(prob))


def flag_sum(*cols: str) -> Column:
    """Row-wise sum of 0/1 (or boolean) flags, NULL counted as 0."""
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.col(c).cast("int"), F.lit(0))
    return total
