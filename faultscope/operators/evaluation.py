"""Exact binary metrics and curves over any number of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.operators.ranking import running_totals
from faultscope.session import materialize


def _ratio(top: Column, bottom: Column, undefined: float = 0.0) -> Column:
    return F.when(bottom == 0, F.lit(undefined)).otherwise(top / bottom)


def scores_with_totals(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score with positives and negatives, and how many of each score at
    least as high. Ties are aggregated first, so a score shared by many rows is one row. The
    aggregate is written once, as it is read for the cuts, the offsets and the totals. A null or
    NaN score is an error."""
    value = F.col(score).cast("double")
    known = F.when(value.isNotNull() & ~F.isnan(value), value).otherwise(
        F.raise_error(F.lit(f"{score} holds null or NaN")).cast("double"))
    per_score = scored.groupBy(known.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return running_totals(materialize(per_score, "scores"), "score", ["pos", "neg"])


def binary_metrics(scored: DataFrame, label: str = "label", score: str = "proba", threshold: float = 0.5) -> DataFrame:
    """One row: accuracy, F1 of class 1 (0 if undefined), exact ROC-AUC (NaN with one class only)
    and the number of samples."""
    above = F.col("score") >= threshold
    sums = scores_with_totals(scored, label, score).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        # each negative is beaten by the positives above it and by half of those at its score
        F.sum(F.col("neg") * (F.col("pos_so_far") - F.col("pos") / 2)).alias("won"),
    )
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "p", "n"))
    return sums.select(
        _ratio(tp + n - fp, p + n, float("nan")).alias("accuracy"),
        _ratio(2 * tp, p + tp + fp).alias("f1"),
        _ratio(F.col("won"), p * n, float("nan")).alias("roc_auc"),
        (F.col("p") + F.col("n")).alias("n_samples"),
    )


def roc_points(scored: DataFrame, label: str = "label", score: str = "proba", drop_intermediate: bool = True) -> DataFrame:
    """``(threshold, fpr, tpr)`` from the highest score down, starting at (infinity, 0, 0).

    ``drop_intermediate`` leaves out points on the straight line between their neighbours."""
    totals = scores_with_totals(scored, label, score)
    whole = totals.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    if whole["p"] is None:
        return totals.select(F.col("score").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).limit(0)
    if drop_intermediate:
        bend = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        first = (F.col("pos_so_far") == F.col("pos")) & (F.col("neg_so_far") == F.col("neg"))
        totals = totals.filter(first | F.col("next_pos").isNull() | bend)

    def rate(c: str, total: int) -> Column:
        return F.col(c) / F.lit(float(total)) if total else F.lit(float("nan"))

    start = F.struct(F.lit(float("inf")).alias("threshold"), (rate("neg", whole["n"]) * 0).alias("fpr"), (rate("pos", whole["p"]) * 0).alias("tpr"))
    point = F.struct(F.col("score").alias("threshold"), rate("neg_so_far", whole["n"]).alias("fpr"), rate("pos_so_far", whole["p"]).alias("tpr"))
    is_first = (F.col("pos_so_far") == F.col("pos")) & (F.col("neg_so_far") == F.col("neg"))
    return totals.select(F.explode(F.when(is_first, F.array(start, point)).otherwise(F.array(point))).alias("at")).select("at.*")


def pr_points(scored: DataFrame, label: str = "label", score: str = "proba") -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, and the end point (null, 1, 0)."""
    totals = scores_with_totals(scored, label, score)
    positives = totals.agg(F.sum("pos").alias("p")).first()["p"] or 0
    recall = F.col("pos_so_far") / F.lit(float(positives)) if positives else F.lit(1.0)
    point = F.struct(
        F.col("score").alias("threshold"),
        (F.col("pos_so_far") / (F.col("pos_so_far") + F.col("neg_so_far"))).alias("precision"),
        recall.alias("recall"),
    )
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    is_first = (F.col("pos_so_far") == F.col("pos")) & (F.col("neg_so_far") == F.col("neg"))
    return totals.select(F.explode(F.when(is_first, F.array(end, point)).otherwise(F.array(point))).alias("at")).select("at.*")


def confusion(predicted: DataFrame, label: str = "label", pred: str = "pred", classes: list[int] = [0, 1]) -> DataFrame:
    """Rows per true and predicted class, zeros included."""
    cells = [(t, p) for t in classes for p in classes]
    counted = predicted.agg(*[
        F.count_if((F.col(label) == t) & (F.col(pred) == p)).alias(f"n_{t}_{p}") for t, p in cells])
    rows = F.array(*[F.struct(F.lit(t).alias("label"), F.lit(p).alias("pred"), F.col(f"n_{t}_{p}").alias("n")) for t, p in cells])
    return counted.select(F.explode(rows).alias("cell")).select("cell.*")


def class_report(predicted: DataFrame, label: str = "label", pred: str = "pred", classes: list[int] = [0, 1]) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    counted = predicted.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        *[F.count_if((F.col(label) == c) & (F.col(pred) == c)).cast("double").alias(f"tp_{c}") for c in classes],
        *[F.count_if(F.col(pred) == c).cast("double").alias(f"said_{c}") for c in classes],
        *[F.count_if(F.col(label) == c).cast("double").alias(f"is_{c}") for c in classes],
    )

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.cast("bigint").alias("support"))

    per_class = {
        c: (
            _ratio(F.col(f"tp_{c}"), F.col(f"said_{c}")),
            _ratio(F.col(f"tp_{c}"), F.col(f"is_{c}")),
            _ratio(2 * F.col(f"tp_{c}"), F.col(f"said_{c}") + F.col(f"is_{c}")),
            F.col(f"is_{c}"),
        ) for c in classes
    }
    accuracy = _ratio(sum((F.col(f"tp_{c}") for c in classes), F.lit(0.0)), F.col("rows"))
    macro = [sum((m[i] for m in per_class.values()), F.lit(0.0)) / len(classes) for i in range(3)]
    weighted = [_ratio(sum((m[i] * m[3] for m in per_class.values()), F.lit(0.0)), F.col("rows")) for i in range(3)]
    rows = [row(str(c), *m) for c, m in per_class.items()]
    rows += [
        row("accuracy", accuracy, accuracy, accuracy, F.col("rows")),
        row("macro avg", *macro, F.col("rows")),
        row("weighted avg", *weighted, F.col("rows")),
    ]
    return counted.select(F.explode(F.array(*rows)).alias("line")).select("line.*")
