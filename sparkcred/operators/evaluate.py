"""Exact classifier metrics from grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcred.functions import lexicons as L


def rated(scores: DataFrame) -> DataFrame:
    """Rows with model, score and a label of 0 or 1, each once."""
    return scores.filter("model is not null and score is not null and label in (0, 1)").select("key", F.col("label").cast("int").alias("label"), "model", "score").distinct()


def predicted(df: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """``pred``: 1 from the threshold on, or above it if strict."""
    s = F.col("score")
    return df.withColumn("pred", (s > threshold if strict else s >= threshold).cast("int"))


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    one = lambda y, p: F.sum(F.when((F.col("label") == y) & (F.col("pred") == p), 1).otherwise(0)).alias
    return df.groupBy(*by).agg(one(0, 0)("tn"), one(0, 1)("fp"), one(1, 0)("fn"), one(1, 1)("tp"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def metrics(counts: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro and weighted precision, recall and F1 of confusion counts; undefined ratios are 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n, n0, n1 = tn + fp + fn + tp, tn + fp, fn + tp
    p1, r1, p0, r0 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fn + fp)
    mean, weighted = (lambda a, b: (a + b) / 2), (lambda a, b: _ratio(a * n0 + b * n1, n))
    cols = {
        "accuracy": _ratio(tp + tn, n), "macro_precision": mean(p0, p1), "macro_recall": mean(r0, r1), "macro_f1": mean(f0, f1),
        "weighted_precision": weighted(p0, p1), "weighted_recall": weighted(r0, r1), "weighted_f1": weighted(f0, f1), "fp_rate": _ratio(fp, n0), "fn_rate": _ratio(fn, n1),
    }
    return counts.select(*by, "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(k) for k, c in cols.items()])


def class_report(counts: DataFrame, by: list[str]) -> DataFrame:
    """One row per class: precision, recall, F1, support."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    row = lambda y, t, wrong, missed: F.struct(F.lit(y).alias("class"), F.round(_ratio(t, t + wrong), 6).alias("precision"), F.round(_ratio(t, t + missed), 6).alias("recall"), F.round(_ratio(2 * t, 2 * t + wrong + missed), 6).alias("f1"), (t + missed).alias("support"))
    return counts.select(*by, F.explode(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))).alias("r")).select(*by, "r.*")


def roc_auc(df: DataFrame, by: str = "model") -> DataFrame:
    """Area under the ROC curve with ties, from counts per distinct score.

    Scores are counted first; the cumulated negatives of a group are over its distinct scores.
    """
    counts = df.groupBy(by, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return won.groupBy(by).agg(F.sum("won").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("w") / (F.col("p") * F.col("n")), 6)).alias("auc"))


def sweep(df: DataFrame, thresholds: list[float], by: str = "model", strict: bool = False) -> DataFrame:
    """Metrics at each threshold, from one pass: rows are counted by the number of thresholds they pass."""
    s = F.col("score")
    thresholds = sorted(thresholds)
    passed = sum(((s > t if strict else s >= t).cast("int") for t in thresholds), F.lit(0))
    counts = df.groupBy(by, passed.alias("passed")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    grid = counts.groupBy(by).agg(*[x for i in range(len(thresholds)) for x in (F.sum(F.when(F.col("passed") > i, F.col("pos")).otherwise(0)).alias(f"tp{i}"), F.sum(F.when(F.col("passed") > i, F.col("neg")).otherwise(0)).alias(f"fp{i}"))], F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("p") - F.col(f"tp{i}")).alias("fn"), (F.col("n") - F.col(f"fp{i}")).alias("tn")) for i, t in enumerate(thresholds)]))
    return metrics(grid.select(by, rows.alias("r")).select(by, "r.*"), [by, "threshold"])


def best(sweeped: DataFrame, by: str = "model") -> DataFrame:
    """The first threshold with the highest macro F1, then accuracy, then nearest to 0."""
    rank = F.struct(F.col("macro_f1"), F.col("accuracy"), -F.abs("threshold"))
    return sweeped.groupBy(by).agg(F.max_by("threshold", rank).alias("threshold"), F.max("macro_f1").alias("macro_f1"))


def flag_slices(df: DataFrame) -> DataFrame:
    """Per flag and model: share predicted 1 among flagged rows, and recall among flagged rows of label 1."""
    long = df.select("model", "label", "pred", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in L.FLAGS])).alias("x")).filter("x.on = 1")
    return long.groupBy("model", F.col("x.flag").alias("flag")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("pred").cast("double")), 6).alias("flagged_positive_rate"), F.round(F.avg(F.when(F.col("label") == 1, F.col("pred").cast("double"))), 6).alias("flagged_recall")
    )


def soft_vote(df: DataFrame, weights: dict[str, float] = L.VOTE_WEIGHTS) -> DataFrame:
    """(key, label, score): weighted mean over the models that scored the key; labels by the largest given."""
    w = F.coalesce(*[F.when(F.col("model") == m, F.lit(x)) for m, x in weights.items()])
    one = df.withColumn("w", w).filter("w is not null").groupBy("key", "model").agg(F.max("label").alias("label"), F.avg("score").alias("score"), F.max("w").alias("w"))
    return one.groupBy("key").agg(F.max("label").alias("label"), (F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("score"))


def threshold_summary(df: DataFrame, thresholds: list[float], old: float = 0.5, by: str = "model") -> DataFrame:
    """Per model the old and the best threshold, macro F1 and misses at both, and what the change gains."""
    swept = sweep(df, sorted({*thresholds, old}), by)
    at = lambda name: swept.select(by, F.col("threshold").alias(f"{name}_threshold"), F.col("macro_f1").alias(f"{name}_f1"), F.col("fn").alias(f"{name}_missed"))
    new = at("new").join(best(swept, by).select(by, F.col("threshold").alias("new_threshold")), [by, "new_threshold"])
    both = new.join(at("old").filter(F.col("old_threshold") == old), by)
    return both.select(by, "old_threshold", "new_threshold", "old_f1", "new_f1", F.round(F.col("new_f1") - F.col("old_f1"), 6).alias("f1_gain"), "old_missed", "new_missed")


def ranking(counts: DataFrame, by: str = "model") -> DataFrame:
    """Models with their place by macro F1, ties by name; models are few, so one window holds them."""
    place = F.row_number().over(Window.orderBy(F.desc("macro_f1"), by))
    return metrics(counts, [by]).select(place.alias("place"), by, "macro_f1", "weighted_f1")


def clipped_sigmoid(x, limit: float = 35.0):
    """Probability of a margin, cut at the limit so that it neither overflows nor reaches 0 or 1."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))
