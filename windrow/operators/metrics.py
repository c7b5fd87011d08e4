"""Classification metrics from predictions, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.columns import metric_from_text


def confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy("reference_label", "predicted_label").agg(F.count("*").alias("n"))


def class_metrics(preds: DataFrame) -> DataFrame:
    """Per class of references and predictions (an empty prediction is one): tp, fp, fn, precision, recall, f1, support."""
    counts = confusion(preds)
    hit = F.when(F.col("reference_label") == F.col("predicted_label"), F.col("n")).otherwise(0)
    refs = counts.select(F.col("reference_label").alias("label"), hit.alias("tp"), F.lit(0).alias("predicted"), F.col("n").alias("support"))
    guesses = counts.select(F.col("predicted_label").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("predicted"), F.lit(0).alias("support"))
    got = refs.unionByName(guesses).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    got = got.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp"), "precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return got.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))).drop("predicted")


def overall_metrics(classes: DataFrame) -> DataFrame:
    """One row: samples, accuracy, macro and support-weighted precision, recall and f1; nulls without samples."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias(f"weighted_{c}")
    names = ("precision", "recall", "f1")
    return classes.agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("samples"), (F.sum("tp") / F.nullif(F.sum("support"), F.lit(0))).alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in names], *map(weighted, names)
    )


def agreement(preds: DataFrame) -> DataFrame:
    """One row: samples, equal labels, distinct predictions and references."""
    return preds.agg(
        F.count("*").alias("samples"), F.count(F.when(F.col("reference_label") == F.col("predicted_label"), 1)).alias("same"),
        F.countDistinct("predicted_label").alias("distinct_predictions"), F.countDistinct("reference_label").alias("distinct_references"),
    )


def label_sides(preds: DataFrame) -> DataFrame:
    """(side, label, n): distributions of references and predictions."""
    side = lambda name, c: preds.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "label", "n")
    return side("reference", "reference_label").unionByName(side("prediction", "predicted_label"))


def metrics_from_logs(logs: DataFrame, keys: list[str]) -> DataFrame:
    """(run, metric columns) of log texts (run, text)."""
    return logs.select("run", *[metric_from_text(F.col("text"), k).alias(k) for k in keys])


def rank_runs(runs: DataFrame, metric: str) -> DataFrame:
    """Runs with a metric, best first (ties by name), with their place. One row for each run."""
    place = Window.orderBy(F.desc(metric), "run")
    return runs.where(F.col(metric).isNotNull()).withColumn("place", F.row_number().over(place))


def run_delta(runs: DataFrame, metric: str, baseline: str, checkpoint: str) -> DataFrame:
    """One row: the metric of both runs and checkpoint - baseline."""
    value = lambda name: F.max(F.when(F.col("run") == name, F.col(metric)))
    got = runs.agg(value(baseline).alias("baseline"), value(checkpoint).alias("checkpoint"))
    return got.withColumn("delta", F.col("checkpoint") - F.col("baseline"))
