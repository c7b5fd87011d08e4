"""Exact-size seeded samples in hash order, and label counts.

A sample of any number of strata takes two passes: one counts rows by stratum and by the first digits of their hash, and
running sums of these counts tell up to which bin a stratum's rows are in; the other takes the rows up to that bin. Only
rows that may be in are shuffled, and only those of equal first digits are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.config import SampleParams
from windrow.functions.columns import hash01, hash_key
from windrow.operators.splits import sequential_ids
from windrow.storage import stored


def label_counts(df: DataFrame, missing: str = "UNKNOWN") -> DataFrame:
    """(label, count, share), a missing label under its own name."""
    got = df.groupBy(F.coalesce("label", F.lit(missing)).alias("label")).agg(F.count("*").alias("count"))
    return got.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))))


def label_options(df: DataFrame) -> list[str]:
    """Distinct non-empty labels in order, for a prompt's list."""
    return [r["label"] for r in df.where(F.col("label") != "").select("label").distinct().orderBy("label").collect()]


#: Digits of the hash that make a bin: 65,536 bins in each stratum.
BIN_DIGITS = 4


def hash_bins(df: DataFrame, stratum: Column, key: list[str], seed: int) -> DataFrame:
    """(stratum, bin, n, before, total): rows of each bin, rows of the stratum in the bins before it, and all its rows. Written down."""
    bins = df.groupBy(stratum.alias("stratum"), F.substring(hash_key(seed, *map(F.col, key)), 1, BIN_DIGITS).alias("bin")).agg(F.count("*").alias("n"))
    over = Window.partitionBy("stratum")
    return stored(bins.select("*", (F.sum("n").over(over.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(over).alias("total")))


def first_by_hash(df: DataFrame, bins: DataFrame, stratum: Column, quota: Column, key: list[str], seed: int) -> DataFrame:
    """Of each stratum the first rows in hash order, ties by key: as many as quota says, an expression of stratum and total."""
    sized = bins.withColumn("quota", quota)
    last = F.when(F.col("before") + F.col("n") >= F.col("quota"), F.struct("bin", (F.col("quota") - F.col("before")).alias("left")))
    edges = sized.groupBy("stratum").agg(F.min(last).alias("_edge")).withColumnRenamed("stratum", "_of")
    rows = df.withColumns({"_stratum": stratum, "_h": hash_key(seed, *map(F.col, key))}).withColumn("_bin", F.substring("_h", 1, BIN_DIGITS))
    near = rows.join(edges, F.col("_stratum").eqNullSafe(F.col("_of"))).where(F.col("_edge").isNull() | (F.col("_bin") <= F.col("_edge.bin")))
    rank = F.row_number().over(Window.partitionBy("_stratum", "_bin").orderBy("_h", *key))
    ranked = near.withColumn("_rank", rank)
    return ranked.where(F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge.bin")) | (F.col("_rank") <= F.col("_edge.left"))).select(*df.columns)


def sample_n(df: DataFrame, n: int, key: list[str], seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, the first in hash order, in that order."""
    if n <= 0:
        return df.limit(0)
    bins = hash_bins(df, F.lit(0), key, seed)
    return shuffled(first_by_hash(df, bins, F.lit(0), F.lit(n), key, seed), key, seed)


def shuffled(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    return df.orderBy(hash_key(seed, *map(F.col, key)), *key)


def shuffled_places(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """df with place, a row's number from 1 in the shuffled order."""
    return sequential_ids(df.withColumn("_h", hash_key(seed, *map(F.col, key))), ["_h", *key], "place").drop("_h")


def balanced_sizes(attack: int, benign: int, params: SampleParams) -> int:
    """Benign rows of the balanced sample: by ratio, within the target and what there is, never negative."""
    wanted = int(attack * params.benign_ratio / (1 - params.benign_ratio))
    if attack + wanted > params.target:
        wanted = params.target - attack
    return max(0, min(wanted, benign))


def balanced_sample(df: DataFrame, key: list[str], params: SampleParams = SampleParams()) -> DataFrame:
    """All rows that are not benign (unknown ones too), and a sample of benign ones."""
    benign = F.coalesce("label", F.lit("UNKNOWN")) == params.benign
    bins = hash_bins(df, benign, key, params.seed)
    counts = {r["stratum"]: r["total"] for r in bins.select("stratum", "total").distinct().collect()}  # two rows
    size = balanced_sizes(counts.get(False, 0), counts.get(True, 0), params)
    return first_by_hash(df, bins, benign, F.when(F.col("stratum"), F.lit(size)).otherwise(F.col("total")), key, params.seed)


def validation_sample(df: DataFrame, key: list[str], n_train: int, benign_rate: float, params: SampleParams = SampleParams(), least: int = 1000) -> DataFrame:
    """Benign rows at the training sample's rate, other labels up to an equal part of the target each; then the target at most."""
    target = max(least, n_train // 10)
    label = F.coalesce("label", F.lit("UNKNOWN"))
    bins = hash_bins(df, label, key, params.seed)
    labels = bins.select("stratum", "total").distinct()
    quota = F.when(F.col("stratum") == params.benign, F.floor(F.col("total") * F.lit(benign_rate))).otherwise(F.lit(target // max(1, labels.count() - 1)))
    kept = first_by_hash(df, bins, label, quota, key, params.seed)
    n = labels.agg(F.coalesce(F.sum(F.least("total", F.greatest(quota, F.lit(0)))), F.lit(0))).first()[0]
    return sample_n(kept, target, key, params.seed) if n > target else shuffled(kept, key, params.seed)


def natural_sample(df: DataFrame, key: list[str], params: SampleParams = SampleParams()) -> DataFrame:
    return sample_n(df, params.natural, key, params.seed)


def head_sample(df: DataFrame, key: list[str], n: int) -> DataFrame:
    return df.orderBy(*key).limit(n)
