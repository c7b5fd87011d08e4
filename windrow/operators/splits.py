"""Stratified splits within groups, and their attachment to wider tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.config import SplitParams
from windrow.functions.columns import hash_key
from windrow.operators.labels import duplicate_keys
from windrow.storage import stored


def group_column(df: DataFrame, override: str | None = None) -> str:
    """The override if the table has it, else label_capture_id if any row has one, else capture_id."""
    if override:
        if override not in df.columns:
            raise ValueError(f"no column {override!r}")
        return override
    if "label_capture_id" in df.columns and df.where(F.col("label_capture_id").isNotNull()).limit(1).count():
        return "label_capture_id"
    if "capture_id" in df.columns:
        return "capture_id"
    raise ValueError("no column to group by")


def ranked_by_hash(df: DataFrame, strata: list[str], key: list[str], hashed: Column) -> DataFrame:
    """df with _rank, the place of a row in its stratum in the order of the hash (hex text) and key, and _total, the stratum's rows.

    A rank over a whole stratum would sort it in one task. Rows get a bin from their hash's first three digits; bins
    are counted and their running sums give each bin's first rank, so that only rows within a bin are sorted.
    """
    ordered = df.withColumn("_h", hashed).withColumn("_bin", F.substring("_h", 1, 3))
    names = [f"_s{i}" for i in range(len(strata))]
    bins = ordered.groupBy(*[F.col(c).alias(n) for c, n in zip(strata, names, strict=True)], F.col("_bin").alias("_b")).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*names)
    bins = bins.withColumns({"_total": F.sum("_n").over(over), "_before": F.sum("_n").over(over.orderBy("_b")) - F.col("_n")})
    rank = F.row_number().over(Window.partitionBy(*strata, "_bin").orderBy("_h", *key)) + F.col("_before")
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(strata, names, strict=True)]
    return ordered.join(bins, [*same, F.col("_bin") == F.col("_b")]).withColumn("_rank", rank).select(*df.columns, "_rank", "_total")


def stratified_split(df: DataFrame, key: list[str], group: str, label: str = "label", params: SplitParams = SplitParams()) -> DataFrame:
    """df with split: within (group, label), rows in hash order are cut at floor(n r), the rest one each to the first splits."""
    ranked = ranked_by_hash(df, [group, label], key, hash_key(params.seed, *map(F.col, [group, label, *key])))
    whole = [F.floor(F.col("_total") * F.lit(r)) for r in params.ratios]
    rest = F.col("_total") - sum(whole[1:], whole[0])
    upto, split = None, None
    for i, (name, base) in enumerate(zip(params.names, whole, strict=True)):
        size = base + F.when(rest > i, 1).otherwise(0)
        upto = size if upto is None else upto + size
        split = F.when(F.col("_rank") <= upto, name) if split is None else split.when(F.col("_rank") <= upto, name)
    return ranked.withColumn("split", split).select(*df.columns, "split")


def split_stats(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """(split, examples, label_counts, group_ids): counts by label as a JSON object in label order, group ids as a sorted list."""
    labels = df.groupBy("split", label).agg(F.count("*").alias("n"))
    counts = labels.groupBy("split").agg(F.sum("n").alias("examples"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n"))))).alias("label_counts"))
    groups = df.select("split", group).distinct().groupBy("split").agg(F.array_join(F.array_sort(F.collect_list(group)), ",").alias("group_ids"))
    return counts.join(groups, "split")


def attach(rich: DataFrame, split: DataFrame, key: list[str], check: bool = True) -> DataFrame:
    """rich with the split of the same window; with check on, an unmatched window or a repeated key raises ValueError."""
    out = rich.join(split.select(*key, "split"), key, "left")
    if check:
        out = stored(out)  # the checks go over it, not over what made it
        if out.where(F.col("split").isNull()).limit(1).count() or duplicate_keys(out, key).limit(1).count():
            raise ValueError("a window has no split, or a key repeats")
    return out


def combine_rich(split: DataFrame, rich: DataFrame, key: list[str], check: bool = True) -> DataFrame:
    """Split rows with only the rich_ columns of the enriched table; a row without partner raises ValueError."""
    names = [c for c in rich.columns if c.startswith("rich_")]
    out = split.join(rich.select(*key, *names, F.lit(True).alias("_there")), key, "left")
    if check:
        out = stored(out)
        if out.where(F.col("_there").isNull()).limit(1).count():
            raise ValueError("a split row has no enriched row")
    return out.drop("_there")


def split_count_gaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Splits whose number of rows differs between two tables."""
    count = lambda df, name: df.groupBy("split").agg(F.count("*").alias(name))
    return count(a, "n_a").join(count(b, "n_b"), "split", "full").where(~F.col("n_a").eqNullSafe(F.col("n_b")))


def sequential_ids(df: DataFrame, order: list[str], name: str = "flow_id", partitions: int | None = None) -> DataFrame:
    """df with 1-based numbers in the given order: a range sort, counts per partition, and running sums of these.

    Nothing but one row per partition meets in one place, unlike row_number over the whole table. The sorted rows are
    written once, as a second sort could cut its ranges elsewhere.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = lambda c: F.shiftright(c, 33)
    counts = rows.groupBy(part(F.col("_at")).alias("_p")).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_start")
    numbered = rows.join(F.broadcast(starts), part(F.col("_at")) == F.col("_p"))  # one row for each partition
    return numbered.withColumn(name, F.col("_start") + F.col("_at") - F.shiftleft(F.col("_p"), 33) + 1).drop("_at", "_p", "_start")
