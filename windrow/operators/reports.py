"""Quality reports: split summaries, label and protocol distributions, IP-pair purity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.columns import pair_display, proto_display
from windrow.operators.packets import ip_pair
from windrow.operators.splits import sequential_ids
from windrow.storage import stored

NO_ATTACK = ("BENIGN", "unknown")


def is_attack():
    return ~F.col("label").isin(*NO_ATTACK)


#: Columns whose distinct values are counted, by the name of the count.
COUNTED = {"tuple5s": "tuple5", "label_captures": "label_capture_id", "captures": "capture_id"}


def describe_splits(df: DataFrame) -> DataFrame:
    """Per split: windows, distinct tuple5 and captures (empty ids count, nulls don't), share of unknown labels.

    Exact counts in two stages: rows are reduced to one for each combination of the columns, written down, and each
    column's values reduced again, so no row is multiplied by the number of counts.
    """
    unknown = F.col("label_is_unknown").cast("int")
    combined = stored(df.groupBy("split", *COUNTED.values()).agg(F.count("*").alias("windows"), F.sum(unknown).alias("unknown"), F.count(unknown).alias("known")))
    out = combined.groupBy("split").agg(F.sum("windows").alias("windows"), (F.sum("unknown") / F.nullif(F.sum("known"), F.lit(0))).alias("unknown_ratio"))
    for name, c in COUNTED.items():
        one = combined.select(F.col("split").alias("_split"), c).distinct().groupBy("_split").agg(F.count(c).alias(name))
        out = out.join(one, F.col("split").eqNullSafe(F.col("_split"))).drop("_split")
    return out.select("split", "windows", *COUNTED, "unknown_ratio")


#: Bits of a sketch's number of slots: a standard error of 0.8 %.
SKETCH_BITS = 14


def split_sketches(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group: windows, unknown labels and a sketch of each counted column, in one pass; for describe_splits where exact counts cost too much.

    Tables of sketches of other days or captures can be put beneath each other and merged.
    """
    unknown = F.col("label_is_unknown").cast("int")
    return df.groupBy(*by).agg(
        F.count("*").alias("windows"), F.coalesce(F.sum(unknown), F.lit(0)).alias("unknown"), F.count(unknown).alias("known"), *[F.hll_sketch_agg(F.concat(F.lit("="), c), SKETCH_BITS).alias(name) for name, c in COUNTED.items()]
    )  # sketches skip empty texts


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups from those of smaller ones, without the rows."""
    return sketches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("windows", "unknown", "known")], *[F.hll_union_agg(name).alias(name) for name in COUNTED])


def estimate_splits(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The columns of describe_splits, with estimated distinct counts."""
    return sketches.select(*by, "windows", *[F.hll_sketch_estimate(name).alias(name) for name in COUNTED], (F.col("unknown") / F.nullif(F.col("known"), F.lit(0))).alias("unknown_ratio"))


def _share(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def label_distribution(df: DataFrame) -> DataFrame:
    """(split, label, count, share, log_count), and the same over all splits as split `all`."""
    per = df.groupBy("split", "label").agg(F.count("*").alias("count"))
    every = per.groupBy("label").agg(F.sum("count").alias("count")).select(F.lit("all").alias("split"), "label", "count")
    return _share(per.unionByName(every), ["split"]).withColumn("log_count", F.log10(F.greatest("count", F.lit(1))))


def protocol_distribution(df: DataFrame) -> DataFrame:
    """(scope, split, proto, count, share): per split, over all windows and over attack windows only."""
    per = df.groupBy("split", "proto").agg(F.count("*").alias("count"), F.count(F.when(is_attack(), 1)).alias("attacks"))
    attacks = per.where("attacks > 0").select(F.lit("attack").alias("scope"), "split", "proto", F.col("attacks").alias("count"))
    return _share(per.select(F.lit("all").alias("scope"), "split", "proto", "count").unionByName(attacks), ["scope", "split"])


def _distinct_flows(df: DataFrame) -> DataFrame:
    """(proto, tuple5, n, attacks): reduced once, so several exact distinct counts need no row per window."""
    return df.groupBy("proto", "tuple5").agg(F.count("*").alias("n"), F.count(F.when(is_attack(), 1)).alias("attacks"))


def protocol_breakdown(df: DataFrame) -> DataFrame:
    """Per protocol: windows, distinct flows, attack windows, flows with attacks, and their shares of all windows."""
    got = _distinct_flows(df).groupBy("proto").agg(
        F.sum("n").alias("windows"), F.count("*").alias("tuple5s"), F.sum("attacks").alias("attack_windows"), F.count(F.when(F.col("attacks") > 0, 1)).alias("attack_tuple5s")
    )
    total = Window.partitionBy(F.lit(0))  # one row for each protocol, 256 at most
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(total), F.lit(0)), F.lit(0.0))
    return got.withColumns({"proto_display": proto_display(F.col("proto")), "window_share": share("windows"), "attack_share": share("attack_windows")})


def totals(df: DataFrame) -> DataFrame:
    """One row: windows, distinct flows, attack windows, and the protocols that attacks use, in order."""
    return _distinct_flows(df).groupBy("tuple5").agg(F.sum("n").alias("n"), F.sum("attacks").alias("attacks"), F.collect_set(F.when(F.col("attacks") > 0, F.col("proto"))).alias("p")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("windows"), F.count("*").alias("tuple5s"), F.coalesce(F.sum("attacks"), F.lit(0)).alias("attack_windows"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).cast("array<string>"), ",").alias("attack_protocols"),
    )


def markdown(df: DataFrame) -> str:
    """The QC report as text, from aggregates of bounded size (splits, labels, protocols) that come to the driver."""
    lines = ["# Dataset QC report", "", "## Totals", ""]
    t = totals(df).first()
    unknown = df.agg(F.avg(F.col("label_is_unknown").cast("int"))).first()[0] or 0.0
    lines += [f"- windows: {t['windows']:,}", f"- flows: {t['tuple5s']:,}", f"- attack windows: {t['attack_windows']:,}", f"- attack protocols: {t['attack_protocols'] or '-'}", f"- unknown labels: {unknown:.2%} (target: under 5%)", ""]
    for title, frame, columns in (
        ("Splits", describe_splits(df).orderBy("split"), ["split", "windows", "tuple5s", "captures", "unknown_ratio"]),
        ("Labels", label_distribution(df).orderBy("split", "label"), ["split", "label", "count", "share"]),
        ("Protocols", protocol_breakdown(df).orderBy("proto"), ["proto_display", "windows", "window_share", "tuple5s", "attack_windows", "attack_share"]),
        ("Protocols by split", protocol_distribution(df).where("scope = 'all'").orderBy("split", "proto"), ["split", "proto", "count", "share"]),
        ("Protocols of attacks by split", protocol_distribution(df).where("scope = 'attack'").orderBy("split", "proto"), ["split", "proto", "count", "share"]),
    ):
        lines += [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        for row in frame.select(*columns).collect():
            cells = [f"{v:.2%}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v) for v in row]
            lines.append("| " + " | ".join(cells) + " |")
        lines.append("")
    return "\n".join(lines)


def pair_labels(df: DataFrame, proto: int | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(ip_low, ip_high, label, cnt, total, fraction): unordered pairs, of one protocol, without the excluded labels."""
    rows = ip_pair(df)
    if proto is not None:
        rows = rows.where(F.col("proto") == proto)
    if exclude:
        rows = rows.where(~F.col("label").isin(*exclude))
    counts = rows.groupBy("ip_low", "ip_high", "label").agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy("ip_low", "ip_high"))
    return counts.withColumn("total", total).withColumn("fraction", F.col("cnt") / F.col("total"))


def pair_purity(pairs: DataFrame) -> DataFrame:
    """(ip_low, ip_high, total, dominant, top, purity): the most frequent label of each pair; ties: the first in order."""
    best = Window.partitionBy("ip_low", "ip_high").orderBy(F.desc("cnt"), "label")
    got = pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return got.select("ip_low", "ip_high", "total", F.col("label").alias("dominant"), F.col("cnt").alias("top"), F.col("fraction").alias("purity"))


def purity_summary(purity: DataFrame) -> DataFrame:
    """One row: pairs, rows, purity weighted by rows, pairs of a purity of 0.9 and more."""
    return purity.agg(
        F.count("*").alias("pairs"), F.coalesce(F.sum("total"), F.lit(0)).alias("rows"), (F.sum("top") / F.sum("total")).alias("weighted_purity"), F.count(F.when(F.col("purity") >= 0.9, 1)).alias("pure_pairs")
    )


def top_pairs(purity: DataFrame, k: int = 10) -> DataFrame:
    top = purity.orderBy(F.desc("total"), "ip_low", "ip_high").limit(k)
    return top.withColumn("pair", pair_display(F.col("ip_low"), F.col("ip_high")))


def pair_mix(pairs: DataFrame, purity: DataFrame, k: int = 10, labels: list[str] | None = None) -> DataFrame:
    """Counts of labels for each top pair, wide, 0 where there is none: of the given labels, or of all that these pairs have."""
    top = top_pairs(purity, k).select("ip_low", "ip_high", "pair")
    rows = pairs.join(top, ["ip_low", "ip_high"])
    if labels is None:
        labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]  # a column each
    return rows.groupBy("pair").pivot("label", labels).sum("cnt").na.fill(0)


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, the last one closed; bounds from the data unless given."""
    if low is None or high is None:
        row = df.agg(F.min(value), F.max(value)).first()
        low, high = (float(x) if x is not None else 0.0 for x in row)
    width = (high - low) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width))
    got = df.where(F.col(value).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return got.select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


#: Pairs of one running sum.
COVERAGE_ROWS = 100_000


def coverage(purity: DataFrame) -> DataFrame:
    """(ip_low, ip_high, rank, total, covered): pairs by volume, and the share of rows that they and all larger ones cover.

    Pairs are sorted by range; running sums go over a partition's own rows and over one row for each partition.
    """
    numbered = sequential_ids(purity.select("ip_low", "ip_high", "total", (-F.col("total")).alias("_down")), ["_down", "ip_low", "ip_high"], "rank")
    rows = stored(numbered.withColumn("_part", F.floor((F.col("rank") - 1) / COVERAGE_ROWS)))
    sums = rows.groupBy("_part").agg(F.sum("total").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")
    sums = sums.select("_part", before.alias("_before"), F.sum("_sum").over(Window.partitionBy(F.lit(0))).alias("_all"))
    upto = F.col("_before") + F.sum("total").over(Window.partitionBy("_part").orderBy("rank"))
    return rows.join(sums, "_part").select("ip_low", "ip_high", "rank", "total", (upto / F.col("_all")).alias("covered"))
