"""Ground-truth intervals: clock offsets per flow, alignment of windows by overlap, and propagation of labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.config import LabelParams
from windrow.functions.columns import clean_label
from windrow.storage import stored

#: Label matching ignores the capture, as one label table may serve several captures of the same hosts.
K5 = ("src_ip", "src_port", "dst_ip", "dst_port", "proto")
TOLERANCE = 1e-9
#: An interval's level is the least even number k such that it is no longer than 2^k microseconds; longer ones don't fit into longs.
LEVELS = range(2, 64, 2)


def label_times(df: DataFrame, params: LabelParams) -> DataFrame:
    """Adds start_us and end_us from text times in the data set's zone; rows with a time that can't be read go.

    The first of the data set's formats that reads a text counts. Local times that a clock change skips or repeats are
    no times either: they are those that two instants, or none, show on the zone's clock. What the clock was ahead by a
    day before and a day after gives the two instants that there can be, whatever the change is: an hour, half of one, or a day.
    """

    shown = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), params.timezone))
    ahead = lambda us: shown(us) - us
    day = 86_400_000_000

    def each(value: Column, f: Callable[[Column], Column]) -> Column:
        """f(value), with the value worked out once."""
        return F.transform(F.array(value), f)[0]

    def instant(c: Column) -> Column:
        a, b = c["before"], c["after"]
        return F.when(c["fits_before"] & (~c["fits_after"] | (a == b)), a).when(~c["fits_before"] & c["fits_after"], b)

    def micros(name: str) -> Column:
        local = F.coalesce(*[F.try_to_timestamp(F.trim(F.col(name)), F.lit(f)) for f in params.time_formats])
        times = each(local, lambda t: F.struct(F.unix_micros(t).alias("clock"), F.unix_micros(F.to_utc_timestamp(t, params.timezone)).alias("near")))
        both = each(times, lambda t: F.struct(t["clock"].alias("clock"), (t["clock"] - ahead(t["near"] - day)).alias("before"), (t["clock"] - ahead(t["near"] + day)).alias("after")))
        fits = each(both, lambda t: F.struct(t["before"].alias("before"), t["after"].alias("after"), (shown(t["before"]) == t["clock"]).alias("fits_before"), (shown(t["after"]) == t["clock"]).alias("fits_after")))
        return each(fits, instant)

    got = df.withColumns({"start_us": micros(params.start), "end_us": micros(params.end)})
    return got.where(F.col("start_us").isNotNull() & F.col("end_us").isNotNull()).withColumn("end_us", F.greatest("start_us", "end_us"))


def prepare(labels: DataFrame, benign: str = "BENIGN") -> DataFrame:
    """Label cleaned, priority 0 for benign and 1 for any other, duration in microseconds, at least 0."""
    label = clean_label(F.col("label"))
    return labels.withColumn("label", label).withColumns({"priority": F.when(F.col("label") == benign, 0).otherwise(1), "dur_us": F.greatest(F.lit(0).cast("long"), F.col("end_us") - F.col("start_us"))})


def offsets(labels: DataFrame, windows: DataFrame, default_us: int = 0) -> DataFrame:
    """(flow key, offset_us, matched) for each key of the labels: its first window less its first label start.

    Keys without a window get the default. Labels and windows are reduced by key before they meet.
    """
    first_label = labels.groupBy(*K5).agg(F.min("start_us").alias("first_label"))
    first_window = windows.groupBy(*K5).agg(F.min("win_start_us").alias("first_window"))
    got = first_label.join(first_window, list(K5), "left")
    offset = F.coalesce(F.col("first_window") - F.col("first_label"), F.lit(default_us).cast("long"))
    return got.select(*K5, offset.alias("offset_us"), F.col("first_window").isNotNull().alias("matched"))


def shifted(labels: DataFrame, offset: DataFrame, extra_us: tuple[int, ...] = ()) -> DataFrame:
    """Each label once for each of its key's distinct offsets: the estimated one, then the given absolute ones."""
    got = labels.join(offset.select(*K5, "offset_us"), list(K5))
    every = F.array_distinct(F.array(F.col("offset_us"), *[F.lit(x).cast("long") for x in extra_us]))
    got = got.select(*labels.columns, F.posexplode(every).alias("offset_no", "used_us"))
    return got.withColumns({"start_us": F.col("start_us") + F.col("used_us"), "end_us": F.col("start_us") + F.col("used_us") + F.col("dur_us")})


def _level(start: str, end: str) -> Column:
    k = F.length(F.bin(F.col(end) - F.col(start) - 1))
    return k + k % 2


def _levels_of(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("_own").distinct().collect())  # of LEVELS


def _in_cells(df: DataFrame, start: str, end: str, others: list[int]) -> DataFrame:
    """df with a row for each cell (_level, _cell) of its own level and of the other side's higher ones: at most two a level."""
    levels = F.concat(F.array("_own"), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda k: k > F.col("_own")))
    cell = lambda c: F.call_function("shiftright", c, F.col("_level"))
    return df.withColumn("_level", F.explode(levels)).withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end) - 1))))


def candidates(windows: DataFrame, entries: DataFrame, points: bool = False) -> DataFrame:
    """Windows joined with the label entries that they overlap by more than nothing, with iou; with `points` also those without length that lie inside them, with iou 0.

    Time is cut into cells of 2^k microseconds. An interval lies in at most two cells of its own level, and is shorter
    than the cells of all higher ones, so a pair is looked for at the higher of its two levels. Each side has rows at its
    own level and at the levels that the other side has above: a second and a year alike make some ten rows, whatever the
    lengths on the other side. A pair that shares two cells is kept in the one in which its overlap starts.
    """
    left = windows.where("win_end_us > win_start_us").withColumn("_own", _level("win_start_us", "win_end_us"))
    right = entries.select(*K5, *[F.col(c).alias(f"l_{c}") for c in entries.columns if c not in K5])
    right = right.where("l_end_us > l_start_us" if not points else "l_end_us >= l_start_us").withColumn("_reach", F.greatest(F.col("l_end_us"), F.col("l_start_us") + 1))
    right = right.withColumn("_own", _level("l_start_us", "_reach"))
    of_windows, of_entries = _levels_of(left), _levels_of(right)
    left = _in_cells(left, "win_start_us", "win_end_us", of_entries).withColumnRenamed("_own", "_own_w")
    right = _in_cells(right, "l_start_us", "_reach", of_windows).withColumnRenamed("_own", "_own_l")
    both = left.join(right, [*K5, "_level", "_cell"]).where(F.col("_level") == F.greatest("_own_w", "_own_l"))
    begin = F.greatest("win_start_us", "l_start_us")
    both = both.where("win_start_us < l_end_us AND l_start_us < win_end_us").where(F.col("_cell") == F.call_function("shiftright", begin, F.col("_level")))
    both = both.withColumn("_inter", F.least("win_end_us", "l_end_us") - begin)
    union = (F.col("win_end_us") - F.col("win_start_us")) + F.col("l_dur_us") - F.col("_inter")
    return both.withColumn("iou", F.when(union > 0, F.col("_inter") / union).otherwise(F.lit(0.0))).drop("_level", "_cell", "_own_w", "_own_l", "_reach", "_inter")


#: What is known of the entry that a window takes.
BEST = {"best_iou": "double", "best_priority": "int", "best_label": "string", "best_capture_id": "string", "best_flow_id": "string"}


def best_entries(found: DataFrame, key: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(key, *BEST, n_candidates) of candidates with iou: which entry each window takes.

    Entries are gone through in start order: a larger IoU wins, within the tolerance the higher priority, else the
    earlier. Candidates are sorted by window and start and read as they come, so a task holds one entry at a time,
    however many a window has.
    """
    types = dict(found.dtypes)
    order = ["l_start_us", "l_label_row", "l_offset_no", "iou", "l_priority"]
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.select(*key, *order, "l_label", "l_label_capture_id", "l_label_flow_id").repartition(n, *key).sortWithinPartitions(*key, *order, "l_label")
    rows = rows.select(*key, "iou", "l_priority", "l_label", "l_label_capture_id", "l_label_flow_id")
    width = len(key)
    names = [*key, *BEST, "n_candidates"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best, count = None, None, 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                own, (iou, priority, *rest) = row[:width], row[width:]
                if own != at:
                    if at is not None:
                        out.append((*at, *best, count))
                    at, best, count = own, (0.0, -1, None, None, None), 0
                count += 1
                if iou > best[0] + tolerance or (abs(iou - best[0]) <= tolerance and priority > best[1]):
                    best = (iou, priority, *rest)
            yield pd.DataFrame(out, columns=names)
        if at is not None:
            yield pd.DataFrame([(*at, *best, count)], columns=names)

    return rows.mapInPandas(fold, ", ".join(f"`{k}` {types[k]}" for k in key) + ", " + ", ".join(f"{c} {t}" for c, t in BEST.items()) + ", n_candidates int")


def align(windows: DataFrame, entries: DataFrame, key: list[str], benign: str = "BENIGN", points: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """Windows with label, label_iou, label_capture_id, label_flow_id, label_priority, label_is_unknown, n_candidates.

    entries are prepared labels, shifted, with label_row; they are written down, as levels, overlaps and flows go over
    them. A window without overlap is benign if all entries of its flow are (with the ids of the earliest), else
    `unknown`. `key` names the columns that make a window unique; none of them is null. Windows are read several times,
    so they should be a written table. `points` makes labels without length candidates of the windows that they lie in;
    IoUs that differ by no more than `tolerance` are alike, with 0 only equal ones.
    """
    for c in ("label_capture_id", "label_flow_id"):
        if c not in entries.columns:
            entries = entries.withColumn(c, F.lit(""))
    entries = stored(entries)
    found = candidates(windows.select(*key, *[c for c in (*K5, "win_start_us", "win_end_us") if c not in key]), entries, points)
    first = F.min(F.struct("start_us", "label_row", "label_capture_id", "label_flow_id"))
    flows = entries.groupBy(*K5).agg((F.max("priority") == 0).alias("all_benign"), first.alias("first"))
    out = windows.join(best_entries(found, key, tolerance), key, "left").join(flows, list(K5), "left")
    hit, calm = F.col("best_label").isNotNull(), F.coalesce("all_benign", F.lit(False))
    pick = lambda name: F.when(hit, F.col(f"best_{name}")).when(calm, F.col(f"first.label_{name}")).otherwise("")
    return out.withColumns({
        "label": F.when(hit, F.col("best_label")).when(calm, benign).otherwise("unknown"), "label_iou": F.when(hit, F.col("best_iou")).otherwise(F.lit(0.0)),
        "label_capture_id": pick("capture_id"), "label_flow_id": pick("flow_id"), "label_priority": F.when(hit, F.col("best_priority")).otherwise(0).cast("smallint"),
        "label_is_unknown": ~hit & ~calm, "n_candidates": F.coalesce("n_candidates", F.lit(0)),
    }).drop(*BEST, "all_benign", "first")


def alignment_stats(labelled: DataFrame, benign: str = "BENIGN") -> DataFrame:
    """One row: windows, unknown ones and their share, windows with several candidates, benign label, counts by label as JSON in label order."""
    per = labelled.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.col("label_is_unknown"), 1)).alias("unknown"), F.count(F.when(F.col("n_candidates") > 1, 1)).alias("multi"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))))  # one entry for each label
    return per.agg(
        whole("n").alias("total"), whole("unknown").alias("unknown_count"), F.coalesce(F.sum("unknown") / F.sum("n"), F.lit(0.0)).alias("unknown_ratio"),
        whole("multi").alias("multi_candidate"), F.lit(benign).alias("benign_label"), counts.alias("label_counts"),
    )


LABEL_COLUMNS = ("label", "label_iou", "label_capture_id", "label_flow_id", "label_priority", "label_is_unknown")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def propagate(rich: DataFrame, labelled: DataFrame, key: list[str], columns: tuple[str, ...] = LABEL_COLUMNS, check: bool = True) -> DataFrame:
    """rich with the label columns of the labelled windows, one to one on the key; old label columns go first.

    With check on, a key that repeats or stays without a partner raises ValueError; the result is written down first, so
    that the checks go over it and not over what made it.
    """
    out = rich.drop(*columns).join(labelled.select(*key, *columns), key, "left")
    if check:
        out = stored(out)
        if any(duplicate_keys(df, key).limit(1).count() for df in (out, labelled)):
            raise ValueError("a window key repeats")
        if out.where(F.col(columns[0]).isNull()).limit(1).count():
            raise ValueError("a window has no label")
    return out
