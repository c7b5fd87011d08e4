"""Sliding windows per flow and their features.

Packets are shuffled once by flow and time bucket, each bucket with copies of the packets of the window before it, so that
lags need nothing from other buckets; their partial sums are shuffled by flow and window. No task gets a flow whole.
Integer microseconds throughout; doubles only in results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.config import WindowParams
from windrow.functions.columns import proto_name, safe_ratio
from windrow.operators.packets import tuple5
from windrow.schemas import KW, K
from windrow.storage import stored

#: Windows (or strides, if longer) of one time bucket of a flow.
BUCKET_WINDOWS = 16
#: Rows of a flow that rolling sums go over in one task at least.
BLOCK_ROWS = 4096


def _div(c: Column, n: int) -> Column:
    """Floor division, for negative times too."""
    return ((c - F.pmod(c, F.lit(n))) / n).cast("long")


def _spread(at: Column, size: int, halo: int) -> Column:
    """The block of `size` that a number is in, and the next one too if the number is among the last `halo` of its block."""
    own = _div(at, size)
    return F.explode(F.when(F.pmod(at, F.lit(size)) >= size - halo, F.array(own, own + 1)).otherwise(F.array(own)))


def placed(packets: DataFrame, params: WindowParams) -> DataFrame:
    """packets with first_win and last_win, the windows that each is in, and prev_us, the time of the flow's packet before.

    Windows start at multiples of the stride, from the one at or before the flow's first packet. prev_us may be null where
    that packet is not in a window with this one. Packets in no window are left out.

    Packets are dealt out by flow and time bucket, the last window of a bucket to the next one too. The flow's first time,
    one row a flow, goes only to the buckets that hold packets of its first windows; it is a minimum of the key columns
    and the time, summed up before its shuffle, which costs less than reading the packets' shuffle or a copy again.
    """
    size, halo = BUCKET_WINDOWS * max(params.window_us, params.stride_us), params.window_us
    here = [*K, "_bucket"]
    rows = packets.withColumn("_bucket", _spread(F.col("ts_us"), size, halo))
    firsts = packets.groupBy(*K).agg(F.min("ts_us").alias("_first_us")).withColumn("_bucket", _spread(F.col("_first_us"), size, halo))
    rows = rows.join(firsts, here, "left").withColumn("prev_us", F.lag("ts_us").over(Window.partitionBy(*here).orderBy("ts_us", "frame_number")))
    low = F.greatest(_div(F.col("ts_us") - params.window_us, params.stride_us) + 1, _div(F.col("_first_us"), params.stride_us))  # skips null
    rows = rows.where(F.col("_bucket") == _div(F.col("ts_us"), size)).withColumns({"first_win": low, "last_win": _div(F.col("ts_us"), params.stride_us)})
    return rows.where("first_win <= last_win").drop("_bucket", "_first_us")


def in_windows(rows: DataFrame) -> DataFrame:
    """A row with win, the window's number, for each window that a placed packet is in."""
    return rows.withColumn("win", F.explode(F.sequence("first_win", "last_win"))).drop("first_win", "last_win")


def memberships(packets: DataFrame, params: WindowParams) -> DataFrame:
    """A row for each window that a packet is in, with win (the window's number) and prev_us."""
    return in_windows(placed(packets, params))


def _histogram(value: Column, edges: tuple[float, ...], name: str) -> list[Column]:
    """Counts of half-open bins, the last one closed; values outside are dropped."""
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        below = value <= b if i == len(edges) - 2 else value < b
        out.append(F.count(F.when((value >= a) & below, 1)).alias(f"_{name}_{i}"))
    return out


def _normalised(df: DataFrame, edges: tuple[float, ...], name: str) -> DataFrame:
    n = len(edges) - 1
    total = sum((F.col(f"_{name}_{i}") for i in range(1, n)), F.col(f"_{name}_0"))
    df = df.withColumn(f"{name}_sum", total)
    part = lambda i: F.when(F.col(f"{name}_sum") > 0, F.col(f"_{name}_{i}") / F.col(f"{name}_sum")).otherwise(F.lit(0.0))
    return df.withColumns({f"{name}_{i}": part(i) for i in range(n)}).drop(*[f"_{name}_{i}" for i in range(n)])


def window_features(members: DataFrame, params: WindowParams) -> DataFrame:
    """One row per flow and window with all numeric features; members needs payload_len."""
    fwd, bwd = F.col("direction") > 0, F.col("direction") < 0
    start = F.col("win") * params.stride_us
    gap_us = F.when(F.col("prev_us") >= start, F.col("ts_us") - F.col("prev_us"))  # whole numbers add up alike in any order
    gap = gap_us / 1000.0
    when = lambda cond, c: F.sum(F.when(cond, c).otherwise(0))
    on = lambda name: F.col(name) == 1
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    size = F.col("pkt_len")
    got = members.groupBy(*KW).agg(
        F.count("*").alias("packet_count"), F.sum(size).alias("byte_count"), F.count(F.when(fwd, 1)).alias("pkt_cnt_fwd"), F.count(F.when(bwd, 1)).alias("pkt_cnt_bwd"),
        when(fwd, size).alias("byte_cnt_fwd"), when(bwd, size).alias("byte_cnt_bwd"), (F.max("ts_us") - F.min("ts_us")).alias("_dur"),
        *[F.sum(f"tcp_{f}").alias(f"_{f}") for f in ("syn", "fin", "rst", "ack", "psh")],
        F.least(F.count(F.when(fwd & on("tcp_syn"), 1)), F.count(F.when(bwd & on("tcp_syn") & on("tcp_ack"), 1)), F.count(F.when(fwd & on("tcp_ack"), 1))).alias("tcp_handshake_score"),
        F.avg("tcp_window").alias("tcp_window_mean"), F.max("tcp_window").alias("tcp_window_max"),
        F.avg(size).alias("pkt_len_mean"), F.stddev_pop(size).alias("pkt_len_std"), F.min(size).alias("pkt_len_min"), F.max(size).alias("pkt_len_max"),
        zero(F.avg(gap_us) / 1000.0).alias("iat_mean_ms"), zero(F.stddev_pop(gap_us) / 1000.0).alias("iat_std_ms"), zero(F.min(gap)).alias("iat_min_ms"), zero(F.max(gap)).alias("iat_max_ms"),
        F.sum("payload_len").alias("payload_total_len"),
        *_histogram(size, params.size_edges, "pkt_size_hist"), *_histogram(gap, params.iat_edges_ms, "iat_hist"),
    )
    base = F.when(F.col("proto") == 6, F.col("packet_count")).otherwise(0)
    got = got.withColumns({
        "tuple5": tuple5(), "proto_name": proto_name(F.col("proto")), "win_start_us": start, "win_end_us": start + params.window_us,
        "win_start_ts": start / 1e6, "win_end_ts": (start + params.window_us) / 1e6, "flow_dur_ms": F.col("_dur") / 1000.0,
        "fwd_bwd_ratio_pkt": safe_ratio(F.col("pkt_cnt_fwd"), F.col("pkt_cnt_bwd")), "fwd_bwd_ratio_byte": safe_ratio(F.col("byte_cnt_fwd"), F.col("byte_cnt_bwd")),
        **{f"tcp_{f}_ratio": safe_ratio(F.col(f"_{f}"), base) for f in ("syn", "fin", "rst", "ack", "psh")},
        "tcp_rst_count": F.col("_rst"), "tcp_psh_count": F.col("_psh"),
    }).drop("_dur", "_syn", "_fin", "_rst", "_ack", "_psh")
    return _normalised(_normalised(got, params.size_edges, "pkt_size_hist"), params.iat_edges_ms, "iat_hist")


def flow_windows(packets: DataFrame, params: WindowParams) -> DataFrame:
    """Windows of canonical packets that have payload_len."""
    narrow = [*K, "frame_number", "ts_us", "direction", "pkt_len", "tcp_window", "payload_len", "tcp_syn", "tcp_ack", "tcp_fin", "tcp_rst", "tcp_psh"]
    return window_features(memberships(packets.select(*narrow), params), params)


def with_context(windows: DataFrame, params: WindowParams) -> DataFrame:
    """Adds sums over the flow's last windows: as many rows as strides fit into 10 and 60 s, empty windows not counted.

    The windows are written down and numbered within each flow, from counts of time blocks. Blocks of BLOCK_ROWS numbers,
    each with copies of the rows before it that its sums reach back to, are summed side by side.
    """
    halo = max(params.context_rows) - 1
    size = max(BLOCK_ROWS, 16 * halo)
    rows = stored(windows).withColumn("_time", _div(F.col("win"), size))
    time = [*K, "_time"]
    counts = rows.groupBy(*time).agg(F.count("*").alias("_n"))
    counts = counts.select(*time, (F.sum("_n").over(Window.partitionBy(*K).orderBy("_time")) - F.col("_n")).alias("_before"))  # a row for each block
    number = F.col("_before") + F.row_number().over(Window.partitionBy(*time).orderBy("win")) - 1
    rows = rows.join(counts, time).withColumn("_at", number).withColumn("_block", _spread(F.col("_at"), size, halo))
    sums = {}
    for n, name in zip(params.context_rows, ("10s", "60s"), strict=True):
        frame = Window.partitionBy(*K, "_block").orderBy("_at").rowsBetween(-(n - 1), 0)
        sums |= {f"{c}_{name}": F.sum(c).over(frame) for c in ("packet_count", "byte_count", "payload_total_len")}
    return rows.withColumns(sums).where(F.col("_block") == _div(F.col("_at"), size)).drop("_time", "_before", "_at", "_block")


def structured(windows: DataFrame) -> DataFrame:
    """All columns but the rich ones."""
    return windows.select([c for c in windows.columns if not c.startswith("rich_")])


def in_order(windows: DataFrame) -> DataFrame:
    return windows.orderBy("win_start_us", "tuple5", "capture_id")
