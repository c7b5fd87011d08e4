"""Packets: payload merge, canonical endpoints, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.schemas import FLAGS, PACKET_REQUIRED


def clean_packets(df: DataFrame) -> DataFrame:
    """Drops rows without a required field; other fields become 0 or empty; ts_us is added."""
    ts = "ts_us" if "ts_us" in df.columns else "ts"
    df = df.na.drop(subset=[ts if c == "ts" else c for c in PACKET_REQUIRED])
    if ts == "ts":
        df = df.withColumn("ts_us", F.round(F.col("ts") * 1_000_000).cast("long"))
    return df.na.fill(0, ["src_port", "dst_port", "pkt_len", "tcp_window", *FLAGS]).na.fill("", ["payload_hex", "capture_id"])


def clean_payload(payload: DataFrame) -> DataFrame:
    """Empty texts for null ones, keys included, and 0 for a null length."""
    if "frame_number" not in payload.columns:
        raise ValueError("the payload table has no frame_number")
    return payload.na.fill("", [c for c, t in payload.dtypes if t == "string"]).na.fill(0, ["rich_payload_len"])


#: What packets and payload rows are joined on, and their tables are bucketed by.
FRAME = ("capture_id", "frame_number")


def merge_payload(packets: DataFrame, payload: DataFrame | None = None, cleaned: bool = False) -> DataFrame:
    """Packets with payload_len, and with the payload row's hex where the frame has such a row, even an empty one.

    Both sides are equi-joined on FRAME. Tables that write_bucketed() made of clean_packets() and clean_payload() are
    joined bucket by bucket, without a shuffle; `cleaned` says that the payload is such a table, whose keys stay as they are.
    """
    if payload is None:
        return packets.withColumn("payload_len", F.expr("length(payload_hex) div 2").cast("int"))
    rich = (payload if cleaned else clean_payload(payload)).withColumn("_there", F.lit(True))
    out = packets.join(rich, list(FRAME), "left")
    out = out.withColumn("payload_hex", F.when(F.col("_there"), F.col("rich_payload_hex")).otherwise(F.col("payload_hex")))
    length = F.when(F.col("rich_payload_len") > 0, F.col("rich_payload_len")).otherwise(F.expr("length(payload_hex) div 2"))
    return out.withColumn("payload_len", length.cast("int")).drop("_there")


def canonicalize(packets: DataFrame) -> DataFrame:
    """Endpoints in the text order of `ip:port`, with direction 1 where they were so already (or alike), else -1."""
    forward = F.concat_ws(":", "src_ip", "src_port") <= F.concat_ws(":", "dst_ip", "dst_port")
    swap = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return packets.withColumns({
        "src_ip": swap("src_ip", "dst_ip"), "dst_ip": swap("dst_ip", "src_ip"), "src_port": swap("src_port", "dst_port"), "dst_port": swap("dst_port", "src_port"),
        "direction": F.when(forward, 1).otherwise(-1),
    })


def tuple5(*_: object):
    return F.concat_ws(",", "src_ip", "dst_ip", "src_port", "dst_port", "proto")


def ip_pair(df: DataFrame) -> DataFrame:
    """Adds ip_low and ip_high: the two addresses in text order."""
    return df.withColumns({"ip_low": F.least("src_ip", "dst_ip"), "ip_high": F.greatest("src_ip", "dst_ip")})
