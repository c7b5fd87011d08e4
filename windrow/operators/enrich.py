"""Payload statistics, key events, protocol tokens and the summary sentence of a window."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.config import WindowParams
from windrow.functions.columns import display_text, human_bytes, proto_name
from windrow.operators.windows import flow_windows, in_order, in_windows, placed, structured, with_context
from windrow.schemas import KW, K
from windrow.storage import stored

#: Packets that a task counts at once.
COUNTED = 2048


class Ends:
    """The first and the last payload bytes of a window, as the packets that hold them: (time, frame, bytes), in order."""

    @staticmethod
    def cut(packets: list[tuple[int, int, bytes]], most: int, last: bool) -> list[tuple[int, int, bytes]]:
        """As many packets of a list in order as hold `most` bytes, from its start or its end; no packet with more bytes than count."""
        out, n = [], 0
        for t, frame, data in reversed(packets) if last else packets:
            if n >= most:
                break
            data = data[-(most - n) :] if last else data[: most - n]
            out.append((t, frame, data))
            n += len(data)
        return out[::-1] if last else out

    @staticmethod
    def packed(packets: list[tuple[int, int, bytes]]) -> bytes:
        return b"".join(struct.pack("<qqi", t, frame, len(data)) + data for t, frame, data in packets)

    @staticmethod
    def unpacked(raw: bytes) -> list[tuple[int, int, bytes]]:
        out, at = [], 0
        while at < len(raw):
            t, frame, n = struct.unpack_from("<qqi", raw, at)
            out.append((t, frame, raw[at + 20 : at + 20 + n]))
            at += 20 + n
        return out


def _counted(part: pd.DataFrame, params: WindowParams) -> pd.DataFrame:
    """A row for each window of some packets: total bytes, counts of the byte values seen, and both ends."""
    flow = part.groupby(list(K), sort=False, dropna=False).ngroup().to_numpy()
    first, last = part["first_win"].to_numpy(), part["last_win"].to_numpy()
    ts, frame = part["ts_us"].to_numpy(), part["frame_number"].to_numpy()
    payloads = [bytes.fromhex(h[: len(h) // 2 * 2]) if h else b"" for h in part["payload_hex"]]
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    slots = np.repeat(np.arange(len(payloads)) * 256, sizes) + np.frombuffer(b"".join(payloads), np.uint8)
    counts = np.bincount(slots, minlength=256 * len(payloads)).reshape(-1, 256)  # 256 slots for each packet, once
    times = last - first + 1
    packet = np.repeat(np.arange(len(part)), times)
    win = first[packet] + np.arange(len(packet)) - np.repeat(np.cumsum(times) - times, times)
    order = np.lexsort((frame[packet], ts[packet], win, flow[packet]))
    packet, win = packet[order], win[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(win) != 0) | (np.diff(flow[packet]) != 0)])
    total = np.add.reduceat(counts[packet], starts, axis=0)
    rows = []
    for a, b, n in zip(starts.tolist(), [*starts[1:].tolist(), len(packet)], total, strict=True):
        own = [(int(ts[i]), int(frame[i]), payloads[i]) for i in packet[a:b] if payloads[i]]
        seen = np.flatnonzero(n)
        rows.append((int(n.sum()), seen.astype(np.uint8).tobytes(), n[seen].tobytes(), Ends.packed(Ends.cut(own, params.head_bytes, False)), Ends.packed(Ends.cut(own, params.tail_bytes, True))))
    out = part[list(K)].iloc[packet[starts]].reset_index(drop=True)
    out["win"] = win[starts]
    out[["total", "seen", "times", "head", "tail"]] = pd.DataFrame(rows, dtype=object)
    return out


#: Byte values that count as text.
TEXT_BYTES = np.array([32 <= b <= 126 or 9 <= b <= 13 for b in range(256)])


def _described(counts: np.ndarray, head: list, tail: list, params: WindowParams) -> tuple:
    total = int(counts.sum())
    n = counts[counts > 0].astype(np.float64)
    entropy = max(0.0, float(np.log2(total) - (n * np.log2(n)).sum() / total)) if total else 0.0
    text = float(counts[TEXT_BYTES].sum() / total) if total else 0.0
    ends = [b"".join(d for _, _, d in packets).hex() for packets in (head, tail)]
    return entropy, text, *ends, total > params.head_bytes + params.tail_bytes


def payload_summary(rows: DataFrame, params: WindowParams) -> DataFrame:
    """(window key, payload_entropy, payload_ascii_ratio, rich_payload_{head,tail}_{hex,ascii}, rich_payload_truncated).

    rows are placed packets. Each payload is decoded once; a packet's byte counts are added to each of its windows, and
    the first and last bytes kept, before anything is shuffled. The parts of a window are then merged as they come in:
    a task holds one window's 256 counts and its ends.
    """
    types = dict(rows.dtypes)
    key = ", ".join(f"{c} {types[c]}" for c in K) + ", win bigint"
    wanted = rows.select(*K, "first_win", "last_win", "ts_us", "frame_number", "payload_hex")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), COUNTED):
                yield _counted(batch.iloc[i : i + COUNTED], params)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, counts, head, tail = None, None, [], []
        done = lambda: (*at, *_described(counts, head, tail, params))
        names = [*KW, "payload_entropy", "payload_ascii_ratio", "rich_payload_head_hex", "rich_payload_tail_hex", "rich_payload_truncated"]
        for batch in batches:
            out = []
            for *own, _, seen, times, first, last in batch.itertuples(index=False, name=None):
                if own != at:
                    if at is not None:
                        out.append(done())
                    at, counts, head, tail = own, np.zeros(256, np.int64), [], []
                counts[np.frombuffer(seen, np.uint8)] += np.frombuffer(times, np.int64)
                head = Ends.cut(sorted(head + Ends.unpacked(first)), params.head_bytes, False)
                tail = Ends.cut(sorted(tail + Ends.unpacked(last)), params.tail_bytes, True)
            yield pd.DataFrame(out, columns=names)
        if at is not None:
            yield pd.DataFrame([done()], columns=names)

    parts = wanted.mapInPandas(count, f"{key}, total bigint, seen binary, times binary, head binary, tail binary")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = parts.repartition(n, *KW).sortWithinPartitions(*KW).mapInPandas(
        merge, f"{key}, payload_entropy double, payload_ascii_ratio double, rich_payload_head_hex string, rich_payload_tail_hex string, rich_payload_truncated boolean"
    )
    return merged.withColumns({f"rich_payload_{e}_ascii": display_text(F.col(f"rich_payload_{e}_hex")) for e in ("head", "tail")})


def payload_stats(rows: DataFrame, params: WindowParams) -> DataFrame:
    """(window key, payload_entropy, payload_ascii_ratio): bits per byte, and share of 9-13 and 32-126."""
    return payload_summary(rows, params).select(*KW, "payload_entropy", "payload_ascii_ratio")


def payload_ends(rows: DataFrame, params: WindowParams) -> DataFrame:
    """(window key, rich_payload_{head,tail}_{hex,ascii}, rich_payload_truncated)."""
    return payload_summary(rows, params).select(*KW, *[f"rich_payload_{e}_{k}" for k in ("hex", "ascii") for e in ("head", "tail")], "rich_payload_truncated")


def protocol_tokens(members: DataFrame) -> DataFrame:
    """(window key, rich_protocols): distinct tokens of the protocol stacks, in order, with commas."""
    token = F.explode_outer(F.split("rich_frame_protocols", ">"))
    rows = members.select(*KW, token.alias("token")).withColumn("token", F.nullif(F.trim("token"), F.lit("")))
    return rows.groupBy(*KW).agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("rich_protocols"))


def application_text(col=F.col) -> Column:
    """What the application layer says of a packet: HTTP, DNS, TLS, else its protocol stack; joined by ` | `."""
    has = lambda name: F.coalesce(col(name), F.lit("")) != ""
    plus = lambda name, before: F.when(has(name), F.concat(F.lit(before), col(name))).otherwise("")
    uri = F.when(has("rich_http_uri"), col("rich_http_uri")).otherwise("/")
    http = F.when(has("rich_http_method"), F.concat(F.lit("HTTP "), col("rich_http_method"), F.lit(" "), uri, plus("rich_http_host", " host="))).when(
        has("rich_http_status_code"), F.concat(F.lit("HTTP "), col("rich_http_status_code"), plus("rich_http_status_phrase", " "))
    )
    kind = F.when(has("rich_dns_qtype"), col("rich_dns_qtype")).otherwise("Q")
    dns = F.when(has("rich_dns_query"), F.concat(F.lit("DNS "), kind, F.lit(" "), col("rich_dns_query"), plus("rich_dns_answers", " ans=")))
    tls = (
        F.when(has("rich_tls_server_name"), F.concat(F.lit("TLS SNI="), col("rich_tls_server_name"), plus("rich_tls_handshake_type", " type="), plus("rich_tls_version", " ver=")))
        .when(has("rich_tls_content_type"), F.concat(F.lit("TLS content="), col("rich_tls_content_type")))
        .when(has("rich_frame_protocols"), F.concat(F.lit("Protocols="), col("rich_frame_protocols")))
    )
    return F.concat_ws(" | ", http, dns, tls)


def _numbers(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Each row's number, from 1, in its group in the given order."""
    at = np.lexsort((*order[::-1], group))
    g = group[at]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    out = np.empty(len(g), np.int64)
    out[at] = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)])) + 1
    return out


class Choice:
    """Packets of some windows, and which of them are events."""

    def __init__(self, rows: pa.Table, most: int) -> None:
        self.rows, self.most = rows, most
        self.window = rows.select(list(KW)).to_pandas().groupby(list(KW), sort=False, dropna=False).ngroup().to_numpy()
        self.ts, self.frame, self.payload = (rows.column(c).to_numpy() for c in ("ts_us", "frame_number", "payload_len"))
        self.edge = (_numbers(self.window, self.ts, self.frame) == 1) | (_numbers(self.window, -self.ts, -self.frame) == 1)
        self.largest = _numbers(self.window, -self.payload.astype(np.int64), self.ts, self.frame)

    def possible(self) -> pa.Table:
        """The rows that may be events, whatever other rows their windows have: at most `most` + 4 of each."""
        return self.rows.take(np.flatnonzero(self.edge | (self.largest <= self.most + 2)))

    def events(self) -> pa.Table:
        """The events of whole windows, with rank and place."""
        size = np.where(self.edge, 0, -self.payload.astype(np.int64))
        rank = _numbers(self.window, ~self.edge, size, self.ts, self.frame)
        chosen = np.flatnonzero(rank <= self.most if self.most > 2 else self.edge | (self.largest == 1))
        place = _numbers(self.window[chosen], self.ts[chosen], self.frame[chosen])
        kept = place <= self.most
        out = self.rows.take(chosen[kept])
        return out.append_column("rank", pa.array(rank[chosen[kept]], pa.int32())).append_column("place", pa.array(place[kept], pa.int32()))


def key_events(members: DataFrame, params: WindowParams) -> DataFrame:
    """The chosen packets of each window, with rank (order of choice) and place (order in time), at most max_events.

    First and last packet, then the largest payloads (ties: the earlier). Of one event it is the first packet; of two,
    the first and the largest one that is neither first nor last, else the last.

    Each task keeps, of the packets of a window that it reads, the few that may be chosen; these are shuffled by window
    once and chosen from as they come in, so no task holds more of a window than a batch and those few.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from Choice(pa.Table.from_batches([batch]), params.max_events).possible().combine_chunks().to_batches()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_window = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if open_window is None else pa.concat_tables([open_window, rows]).combine_chunks()
            window = Choice(rows, params.max_events).window
            last = int(np.flatnonzero(window == window[-1])[0])  # rows of a window follow each other
            if last:
                yield from Choice(rows.slice(0, last), params.max_events).events().combine_chunks().to_batches()
            open_window = Choice(rows.slice(last), params.max_events).possible()
        if open_window is not None:
            yield from Choice(open_window, params.max_events).events().combine_chunks().to_batches()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = members.mapInArrow(possible, members.schema).repartition(n, *KW).sortWithinPartitions(*KW)
    return few.mapInArrow(choose, T.StructType(list(members.schema.fields)).add("rank", T.IntegerType()).add("place", T.IntegerType()))


def event_struct(params: WindowParams) -> Column:
    """The event of a row of key_events: numbers, flags, preview and its one-line text."""
    offset = (F.col("ts_us") - F.col("win") * params.stride_us) / 1000.0
    names = ("SYN", "ACK", "FIN", "RST", "PSH")
    flags = F.array_compact(F.array(*[F.when(F.col(f"tcp_{n.lower()}") == 1, n) for n in names]))
    direction = F.when(F.col("direction") > 0, "FWD").otherwise("BWD")
    preview = F.nullif(display_text(F.substring("payload_hex", 1, 64)), F.lit(""))
    application = F.nullif(application_text(), F.lit(""))
    window = F.when(F.col("tcp_window") > 0, F.col("tcp_window").cast("int"))
    number = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"))
    text = F.concat_ws(
        " ", F.format_string("[+%.2fms]", offset), direction, proto_name(F.col("proto")), number("len", F.col("pkt_len")), number("payload", F.col("payload_len")),
        F.concat(F.lit("flags="), F.when(F.size(flags) > 0, F.array_join(flags, "|")).otherwise("-")), number("win", window), application, F.concat(F.lit('preview="'), preview, F.lit('"')),
    )
    return F.struct(
        F.round(offset, 3).alias("offset_ms"), direction.alias("direction"), proto_name(F.col("proto")).alias("proto"), F.col("pkt_len").cast("int").alias("len"),
        F.col("payload_len").cast("int").alias("payload_len"), flags.alias("flags"), window.alias("tcp_window"), preview.alias("preview"), application.alias("application"), text.alias("text"),
    )


def window_events(members: DataFrame, params: WindowParams) -> DataFrame:
    """(window key, rich_event_count, rich_events): the events of each window in time order, as JSON text."""
    rows = key_events(members, params).select(*KW, F.struct("place", event_struct(params).alias("event")).alias("e"))
    got = rows.groupBy(*KW).agg(F.count("*").cast("int").alias("rich_event_count"), F.array_sort(F.collect_list("e")).alias("e"))
    return got.select(*KW, "rich_event_count", F.to_json(F.transform("e", lambda x: x["event"])).alias("rich_events"))


def context_summary(params: WindowParams) -> Column:
    """The sentence about a window; needs the features, the context sums and the rich columns."""
    short, long = (f"last {int(s)}s: " for s in params.context_sec)
    whole = lambda c: F.col(c).cast("string")
    base = F.concat(
        F.col("proto_name"), F.lit(" window "), F.format_string("%.3f-%.3fs: ", "win_start_ts", "win_end_ts"), whole("packet_count"), F.lit(" pkts ("), human_bytes(F.col("byte_count")),
        F.lit(") fwd/bwd bytes="), human_bytes(F.col("byte_cnt_fwd")), F.lit("/"), human_bytes(F.col("byte_cnt_bwd")), F.format_string(" summarized entropy=%.2f bits", "payload_entropy"),
    )
    rolling = [F.concat(F.lit(s), whole(f"packet_count_{n}"), F.lit(" pkts / "), human_bytes(F.col(f"byte_count_{n}"))) for s, n in ((short, "10s"), (long, "60s"))]
    events = F.when(F.col("rich_event_count") > 0, F.concat(whole("rich_event_count"), F.lit(" key events captured")))
    protocols = F.when(F.col("rich_protocols") != "", F.concat(F.lit("protocols="), F.col("rich_protocols")))
    return F.concat_ws(" | ", base, *rolling, events, protocols, F.format_string("payload_ascii_ratio=%.2f", "payload_ascii_ratio"))


RICH_OUTPUT = (
    "payload_entropy", "payload_ascii_ratio", "rich_payload_head_hex", "rich_payload_head_ascii", "rich_payload_tail_hex", "rich_payload_tail_ascii", "rich_payload_truncated",
    "rich_event_count", "rich_events", "rich_protocols", "rich_context_summary",
)


def with_rich(windows: DataFrame, rows: DataFrame, params: WindowParams) -> DataFrame:
    """Windows with context sums joined with all rich columns, from placed packets; with compute_rich off, zeros and empty texts."""
    if not params.compute_rich:
        zero = {"payload_entropy": F.lit(0.0), "payload_ascii_ratio": F.lit(0.0), "rich_event_count": F.lit(0), "rich_events": F.lit("[]"), "rich_payload_truncated": F.lit(False)}
        empty = {c: F.lit("") for c in ("rich_payload_head_hex", "rich_payload_head_ascii", "rich_payload_tail_hex", "rich_payload_tail_ascii", "rich_protocols", "rich_context_summary")}
        return windows.withColumns(zero | empty)
    rows = stored(rows)  # three groupings go over them
    members = in_windows(rows)
    out = windows
    for part in (payload_summary(rows, params), protocol_tokens(members), window_events(members, params)):
        out = out.join(part, list(KW), "left")
    return out.withColumn("rich_context_summary", context_summary(params))


def window_tables(packets: DataFrame, params: WindowParams) -> dict[str, DataFrame]:
    """The tables that the switches ask for: `standard` with the structured columns, `rich` with all; both in order."""
    windows = with_context(flow_windows(packets, params), params)
    out = {}
    if params.compute_standard:
        out["standard"] = in_order(structured(windows))
    if params.compute_rich:
        out["rich"] = in_order(with_rich(windows, placed(packets, params), params))
    return out
