"""Operators on small literal tables, against hand-written answers and independent walks."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from windrow.config import LabelParams, SampleParams, SplitParams, WindowParams, dataset
from windrow.functions import columns as C
from windrow.operators import enrich as E
from windrow.operators import labels as L
from windrow.operators import metrics as M
from windrow.operators import prompts as P
from windrow.operators import records as R
from windrow.operators import reports as Q
from windrow.operators import sampling as S
from windrow.operators import splits as X
from windrow.operators import windows as W
from windrow.operators.packets import FRAME, canonicalize, clean_packets, clean_payload, merge_payload
from windrow.operators.responses import parse_response
from windrow.schemas import K
from windrow.sources import tables as T

FLOW = ["a", "10.0.0.1", 80, "10.0.0.2", 443, 6]


def packet_rows(seed, n, spread):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = (("10.0.0.1", 80), ("10.0.0.2", 443)) if rng.random() < 0.6 else (("10.0.0.2", 443), ("10.0.0.1", 80))
        f = lambda: rng.randint(0, 1)
        out.append(("a" if rng.random() < 0.7 else "b", i, rng.randint(0, spread), 6 if i % 9 else 17, a[0], b[0], a[1], b[1], rng.randint(0, 1600), f(), f(), f(), f(), f(), rng.randint(0, 9), "00ff41" * rng.randint(0, 3)))
    return out


SCHEMA = "capture_id string, frame_number long, ts_us long, proto int, src_ip string, dst_ip string, src_port int, dst_port int, pkt_len int, tcp_syn int, tcp_ack int, tcp_fin int, tcp_rst int, tcp_psh int, tcp_window int, payload_hex string"


def walk(rows, params):
    """Pointer walk over each flow's packets, window by window."""
    flows = {}
    for r in rows:
        forward = f"{r[4]}:{r[6]}" <= f"{r[5]}:{r[7]}"
        key = (r[0], *((r[4], r[6], r[5], r[7]) if forward else (r[5], r[7], r[4], r[6])), r[3])
        flows.setdefault(key, []).append((r[2], r[1], 1 if forward else -1, r))
    out = {}
    for key, packets in flows.items():
        packets.sort(key=lambda p: p[:2])
        win = packets[0][0] // params.stride_us
        while win * params.stride_us <= packets[-1][0]:
            start = win * params.stride_us
            inside = [p for p in packets if start <= p[0] < start + params.window_us]
            if inside:
                gaps = [(b[0] - a[0]) / 1000 for a, b in zip(inside, inside[1:], strict=False)]
                sizes = [p[3][8] for p in inside]
                mean = sum(sizes) / len(sizes)
                fwd = sum(p[2] > 0 for p in inside)
                out[*key, win] = (
                    len(inside), sum(sizes), fwd, fwd / (len(inside) - fwd) if len(inside) > fwd else float(fwd), math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)),
                    sum(gaps) / len(gaps) if gaps else 0.0, max(gaps, default=0.0), sum(0 <= s < 64 for s in sizes), sum(len(p[3][15]) // 2 for p in inside),
                )
            win += 1
    return out


@pytest.mark.parametrize("window,stride", [(2.0, 1.0), (1.0, 1.0), (3.0, 2.0), (1.0, 2.5)])
def test_windows_against_a_pointer_walk(spark, window, stride):
    params = WindowParams(window_sec=window, stride_sec=stride)
    rows = packet_rows(int(window * 10 + stride), 300, 40_000_000)
    got = W.flow_windows(canonicalize(merge_payload(clean_packets(spark.createDataFrame(rows, SCHEMA)))), params).collect()
    want = walk(rows, params)
    assert len(got) == len(want)
    for r in got:
        n, size, fwd, ratio, std, gap, longest, small, payload = want[*[r[k] for k in K], r.win]
        assert (r.packet_count, r.byte_count, r.pkt_cnt_fwd, r.payload_total_len) == (n, size, fwd, payload)
        for a, b in ((r.fwd_bwd_ratio_pkt, ratio), (r.pkt_len_std, std), (r.iat_mean_ms, gap), (r.iat_max_ms, longest)):
            assert abs(a - b) < 1e-6
        total = sum(r[f"pkt_size_hist_{i}"] for i in range(7))
        assert abs(total - 1) < 1e-9 and abs(r.pkt_size_hist_0 - small / r.pkt_size_hist_sum) < 1e-9


def test_context_sums_of_one_long_flow(spark, monkeypatch):
    """Blocks of rows, with what sums reach back to: sums over rows, not times, across gaps of any length."""
    monkeypatch.setattr(W, "BLOCK_ROWS", 16)
    rng = random.Random(4)
    params = WindowParams(context_sec=(2.0, 5.0))
    wins = sorted(rng.sample(range(3_000), 700))
    rows = [("a", "x", 1, "y", 2, 6, w, rng.randint(1, 99), 7, w) for w in wins] + [("b", "x", 1, "y", 2, 6, 5, 3, 1, 1)]
    df = spark.createDataFrame(rows, "capture_id string, src_ip string, src_port int, dst_ip string, dst_port int, proto int, win long, packet_count long, byte_count long, payload_total_len long")
    got = {(r.capture_id, r.win): r for r in W.with_context(df, params).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows[:-1]):
        mine = got["a", r[6]]
        for n, name in zip(params.context_rows, ("10s", "60s"), strict=True):
            assert mine[f"packet_count_{name}"] == sum(x[7] for x in rows[max(0, i - n + 1) : i + 1])
            assert mine[f"payload_total_len_{name}"] == sum(x[9] for x in rows[max(0, i - n + 1) : i + 1])
    assert got["b", 5].byte_count_60s == 1


def test_clean_packets_and_endpoint_order(spark):
    rows = [("a", 1, 5, 6, "10.0.0.1", "10.0.0.1", 443, 80, None, None, 1, 0, 0, 0, None, None), ("a", None, 5, 6, "x", "y", 1, 2, 3, 0, 0, 0, 0, 0, 0, ""), ("a", 3, 5, None, "x", "y", 1, 2, 3, 0, 0, 0, 0, 0, 0, "")]
    got = canonicalize(clean_packets(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 1 and (got[0].src_port, got[0].dst_port, got[0].direction, got[0].pkt_len, got[0].payload_hex) == (443, 80, 1, 0, "")


def test_payload_merge(spark):
    packets = spark.createDataFrame([("a", i, "aabb") for i in range(5)], "capture_id string, frame_number long, payload_hex string")
    rich = spark.createDataFrame([("a", 1, "", 0), ("a", 2, "ccddee", 9), ("b", 3, "ff", 1), ("a", 4, None, 7)], "capture_id string, frame_number long, rich_payload_hex string, rich_payload_len int")
    got = {r.frame_number: (r.payload_hex, r.payload_len) for r in merge_payload(packets, rich).collect()}
    assert got == {0: ("aabb", 2), 1: ("", 0), 2: ("ccddee", 9), 3: ("aabb", 2), 4: ("", 7)}
    with pytest.raises(ValueError):
        merge_payload(packets, rich.drop("frame_number"))


def placed(spark, rows):
    return W.placed(canonicalize(merge_payload(clean_packets(spark.createDataFrame(rows, SCHEMA)))), WindowParams())


def members(spark, rows):
    return W.in_windows(placed(spark, rows))


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_key_events_by_definition(spark, most):
    got = {}
    every = members(spark, packet_rows(3, 200, 12_000_000))
    for r in E.key_events(every, WindowParams(max_events=most)).collect():
        got.setdefault((*[r[k] for k in K], r.win), []).append((r.place, r.frame_number))
    windows = {}
    for r in every.collect():
        windows.setdefault((*[r[k] for k in K], r.win), []).append((r.ts_us, r.frame_number, r.payload_len))
    assert got.keys() == windows.keys()
    for key, packets in windows.items():
        packets.sort()
        chosen = [packets[0], *packets[-1:]] if len(packets) > 1 else packets[:1]
        for p in sorted(packets, key=lambda p: -p[2]):
            if p not in chosen:
                chosen.append(p)
            if len(chosen) >= most:
                break
        chosen = sorted(chosen)[:most]
        assert [f for _, f in sorted(got[key])] == [p[1] for p in chosen]


def test_key_events_of_one_large_window(spark):
    """Small batches: the window's packets come in many parts and are cut down in each."""
    n = 5_000
    rows = spark.range(n).select(
        F.lit("a").alias("capture_id"), F.lit("x").alias("src_ip"), F.lit(1).alias("src_port"), F.lit("y").alias("dst_ip"), F.lit(2).alias("dst_port"), F.lit(6).alias("proto"), F.lit(0).cast("long").alias("win"),
        (F.col("id") * 7919 % n).alias("ts_us"), F.col("id").alias("frame_number"), (F.col("id") * 31 % 997).cast("int").alias("payload_len"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(map(tuple, E.key_events(rows.repartition(5), WindowParams(max_events=6)).select("place", "rank", "ts_us", "payload_len").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    packets = sorted((i * 7919 % n, i, i * 31 % 997) for i in range(n))
    chosen = [packets[0], packets[-1], *sorted(packets[1:-1], key=lambda p: (-p[2], p[0], p[1]))[:4]]
    order = sorted(chosen)
    assert got == [(order.index(p) + 1, chosen.index(p) + 1, p[0], p[2]) for p in order]


def test_payload_numbers_and_ends(spark, monkeypatch):
    rows = packet_rows(8, 60, 5_000_000)
    params = WindowParams(head_bytes=4, tail_bytes=5)
    monkeypatch.setattr(E, "COUNTED", 7)  # windows come in many parts
    every = members(spark, rows)
    windows = {}
    for r in every.orderBy("ts_us", "frame_number").collect():
        windows.setdefault((*[r[k] for k in K], r.win), []).append(bytes.fromhex(r.payload_hex))
    stats = {(*[r[k] for k in K], r.win): r for r in E.payload_stats(placed(spark, rows), params).collect()}
    ends = {(*[r[k] for k in K], r.win): r for r in E.payload_ends(placed(spark, rows), params).collect()}
    assert stats.keys() == ends.keys() == windows.keys()
    for key, parts in windows.items():
        data = b"".join(parts)
        p = [data.count(b) / len(data) for b in set(data)]
        assert abs(stats[key].payload_entropy + sum(x * math.log2(x) for x in p)) < 1e-9
        assert abs(stats[key].payload_ascii_ratio - (sum(32 <= b <= 126 or 9 <= b <= 13 for b in data) / len(data) if data else 0)) < 1e-9
        assert ends[key].rich_payload_head_hex == data[:4].hex() and ends[key].rich_payload_tail_hex == data[-5:].hex() and ends[key].rich_payload_truncated == (len(data) > 9)
        assert ends[key].rich_payload_head_ascii == "".join(chr(b) if 32 <= b <= 126 else " " if 9 <= b <= 13 else "." for b in data[:4])


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(C.clean_label(F.lit(" Web Attack – XSS\u0096− "))) == "Web Attack - XSS--" and value(C.clean_label(F.lit(None).cast("string"))) == ""
    assert [value(C.flag(F.lit(x))) for x in ("", "0", " False", "true", "2")] == [0, 0, 0, 1, 1]
    assert [value(C.safe_int(F.lit(x))) for x in ("3.9", "nan", "inf", "", "x", "-2.5")] == [3, 0, 0, 0, 0, -2]
    assert [value(C.human_bytes(F.lit(x))) for x in (12, 2048, 3 << 20, 5 << 30)] == ["12 B", "2.00 KiB", "3.00 MiB", "5.00 GiB"]
    assert value(C.display_text(F.lit("41097f00ff20"))) == "A ... "
    assert value(C.safe_ratio(F.lit(1000), F.lit(0))) == 1000.0
    assert value(C.metric_from_text(F.lit('x "Macro_F1" : 0.75,'), "macro_f1")) == 0.75 and value(C.metric_from_text(F.lit("Macro F1 = -.5"), "macro_f1")) == -0.5
    assert value(C.metric_from_text(F.lit("none"), "macro_f1")) is None
    assert P.relative_text("TCP Window 10.000-12.500s, window 1-2s") == "TCP window 0.000-2.500s, window 0.000-1.000s".replace("TCP window", "TCP window")


LABEL = "label_row long, start_us long, end_us long, label string, src_ip string, dst_ip string, src_port int, dst_port int, proto int"


def test_alignment_against_a_loop(spark):
    """Near ties included: the fold follows the entries in start order."""
    rng = random.Random(1)
    wins = []
    for f in range(6):
        wins += [("a", f"t{f}", w, f"10.0.0.{f}", 1, "10.1.0.1", 2, 6, w * 1_000_000, w * 1_000_000 + 2_000_000) for w in range(30)]
    labels = []
    for i in range(60):
        f = rng.randint(0, 4)
        s = rng.randint(0, 30) * 500_000
        labels.append((i, s, s + rng.choice([0, 1_000_000, 2_000_000, 2_000_001]), rng.choice(["BENIGN", "DoS", "Bot"]) if f else "BENIGN", f"10.0.0.{f}", "10.1.0.1", 1, 2, 6))
    windows = spark.createDataFrame(wins, "capture_id string, tuple5 string, win long, src_ip string, src_port int, dst_ip string, dst_port int, proto int, win_start_us long, win_end_us long")
    prepared = L.prepare(spark.createDataFrame(labels, LABEL))
    entries = L.shifted(prepared, L.offsets(prepared, windows), (0, 3_000_000))
    got = {(r.tuple5, r.win): r for r in L.align(windows, entries, ["capture_id", "tuple5", "win"]).collect()}
    first = {f: min((x[1] for x in labels if x[4] == f"10.0.0.{f}"), default=None) for f in range(6)}
    for _, t, w, *_, a, b in wins:
        f = int(t[1:])
        own = []
        for row, s, e, name, ip, *_ in labels:
            if ip == f"10.0.0.{f}":
                for no, off in enumerate(dict.fromkeys([-first[f], 0, 3_000_000])):
                    own.append((s + off, row, no, s + off + (e - s), e - s, name, int(name != "BENIGN")))
        best = (0.0, -1, None)
        n = 0
        for s, _, _, e, dur, name, priority in sorted(own):
            inter = min(b, e) - max(a, s)
            if inter > 0:
                n += 1
                iou = inter / (b - a + dur - inter)
                if iou > best[0] + 1e-9 or (abs(iou - best[0]) <= 1e-9 and priority > best[1]):
                    best = (iou, priority, name)
        calm = bool(own) and all(not x[-1] for x in own)
        r = got[t, w]
        assert r.label == (best[2] or ("BENIGN" if calm else "unknown")) and r.n_candidates == n and r.label_is_unknown == (best[2] is None and not calm)
        assert abs(r.label_iou - best[0]) < 1e-12


def test_label_times(spark):
    rows = [("3/7/2017 9:05:00", "3/7/2017 9:06:00"), ("bad", "3/7/2017 9:06:00"), ("3/7/2017 9:05:00", "3/7/2017 9:00:00"), (None, None)]
    got = L.label_times(spark.createDataFrame(rows, "ts_start string, ts_end string"), LabelParams(timezone="America/Halifax")).collect()
    assert [(r.start_us, r.end_us - r.start_us) for r in got] == [(1_499_083_500_000_000, 60_000_000), (1_499_083_500_000_000, 0)]
    with pytest.raises(ValueError):
        dataset("other")


def test_propagation_and_its_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, label string")
    assert L.propagate(a, spark.createDataFrame([(1, "p"), (2, "q")], "k long, label string"), ["k"], ("label",)).where("k = 2").first().label == "q"
    for other in ([(1, "p")], [(1, "p"), (2, "q"), (2, "r")]):
        with pytest.raises(ValueError):
            L.propagate(a, spark.createDataFrame(other, "k long, label string"), ["k"], ("label",))


def test_split_sizes(spark):
    rows = [(i, f"g{i % 3}" if i % 7 else None, "A" if i % 5 else "B") for i in range(400)]
    got = X.stratified_split(spark.createDataFrame(rows, "k long, g string, label string"), ["k"], "g", params=SplitParams(ratios=(0.8, 0.1, 0.1)))
    sizes, strata = {}, {}
    for r in got.collect():
        sizes[r.g, r.label, r.split] = sizes.get((r.g, r.label, r.split), 0) + 1
    for _, g, label in rows:
        strata[g, label] = strata.get((g, label), 0) + 1
    for (g, label), n in strata.items():
        whole = [math.floor(n * x) for x in (0.8, 0.1, 0.1)]
        for i in range(n - sum(whole)):
            whole[i % 3] += 1
        assert [sizes.get((g, label, s), 0) for s in ("train", "val", "test")] == whole
    with pytest.raises(ValueError):
        SplitParams(ratios=(0.5, 0.4, 0.2))


def test_ids_are_the_places_in_order(spark):
    rows = [(random.Random(i).randint(0, 10**6), i) for i in range(500)]
    got = {r.i: r.flow_id for r in X.sequential_ids(spark.createDataFrame(rows, "x long, i long"), ["x", "i"]).collect()}
    assert got == {i: n + 1 for n, (_, i) in enumerate(sorted(rows))}


def test_samples(spark):
    rows = [(i, "BENIGN" if i % 10 else ("DoS", None, "unknown")[i % 3]) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, label string")
    attack = sum(x[1] != "BENIGN" for x in rows)
    got = S.balanced_sample(df, ["k"], SampleParams(target=600))
    assert got.count() == 600 and got.where("label is null or label <> 'BENIGN'").count() == attack
    assert S.balanced_sizes(700, 5000, SampleParams(target=600)) == 0
    assert S.balanced_sample(df, ["k"], SampleParams(target=20_000)).count() == attack * 4
    assert S.sample_n(df, 50, ["k"], 1).count() == 50 and S.sample_n(df, 50, ["k"], 1).exceptAll(df).count() == 0
    assert S.sample_n(df, 50, ["k"], 1).exceptAll(S.sample_n(df, 1999, ["k"], 1)).count() == 0
    assert S.validation_sample(df, ["k"], 1000, 0.5, least=300).count() == 300
    assert S.validation_sample(df.where("label = 'BENIGN'"), ["k"], 0, 0.0).count() == 0


def test_samples_are_the_first_in_hash_order(spark):
    """Strata of one to 3,000 rows, a null one and repeated rows, against a sort of each whole stratum; the counting pass is the only other one."""
    rows = [(i // 2 if i < 40 else i, None if i % 50 == 7 else "big" if i % 5 else f"s{i % 15}") for i in range(4000)] + [(9999, "one")]
    df = spark.createDataFrame(rows, "k long, label string")
    quotas = {"big": 700, "s0": 0, "s5": 10**6, "s10": 13, None: 5, "one": 1}
    quota = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() if kv[0] for x in kv])[F.col("stratum")], F.lit(quotas[None]))
    bins = S.hash_bins(df, F.col("label"), ["k"], 3)
    got = S.first_by_hash(df, bins, F.col("label"), quota, ["k"], 3)
    hashed = {r.k: r.h for r in df.select("k", C.hash_key(3, F.col("k")).alias("h")).distinct().collect()}
    want = []
    for label, n in quotas.items():
        own = sorted((x for x in rows if x[1] == label), key=lambda x: (hashed[x[0]], x[0]))
        want += own[:n]
    text = lambda xs: sorted((k, str(label)) for k, label in xs)
    assert text(map(tuple, got.collect())) == text(want)
    assert {r.stratum: r.total for r in bins.collect()} == {x: sum(y[1] == x for y in rows) for x in quotas}
    order = [hashed[r.k] for r in S.sample_n(df, 300, ["k"], 3).collect()]
    assert order == sorted(order) == sorted(hashed[k] for k, _ in rows)[:300]
    assert S.sample_n(df.limit(0), 5, ["k"], 3).count() == S.balanced_sample(df.limit(0), ["k"]).count() == 0


def test_lines_that_are_no_strict_json(spark):
    odd = ['{"flow_id": 1, "label": NaN}', '{"label": "a"} trailing', "[1]", "5", "null", '{"flow_id": null, "tuple5": {}, "window": [1, null], "features": 3, "label": null}', "{}"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(odd)], "file string, line int, value string")
    found = {(r.line, r.path): r.message for r in R.validate(lines).collect()}
    assert {i for (i, p), m in found.items() if p == "" and m == "not a JSON object"} >= {2, 3, 4} and (6, "") not in found and (0, "") not in found
    assert {p for i, p in found if i == 5} == {"flow_id", "tuple5", "window", "features", "label", *(f"features.{c}" for c in R.ESSENTIAL)}
    assert {(p, m) for (i, p), m in found.items() if i == 6} == {(k, "required") for k in R.RECORD_KEYS}


def test_metrics_by_definition(spark):
    pairs = [("a", "a")] * 3 + [("a", "b"), ("b", ""), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(pairs, "reference_label string, predicted_label string")
    got = {r.label: r for r in M.class_metrics(df).collect()}
    assert set(got) == {"a", "b", "c", ""} and got["a"].precision == 0.75 and got["a"].recall == 0.75 and got[""].f1 == 0.0
    overall = M.overall_metrics(M.class_metrics(df)).first()
    assert abs(overall.accuracy - 4 / 7) < 1e-12 and abs(overall.macro_recall - (0.75 + 0.5) / 4) < 1e-12
    assert M.overall_metrics(M.class_metrics(df.limit(0))).first().accuracy is None


def test_responses():
    cases = {
        '{"label": "Bot", "explanation": "x"} tail }': ("Bot", "x"),
        'a {"x": {"label": "DoS"}}': ("DoS", None),
        '{"label": "DoS Hulk", "explanation": "cut} he said': ("DoS Hulk", "cut} he said"),
        "First. This is a ddos flood! End": ("DDoS", "This is a ddos flood"),
        "the label is 'weird' here": ("WEIRD", "the label is 'weird' here"),
        "": (None, None),
        "{" * 3000 + "}": (None, None),
    }
    for text, want in cases.items():
        assert parse_response(text) == want
    assert parse_response(None) == (None, None)


def test_records_round_trip_and_rules(spark, tmp_path):
    rows = [tuple([*FLOW, 0, "t", "TCP", 0.0, 2.0, 1, 0, 10, 0, 1.0, 10.0, 0.5, 0.0, float("nan"), 0.5, 0.5, "BENIGN", 1, '[{"direction":"UP","len":1}]', "a,,b", 0.5])]
    names = [*K, "win", "tuple5", "proto_name", "win_start_ts", "win_end_ts", *R.ESSENTIAL, "pkt_size_hist_0", "pkt_size_hist_1", "label", "flow_id", "rich_events", "rich_protocols", "payload_entropy"]
    df = spark.createDataFrame(rows, names).withColumns({c: F.lit("") for c in ("rich_context_summary", "rich_payload_head_ascii", "rich_payload_head_hex", "rich_payload_tail_ascii", "rich_payload_tail_hex")})
    df = df.withColumns({"payload_total_len": F.lit(3), "payload_ascii_ratio": F.lit(1.5), "rich_event_count": F.lit(1), "rich_payload_truncated": F.lit(False)})
    record = json.loads(df.select(R.struct_json(df)).first()[0])
    assert record["tuple5"] == ["10.0.0.1", "10.0.0.2", 80, 443, 6] and record["window"] == [0.0, 2.0] and "tcp_rst_ratio" not in record["features"]
    assert record["features"]["pkt_size_hist"] == [0.5, 0.5] and record["label"] == "BENIGN"
    rich = json.loads(df.select(R.enriched_json(df)).first()[0])["enriched"]
    assert rich["protocols"] == ["a", "b"] and rich["payload"]["total_len"] == 3 and rich["events"][0]["direction"] == "UP"
    lines = df.select(F.lit("f").alias("file"), F.lit(1).alias("line"), R.enriched_json(df).alias("value"))
    found = {(r.path, r.message) for r in R.validate(lines, enriched=True).collect()}
    assert {("features.tcp_rst_ratio", "a required number"), ("enriched.events.direction", "FWD or BWD"), ("enriched.payload.ascii_ratio", "within 0 and 1")} <= found
    path = str(tmp_path / "r.jsonl")
    with open(path, "w") as f:
        f.write(json.dumps(record) + "\n\n{broken\n" + json.dumps({k: v for k, v in record.items() if k != "label"}) + "\n")
    assert [r.tuple5 for r in T.read_records(spark, path).collect()] == [["10.0.0.1", "10.0.0.2", "80", "443", "6"]]
    assert {(r.line, r.path) for r in R.validate(T.read_lines(spark, path)).where("path in ('', 'label')").collect()} == {(3, ""), (4, "label")}
    assert R.validate(T.read_lines(spark, path), limit=1).where("line > 1").count() == 0


def test_records_of_any_address(spark):
    odd = ['[fe80::1]', 'a"b', "back\\slash", "\x01\n\t", "é" * 20_000, "", None, "]}],["]
    rows = [(i, a, b, 1, None, 6, 0.0, 1.0, 5, "x") for i, (a, b) in enumerate(zip(odd, reversed(odd), strict=True))]
    df = spark.createDataFrame(rows, "flow_id long, src_ip string, dst_ip string, src_port int, dst_port int, proto int, win_start_ts double, win_end_ts double, pkt_cnt_fwd int, label string")
    df = df.withColumn("proto_name", F.lit("TCP"))
    for make in (R.struct_json, R.prompt_json):
        for text, row in zip(df.select(make(df)).collect(), rows, strict=True):
            assert json.loads(text[0])["tuple5"] == [row[1] or "", row[2] or "", 1, 0, 6]


def test_sources(spark, tmp_path):
    head = "frame.number,frame.time_epoch,ip.src,ip.dst,ip.proto,tcp.srcport,udp.srcport,tcp.dstport,frame.len,tcp.flags.syn,data.data,tcp.payload,frame.protocols,dns.a,dns.aaaa"
    with open(tmp_path / "f.csv", "w") as f:
        f.write(head + '\n1.0,2.5,"a",b,6,,53,443,60.7,True,AA:0b,,eth:ip,"1,2",::1\n2,x,a,b,6,1,,2,3,0,,,,,\n3,1,a,b,6.5,1,,2,3,0,,cc,,,\n')
    raw = T.read_fields(spark, str(tmp_path / "f.csv"))
    r = T.normalise_packets(raw).collect()
    assert len(r) == 1 and (r[0].src_port, r[0].dst_port, r[0].pkt_len, r[0].tcp_syn, r[0].tcp_ack, r[0].payload_hex) == (53, 443, 60, 1, 0, "aa0b")
    p = T.normalise_payload(raw).orderBy("frame_number").collect()
    assert [(x.rich_payload_hex, x.rich_payload_len, x.rich_frame_protocols, x.rich_dns_answers) for x in p] == [("aa0b", 2, "eth>ip", "1;2;::1"), ("", 0, "", ""), ("cc", 1, "", "")]
    df = spark.createDataFrame([(1, "train"), (2, "val")], "x long, split string")
    T.write_splits(df, str(tmp_path / "s"), ("train", "val"))
    assert {(x.x, x.split) for x in T.read_splits(spark, str(tmp_path / "s")).collect()} == {(1, "train"), (2, "val")}
    T.write_lines(df, F.to_json(F.struct("x")), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 2
    for run, text in (("r1", "accuracy: 0.5"), ("r2", '{"accuracy": 0.7}')):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "val_log.txt").write_text(text)
    runs = M.metrics_from_logs(T.read_logs(spark, str(tmp_path / "runs/*/val_log.txt")), ["accuracy"])
    assert [tuple(x) for x in M.rank_runs(runs, "accuracy").orderBy("place").collect()] == [("r2", 0.7, 1), ("r1", 0.5, 2)]


def test_report_and_histograms(spark):
    rows = [(f"t{i % 4}", "c", "", 6 if i % 3 else 17, ("BENIGN", "DoS", "unknown")[i % 3], i % 3 == 2, "train" if i % 2 else "test") for i in range(60)]
    df = spark.createDataFrame(rows, "tuple5 string, capture_id string, label_capture_id string, proto int, label string, label_is_unknown boolean, split string")
    text = Q.markdown(df)
    assert "- windows: 60" in text and "33.33%" in text and "| 6 (TCP) |" in text
    values = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 9, 10, 10)], "v double")
    assert {r.bin: r.n for r in Q.histogram(values, "v", 5).collect()} == {0: 2, 1: 1, 4: 3}


def test_masks_and_prompts(spark):
    df = spark.createDataFrame([(i, "1.2.3.4", "5.6.7.8") for i in range(2000)], "flow_id long, src_ip string, dst_ip string")
    got = P.mask_ips(df, 0.3).agg(F.avg((F.col("src_ip") == "REDACTED").cast("int")), F.avg(((F.col("src_ip") == "REDACTED") & (F.col("dst_ip") == "REDACTED")).cast("int"))).first()
    assert abs(got[0] - 0.3) < 0.04 and abs(got[1] - 0.09) < 0.03
    assert P.mask_ips(df, 0.0) is df
    assert "  - Bot\n  - DoS" in P.system_prompt(["DoS", "Bot", "DoS"])


def test_label_times_where_the_clock_changes_by_half_an_hour_or_a_day(spark):
    cases = [
        ("Australia/Lord_Howe", "07/04/2019 01:45", None), ("Australia/Lord_Howe", "07/04/2019 01:15", datetime.datetime(2019, 4, 6, 14, 15)), ("Australia/Lord_Howe", "07/04/2019 02:15", datetime.datetime(2019, 4, 6, 15, 45)),
        ("Australia/Lord_Howe", "06/10/2019 02:10", None), ("Australia/Lord_Howe", "06/10/2019 02:40", datetime.datetime(2019, 10, 5, 15, 40)),
        ("Pacific/Apia", "30/12/2011 12:00", None), ("Pacific/Apia", "29/12/2011 12:00", datetime.datetime(2011, 12, 29, 22, 0)), ("Pacific/Apia", "31/12/2011 12:00", datetime.datetime(2011, 12, 30, 22, 0)),
        ("Antarctica/Troll", "27/10/2019 02:30", None), ("Antarctica/Troll", "27/10/2019 03:30", datetime.datetime(2019, 10, 27, 3, 30)), ("Asia/Kolkata", "01/02/2020 00:00", datetime.datetime(2020, 1, 31, 18, 30)),
    ]
    for zone, text, want in cases:
        got = L.label_times(spark.createDataFrame([(text, text)], "ts_start string, ts_end string"), LabelParams(timezone=zone)).collect()
        assert [r.start_us for r in got] == ([int(want.replace(tzinfo=datetime.UTC).timestamp()) * 1_000_000] if want else []), (zone, text)


def test_candidates_of_any_length_against_all_pairs(spark):
    """Labels from a second to a year, windows of two lengths, times before 1970 too."""
    rng = random.Random(12)
    year = 366 * 86_400_000_000
    flow = ("x", 1, "y", 2, 6)
    wins = [(i, *flow, s, s + rng.choice([2_000_000, 28_800_000_000])) for i in range(300) for s in [rng.randrange(-year, year)]]
    wins += [(1000 + i, *flow, w[6], w[7]) for i, w in enumerate(wins[:5])] + [(2000, *flow, 5, 5)]
    labels = [(i, *flow, s, s + int(math.exp(rng.uniform(0, math.log(year)))), 0) for i in range(300) for s in [rng.choice(wins)[6] + rng.randrange(-(10**9), 10**9)]] + [(900, *flow, 7, 7, 0)]
    five = "src_ip string, src_port int, dst_ip string, dst_port int, proto int"
    entries = spark.createDataFrame([(*x[:8], x[7] - x[6]) for x in labels], f"label_row long, {five}, start_us long, end_us long, dur_us long")
    got = L.candidates(spark.createDataFrame(wins, f"win long, {five}, win_start_us long, win_end_us long"), entries).select("win", "l_label_row", "iou").collect()
    want = {}
    for w in wins:
        for x in labels:
            inter = min(w[7], x[7]) - max(w[6], x[6])
            if inter > 0:
                want[w[0], x[0]] = inter / (w[7] - w[6] + x[7] - x[6] - inter)
    assert len(got) == len(want) > 300
    assert all(abs(r.iou - want[r.win, r.l_label_row]) < 1e-12 for r in got)


def test_candidates_without_length_against_all_pairs(spark):
    """Times before 1970 and the ends of windows too; left out unless asked for."""
    rng = random.Random(13)
    flow = ("x", 1, "y", 2, 6)
    wins = [(i, *flow, s, s + rng.choice([1, 2, 7, 2_000_000])) for i in range(200) for s in [rng.randrange(-3_000_000, 3_000_000)]]
    at = [rng.choice(wins)[k] + d for k in (6, 7) for d in (-1, 0, 1) for _ in range(30)]
    labels = [(i, *flow, s, s + rng.choice([0, 0, 1, 500]), 0) for i, s in enumerate(at)]
    five = "src_ip string, src_port int, dst_ip string, dst_port int, proto int"
    entries = spark.createDataFrame([(*x[:8], x[7] - x[6]) for x in labels], f"label_row long, {five}, start_us long, end_us long, dur_us long")
    windows = spark.createDataFrame(wins, f"win long, {five}, win_start_us long, win_end_us long")
    want = {(w[0], x[0]): (min(w[7], x[7]) - max(w[6], x[6])) / (w[7] - w[6] + x[7] - x[6] - min(w[7], x[7]) + max(w[6], x[6])) for w in wins for x in labels if w[6] < x[7] and x[6] < w[7]}
    got = L.candidates(windows, entries, points=True).select("win", "l_label_row", "iou").collect()
    assert len(got) == len(want) and all(abs(r.iou - want[r.win, r.l_label_row]) < 1e-12 for r in got)
    assert 0 < L.candidates(windows, entries).count() == sum(iou > 0 for iou in want.values()) < len(want)


def test_best_entry_of_a_window_with_a_million_candidates(spark):
    n = 1_000_000
    found = spark.range(n).select(
        F.lit("a").alias("capture_id"), F.when(F.col("id") < n - 2, 1).otherwise(2).cast("long").alias("win"), F.col("id").alias("l_start_us"), F.col("id").alias("l_label_row"), F.lit(0).alias("l_offset_no"),
        F.when(F.col("id") == 654_321, 0.75).otherwise(F.col("id") % 1000 / 2000).alias("iou"), (F.col("id") % 2).cast("int").alias("l_priority"), F.concat(F.lit("L"), F.col("id")).alias("l_label"),
        F.lit("").alias("l_label_capture_id"), F.lit("").alias("l_label_flow_id"),
    )
    got = {r.win: r for r in L.best_entries(found.repartition(6), ["capture_id", "win"]).collect()}
    assert (got[1].best_label, got[1].best_iou, got[1].n_candidates) == ("L654321", 0.75, n - 2)
    assert (got[2].best_label, got[2].n_candidates) == (f"L{n - 1}", 2)


def test_label_times_in_several_forms_and_odd_hours(spark):
    forms = ["07/03/2017 08:05:09", "7/3/2017 8:05", "7/3/2017 08:05:09 PM", "2017-03-07 08:05:09", "7/14/2017 8:05", "soon", "", None, "26/3/2017 2:30:00", "29/10/2017 2:30:00"]
    params = LabelParams(timezone="Europe/Berlin")
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(forms)], "i int, ts_start string, ts_end string")
    got = {r.i: r.start_us // 1_000_000 for r in L.label_times(df, params).collect()}
    at = lambda *x: int(datetime.datetime(*x, tzinfo=datetime.UTC).timestamp())
    want = {0: at(2017, 3, 7, 7, 5, 9), 1: at(2017, 3, 7, 7, 5), 2: at(2017, 3, 7, 19, 5, 9), 3: at(2017, 3, 7, 7, 5, 9), 4: at(2017, 7, 14, 6, 5)}
    assert got == want  # the last two are skipped and shown twice by the clock


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 1), ("c", 500)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" if i % 5 else "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted((r.file[-5], r.line, r.value) for r in T.read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(name, i, f"{name}{i}" if i % 5 else "") for name, n in (("a", 3000), ("b", 1), ("c", 500)) for i in range(1, n + 1)]


def test_window_tables_by_switches(spark):
    packets = canonicalize(merge_payload(clean_packets(spark.createDataFrame(packet_rows(2, 40, 5_000_000), SCHEMA))))
    packets = packets.withColumns({c: F.lit("") for c in ("rich_frame_protocols", "rich_http_method", "rich_http_uri", "rich_http_host", "rich_http_status_code", "rich_http_status_phrase", "rich_dns_query", "rich_dns_qtype", "rich_dns_answers", "rich_tls_server_name", "rich_tls_handshake_type", "rich_tls_content_type", "rich_tls_version")})
    tables = E.window_tables(packets, WindowParams(compute_standard=False))
    assert list(tables) == ["rich"] and set(E.RICH_OUTPUT) <= set(tables["rich"].columns)
    tables = E.window_tables(packets, WindowParams(compute_rich=False))
    assert list(tables) == ["standard"] and not any(c.startswith("rich_") for c in tables["standard"].columns)
    with pytest.raises(ValueError):
        WindowParams(compute_standard=False, compute_rich=False)


def test_raw_prompt_hides_times_and_label(spark):
    rows = [tuple([*FLOW, 0, "t", "TCP", 100.0, 102.0, *[1.0] * len(R.ESSENTIAL), "Bot", 1, "[]", "", 0.5, "TCP window 100.000-102.000s: 1 pkts"])]
    names = [*K, "win", "tuple5", "proto_name", "win_start_ts", "win_end_ts", *R.ESSENTIAL, "label", "flow_id", "rich_events", "rich_protocols", "payload_entropy", "rich_context_summary"]
    df = spark.createDataFrame(rows, names).withColumns({c: F.lit("") for c in ("rich_payload_head_ascii", "rich_payload_head_hex", "rich_payload_tail_ascii", "rich_payload_tail_hex")})
    df = df.withColumns({"payload_total_len": F.lit(3), "payload_ascii_ratio": F.lit(0.5), "rich_event_count": F.lit(0), "rich_payload_truncated": F.lit(False)})
    for rich in (False, True):
        text = df.select(P.raw_prompt(df, ["Bot"], with_enriched=rich)).first()[0]
        assert text.startswith(P.system_prompt(["Bot"]) + "\n")
        record = json.loads(text[len(P.system_prompt(["Bot"])) + 1 :])
        assert record["windows_length"] == 2.0 and "window" not in record and "label" not in record
        assert not rich or record["enriched"]["context_summary"] == "TCP window 0.000-2.000s: 1 pkts"


def test_values_of_other_kinds_break_rules(spark):
    good = {"flow_id": 1, "tuple5": ["a", "b", 1, 2, 6], "window": [0.5, 2], "features": {n: 1 for n in R.ESSENTIAL} | {"iat_hist": [0, 0.5], "other": None, "name": "x", "on": True}, "label": "Bot"}
    event = {"offset_ms": 0.5, "direction": "FWD", "proto": "TCP", "len": 1, "payload_len": 0, "flags": ["SYN"]}
    payload = {"total_len": 0, "entropy": 0, "ascii_ratio": 1, "head_ascii": "", "head_hex": "", "tail_ascii": "", "tail_hex": "", "truncated": False}
    rich = good | {"enriched": {"context_summary": "", "events": [event, event | {"tcp_window": 5, "text": "t"}], "event_count": 2, "payload": payload, "protocols": ["a"], "proto_name": "TCP"}}

    def broken(record, enriched=False):
        lines = spark.createDataFrame([("f", 1, json.dumps(record))], "file string, line int, value string")
        return {(r.path, r.message) for r in R.validate(lines, enriched).collect()}

    assert broken(good) == broken(rich, True) == set()
    plain = good | {"flow_id": "1", "tuple5": [1, "b", 1, 2, 6], "window": ["0", 1], "label": 3, "features": good["features"] | {"iat_hist": ["x"], "deep": {"a": 1}, "pkt_cnt_fwd": "1"}}
    assert {p for p, _ in broken(plain)} == {"flow_id", "tuple5", "window", "label", "features.iat_hist", "features", "features.pkt_cnt_fwd"}
    assert broken(rich | {"enriched": rich["enriched"] | {"events": [event] * 11}}, True) == {("enriched.events", "at most 10")}
    odd = rich["enriched"] | {"events": [event | {"len": -1, "flags": "SYN", "tcp_window": 1.5}], "protocols": [1], "payload": {k: v for k, v in payload.items() if k != "truncated"} | {"entropy": -1, "x": 1}}
    assert {p for p, _ in broken(rich | {"enriched": odd}, True)} == {
        "enriched.events.len", "enriched.events.flags", "enriched.events.tcp_window", "enriched.protocols", "enriched.payload.truncated", "enriched.payload.entropy", "enriched.payload",
    }


def test_pair_mix_has_all_labels(spark):
    pairs = spark.createDataFrame([("a", "b", x, n, 6, 0.5) for x, n in (("BENIGN", 3), ("Web Attack - XSS", 2), ("DoS", 1))] + [("c", "d", "Bot", 1, 1, 1.0)], "ip_low string, ip_high string, label string, cnt long, total long, fraction double")
    row = Q.pair_mix(pairs, Q.pair_purity(pairs), 1).collect()
    assert [r.asDict() for r in row] == [{"pair": "a↔b", "BENIGN": 3, "DoS": 1, "Web Attack - XSS": 2}]


def test_splits_are_written_in_one_pass(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    df = spark.range(90).select(counted.asNondeterministic()("id").alias("id"), F.element_at(F.array(F.lit("train"), F.lit("test"), F.lit("left out")), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    for _ in range(2):  # the second time over old tables
        T.write_splits(df, str(tmp_path))
    assert calls.value <= 2 * 90
    got = T.read_splits(spark, str(tmp_path))
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 30, "test": 30}
    assert spark.read.parquet(f"{tmp_path}/features_val.parquet").columns == ["id"]
    assert not list(tmp_path.glob("_splits-*"))


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    packets = spark.range(500).select(F.lit("a").alias("capture_id"), F.col("id").alias("frame_number"), F.lit("aabb").alias("payload_hex"))
    rich = packets.where("frame_number % 3 = 0").select(*FRAME, F.lit("cc").alias("rich_payload_hex"), F.lit(None).cast("int").alias("rich_payload_len"))
    tables = [T.write_bucketed(df, f"bucketed_{name}", FRAME, 4, str(tmp_path / name)) for name, df in (("packets", packets), ("payload", clean_payload(rich)))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = merge_payload(*tables, cleaned=True)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.select("frame_number", "payload_hex", "payload_len").collect())) == sorted(map(tuple, merge_payload(packets, rich).select("frame_number", "payload_hex", "payload_len").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("packets", "payload"):
            spark.sql(f"DROP TABLE bucketed_{name}")


def test_distinct_counts_exact_and_sketched(spark):
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("t"), (F.col("id") * 7 % 20_011).cast("string")).alias("tuple5"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")).alias("label_capture_id"),
        F.lit("").alias("capture_id"), (F.col("id") % 10 == 0).alias("label_is_unknown"),
    )
    exact = Q.describe_splits(df)
    want = {}
    for r in df.collect():
        w = want.setdefault(r.split, [0, set(), set(), set(), 0])
        w[0] += 1
        w[1].add(r.tuple5)
        w[2] |= {r.label_capture_id} - {None}
        w[3].add(r.capture_id)
        w[4] += r.label_is_unknown
    assert {r.split: (r.windows, r.tuple5s, r.label_captures, r.captures, r.unknown_ratio) for r in exact.collect()} == {k: (w[0], len(w[1]), len(w[2]), len(w[3]), w[4] / w[0]) for k, w in want.items()}
    assert "Expand" not in exact._jdf.queryExecution().executedPlan().toString()
    halves = [Q.split_sketches(df.where(F.col("tuple5") < "t2"), ["split"]), Q.split_sketches(df.where(F.col("tuple5") >= "t2"), ["split"])]
    for r in Q.estimate_splits(Q.merge_sketches(halves[0].unionByName(halves[1]), ["split"]), ["split"]).collect():
        w = want[r.split]
        assert r.windows == w[0] and abs(r.unknown_ratio - w[4] / w[0]) < 1e-12
        for got, true in ((r.tuple5s, len(w[1])), (r.label_captures, len(w[2])), (r.captures, len(w[3]))):
            assert abs(got - true) <= 0.02 * true
    assert Q.describe_splits(df.limit(0)).count() == 0
