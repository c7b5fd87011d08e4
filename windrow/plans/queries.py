"""One query for each operator of the library, over views of the given tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

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
from windrow.operators.packets import FRAME, canonicalize, clean_payload, merge_payload
from windrow.operators.responses import parse_responses
from windrow.plans import fixtures as V
from windrow.schemas import ENRICHED, EVENT, KW, PACKET, RECORD
from windrow.sources import tables as T
from windrow.storage import shared_folder, stored

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


ID = ["capture_id", "tuple5", "win_start_us"]


@query
def flow_windows(spark: SparkSession, d: str) -> DataFrame:
    return V.windows(spark, d).select(*ID, "packet_count", "byte_count", "pkt_cnt_fwd", "pkt_cnt_bwd", "byte_cnt_fwd", "byte_cnt_bwd", "proto_name", *r6("flow_dur_ms", "fwd_bwd_ratio_pkt", "fwd_bwd_ratio_byte"))


@query
def flow_window_tcp(spark: SparkSession, d: str) -> DataFrame:
    return V.windows(spark, d).select(*ID, *r6(*[f"tcp_{f}_ratio" for f in ("syn", "fin", "rst", "ack", "psh")], "tcp_window_mean"), "tcp_handshake_score", "tcp_rst_count", "tcp_psh_count", "tcp_window_max")


@query
def flow_window_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.windows(spark, d).select(*ID, *r6("pkt_len_mean", "pkt_len_std"), "pkt_len_min", "pkt_len_max", "payload_total_len")


@query
def flow_window_iat(spark: SparkSession, d: str) -> DataFrame:
    # means of whole microseconds often lie half way between two results; the shift makes both engines round them up
    return V.windows(spark, d).select(*ID, *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("iat_mean_ms", "iat_std_ms", "iat_min_ms", "iat_max_ms")])


@query
def flow_window_hist(spark: SparkSession, d: str) -> DataFrame:
    return V.windows(spark, d).select(*ID, *r6(*[f"pkt_size_hist_{i}" for i in range(7)], *[f"iat_hist_{i}" for i in range(7)]), "pkt_size_hist_sum", "iat_hist_sum")


@query
def flow_context(spark: SparkSession, d: str) -> DataFrame:
    return W.with_context(V.windows(spark, d), V.WINDOWS).select(*ID, *[f"{c}_{n}" for n in ("10s", "60s") for c in ("packet_count", "byte_count", "payload_total_len")])


@query
def structured_columns(spark: SparkSession, d: str) -> DataFrame:
    rich = V.windows(spark, d).withColumn("rich_note", F.lit("x"))
    kept = W.in_order(W.structured(rich))
    return kept.select("capture_id", "tuple5", "win_start_us", "packet_count", F.lit(len([c for c in kept.columns if c.startswith("rich_")])).alias("rich_columns"))


@query
def key_events(spark: SparkSession, d: str) -> DataFrame:
    return E.key_events(V.members(spark, d).select(*KW, "ts_us", "frame_number", "payload_len"), V.WINDOWS).select("capture_id", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "win", "frame_number", "payload_len", "place")


@query
def window_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as they are read back from their JSON text."""
    got = E.window_events(V.members(spark, d, rich=True), V.WINDOWS)
    rows = got.select(*KW, "rich_event_count", F.posexplode(F.from_json("rich_events", f"array<struct<{EVENT}>>")).alias("i", "e"))
    return rows.select(
        *KW, "rich_event_count", (F.col("i") + 1).alias("place"), "e.offset_ms", "e.direction", F.col("e.proto").alias("event_proto"), "e.len", "e.payload_len",
        F.array_join("e.flags", "|").alias("flags"), "e.tcp_window", "e.preview", "e.application", "e.text",
    )


@query
def payload_merge(spark: SparkSession, d: str) -> DataFrame:
    return V.canonical(spark, d, rich=True).select("capture_id", "frame_number", "payload_hex", "payload_len")


@query
def payload_merge_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Packets and payload rows as bucketed tables, joined without a shuffle."""
    folder = _folder(spark)
    name = f"windrow_{uuid.uuid4().hex}"
    packets = T.write_bucketed(V.packets(spark, d), f"{name}_packets", FRAME, 8, f"{folder}/packets")
    payload = T.write_bucketed(clean_payload(V.payload(spark, d)), f"{name}_payload", FRAME, 8, f"{folder}/payload")
    return canonicalize(merge_payload(packets, payload, cleaned=True)).select(*FRAME, "payload_hex", "payload_len")


@query
def payload_stats(spark: SparkSession, d: str) -> DataFrame:
    got = E.payload_stats(V.placed_packets(spark, d), V.WINDOWS)
    return got.select("capture_id", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "win", *[F.round(c, 5).alias(c) for c in ("payload_entropy", "payload_ascii_ratio")])


@query
def payload_ends(spark: SparkSession, d: str) -> DataFrame:
    return E.payload_ends(V.placed_packets(spark, d), V.WINDOWS)


@query
def protocol_tokens(spark: SparkSession, d: str) -> DataFrame:
    return E.protocol_tokens(V.members(spark, d, rich=True))


@query
def application_text(spark: SparkSession, d: str) -> DataFrame:
    return V.payload(spark, d).select("frame_number", E.application_text().alias("application"), C.human_bytes(F.col("frame_number") * 4099).alias("size"))


def _rich(spark: SparkSession, d: str) -> DataFrame:
    packets = V.canonical(spark, d, rich=True)
    return E.with_rich(W.with_context(W.flow_windows(packets, V.WINDOWS), V.WINDOWS), W.placed(packets, V.WINDOWS), V.WINDOWS)


@query
def context_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rich(spark, d).select(*ID, "rich_context_summary", "rich_event_count", "rich_payload_truncated")


@query
def window_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and rich columns of the tables that each setting of the switches gives."""
    packets = V.canonical(spark, d, rich=True)
    out = None
    for standard, rich in ((True, True), (True, False), (False, True)):
        for name, df in E.window_tables(packets, replace(V.WINDOWS, compute_standard=standard, compute_rich=rich)).items():
            n_rich = len([c for c in df.columns if c.startswith("rich_")])
            one = df.agg(F.count("*").alias("n")).select(F.lit(standard).alias("standard"), F.lit(rich).alias("rich"), F.lit(name).alias("name"), F.lit(n_rich).alias("rich_columns"), "n")
            out = one if out is None else out.unionByName(one)
    return out


@query
def normalise_packets(spark: SparkSession, d: str) -> DataFrame:
    return T.normalise_packets(V.field_table(spark, d)).drop("ts")


@query
def normalise_payload(spark: SparkSession, d: str) -> DataFrame:
    return T.normalise_payload(V.field_table(spark, d)).select("frame_number", "rich_payload_hex", "rich_payload_len", "rich_frame_protocols", "rich_dns_answers", "rich_http_host")


@query
def label_clean(spark: SparkSession, d: str) -> DataFrame:
    return L.prepare(V.truth(spark, d)).select("label_row", "label", "priority", "dur_us")


@query
def label_offsets(spark: SparkSession, d: str) -> DataFrame:
    return L.offsets(L.prepare(V.truth(spark, d)), V.windows(spark, d))


@query
def label_align(spark: SparkSession, d: str) -> DataFrame:
    return V.labelled(spark, d).select(*ID, "label", F.round("label_iou", 9).alias("label_iou"), F.col("label_priority").cast("int").alias("label_priority"), "label_is_unknown", "n_candidates")


@query
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.alignment_stats(V.labelled(spark, d)).withColumn("unknown_ratio", F.round("unknown_ratio", 9))


@query
def label_propagate(spark: SparkSession, d: str) -> DataFrame:
    rich = V.windows(spark, d).select(*V.KEY, "win_start_us", F.lit("old").alias("label"))
    return L.propagate(rich, V.labelled(spark, d), V.KEY).select(*ID, "label", "label_is_unknown")


@query
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return L.duplicate_keys(V.packets(spark, d), ["capture_id", "src_ip", "dst_port", "pkt_len"])


def _split(spark: SparkSession, d: str) -> DataFrame:
    return X.stratified_split(V.labelled(spark, d), V.KEY, X.group_column(V.windows(spark, d), "capture_id"), params=V.SPLITS)


@query
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select(*ID, "label", "split")


@query
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.split_stats(_split(spark, d), "capture_id")


@query
def split_attach(spark: SparkSession, d: str) -> DataFrame:
    rich = V.windows(spark, d).select(*V.KEY, F.concat(F.lit("n="), F.col("packet_count").cast("string")).alias("rich_note"))
    split = _split(spark, d)
    return X.combine_rich(X.attach(rich.select(*V.KEY), split, V.KEY), rich, V.KEY).groupBy("split").agg(F.count("*").alias("n"), F.min("rich_note").alias("first_note"))


@query
def sequential_ids(spark: SparkSession, d: str) -> DataFrame:
    return X.sequential_ids(V.windows(spark, d).select(*ID), ["win_start_us", "tuple5", "capture_id"])


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return X.sequential_ids(V.labelled(spark, d), ["win_start_us", "tuple5", "capture_id"])


@query
def struct_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON text and read again by the record schema."""
    rows = _numbered(spark, d)
    back = rows.select(R.struct_json(rows).alias("value")).select(F.from_json("value", "flow_id bigint, tuple5 array<string>, window array<double>, features map<string,string>, label string").alias("r"))
    return back.select(
        "r.flow_id", F.array_join("r.tuple5", ",").alias("tuple5"), F.element_at("r.window", 1).cast("bigint").alias("start"), F.col("r.features")["packet_count"].cast("bigint").alias("packet_count"),
        F.size(F.from_json(F.col("r.features")["pkt_size_hist"], "array<double>")).alias("size_bins"), "r.label",
    )


@query
def awkward_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose addresses hold brackets, quotes, backslashes and up to 20,000 characters, read again."""
    odd = lambda c: F.concat(F.lit("[fe80::"), F.col(c), F.lit(']"\\,é\n'), F.repeat(F.lit("x"), F.when(F.col("packet_count") % 7 == 0, 20_000).otherwise(F.col("packet_count")).cast("int")))
    rows = V.windows(spark, d).withColumns({"flow_id": F.col("win"), "label": F.concat(F.lit('"'), F.col("capture_id")), "src_ip": odd("src_ip"), "dst_ip": odd("dst_ip")})
    back = rows.select(R.struct_json(rows).alias("value")).select(F.from_json("value", RECORD).alias("r"))
    part = lambda i: F.element_at("r.tuple5", i)
    return back.select(
        F.col("r.flow_id").alias("win"), F.col("r.label").alias("label"), F.md5(part(1)).alias("src_md5"), F.md5(part(2)).alias("dst_md5"), F.length(part(1)).alias("length"),
        *[part(i).cast("int").alias(n) for i, n in ((3, "src_port"), (4, "dst_port"), (5, "proto"))], F.size("r.tuple5").alias("parts"),
        *[F.element_at("r.window", i).cast("bigint").alias(n) for i, n in ((1, "start"), (2, "end"))], F.col("r.features")["byte_count"].cast("bigint").alias("byte_count"),
    )


@query
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    """Faults planted by flow_id, and the rules that they break."""
    rows = _numbered(spark, d)
    value, i = R.struct_json(rows), F.col("flow_id")
    faulty = (
        F.when(i % 10 == 0, F.regexp_replace(value, r'"flow_id":\d+', '"flow_id":0')).when(i % 10 == 1, F.regexp_replace(value, r',"label":"[^"]*"', "")).when(i % 10 == 2, F.substring(value, 1, 40))
        .when(i % 10 == 3, F.regexp_replace(value, r"^\{", '{"more":1,')).when(i % 10 == 4, F.regexp_replace(value, r',\d+\],"window"', '],"window"')).when(i % 10 == 5, F.regexp_replace(value, '"pkt_cnt_fwd":', '"pkt_cnt":')).when(i % 10 == 6, F.lit("  "))
        .otherwise(value)
    )
    lines = rows.select(F.lit("f").alias("file"), i.alias("line"), faulty.alias("value"))
    return R.validate(lines).groupBy("path", "message").agg(F.count("*").alias("n"))


@query
def qc_splits(spark: SparkSession, d: str) -> DataFrame:
    return Q.describe_splits(_split(spark, d)).withColumn("unknown_ratio", F.round("unknown_ratio", 9))


@query
def qc_split_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches by split and capture, merged by split without the rows; estimates within 2 % of the exact counts, as numbers of hits."""
    rows = stored(_split(spark, d))
    merged = Q.estimate_splits(Q.merge_sketches(Q.split_sketches(rows, ["split", "capture_id"]), ["split"]), ["split"])
    exact = Q.describe_splits(rows).select("split", *[F.col(c).alias(f"exact_{c}") for c in ("windows", "tuple5s", "label_captures", "captures")])
    close = lambda c: F.abs(F.col(c) - F.col(f"exact_{c}")) <= 0.02 * F.col(f"exact_{c}")
    return merged.join(exact, "split").select("split", "windows", *[close(c).alias(f"{c}_close") for c in ("tuple5s", "label_captures", "captures")], F.round("unknown_ratio", 9).alias("unknown_ratio"))


@query
def qc_labels(spark: SparkSession, d: str) -> DataFrame:
    return Q.label_distribution(_split(spark, d)).select("split", "label", "count", *r6("share", "log_count"))


@query
def qc_protocols(spark: SparkSession, d: str) -> DataFrame:
    return Q.protocol_breakdown(_split(spark, d)).select("proto", "proto_display", "windows", "tuple5s", "attack_windows", "attack_tuple5s", *r6("window_share", "attack_share"))


@query
def qc_protocol_splits(spark: SparkSession, d: str) -> DataFrame:
    return Q.protocol_distribution(_split(spark, d)).select("scope", "split", "proto", "count", *r6("share"))


@query
def qc_totals(spark: SparkSession, d: str) -> DataFrame:
    return Q.totals(V.labelled(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return Q.pair_labels(V.labelled(spark, d), proto=6, exclude=("unknown",))


@query
def pair_labels(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("ip_low", "ip_high", "label", "cnt", "total", *r6("fraction"))


@query
def pair_purity(spark: SparkSession, d: str) -> DataFrame:
    return Q.pair_purity(_pairs(spark, d)).select("ip_low", "ip_high", "total", "dominant", "top", *r6("purity"))


@query
def purity_summary(spark: SparkSession, d: str) -> DataFrame:
    return Q.purity_summary(Q.pair_purity(_pairs(spark, d))).withColumn("weighted_purity", F.round("weighted_purity", 9))


@query
def pair_top(spark: SparkSession, d: str) -> DataFrame:
    return Q.top_pairs(Q.pair_purity(_pairs(spark, d)), 5).select("pair", "total", "dominant")


@query
def pair_mix(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    mixed = Q.pair_mix(pairs, Q.pair_purity(pairs), 5)
    return mixed.unpivot("pair", None, "label", "cnt")


@query
def pair_coverage(spark: SparkSession, d: str) -> DataFrame:
    return Q.coverage(Q.pair_purity(_pairs(spark, d))).select("ip_low", "ip_high", "rank", "total", *r6("covered"))


@query
def purity_hist(spark: SparkSession, d: str) -> DataFrame:
    return Q.histogram(Q.pair_purity(_pairs(spark, d)), "purity", 10, 0.0, 1.0).select("bin", "n", *r6("low", "high"))


@query
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.label_counts(V.labelled(spark, d)).select("label", "count", *r6("share"))


@query
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.balanced_sample(V.labelled(spark, d).select(*ID, "win", "label"), V.KEY, V.SAMPLES)


@query
def val_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.validation_sample(V.labelled(spark, d).select(*ID, "win", "label"), V.KEY, 4_000, 0.05, V.SAMPLES, least=100)


@query
def natural_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.natural_sample(V.labelled(spark, d).select(*ID, "win", "label"), V.KEY, V.SAMPLES)


@query
def head_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.head_sample(V.packets(spark, d).select("capture_id", "frame_number", "ts_us"), ["frame_number", "capture_id"], 100)


@query
def prompt_masked(spark: SparkSession, d: str) -> DataFrame:
    rows = V.windows(spark, d).withColumn("flow_id", F.concat_ws("/", *V.KEY))
    return P.mask_ips(rows, 0.2).select("capture_id", "tuple5", "win", "src_ip", "dst_ip")


@query
def relative_time(spark: SparkSession, d: str) -> DataFrame:
    rows = V.windows(spark, d).withColumn("note", F.concat(F.lit("TCP Window "), (F.col("win_start_us") / 1000000).cast("bigint").cast("string"), F.lit(".0-"), (F.col("win_end_us") / 1000000).cast("bigint").cast("string"), F.lit(".500s end")))
    return P.relative_time(rows, ("note",)).select("capture_id", "tuple5", "win", "windows_length", "note")


@query
def prompt_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _rich(spark, d)
    return rows.select("capture_id", "tuple5", "win", P.summary_prompt(rows, S.label_options(V.labelled(spark, d))).alias("prompt"))


@query
def system_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The instruction text with the data's labels and with the listed ones, and the labels."""
    labels = S.label_options(V.labelled(spark, d))
    rows = [("data", P.system_prompt(labels), ",".join(labels)), ("listed", P.system_prompt(), ",".join(sorted(P.FALLBACK_LABELS)))]
    return spark.createDataFrame(rows, "kind string, prompt string, labels string")


@query
def prompt_raw(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of whole records, taken apart: the instruction, and the record read back from the rest."""
    rich = _rich(spark, d).select(*V.KEY, *[c for c in E.RICH_OUTPUT])
    rows = P.mask_ips(X.combine_rich(_numbered(spark, d), rich, V.KEY).join(rich.select(*V.KEY, "payload_entropy", "payload_ascii_ratio"), V.KEY), 0.2)
    labels = S.label_options(rows)
    system = len(P.system_prompt(labels))
    prompts = rows.select(P.raw_prompt(rows, labels, with_enriched=True).alias("prompt"))
    schema = f"flow_id bigint, tuple5 array<string>, window string, label string, windows_length double, features map<string,string>, enriched struct<{ENRICHED}>"
    back = prompts.select(F.md5(F.substring("prompt", 1, system).cast("binary")).alias("system_md5"), F.from_json(F.substring("prompt", system + 2, 2**31 - 1), schema).alias("r"))
    return back.select(
        "system_md5", "r.flow_id", F.array_join("r.tuple5", ",").alias("tuple5"), "r.window", "r.label", "r.windows_length", F.col("r.features")["packet_count"].cast("bigint").alias("packet_count"),
        F.col("r.enriched.context_summary").alias("context_summary"), F.col("r.enriched.event_count").alias("event_count"), F.array_join("r.enriched.protocols", ",").alias("protocols"),
    )


@query
def completions(spark: SparkSession, d: str) -> DataFrame:
    return V.labelled(spark, d).select("capture_id", "tuple5", "win", P.train_completion(F.col("label")).alias("completion"), P.closed_completion(F.col("label")).alias("closed"))


@query
def explanations(spark: SparkSession, d: str) -> DataFrame:
    rows = V.labelled(spark, d)
    return rows.select("capture_id", "tuple5", "win", P.fallback_explanation(rows).alias("explanation"))


@query
def parsed_responses(spark: SparkSession, d: str) -> DataFrame:
    return parse_responses(V.responses(spark, d)).select("doc_id", "label", "explanation")


@query
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.class_metrics(V.preds(spark, d)).select("label", "tp", "fp", "fn", "support", *r6("precision", "recall", "f1"))


@query
def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = M.overall_metrics(M.class_metrics(V.preds(spark, d)))
    return got.select("samples", *r6(*[c for c in got.columns if c != "samples"]))


@query
def agreement(spark: SparkSession, d: str) -> DataFrame:
    return M.agreement(V.preds(spark, d))


@query
def label_sides(spark: SparkSession, d: str) -> DataFrame:
    return M.label_sides(V.preds(spark, d))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run's accuracy, by way of a log text."""
    per = V.preds(spark, d).groupBy("run").agg(F.avg((F.col("reference_label") == F.col("predicted_label")).cast("int")).alias("a"))
    text = F.when(F.col("run") == "base", F.format_string('step 3\n{"macro_f1": 0.5, "Eval_Accuracy": %.4f}', "a")).otherwise(F.format_string("done\nEval Accuracy : %.4f\n", "a"))
    return M.metrics_from_logs(per.select("run", text.alias("text")), ["eval_accuracy"])


@query
def run_ranking(spark: SparkSession, d: str) -> DataFrame:
    return M.rank_runs(_runs(spark, d), "eval_accuracy").select("run", "place", F.round("eval_accuracy", 3).alias("eval_accuracy"))


@query
def run_delta(spark: SparkSession, d: str) -> DataFrame:
    return M.run_delta(_runs(spark, d), "eval_accuracy", "base", "tuned").select(*[F.round(c, 3).alias(c) for c in ("baseline", "checkpoint", "delta")])


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


@query
def packet_files(spark: SparkSession, d: str) -> DataFrame:
    """Packets written as a file of the packet format, and read again."""
    path = _folder(spark)
    columns = [x.split(" ")[0] for x in PACKET.split(", ")]
    T.write_tables({"packets": V.packets(spark, d).withColumn("ts", F.col("ts_us") / 1e6).select(*columns)}, path)
    return T.read_packets(spark, f"{path}/packets.parquet").drop("ts")


@query
def payload_files(spark: SparkSession, d: str) -> DataFrame:
    """Payload rows written as CSV, and read again."""
    path = f"{_folder(spark)}/payload.csv"
    V.payload(spark, d).write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    return T.read_payload(spark, path)


@query
def label_files(spark: SparkSession, d: str) -> DataFrame:
    """Label intervals written as CSV with times in several forms, and read again; some times can't be read."""
    path = f"{_folder(spark)}/labels.csv"
    at = lambda c: F.timestamp_micros(c)
    forms = ("dd/MM/yyyy HH:mm:ss", "d/M/yyyy H:mm", "dd/MM/yyyy hh:mm:ss a", "yyyy-MM-dd HH:mm:ss")
    text = lambda c: F.when(F.col("label_row") % 13 == 0, "soon").otherwise(
        F.element_at(F.array(*[F.date_format(at(F.col(c)), f) for f in forms]), (F.col("label_row") % 4 + 1).cast("int"))
    )
    rows = V.truth(spark, d).select("label", text("start_us").alias("ts_start"), text("end_us").alias("ts_end"), "src_ip", "dst_ip", "src_port", "dst_port", F.col("proto").cast("double").alias("protocol"), F.col("label_row").alias("flow_id"))
    rows.write.option("header", True).csv(path)
    got = L.label_times(T.read_labels(spark, path, V.LABELS), V.LABELS)
    return got.select("label_flow_id", "label_capture_id", "src_ip", "src_port", "proto", "start_us", "end_us")


@query
def record_files(spark: SparkSession, d: str) -> DataFrame:
    """Records written as lines, some cut off and some without a label, and read by the tolerant reader."""
    path = _folder(spark)
    rows = _numbered(spark, d)
    value = R.struct_json(rows)
    cut = F.when(F.col("flow_id") % 7 == 0, F.substring(value, 1, 50)).when(F.col("flow_id") % 7 == 1, F.regexp_replace(value, r',"label":"[^"]*"', "")).otherwise(value)
    T.write_lines(rows, cut, path)
    return T.read_records(spark, path).select("flow_id", F.array_join("tuple5", ",").alias("tuple5"), F.element_at("window", 2).cast("bigint").alias("end"), "label")


@query
def enriched_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Enriched records written as lines, and read again."""
    path = _folder(spark)
    rich = _rich(spark, d)
    rows = X.sequential_ids(rich.withColumn("label", F.lit("BENIGN")), ["win_start_us", "tuple5", "capture_id"])
    T.write_lines(rows, R.enriched_json(rows), path)
    back = T.read_records(spark, path, enriched=True)
    p = "enriched.payload"
    return back.select(
        "flow_id", F.col("enriched.context_summary").alias("context_summary"), F.col("enriched.event_count").alias("event_count"), F.size("enriched.events").alias("n_events"),
        F.element_at("enriched.events", 1)["text"].alias("first_event"), F.array_join("enriched.protocols", ",").alias("protocols"), F.col("enriched.proto_name").alias("proto_name"),
        F.col(f"{p}.total_len").alias("total_len"), F.round(f"{p}.entropy", 5).alias("entropy"), F.round(f"{p}.ascii_ratio", 5).alias("ascii_ratio"), F.col(f"{p}.head_hex").alias("head_hex"),
        F.col(f"{p}.tail_ascii").alias("tail_ascii"), F.col(f"{p}.truncated").alias("truncated"), F.col("features")["pkt_cnt_fwd"].cast("bigint").alias("pkt_cnt_fwd"),
    )


@query
def validate_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Faults planted by flow_id in enriched records, and the rules that they break."""
    rich = _rich(spark, d)
    rows = X.sequential_ids(rich.withColumn("label", F.lit("BENIGN")), ["win_start_us", "tuple5", "capture_id"])
    faults = (
        ('"event_count":\\d+', '"event_count":-1'), ('"entropy":[^,]+', '"entropy":"much"'), ('"direction":"(FWD|BWD)"', '"direction":"UP"'), ('"truncated":(true|false)', '"truncated":0'),
        ('"head_hex":"[^"]*",', ""), ('"payload_len":\\d+,', ""), ('"proto_name":"', '"more":1,"proto_name":"'), ('"label":"BENIGN"', '"label":5'), ('"pkt_size_hist":\\[', '"pkt_size_hist":["x",'), ('"offset_ms":', '"odd":1,"offset_ms":'),
    )
    value = R.enriched_json(rows)
    faulty = F.when(F.col("flow_id") % 12 > 9, value)
    for i, (old, new) in enumerate(faults):
        faulty = faulty.when(F.col("flow_id") % 12 == i, F.regexp_replace(value, old, new))
    return R.validate(rows.select(F.lit("f").alias("file"), F.col("flow_id").alias("line"), faulty.alias("value")), enriched=True).groupBy("path", "message").agg(F.count("*").alias("n"))


@query
def validate_first_lines(spark: SparkSession, d: str) -> DataFrame:
    """Files of a hundred cut-off records each, checked up to line 40."""
    path = _folder(spark)
    rows = _numbered(spark, d)
    text = rows.select(F.floor((F.col("flow_id") - 1) / 100).alias("part"), "flow_id", F.substring(R.struct_json(rows), 1, 30).alias("value"))
    one = text.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flow_id", "value"))), lambda x: x["value"]), "\n").alias("value"))
    one.write.partitionBy("part").text(path)
    got = R.validate(T.read_lines(spark, f"{path}/*/*.txt"), limit=40)
    return got.groupBy(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part")).agg(F.count("*").alias("n"), F.max("line").alias("last"))


@query
def split_files(spark: SparkSession, d: str) -> DataFrame:
    """Splits written as a table each, and read again as one."""
    path = _folder(spark)
    T.write_splits(_split(spark, d), path)
    return T.read_splits(spark, path).select(*ID, "label", "split")


@query
def sample_lines(spark: SparkSession, d: str) -> DataFrame:
    """A sample's records written as lines, and read again with the lines' numbers left out."""
    path = _folder(spark)
    rows = S.natural_sample(_numbered(spark, d), V.KEY, V.SAMPLES)
    T.write_lines(rows, R.struct_json(rows), path)
    return T.read_lines(spark, path).select(F.get_json_object("value", "$.flow_id").cast("bigint").alias("flow_id"), F.get_json_object("value", "$.label").alias("label"))


@query
def stats_files(spark: SparkSession, d: str) -> DataFrame:
    """Alignment figures written as one JSON object, and read again."""
    path = _folder(spark)
    T.write_stats(L.alignment_stats(V.labelled(spark, d)), path)
    schema = "total bigint, unknown_count bigint, unknown_ratio double, multi_candidate bigint, benign_label string, label_counts string"
    return spark.read.schema(schema).json(path).withColumn("unknown_ratio", F.round("unknown_ratio", 9))


@query
def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as lines in the order of their index, and read again."""
    path = _folder(spark)
    T.write_predictions(V.preds(spark, d).withColumnRenamed("doc_id", "index"), path)
    return spark.read.schema("reference_label string, predicted_label string, run string").json(path).groupBy("reference_label", "predicted_label", "run").agg(F.count("*").alias("n"))


@query
def log_files(spark: SparkSession, d: str) -> DataFrame:
    """A log file for each run, read again for the runs' metrics."""
    path = _folder(spark)
    per = V.preds(spark, d).groupBy("run").agg(F.avg((F.col("reference_label") == F.col("predicted_label")).cast("int")).alias("a"))
    per.select("run", F.format_string("step 1\neval_accuracy = %.4f", "a").alias("value")).write.partitionBy("run").text(path)
    runs = M.metrics_from_logs(T.read_logs(spark, f"{path}/*/*.txt"), ["eval_accuracy"])
    return M.rank_runs(runs.withColumn("run", F.regexp_replace("run", "^run=", "")), "eval_accuracy").select("run", "place", F.round("eval_accuracy", 3).alias("eval_accuracy"))


EXTRA_US = (3_600_000_000, -7_200_000_000)


@query
def label_extra_offsets(spark: SparkSession, d: str) -> DataFrame:
    prepared = L.prepare(V.truth(spark, d))
    return L.shifted(prepared, L.offsets(prepared, V.windows(spark, d)), EXTRA_US).select("label_row", "offset_no", "used_us", "start_us", "end_us")


@query
def split_by_default_group(spark: SparkSession, d: str) -> DataFrame:
    rows = V.labelled(spark, d)
    return X.stratified_split(rows, V.KEY, X.group_column(rows), params=V.SPLITS).select(*ID, "label", "split")


@query
def label_list(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(S.label_options(V.labelled(spark, d)), 1)], "place int, label string")


@query
def shuffled_order(spark: SparkSession, d: str) -> DataFrame:
    return S.shuffled_places(V.windows(spark, d).select(*ID, "win"), V.KEY, 42).select(*ID, "place")


@query
def pair_volume_hist(spark: SparkSession, d: str) -> DataFrame:
    return Q.histogram(Q.pair_purity(_pairs(spark, d)), "total", 8).select("bin", "n", *r6("low", "high"))


@query
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the report's tables of protocols by split, as fields."""
    text = Q.markdown(_split(spark, d))
    rows = [("attack" if "attacks" in part[:40] else "all", *[x.strip() for x in line.strip("|").split("|")]) for part in text.split("## ") if part.startswith("Protocols ") for line in part.split("\n")[4:] if line]
    return spark.createDataFrame(rows, "scope string, split string, proto string, count string, share string").select("scope", "split", F.col("proto").cast("int"), F.replace("count", F.lit(","), F.lit("")).cast("bigint").alias("count"), "share")
