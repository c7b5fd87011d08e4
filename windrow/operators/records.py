"""JSON records of windows: building, checking feature columns, validation against the record schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.schemas import EVENT

#: Columns that are no features, and features that records must have.
META = (
    "tuple5", "capture_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "proto_name", "win", "win_start_us", "win_end_us", "win_start_ts", "win_end_ts", "dataset", "split", "flow_id",
    "label", "label_iou", "label_capture_id", "label_flow_id", "label_priority", "label_is_unknown", "n_candidates",
)
ESSENTIAL = ("pkt_cnt_fwd", "pkt_cnt_bwd", "byte_cnt_fwd", "byte_cnt_bwd", "fwd_bwd_ratio_pkt", "fwd_bwd_ratio_byte", "tcp_syn_ratio", "tcp_fin_ratio", "tcp_rst_ratio")
NUMERIC = re.compile(r"(tinyint|smallint|int|bigint|float|double|decimal.*)$")
HIST = re.compile(r"(pkt_size_hist|iat_hist)_(\d+)$")


def feature_columns(df: DataFrame) -> tuple[list[str], list[str], list[str], list[str]]:
    """(scalar features, packet size bins, inter-arrival bins, missing essential names), bins by number."""
    numeric = [c for c, t in df.dtypes if NUMERIC.match(t) and c not in META]
    bins = {"pkt_size_hist": [], "iat_hist": []}
    for c in numeric:
        if m := HIST.match(c):
            bins[m[1]].append((int(m[2]), c))
    scalars = [c for c in numeric if not HIST.match(c) and not c.startswith("rich_")]
    sizes, gaps = ([c for _, c in sorted(bins[k])] for k in ("pkt_size_hist", "iat_hist"))
    return scalars, sizes, gaps, [c for c in ESSENTIAL if c not in df.columns]


def features(df: DataFrame) -> Column:
    """Scalars that are not null or NaN, and the histograms as arrays."""
    scalars, sizes, gaps, _ = feature_columns(df)
    floating = {c for c, t in df.dtypes if t in ("float", "double")}
    fields = [(F.nanvl(F.col(c), F.lit(None).cast("double")) if c in floating else F.col(c)).alias(c) for c in scalars]
    fields += [F.array(*[F.col(c) for c in cs]).alias(n) for n, cs in (("pkt_size_hist", sizes), ("iat_hist", gaps)) if cs]
    return F.struct(*fields)


def _tuple5() -> Column:
    """[src_ip, dst_ip, src_port, dst_port, proto]: texts and numbers in one array, so each is a variant."""
    empty = {"src_ip": F.lit(""), "dst_ip": F.lit("")}
    return F.array(*[F.coalesce(c, empty.get(c, F.lit(0))).cast("variant") for c in ("src_ip", "dst_ip", "src_port", "dst_port", "proto")]).alias("tuple5")


def _record(*more: Column) -> Column:
    """A record as JSON text: flow_id, tuple5, then what is given. Any text makes valid JSON, as none is put together by hand."""
    return F.to_json(F.struct(F.col("flow_id"), _tuple5(), *more))


def _struct_part(df: DataFrame) -> tuple[Column, ...]:
    return F.array("win_start_ts", "win_end_ts").alias("window"), features(df).alias("features"), F.col("label")


def struct_json(df: DataFrame) -> Column:
    """The record of a window as JSON text; flow_id and label must be there."""
    return _record(*_struct_part(df))


def enriched_part(summary: Column | None = None) -> Column:
    """The enriched part of a record: events that can't be read become an empty list, numbers that aren't finite 0."""
    summary = F.col("rich_context_summary") if summary is None else summary
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.removeprefix("rich_payload_"))
    number = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    payload = F.struct(
        F.coalesce("payload_total_len", F.lit(0)).alias("total_len"), number("payload_entropy").alias("entropy"), number("payload_ascii_ratio").alias("ascii_ratio"),
        *[text(f"rich_payload_{e}_{k}") for e in ("head", "tail") for k in ("ascii", "hex")], F.coalesce("rich_payload_truncated", F.lit(False)).alias("truncated"),
    )
    events = F.coalesce(F.from_json("rich_events", f"array<struct<{EVENT}>>"), F.array().cast(f"array<struct<{EVENT}>>"))
    protocols = F.filter(F.split(F.coalesce("rich_protocols", F.lit("")), ","), lambda x: x != "")
    return F.struct(
        F.coalesce(summary, F.lit("")).alias("context_summary"), events.alias("events"), F.coalesce("rich_event_count", F.size(events)).alias("event_count"),
        payload.alias("payload"), protocols.alias("protocols"), "proto_name",
    )


def enriched_json(df: DataFrame) -> Column:
    """The record with its enriched part."""
    return _record(*_struct_part(df), enriched_part().alias("enriched"))


def prompt_json(df: DataFrame, summary: Column | None = None) -> Column:
    """The record for a prompt: no label, and the window's length at the end in place of its times; enriched if a summary is given."""
    length = (F.col("win_end_ts") - F.col("win_start_ts")).alias("windows_length")
    return _record(features(df).alias("features"), *([] if summary is None else [enriched_part(summary).alias("enriched")]), length)


#: The keys of records and their kinds.
RECORD_KEYS = ("flow_id", "tuple5", "window", "features", "label")
ENRICHED_KINDS = {"context_summary": "text", "events": "list", "event_count": "count", "payload": "object", "protocols": "texts", "proto_name": "text"}
PAYLOAD_KINDS = {
    "total_len": "count", "entropy": "amount", "ascii_ratio": "share", "head_ascii": "text", "head_hex": "text", "tail_ascii": "text", "tail_hex": "text", "truncated": "flag",
}
EVENT_KINDS = {"offset_ms": "number", "direction": "side", "proto": "text", "len": "count", "payload_len": "count", "flags": "texts"}
EVENT_EXTRAS = {"tcp_window": "count", "preview": "text", "application": "text", "text": "text"}
MESSAGES = {
    "text": "a text", "list": "a list", "object": "an object", "count": "an integer of at least 0", "amount": "a number of at least 0", "share": "within 0 and 1", "flag": "true or false",
    "number": "a number", "texts": "a list of texts", "side": "FWD or BWD", "numbers": "a list of numbers", "id": "an integer of at least 1", "pair": "two numbers",
    "ends": "two texts and three integers", "feature": "a required number",
}
#: The kind that a value must have, by its path; paths without one may hold anything.
RECORD_RULES = {
    "flow_id": "id", "tuple5": "ends", "window": "pair", "label": "text", "features": "object", **{f"features.{c}": "feature" for c in ESSENTIAL},
    "features.pkt_size_hist": "numbers", "features.iat_hist": "numbers",
}
ENRICHED_RULES = {"enriched": "object", **{f"enriched.{c}": k for c, k in ENRICHED_KINDS.items()}, **{f"enriched.payload.{c}": k for c, k in PAYLOAD_KINDS.items()}}
EVENT_RULES = {f"enriched.events.{c}": k for c, k in (EVENT_KINDS | EVENT_EXTRAS).items()}
INTEGERS, NUMBERS = r"^(BIGINT|DECIMAL\(\d+,0\))$", r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _is(kind: Column, x: Column) -> Column:
    """Whether a variant is of the kind that the column names; false for null."""
    name, value, items = F.schema_of_variant(x), F.try_variant_get(x, "$", "double"), F.try_variant_get(x, "$", "array<variant>")
    every = lambda test: name.startswith("ARRAY") & F.forall(items, lambda y: F.coalesce(test(F.schema_of_variant(y)), F.lit(False)))
    number, integer = lambda n: n.rlike(NUMBERS), lambda n: n.rlike(INTEGERS)
    ends = F.transform(items, lambda y, i: F.when(i < 2, F.schema_of_variant(y) == "STRING").otherwise(integer(F.schema_of_variant(y))))
    tests = {
        "text": name == "STRING", "flag": name == "BOOLEAN", "object": name.startswith("OBJECT"), "list": name.startswith("ARRAY"), "number": number(name), "feature": number(name),
        "count": integer(name) & (value >= 0), "id": integer(name) & (value >= 1), "amount": number(name) & (value >= 0), "share": number(name) & value.between(0, 1),
        "side": F.try_variant_get(x, "$", "string").isin("FWD", "BWD"), "texts": every(lambda n: n == "STRING"), "numbers": every(number), "pair": (F.size(items) == 2) & every(number),
        "ends": (F.size(items) == 5) & F.forall(ends, lambda ok: F.coalesce(ok, F.lit(False))),
    }
    found = F.lit(False)
    for one, test in tests.items():
        found = F.when(kind == one, test).otherwise(found)
    return F.coalesce(found, F.lit(False))


FAULT = "array<struct<path: string, message: string>>"


def _fault(path: Column, message: Column) -> Column:
    return F.struct(path.alias("path"), message.alias("message"))


def _faults_if(cond: Column, path: str, message: Column | str) -> Column:
    """A list of one fault where the condition holds, else an empty one."""
    message = message if isinstance(message, Column) else F.lit(message)
    return F.when(cond, F.array(_fault(F.lit(path), message))).otherwise(F.lit(None).cast(FAULT))


def _literals(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


def _absent(names: Column, required: list[str], path: str, message: str) -> Column:
    """A fault for each required name that is not among the names."""
    return F.transform(F.array_except(_literals(required), names), lambda k: _fault(F.concat(F.lit(path), k), F.lit(message)))


def _extra(names: Column, allowed: list[str]) -> Column:
    return F.array_except(names, _literals(allowed))


def _wrong(fields: Column, path: str, rules: dict[str, str]) -> Column:
    """A fault for each field of the object, a map of variants, that is not of the kind that the rules give its path."""
    own = {k.removeprefix(path): v for k, v in rules.items() if k.startswith(path) and "." not in k.removeprefix(path)}
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    kinds, messages = table(own), table({k: MESSAGES[k] for k in {*own.values()}})
    bad = F.map_filter(fields, lambda k, x: kinds[k].isNotNull() & ~_is(kinds[k], x))
    return F.transform(F.map_keys(bad), lambda k: _fault(F.concat(F.lit(path), k), messages[kinds[k]]))


def _event_faults(events: Column) -> Column:
    """The faults of all events, each path and message once."""

    def of(event: Column) -> Column:
        fields = F.try_variant_get(event, "$", "map<string,variant>")
        names = F.map_keys(fields)
        return F.when(fields.isNull(), F.array(_fault(F.lit("enriched.events"), F.lit("objects")))).otherwise(
            F.concat(
                F.coalesce(_faults_if(F.size(_extra(names, [*EVENT_KINDS, *EVENT_EXTRAS])) > 0, "enriched.events", "keys that are not allowed"), F.array().cast(FAULT)),
                _absent(names, [*EVENT_KINDS], "enriched.events.", "required"), _wrong(fields, "enriched.events.", EVENT_RULES),
            )
        )

    return F.array_distinct(F.flatten(F.transform(events, of)))


def validate(lines: DataFrame, enriched: bool = False, limit: int | None = None) -> DataFrame:
    """(file, line, path, message) for each rule that a line of (file, line, value) breaks.

    Blank lines are skipped, though they count in `line`. With a limit, only each file's first lines are read. Rules:
    readable JSON object; required and no other keys; kinds of all values; flow_id >= 1; lengths of tuple5 and window;
    required numeric features and no nested ones, histograms of numbers; for enriched records also the keys and kinds of
    events and payload, at most ten events, and no negative numbers. A rule on events names their common path once.

    A line is parsed once, to a variant; its objects become maps whose fields are held against the tables of rules. Only
    the keys of a line that is no strict JSON (such as one with NaN) are read by the laxer parser.
    """
    rows = lines.where(F.trim("value") != "")
    if limit is not None:
        rows = rows.where(F.col("line") <= limit)
    object_at = lambda path: F.try_variant_get("v", path, "map<string,variant>")
    there = lambda path: F.try_variant_get("v", path, "variant").isNotNull()
    keys = [*RECORD_KEYS, *(["enriched"] if enriched else [])]
    listed = lambda names: F.concat(F.lit("not allowed: "), F.array_join(F.array_sort(names), ","))
    rules = RECORD_RULES | (ENRICHED_RULES if enriched else {})
    rows = rows.select("file", "line", "value", F.try_parse_json("value").alias("v"))
    rows = rows.select("file", "line", "v", F.when(F.col("v").isNull(), F.map_keys(F.from_json("value", "map<string,string>"))).otherwise(F.map_keys(object_at("$"))).alias("names"), object_at("$").alias("top"), object_at("$.features").alias("features"))
    nested = F.exists(F.map_values("features"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    faults = [
        _faults_if(F.col("names").isNull(), "", "not a JSON object"), _absent(F.col("names"), keys, "", "required"), _faults_if(F.size(_extra(F.col("names"), keys)) > 0, "", listed(_extra(F.col("names"), keys))),
        _wrong(F.col("top"), "", rules), F.when(there("$.features"), _absent(F.coalesce(F.map_keys("features"), _literals([])), [*ESSENTIAL], "features.", MESSAGES["feature"])),
        _wrong(F.col("features"), "features.", rules), _faults_if(nested, "features", "no nested objects"),
    ]
    if enriched:
        for path, kinds in (("enriched", ENRICHED_KINDS), ("enriched.payload", PAYLOAD_KINDS)):
            fields = object_at(f"$.{path}")
            names = F.map_keys(fields)
            faults += [_absent(names, [*kinds], f"{path}.", "required"), _faults_if(F.size(_extra(names, [*kinds])) > 0, path, listed(_extra(names, [*kinds]))), _wrong(fields, f"{path}.", rules)]
        events = F.try_variant_get("v", "$.enriched.events", "array<variant>")
        faults += [_faults_if(F.size(events) > 10, "enriched.events", "at most 10"), _event_faults(events)]
    found = F.concat(*[F.coalesce(f, F.array().cast(FAULT)) for f in faults])
    return rows.select("file", "line", F.explode(found).alias("e")).select("file", "line", "e.path", "e.message")
