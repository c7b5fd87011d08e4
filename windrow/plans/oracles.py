"""DuckDB SQL equal to the queries, over the same tables."""

from __future__ import annotations

from windrow.operators.prompts import FALLBACK_LABELS, SYSTEM_PROMPT
from windrow.plans.fixtures import DUCK_US, PACKETS, PAYLOAD, PREDS, SAMPLES, TRUTH, WINDOWS


def _fill(text: str) -> str:
    return text.replace("{TS_US}", DUCK_US).replace("{events}", "events").replace("{labels}", "labels")


KCOLS = "capture_id, src_ip, src_port, dst_ip, dst_port, proto"
K5 = "src_ip, src_port, dst_ip, dst_port, proto"
TUPLE5 = "concat_ws(',', src_ip, dst_ip, src_port, dst_port, proto)"
W, S = WINDOWS.window_us, WINDOWS.stride_us
ID = f"capture_id, {TUPLE5} AS tuple5, win * {S} AS win_start_us"


def _canonical(name: str) -> str:
    """Endpoint columns of a table in the text order of ip:port."""
    forward = f"concat({name}.src_ip, ':', {name}.src_port) <= concat({name}.dst_ip, ':', {name}.dst_port)"
    swap = lambda a, b: f"CASE WHEN {forward} THEN {name}.{a} ELSE {name}.{b} END AS {a}"
    return ", ".join([swap("src_ip", "dst_ip"), swap("src_port", "dst_port"), swap("dst_ip", "src_ip"), swap("dst_port", "src_port")]) + f", CASE WHEN {forward} THEN 1 ELSE -1 END AS direction"


CANON = f"""packets AS ({_fill(PACKETS)}),
k AS (SELECT p.capture_id, p.frame_number, p.ts_us, p.proto, p.pkt_len, p.tcp_syn, p.tcp_ack, p.tcp_fin, p.tcp_rst, p.tcp_psh, p.tcp_window, p.payload_hex, {_canonical('p')} FROM packets p)"""
RICH = f"""payload AS ({_fill(PAYLOAD)}),
k2 AS (SELECT k.* EXCLUDE (payload_hex), y.* EXCLUDE (capture_id, frame_number), CASE WHEN y.frame_number IS NOT NULL THEN y.rich_payload_hex ELSE k.payload_hex END AS payload_hex
  FROM k LEFT JOIN payload y ON k.capture_id = y.capture_id AND k.frame_number = y.frame_number),
k3 AS (SELECT *, CASE WHEN rich_payload_len > 0 THEN rich_payload_len ELSE CAST(length(payload_hex) // 2 AS INT) END AS payload_len FROM k2)"""


def _members(source: str, extra: str = "") -> str:
    return f"""l AS (SELECT *{extra}, lag(ts_us) OVER (PARTITION BY {KCOLS} ORDER BY ts_us, frame_number) AS prev_us, min(ts_us) OVER (PARTITION BY {KCOLS}) AS first_us FROM {source}),
m AS (SELECT *, unnest(generate_series(greatest((ts_us - {W}) // {S} + 1, first_us // {S}), ts_us // {S})) AS win FROM l)"""


MEMBERS = f"WITH {CANON}, {_members('k', ', length(payload_hex) // 2 AS payload_len')}"
MEMBERS_RICH = f"WITH {CANON}, {RICH}, {_members('k3')}"
BY = f"GROUP BY {KCOLS}, win"
GAP_US = f"CASE WHEN prev_us >= win * {S} THEN ts_us - prev_us END"
GAP = f"CASE WHEN prev_us >= win * {S} THEN (ts_us - prev_us) / 1000.0 END"


def _ratio(num: str, den: str) -> str:
    return f"round(CASE WHEN {den} = 0 THEN CAST({num} AS DOUBLE) ELSE ({num})::DOUBLE / ({den}) END, 6)"


FWD, BWD = "count(*) FILTER (direction > 0)", "count(*) FILTER (direction < 0)"
SUM = lambda c: f"CAST(coalesce(sum({c}), 0) AS BIGINT)"
BFWD, BBWD = SUM("CASE WHEN direction > 0 THEN pkt_len ELSE 0 END"), SUM("CASE WHEN direction < 0 THEN pkt_len ELSE 0 END")
NAME = "CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE CAST(proto AS VARCHAR) END"


def _hist(value: str, edges: tuple[float, ...], name: str) -> tuple[str, str]:
    counts = []
    for i in range(len(edges) - 1):
        op = "<=" if i == len(edges) - 2 else "<"
        counts.append(f"count(*) FILTER ({value} >= {edges[i]} AND {value} {op} {edges[i + 1]}) AS h{i}")
    total = "(" + " + ".join(f"h{i}" for i in range(len(counts))) + ")"
    out = ", ".join(f"round(CASE WHEN {total} > 0 THEN h{i}::DOUBLE / {total} ELSE 0 END, 6) AS {name}_{i}" for i in range(len(counts)))
    return ", ".join(counts), f"{out}, {total} AS {name}_sum"


_size, _size_out = _hist("pkt_len", WINDOWS.size_edges, "pkt_size_hist")
_iat, _iat_out = _hist("gap", WINDOWS.iat_edges_ms, "iat_hist")
_iat, _iat_out = _iat.replace(" AS h", " AS g"), _iat_out
for _i in range(7):
    _iat_out = _iat_out.replace(f"h{_i}", f"g{_i}")

WINS = f"wins AS (SELECT {KCOLS}, win, {ID}, win * {S} + {W} AS win_end_us, count(*) AS packet_count, {SUM('pkt_len')} AS byte_count, {SUM('payload_len')} AS payload_total_len FROM m {BY})".replace(
    f"{KCOLS}, win, capture_id, ", f"{KCOLS}, win, "
)
TRUTH_CTE = f"""truth AS ({_fill(TRUTH)}), t0 AS (SELECT t.label_row, t.start_us, t.end_us, translate(trim(t.label), '\u0096–—−', '----') AS label, t.proto, {_canonical('t')} FROM truth t),
t AS (SELECT *, CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END AS priority, greatest(0, end_us - start_us) AS dur_us FROM t0),
off AS (SELECT a.*, b.first_window FROM (SELECT {K5}, min(start_us) AS first_label FROM t GROUP BY ALL) a LEFT JOIN (SELECT {K5}, min(win_start_us) AS first_window FROM wins GROUP BY ALL) b USING ({K5}))"""
LAB = f"""{TRUTH_CTE}, e AS (SELECT t.*, start_us + coalesce(first_window - first_label, 0) AS s, start_us + coalesce(first_window - first_label, 0) + dur_us AS f FROM t JOIN off USING ({K5})),
cand AS (SELECT wins.capture_id, wins.tuple5, wins.win, e.label, e.priority, e.s, e.label_row, least(win_end_us, f) - greatest(win_start_us, s) AS inter, (win_end_us - win_start_us) + dur_us - (least(win_end_us, f) - greatest(win_start_us, s)) AS uni
  FROM wins JOIN e USING ({K5}) WHERE win_start_us < f AND s < win_end_us),
best AS (SELECT *, inter::DOUBLE / uni AS iou, count(*) OVER (PARTITION BY capture_id, tuple5, win) AS n, row_number() OVER (PARTITION BY capture_id, tuple5, win ORDER BY inter::DOUBLE / uni DESC, priority DESC, s, label_row) AS r FROM cand),
flows AS (SELECT {K5}, max(priority) = 0 AS calm FROM e GROUP BY ALL),
lab AS (SELECT wins.*, coalesce(best.label, CASE WHEN calm THEN 'BENIGN' ELSE 'unknown' END) AS label, coalesce(iou, 0) AS label_iou, coalesce(priority, 0) AS label_priority, best.label IS NULL AND NOT coalesce(calm, false) AS label_is_unknown, coalesce(n, 0) AS n_candidates
  FROM wins LEFT JOIN (SELECT * FROM best WHERE r = 1) best USING (capture_id, tuple5, win) LEFT JOIN flows USING ({K5}))"""
LABELLED = f"{MEMBERS}, {WINS}, {LAB}"
HASH = lambda *parts: f"md5(concat_ws('|', '42', {', '.join(parts)}))"
KEY = ("capture_id", "tuple5", "win")
SPLIT = f"""{LABELLED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id, label ORDER BY {HASH('capture_id', 'label', *KEY)}, capture_id, tuple5, win) AS r, count(*) OVER (PARTITION BY capture_id, label) AS n FROM lab),
cut AS (SELECT *, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS b FROM ranked),
split AS (SELECT *, CASE WHEN r <= a + (n - a - 2 * b >= 1)::INT THEN 'train' WHEN r <= a + b + (n - a - 2 * b >= 1)::INT + (n - a - 2 * b >= 2)::INT THEN 'val' ELSE 'test' END AS split FROM cut)"""
NUMBERED = f"{LABELLED}, num AS (SELECT *, row_number() OVER (ORDER BY win_start_us, tuple5, capture_id) AS flow_id FROM lab)"
PAIRS = f"""{LABELLED}, pc AS (SELECT least(src_ip, dst_ip) AS ip_low, greatest(src_ip, dst_ip) AS ip_high, label, count(*) AS cnt FROM lab WHERE proto = 6 AND label <> 'unknown' GROUP BY ALL),
pairs AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY ip_low, ip_high) AS BIGINT) AS total FROM pc),
pure AS (SELECT ip_low, ip_high, total, label AS dominant, cnt AS top, cnt::DOUBLE / total AS purity FROM (SELECT *, row_number() OVER (PARTITION BY ip_low, ip_high ORDER BY cnt DESC, label) AS r FROM pairs) WHERE r = 1)"""
ATTACK = "label NOT IN ('BENIGN', 'unknown')"
P = f"WITH p AS ({PREDS.replace('{labels}', 'labels')})"
CLASSES = f"""{P}, c AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(g) AS BIGINT) - CAST(sum(tp) AS BIGINT) AS fp, CAST(sum(s) AS BIGINT) - CAST(sum(tp) AS BIGINT) AS fn, CAST(sum(s) AS BIGINT) AS support FROM (
  SELECT reference_label AS label, (reference_label = predicted_label)::INT AS tp, 0 AS g, 1 AS s FROM p UNION ALL SELECT predicted_label, 0, 1, 0 FROM p) GROUP BY label),
m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""
SIMPLE = "capture_id, tuple5, win_start_us, win, label"
RUNS = f"{P}, runs AS (SELECT run, round(avg((reference_label = predicted_label)::INT), 4) AS a FROM p GROUP BY run)"


# Numbers as text with two decimals, halves up: from hundredths, from microseconds as milliseconds, from a double, and sizes in bytes.
CENTS = lambda h: f"printf('%d.%02d', ({h}) // 100, ({h}) % 100)"
MS = lambda us: CENTS(f"(({us}) + 5) // 10")
TWO = lambda x: CENTS(f"CAST(floor(({x}) * 100 + 0.5 + 1e-9) AS BIGINT)")


def _bytes(c: str) -> str:
    unit = lambda n, name: f"{CENTS(f'(({c}) * 200 + {n}) // {2 * n}')} || ' {name}'"
    return f"CASE WHEN {c} >= {1 << 30} THEN {unit(1 << 30, 'GiB')} WHEN {c} >= {1 << 20} THEN {unit(1 << 20, 'MiB')} WHEN {c} >= 1024 THEN {unit(1024, 'KiB')} ELSE ({c}) || ' B' END"


def _shown(hexes: str) -> str:
    """Bytes in hex as text: white space as a blank, what is not printable as a dot."""
    return f"regexp_replace(regexp_replace(decode(unhex({hexes})), '[\\x09-\\x0D]', ' ', 'g'), '[^\\x20-\\x7E]', '.', 'g')"


def _application() -> str:
    col = lambda n: f"coalesce(rich_{n}, '')"
    plus = lambda n, before: f"CASE WHEN {col(n)} <> '' THEN '{before}' || {col(n)} ELSE '' END"
    http = f"""CASE WHEN {col('http_method')} <> '' THEN 'HTTP ' || {col('http_method')} || ' ' || CASE WHEN {col('http_uri')} <> '' THEN {col('http_uri')} ELSE '/' END || {plus('http_host', ' host=')}
WHEN {col('http_status_code')} <> '' THEN 'HTTP ' || {col('http_status_code')} || {plus('http_status_phrase', ' ')} END"""
    dns = f"CASE WHEN {col('dns_query')} <> '' THEN 'DNS ' || CASE WHEN {col('dns_qtype')} <> '' THEN {col('dns_qtype')} ELSE 'Q' END || ' ' || {col('dns_query')} || {plus('dns_answers', ' ans=')} END"
    tls = f"""CASE WHEN {col('tls_server_name')} <> '' THEN 'TLS SNI=' || {col('tls_server_name')} || {plus('tls_handshake_type', ' type=')} || {plus('tls_version', ' ver=')}
WHEN {col('tls_content_type')} <> '' THEN 'TLS content=' || {col('tls_content_type')} WHEN {col('frame_protocols')} <> '' THEN 'Protocols=' || {col('frame_protocols')} END"""
    return f"concat_ws(' | ', {http}, {dns}, {tls})"


FLAGS = "concat_ws('|', " + ", ".join(f"CASE WHEN tcp_{x.lower()} = 1 THEN '{x}' END" for x in ("SYN", "ACK", "FIN", "RST", "PSH")) + ")"
PLACES = f"""a AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY {KCOLS}, win) AS n FROM m WINDOW w AS (PARTITION BY {KCOLS}, win ORDER BY ts_us, frame_number)),
b AS (SELECT *, row_number() OVER (PARTITION BY {KCOLS}, win ORDER BY CASE WHEN pos = 1 OR pos = n THEN 0 ELSE 1 END, CASE WHEN pos = 1 OR pos = n THEN 0 ELSE -payload_len END, pos) AS rank FROM a)"""
EVENTS = f"""{PLACES}, shown AS (SELECT *, ts_us - win * {S} AS off, {FLAGS} AS flags, CASE WHEN tcp_window > 0 THEN tcp_window END AS shown_window, nullif({_shown('payload_hex[1:64]')}, '') AS preview,
  nullif({_application()}, '') AS application, CASE WHEN direction > 0 THEN 'FWD' ELSE 'BWD' END AS side, {NAME} AS event_proto FROM b WHERE rank <= {WINDOWS.max_events}),
ev AS (SELECT {KCOLS}, win, count(*) OVER (PARTITION BY {KCOLS}, win)::INT AS rich_event_count, row_number() OVER (PARTITION BY {KCOLS}, win ORDER BY pos) AS place, off / 1000.0 AS offset_ms, side AS direction, event_proto,
  pkt_len AS len, CAST(payload_len AS INT) AS payload_len, flags, shown_window AS tcp_window, preview, application,
  concat_ws(' ', '[+' || {MS('off')} || 'ms]', side, event_proto, 'len=' || pkt_len, 'payload=' || payload_len, 'flags=' || coalesce(nullif(flags, ''), '-'), 'win=' || shown_window, application, 'preview="' || preview || '"') AS text FROM shown)"""
_PS = f"""xb AS (SELECT {KCOLS}, win, unnest(regexp_extract_all(payload_hex, '..')) AS b FROM m), cb AS (SELECT {KCOLS}, win, b, count(*) AS n FROM xb GROUP BY ALL),
st0 AS (SELECT {KCOLS}, win, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS ent, sum(CASE WHEN b BETWEEN '20' AND '7e' OR b BETWEEN '09' AND '0d' THEN n ELSE 0 END) / sum(n) AS asc_ratio FROM cb GROUP BY ALL),
st AS (SELECT {KCOLS}, win, greatest(0, coalesce(ent, 0)) AS ent, coalesce(asc_ratio, 0)::DOUBLE AS asc_ratio FROM (SELECT DISTINCT {KCOLS}, win FROM m) LEFT JOIN st0 USING ({KCOLS}, win))"""
_ENDS = f"""j AS (SELECT {KCOLS}, win, coalesce(string_agg(payload_hex, '' ORDER BY ts_us, frame_number), '') AS h FROM m GROUP BY ALL),
ends AS (SELECT {KCOLS}, win, h[1:{2 * WINDOWS.head_bytes}] AS head_hex, right(h, {2 * WINDOWS.tail_bytes}) AS tail_hex, length(h) // 2 > {WINDOWS.head_bytes + WINDOWS.tail_bytes} AS truncated FROM j)"""
_TOKENS = f"""xt AS (SELECT DISTINCT {KCOLS}, win, trim(unnest(string_split(coalesce(rich_frame_protocols, ''), '>'))) AS t FROM m),
tok AS (SELECT {KCOLS}, win, coalesce(string_agg(t, ',' ORDER BY t) FILTER (t <> ''), '') AS protocols FROM xt GROUP BY ALL)"""
_SEC = lambda us: f"printf('%d.%03d', ({us}) // 1000000, ({us}) % 1000000 // 1000)"
_ROLL = lambda c, n: f"CAST(sum({c}) OVER (PARTITION BY {KCOLS} ORDER BY win ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS BIGINT)"
_SHORT, _LONG = WINDOWS.context_rows
_RATIOS = ", ".join(f"CASE WHEN proto = 6 THEN {SUM('tcp_' + x)}::DOUBLE / count(*) ELSE {SUM('tcp_' + x)}::DOUBLE END AS {x}_ratio" for x in ("syn", "ack", "psh", "fin", "rst"))
RICHW = f"""{MEMBERS_RICH}, {EVENTS}, {_PS}, {_ENDS}, {_TOKENS},
w0 AS (SELECT {ID}, {KCOLS}, win, {NAME} AS proto_name, count(*) AS packet_count, {SUM('pkt_len')} AS byte_count, {FWD} AS pkt_cnt_fwd, {BWD} AS pkt_cnt_bwd, {BFWD} AS byte_cnt_fwd, {BBWD} AS byte_cnt_bwd,
  {SUM('payload_len')} AS payload_total_len, max(ts_us) - min(ts_us) AS dur_us, {_RATIOS} FROM m {BY}),
w1 AS (SELECT *, {_ROLL('packet_count', _SHORT)} AS p10, {_ROLL('byte_count', _SHORT)} AS b10, {_ROLL('packet_count', _LONG)} AS p60, {_ROLL('byte_count', _LONG)} AS b60 FROM w0),
first_ev AS (SELECT {KCOLS}, win, any_value(rich_event_count) AS rich_event_count, any_value(text) FILTER (place = 1) AS first_event FROM ev GROUP BY {KCOLS}, win),
rw AS (SELECT * FROM w1 LEFT JOIN st USING ({KCOLS}, win) LEFT JOIN ends USING ({KCOLS}, win) LEFT JOIN tok USING ({KCOLS}, win) LEFT JOIN first_ev USING ({KCOLS}, win)),
rich AS (SELECT *, concat_ws(' | ', proto_name || ' window {{span}}: ' || packet_count || ' pkts (' || {_bytes('byte_count')} || ') fwd/bwd bytes=' || {_bytes('byte_cnt_fwd')} || '/' || {_bytes('byte_cnt_bwd')} || ' summarized entropy=' || {TWO('ent')} || ' bits',
  'last {int(WINDOWS.context_sec[0])}s: ' || p10 || ' pkts / ' || {_bytes('b10')}, 'last {int(WINDOWS.context_sec[1])}s: ' || p60 || ' pkts / ' || {_bytes('b60')},
  CASE WHEN rich_event_count > 0 THEN rich_event_count || ' key events captured' END, CASE WHEN protocols <> '' THEN 'protocols=' || protocols END, 'payload_ascii_ratio=' || {TWO('asc_ratio')}) AS summary FROM rw)""".replace(
    f"{ID}, {KCOLS}", f"{ID}, {KCOLS}".replace("capture_id, concat", "concat", 1)
)
ABSOLUTE = f"' || {_SEC('win_start_us')} || '-' || {_SEC(f'win_start_us + {W}')} || 's"
RELATIVE = f"0.000-{W / 1e6:.3f}s"
RICH_ABS = RICHW.replace("{span}", ABSOLUTE)
RICH_REL = RICHW.replace("{span}", RELATIVE).replace("proto_name || ' window", "proto_name || ' window")
_LABELS = "(SELECT string_agg('  - ' || label, chr(10) ORDER BY label) FROM (SELECT DISTINCT label FROM lab WHERE label <> ''))"
_BEFORE, _AFTER = (x.replace("{{", "{").replace("}}", "}").replace("'", "''") for x in SYSTEM_PROMPT.split("{labels}"))
_SYSTEM = f"('{_BEFORE}' || {_LABELS} || '{_AFTER}')"
_LABELLED_TAIL = f"{WINS}, {LAB}"


def _line(*parts: str) -> str:
    return " || ".join(parts)


_PROMPT = "concat_ws(chr(10), " + ", ".join([
    "'Connection: ' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port || ' (proto=' || proto || ')'",
    "'Packets: ' || packet_count || ' total (fwd=' || pkt_cnt_fwd || ', bwd=' || pkt_cnt_bwd || ')'", "'Bytes: ' || byte_count || ' total (fwd=' || byte_cnt_fwd || ', bwd=' || byte_cnt_bwd || ')'",
    f"'Flow duration: ' || {MS('dur_us')} || 'ms'",
    "'TCP flags: ' || nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {x}_ratio > 0 THEN '{x.upper()}=' || {TWO(x + '_ratio')} END" for x in ("syn", "ack", "psh", "fin", "rst")) + "), '')",
    f"CASE WHEN payload_total_len > 0 THEN 'Payload: ' || payload_total_len || ' bytes, entropy=' || {TWO('ent')} || ', ASCII ratio=' || {TWO('asc_ratio')} END",
    "CASE WHEN protocols <> '' THEN 'Protocols: ' || array_to_string(string_split(protocols, ',')[1:5], ', ') END", "'Context: ' || summary[1:150]",
]) + ")"
MASKED = lambda c: f"CASE WHEN CAST(CONCAT('0x', left(md5(concat_ws('|', '42', flow_id, '{c}')), 12)) AS BIGINT) / 281474976710656.0 < 0.2 THEN 'REDACTED' ELSE {c} END"


def _first(n: str, where: str) -> str:
    return f"SELECT {SIMPLE} FROM (SELECT *, row_number() OVER (ORDER BY {HASH(*KEY)}, capture_id, tuple5, win) AS r FROM lab WHERE {where}) WHERE r <= {n}"


ORACLES = {
    "flow_windows": f"{MEMBERS} SELECT {ID}, count(*) AS packet_count, {SUM('pkt_len')} AS byte_count, {FWD} AS pkt_cnt_fwd, {BWD} AS pkt_cnt_bwd, {BFWD} AS byte_cnt_fwd, {BBWD} AS byte_cnt_bwd, {NAME} AS proto_name, round((max(ts_us) - min(ts_us)) / 1000.0, 6) AS flow_dur_ms, {_ratio(FWD, BWD)} AS fwd_bwd_ratio_pkt, {_ratio(BFWD, BBWD)} AS fwd_bwd_ratio_byte FROM m {BY}",
    "flow_window_tcp": f"{MEMBERS} SELECT {ID}, "
    + ", ".join(f"{_ratio(SUM('tcp_' + x), '(CASE WHEN proto = 6 THEN count(*) ELSE 0 END)')} AS tcp_{x}_ratio" for x in ("syn", "fin", "rst", "ack", "psh"))
    + f", round(avg(tcp_window), 6) AS tcp_window_mean, least(count(*) FILTER (direction > 0 AND tcp_syn = 1), count(*) FILTER (direction < 0 AND tcp_syn = 1 AND tcp_ack = 1), count(*) FILTER (direction > 0 AND tcp_ack = 1)) AS tcp_handshake_score, {SUM('tcp_rst')} AS tcp_rst_count, {SUM('tcp_psh')} AS tcp_psh_count, max(tcp_window) AS tcp_window_max FROM m {BY}",
    "flow_window_stats": f"{MEMBERS} SELECT {ID}, round(avg(pkt_len), 6) AS pkt_len_mean, round(stddev_pop(pkt_len), 6) AS pkt_len_std, min(pkt_len) AS pkt_len_min, max(pkt_len) AS pkt_len_max, {SUM('payload_len')} AS payload_total_len FROM m {BY}",
    "flow_window_iat": f"{MEMBERS} SELECT {ID}, "
    + ", ".join(f"round(coalesce({f}({GAP_US}) / 1000.0, 0) + 1e-7, 4) AS iat_{n}_ms" for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max")))
    + f" FROM m {BY}",
    "flow_window_hist": f"{MEMBERS}, gaps AS (SELECT *, {GAP} AS gap FROM m), c AS (SELECT {KCOLS}, win, {_size}, {_iat} FROM gaps {BY}) SELECT {ID}, {_size_out}, {_iat_out} FROM c",
    "flow_context": f"{MEMBERS}, {WINS} SELECT capture_id, tuple5, win_start_us, "
    + ", ".join(
        f"CAST(sum({c}) OVER (PARTITION BY capture_id, tuple5 ORDER BY win ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS {c}_{name}"
        for n, name in zip(WINDOWS.context_rows, ("10s", "60s"), strict=True)
        for c in ("packet_count", "byte_count", "payload_total_len")
    )
    + " FROM wins",
    "structured_columns": f"{MEMBERS}, {WINS} SELECT capture_id, tuple5, win_start_us, packet_count, 0 AS rich_columns FROM wins",
    "key_events": f"""{MEMBERS}, a AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY {KCOLS}, win) AS n FROM m WINDOW w AS (PARTITION BY {KCOLS}, win ORDER BY ts_us, frame_number)),
b AS (SELECT *, row_number() OVER (PARTITION BY {KCOLS}, win ORDER BY CASE WHEN pos = 1 OR pos = n THEN 0 ELSE 1 END, CASE WHEN pos = 1 OR pos = n THEN 0 ELSE -payload_len END, pos) AS rank FROM a)
SELECT {KCOLS}, win, frame_number, CAST(payload_len AS INT) AS payload_len, row_number() OVER (PARTITION BY {KCOLS}, win ORDER BY pos) AS place FROM b WHERE rank <= {WINDOWS.max_events}""",
    "payload_merge": f"WITH {CANON}, {RICH} SELECT capture_id, frame_number, payload_hex, payload_len FROM k3",
    "payload_merge_bucketed": f"WITH {CANON}, {RICH} SELECT capture_id, frame_number, payload_hex, payload_len FROM k3",
    "payload_stats": f"""{MEMBERS_RICH}, x AS (SELECT {KCOLS}, win, unnest(regexp_extract_all(payload_hex, '..')) AS b FROM m), c AS (SELECT {KCOLS}, win, b, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT {KCOLS}, win, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS ent, sum(CASE WHEN b BETWEEN '20' AND '7e' OR b BETWEEN '09' AND '0d' THEN n ELSE 0 END) / sum(n) AS asc_ratio FROM c GROUP BY ALL)
SELECT {KCOLS}, win, round(greatest(0, coalesce(ent, 0)), 5) AS payload_entropy, round(coalesce(asc_ratio, 0), 5)::DOUBLE AS payload_ascii_ratio FROM (SELECT DISTINCT {KCOLS}, win FROM m) LEFT JOIN s USING ({KCOLS}, win)""",
    "payload_ends": f"""{MEMBERS_RICH}, j AS (SELECT {KCOLS}, win, coalesce(string_agg(payload_hex, '' ORDER BY ts_us, frame_number), '') AS h FROM m GROUP BY ALL)
SELECT {KCOLS}, win, h[1:{2 * WINDOWS.head_bytes}] AS rich_payload_head_hex, right(h, {2 * WINDOWS.tail_bytes}) AS rich_payload_tail_hex, length(h) // 2 > {WINDOWS.head_bytes + WINDOWS.tail_bytes} AS rich_payload_truncated,
regexp_replace(regexp_replace(decode(unhex(h[1:{2 * WINDOWS.head_bytes}])), '[\\x09-\\x0D]', ' ', 'g'), '[^\\x20-\\x7E]', '.', 'g') AS rich_payload_head_ascii,
regexp_replace(regexp_replace(decode(unhex(right(h, {2 * WINDOWS.tail_bytes}))), '[\\x09-\\x0D]', ' ', 'g'), '[^\\x20-\\x7E]', '.', 'g') AS rich_payload_tail_ascii FROM j""",
    "protocol_tokens": f"""{MEMBERS_RICH}, x AS (SELECT DISTINCT {KCOLS}, win, trim(unnest(string_split(coalesce(rich_frame_protocols, ''), '>'))) AS t FROM m)
SELECT {KCOLS}, win, coalesce(string_agg(t, ',' ORDER BY t) FILTER (t <> ''), '') AS rich_protocols FROM x GROUP BY ALL""",
    "normalise_packets": """SELECT event_id AS frame_number, 6 AS proto, concat('10.0.0.', user_id % 20) AS src_ip, '192.168.1.1' AS dst_ip, CASE WHEN event_id % 2 = 0 THEN 53 ELSE user_id + 1000 END AS src_port,
CASE WHEN event_id % 3 = 0 THEN 0 ELSE 443 END AS dst_port, CAST(floor(value * 20) AS INT) AS pkt_len, CASE WHEN event_id % 5 IN (0, 3) THEN 1 ELSE 0 END AS tcp_syn, 1 AS tcp_ack, 0 AS tcp_fin, 0 AS tcp_rst, 0 AS tcp_psh, 0 AS tcp_window,
CASE WHEN event_id % 2 = 0 THEN '' ELSE 'aabb0c' END AS payload_hex FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0""",
    "normalise_payload": """SELECT event_id AS frame_number, h AS rich_payload_hex, CAST(length(h) // 2 AS INT) AS rich_payload_len, 'eth>ip>tcp' AS rich_frame_protocols,
concat_ws(';', CASE WHEN event_id % 4 = 0 THEN '1.1.1.1;2.2.2.2' END, CASE WHEN event_id % 6 = 0 THEN '::1' END) AS rich_dns_answers, event_type AS rich_http_host
FROM (SELECT *, CASE WHEN event_id % 2 = 1 THEN 'aabb0c' WHEN event_id % 3 = 0 THEN 'dead' ELSE '010203' END AS h FROM events WHERE event_id % 17 <> 0)""",
    "label_clean": f"{MEMBERS}, {WINS}, {TRUTH_CTE} SELECT label_row, label, priority, dur_us FROM t",
    "label_offsets": f"{MEMBERS}, {WINS}, {TRUTH_CTE} SELECT {K5}, coalesce(first_window - first_label, 0) AS offset_us, first_window IS NOT NULL AS matched FROM off",
    "label_align": f"{LABELLED} SELECT capture_id, tuple5, win_start_us, label, round(label_iou, 9) AS label_iou, label_priority, label_is_unknown, n_candidates FROM lab",
    "label_stats": f"""{LABELLED} SELECT count(*) AS total, count(*) FILTER (label_is_unknown) AS unknown_count, round(avg(label_is_unknown::INT), 9) AS unknown_ratio, count(*) FILTER (n_candidates > 1) AS multi_candidate, 'BENIGN' AS benign_label,
(SELECT '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' FROM (SELECT label, count(*) AS n FROM lab GROUP BY label)) AS label_counts FROM lab""",
    "label_propagate": f"{LABELLED} SELECT capture_id, tuple5, win_start_us, label, label_is_unknown FROM lab",
    "duplicate_keys": f"WITH {CANON} SELECT capture_id, src_ip, dst_port, pkt_len, count(*) AS n FROM packets GROUP BY ALL HAVING count(*) > 1",
    "stratified_split": f"{SPLIT} SELECT capture_id, tuple5, win_start_us, label, split FROM split",
    "split_stats": f"""{SPLIT}, c AS (SELECT split, label, count(*) AS n FROM split GROUP BY ALL)
SELECT split, CAST(sum(n) AS BIGINT) AS examples, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS label_counts, (SELECT string_agg(g, ',' ORDER BY g) FROM (SELECT DISTINCT capture_id AS g FROM split s WHERE s.split = c.split)) AS group_ids FROM c GROUP BY split""",
    "split_attach": f"{SPLIT} SELECT split, count(*) AS n, min('n=' || packet_count) AS first_note FROM split GROUP BY split",
    "sequential_ids": f"{MEMBERS}, {WINS} SELECT capture_id, tuple5, win_start_us, row_number() OVER (ORDER BY win_start_us, tuple5, capture_id) AS flow_id FROM wins",
    "struct_jsonl": f"{NUMBERED} SELECT flow_id, tuple5, win_start_us // 1000000 AS start, packet_count, 7 AS size_bins, label FROM num",
    "awkward_records": f"""{MEMBERS}, {WINS}, o AS (SELECT *, repeat('x', CAST(CASE WHEN packet_count % 7 = 0 THEN 20000 ELSE packet_count END AS INT)) AS tail FROM wins)
SELECT win, '"' || capture_id AS label, md5(concat('[fe80::', src_ip, ']"\\,é' || chr(10), tail)) AS src_md5, md5(concat('[fe80::', dst_ip, ']"\\,é' || chr(10), tail)) AS dst_md5, length(concat('[fe80::', src_ip, ']"\\,é' || chr(10), tail)) AS length,
src_port, dst_port, proto, 5 AS parts, win_start_us // 1000000 AS start, win_end_us // 1000000 AS "end", byte_count FROM o""",
    "validate_records": f"""{NUMBERED} SELECT path, message, count(*) AS n FROM (SELECT flow_id % 10 AS i FROM num) JOIN (VALUES (0, 'flow_id', 'an integer of at least 1'), (1, 'label', 'required'), (2, '', 'not a JSON object'), (3, '', 'not allowed: more'),
(4, 'tuple5', 'two texts and three integers'), (5, 'features.pkt_cnt_fwd', 'a required number')) v(i, path, message) USING (i) GROUP BY ALL""",
    "qc_splits": f"{SPLIT} SELECT split, count(*) AS windows, count(DISTINCT tuple5) AS tuple5s, count(DISTINCT '') AS label_captures, count(DISTINCT capture_id) AS captures, round(avg(label_is_unknown::INT), 9) AS unknown_ratio FROM split GROUP BY split",
    "qc_split_sketches": f"{SPLIT} SELECT split, count(*) AS windows, true AS tuple5s_close, true AS label_captures_close, true AS captures_close, round(avg(label_is_unknown::INT), 9) AS unknown_ratio FROM split GROUP BY split",
    "qc_labels": f"""{SPLIT}, c AS (SELECT split, label, count(*) AS count FROM split GROUP BY ALL UNION ALL SELECT 'all', label, count(*) FROM split GROUP BY label)
SELECT split, label, count, round(count / sum(count) OVER (PARTITION BY split), 6)::DOUBLE AS share, round(log10(greatest(count, 1)), 6) AS log_count FROM c""",
    "qc_protocols": f"""{LABELLED}, c AS (SELECT proto, count(*) AS windows, count(DISTINCT tuple5) AS tuple5s, count(*) FILTER ({ATTACK}) AS attack_windows, count(DISTINCT tuple5) FILTER ({ATTACK}) AS attack_tuple5s FROM lab GROUP BY proto)
SELECT proto, CASE proto WHEN 6 THEN '6 (TCP)' WHEN 17 THEN '17 (UDP)' WHEN 1 THEN '1 (ICMP)' END AS proto_display, windows, tuple5s, attack_windows, attack_tuple5s, round(windows / sum(windows) OVER (), 6)::DOUBLE AS window_share, round(attack_windows / sum(attack_windows) OVER (), 6)::DOUBLE AS attack_share FROM c""",
    "qc_protocol_splits": f"""{SPLIT}, c AS (SELECT 'all' AS scope, split, proto, count(*) AS count FROM split GROUP BY ALL UNION ALL SELECT 'attack', split, proto, count(*) FROM split WHERE {ATTACK} GROUP BY ALL)
SELECT scope, split, proto, count, round(count / sum(count) OVER (PARTITION BY scope, split), 6)::DOUBLE AS share FROM c""",
    "qc_totals": f"{LABELLED} SELECT count(*) AS windows, count(DISTINCT tuple5) AS tuple5s, count(*) FILTER ({ATTACK}) AS attack_windows, (SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FROM (SELECT DISTINCT proto AS p FROM lab WHERE {ATTACK})) AS attack_protocols FROM lab",
    "pair_labels": f"{PAIRS} SELECT ip_low, ip_high, label, cnt, total, round(cnt::DOUBLE / total, 6) AS fraction FROM pairs",
    "pair_purity": f"{PAIRS} SELECT ip_low, ip_high, total, dominant, top, round(purity, 6) AS purity FROM pure",
    "purity_summary": f"{PAIRS} SELECT count(*) AS pairs, CAST(sum(total) AS BIGINT) AS rows, round(sum(top)::DOUBLE / sum(total), 9) AS weighted_purity, count(*) FILTER (purity >= 0.9) AS pure_pairs FROM pure",
    "pair_top": f"{PAIRS} SELECT ip_low || '↔' || ip_high AS pair, total, dominant FROM pure ORDER BY total DESC, ip_low, ip_high LIMIT 5",
    "pair_mix": f"""{PAIRS}, top AS (SELECT ip_low, ip_high, ip_low || '↔' || ip_high AS pair FROM pure ORDER BY total DESC, ip_low, ip_high LIMIT 5),
tp AS (SELECT pair, label, cnt FROM top JOIN pairs USING (ip_low, ip_high)), names AS (SELECT DISTINCT label FROM tp)
SELECT top.pair, names.label, coalesce(tp.cnt, 0) AS cnt FROM top CROSS JOIN names LEFT JOIN tp ON tp.pair = top.pair AND tp.label = names.label""",
    "pair_coverage": f"{PAIRS} SELECT ip_low, ip_high, row_number() OVER w AS rank, total, round(sum(total) OVER w / sum(total) OVER (), 6)::DOUBLE AS covered FROM pure WINDOW w AS (ORDER BY total DESC, ip_low, ip_high ROWS UNBOUNDED PRECEDING)",
    "purity_hist": f"{PAIRS} SELECT CAST(least(9, floor(purity / 0.1::DOUBLE)) AS INT) AS bin, count(*) AS n, round(CAST(least(9, floor(purity / 0.1::DOUBLE)) AS INT) * 0.1, 6)::DOUBLE AS low, round((CAST(least(9, floor(purity / 0.1::DOUBLE)) AS INT) + 1) * 0.1, 6)::DOUBLE AS high FROM pure GROUP BY ALL",
    "label_counts": f"{LABELLED} SELECT label, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM lab GROUP BY label",
    "balanced_sample": f"{LABELLED}, c AS (SELECT count(*) FILTER (label <> 'BENIGN') AS a, count(*) FILTER (label = 'BENIGN') AS b FROM lab), q AS (SELECT greatest(0, least(CASE WHEN a + a * 3 > {SAMPLES.target} THEN {SAMPLES.target} - a ELSE a * 3 END, b)) AS n FROM c) SELECT {SIMPLE} FROM lab WHERE label <> 'BENIGN' UNION ALL ("
    + _first("(SELECT n FROM q)", "label = 'BENIGN'")
    + ")",
    "val_sample": f"""{LABELLED}, c AS (SELECT label, count(*) AS n, count(*) OVER () AS labels FROM lab GROUP BY label), q AS (SELECT label, least(n, CASE WHEN label = 'BENIGN' THEN CAST(floor(n * 0.05::DOUBLE) AS BIGINT) ELSE 400 // greatest(1, labels - 1) END) AS quota FROM c),
s AS (SELECT *, {HASH(*KEY)} AS h, row_number() OVER (PARTITION BY label ORDER BY {HASH(*KEY)}, capture_id, tuple5, win) AS r FROM lab), kept AS (SELECT s.* FROM s JOIN q USING (label) WHERE r <= quota)
SELECT {SIMPLE} FROM (SELECT *, row_number() OVER (ORDER BY h, capture_id, tuple5, win) AS z FROM kept) WHERE z <= 400""",
    "natural_sample": f"{LABELLED} " + _first(str(SAMPLES.natural), "true"),
    "head_sample": f"WITH {CANON} SELECT capture_id, frame_number, ts_us FROM packets ORDER BY frame_number, capture_id LIMIT 100",
    "prompt_masked": f"{MEMBERS}, {WINS}, h AS (SELECT *, concat_ws('/', capture_id, tuple5, win) AS flow_id FROM wins) SELECT capture_id, tuple5, win, "
    + ", ".join(f"CASE WHEN CAST(CONCAT('0x', left(md5(concat_ws('|', '42', flow_id, '{c}')), 12)) AS BIGINT) / 281474976710656.0 < 0.2 THEN 'REDACTED' ELSE {c} END AS {c}" for c in ("src_ip", "dst_ip"))
    + " FROM h",
    "relative_time": f"{MEMBERS}, {WINS} SELECT capture_id, tuple5, win, {W} / 1e6 AS windows_length, 'TCP window 0.000-{W / 1e6 + 0.5:.3f}s end' AS note FROM wins",
    "completions": f"""{LABELLED} SELECT capture_id, tuple5, win, '{{"label": "' || label || '", "explanation": "' AS completion, '{{"label":"' || label || '","explanation":""}}' AS closed FROM lab""",
    "explanations": f"""{LABELLED} SELECT capture_id, tuple5, win, CASE WHEN label LIKE '%XSS%' THEN coalesce(nullif(concat_ws(', ', CASE WHEN dst_port IN (80, 443, 8080) THEN 'HTTP traffic on port ' || dst_port END,
CASE WHEN packet_count > 100 THEN 'high packet count (' || packet_count || ')' END, CASE WHEN payload_total_len > 1000 THEN 'large payload (' || payload_total_len || ' bytes)' END), ''), 'Flow with ' || packet_count || ' packets and ' || byte_count || ' bytes')
WHEN label = 'Infiltration' THEN 'suspicious activity (' || packet_count || ' pkts, ' || byte_count || ' bytes)' WHEN label = 'BENIGN' THEN 'normal pattern (' || packet_count || ' pkts, ' || byte_count || ' bytes)'
ELSE 'Flow with ' || packet_count || ' packets and ' || byte_count || ' bytes' END AS explanation FROM lab""",
    "parsed_responses": """SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 2, 3) THEN lab END AS label,
CASE doc_id % 6 WHEN 0 THEN 'doc ' || doc_id WHEN 2 THEN 'cut off} here' WHEN 3 THEN 'I think ' || lab || ' fits' END AS explanation FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'BENIGN' ELSE 'PortScan' END AS lab FROM labels) WHERE doc_id % 6 <> 4
UNION ALL SELECT doc_id, 'SOMETHING', 'it is classified as something' FROM labels WHERE doc_id % 6 = 4""",
    "class_metrics": f"{CLASSES} SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "overall_metrics": f"{CLASSES} SELECT CAST(sum(support) AS BIGINT) AS samples, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, "
    + ", ".join(f"round(avg({c}), 6) AS macro_{c}, round(sum({c} * support) / sum(support), 6) AS weighted_{c}" for c in ("precision", "recall", "f1"))
    + " FROM f",
    "agreement": f"{P} SELECT count(*) AS samples, count(*) FILTER (reference_label = predicted_label) AS same, count(DISTINCT predicted_label) AS distinct_predictions, count(DISTINCT reference_label) AS distinct_references FROM p",
    "label_sides": f"{P} SELECT 'reference' AS side, reference_label AS label, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'prediction', predicted_label, count(*) FROM p GROUP BY ALL",
    "run_ranking": f"{RUNS} SELECT run, row_number() OVER (ORDER BY a DESC, run) AS place, round(a, 3) AS eval_accuracy FROM runs",
    "run_delta": f"{RUNS} SELECT round(max(a) FILTER (run = 'base'), 3) AS baseline, round(max(a) FILTER (run = 'tuned'), 3) AS checkpoint, round(max(a) FILTER (run = 'tuned') - max(a) FILTER (run = 'base'), 3) AS delta FROM runs",
    "window_events": f"{MEMBERS_RICH}, {EVENTS} SELECT * FROM ev",
    "application_text": f"WITH payload AS ({_fill(PAYLOAD)}) SELECT frame_number, {_application()} AS application, {_bytes('(frame_number * 4099)')} AS size FROM payload",
    "context_summary": f"{RICH_ABS} SELECT capture_id, tuple5, win_start_us, summary AS rich_context_summary, rich_event_count, truncated AS rich_payload_truncated FROM rich",
    "window_tables": f"""{MEMBERS}, c AS (SELECT count(*) AS n FROM (SELECT DISTINCT {KCOLS}, win FROM m))
SELECT standard, rich, name, rich_columns, n FROM c, (VALUES (true, true, 'standard', 0), (true, true, 'rich', 9), (true, false, 'standard', 0), (false, true, 'rich', 9)) v(standard, rich, name, rich_columns)""",
    "prompt_summary": f"{RICH_ABS}, {_LABELLED_TAIL} SELECT capture_id, tuple5, win, {_SYSTEM} || chr(10) || {_PROMPT} AS prompt FROM rich",
    "system_prompts": f"""{LABELLED} SELECT 'data' AS kind, {_SYSTEM} AS prompt, (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM lab WHERE label <> '')) AS labels
UNION ALL SELECT 'listed', '{_BEFORE}' || '{chr(10).join('  - ' + x for x in sorted(FALLBACK_LABELS))}' || '{_AFTER}', '{','.join(sorted(FALLBACK_LABELS))}'""",
    "prompt_raw": f"""{RICH_REL}, {_LABELLED_TAIL}, num AS (SELECT *, row_number() OVER (ORDER BY win_start_us, tuple5, capture_id) AS flow_id FROM lab)
SELECT md5({_SYSTEM}) AS system_md5, flow_id, concat_ws(',', {MASKED('num.src_ip')}, {MASKED('num.dst_ip')}, num.src_port, num.dst_port, num.proto) AS tuple5, NULL::VARCHAR AS window, NULL::VARCHAR AS label, {W} / 1e6 AS windows_length,
rich.packet_count, summary AS context_summary, rich_event_count AS event_count, protocols FROM num JOIN rich ON num.capture_id = rich.capture_id AND num.tuple5 = rich.tuple5 AND num.win = rich.win""".replace("'num.", "'"),
    "packet_files": f"WITH {CANON} SELECT * FROM packets",
    "payload_files": f"WITH payload AS ({_fill(PAYLOAD)}) SELECT * FROM payload",
    "label_files": f"""{MEMBERS}, {WINS}, {TRUTH_CTE}, f AS (SELECT *, CASE WHEN label_row % 4 = 1 THEN 60000000 ELSE 1000000 END AS step FROM t WHERE label_row % 13 <> 0)
SELECT CAST(label_row AS VARCHAR) AS label_flow_id, '' AS label_capture_id, src_ip, src_port, proto, start_us // step * step AS start_us, end_us // step * step AS end_us FROM f""",
    "record_files": f"{NUMBERED} SELECT flow_id, tuple5, win_end_us // 1000000 AS end, label FROM num WHERE flow_id % 7 > 1",
    "enriched_jsonl": f"""{RICH_ABS} SELECT row_number() OVER (ORDER BY win_start_us, tuple5, capture_id) AS flow_id, summary AS context_summary, rich_event_count AS event_count, rich_event_count AS n_events, first_event, protocols, proto_name,
payload_total_len AS total_len, round(ent, 5) AS entropy, round(asc_ratio, 5) AS ascii_ratio, head_hex, {_shown('tail_hex')} AS tail_ascii, truncated, pkt_cnt_fwd FROM rich""",
    "validate_enriched": f"""{RICH_ABS}, num AS (SELECT *, row_number() OVER (ORDER BY win_start_us, tuple5, capture_id) AS flow_id FROM rich) SELECT path, message, count(*) AS n FROM (SELECT flow_id % 12 AS i FROM num) JOIN (VALUES (0, 'enriched.event_count', 'an integer of at least 0'),
(1, 'enriched.payload.entropy', 'a number of at least 0'), (2, 'enriched.events.direction', 'FWD or BWD'), (3, 'enriched.payload.truncated', 'true or false'), (4, 'enriched.payload.head_hex', 'required'), (5, 'enriched.events.payload_len', 'required'),
(6, 'enriched', 'not allowed: more'), (9, 'enriched.events', 'keys that are not allowed'), (7, 'label', 'a text'), (8, 'features.pkt_size_hist', 'a list of numbers')) v(i, path, message) USING (i) GROUP BY ALL""",
    "validate_first_lines": f"{NUMBERED}, p AS (SELECT (flow_id - 1) // 100 AS part, count(*) AS n FROM num GROUP BY ALL) SELECT part, least(40, n) AS n, least(40, n) AS last FROM p",
    "split_files": f"{SPLIT} SELECT capture_id, tuple5, win_start_us, label, split FROM split",
    "sample_lines": f"{NUMBERED} SELECT flow_id, label FROM (SELECT *, row_number() OVER (ORDER BY {HASH(*KEY)}, capture_id, tuple5, win) AS r FROM num) WHERE r <= {SAMPLES.natural}",
    "prediction_files": f"{P} SELECT reference_label, predicted_label, run, count(*) AS n FROM p GROUP BY ALL",
    "log_files": f"{RUNS} SELECT run, row_number() OVER (ORDER BY a DESC, run) AS place, round(a, 3) AS eval_accuracy FROM runs",
    "label_extra_offsets": f"""{MEMBERS}, {WINS}, {TRUTH_CTE}, o AS (SELECT t.*, coalesce(first_window - first_label, 0) AS own FROM t JOIN off USING ({K5})),
u AS (SELECT *, CASE own WHEN 3600000000 THEN [own, -7200000000] WHEN -7200000000 THEN [own, 3600000000] ELSE [own, 3600000000, -7200000000] END AS l FROM o),
n AS (SELECT *, unnest(range(len(l))) AS i FROM u)
SELECT label_row, CAST(i AS INT) AS offset_no, l[i + 1] AS used_us, start_us + l[i + 1] AS start_us, start_us + l[i + 1] + dur_us AS end_us FROM n""",
    "split_by_default_group": SPLIT.replace("PARTITION BY capture_id, label", "PARTITION BY label").replace(HASH("capture_id", "label", *KEY), HASH("''", "label", *KEY)) + " SELECT capture_id, tuple5, win_start_us, label, split FROM split",
    "label_list": f"{LABELLED} SELECT CAST(row_number() OVER (ORDER BY label) AS INT) AS place, label FROM (SELECT DISTINCT label FROM lab)",
    "shuffled_order": f"{MEMBERS}, {WINS} SELECT capture_id, tuple5, win_start_us, row_number() OVER (ORDER BY {HASH(*KEY)}, capture_id, tuple5, win) AS place FROM wins",
    "pair_volume_hist": f"""{PAIRS}, b AS (SELECT min(total)::DOUBLE AS lo, max(total)::DOUBLE AS hi FROM pure), g AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 8 ELSE 1 END AS width FROM b),
h AS (SELECT CAST(least(7, floor((total - lo) / width)) AS INT) AS bin, lo, width FROM pure, g) SELECT bin, count(*) AS n, round(any_value(lo + bin * width), 6) AS low, round(any_value(lo + (bin + 1) * width), 6) AS high FROM h GROUP BY bin""",
    "report_text": f"""{SPLIT}, c AS (SELECT 'all' AS scope, split, proto, count(*) AS count FROM split GROUP BY ALL UNION ALL SELECT 'attack', split, proto, count(*) FROM split WHERE {ATTACK} GROUP BY ALL)
SELECT scope, split, proto, count, printf('%.2f%%', 100 * count::DOUBLE / sum(count) OVER (PARTITION BY scope, split)) AS share FROM c""",
}
ORACLES["stats_files"] = ORACLES["label_stats"]
