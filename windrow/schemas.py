"""Schemas of the tables that the jobs read."""

from __future__ import annotations

#: Column and field names of the file formats.
PACKET = (
    "capture_id string, frame_number bigint, ts double, proto int, src_ip string, dst_ip string, src_port int, dst_port int, pkt_len int, "
    "tcp_syn int, tcp_ack int, tcp_fin int, tcp_rst int, tcp_psh int, tcp_window int, payload_hex string"
)
PACKET_REQUIRED = ("frame_number", "ts", "proto", "src_ip", "dst_ip")
FLAGS = ("tcp_syn", "tcp_ack", "tcp_fin", "tcp_rst", "tcp_psh")

#: Column and field names of the file formats.
RICH_TEXT = (
    "rich_frame_protocols", "rich_http_method", "rich_http_uri", "rich_http_host", "rich_http_user_agent", "rich_http_status_code", "rich_http_status_phrase",
    "rich_dns_query", "rich_dns_qtype", "rich_dns_answers", "rich_tls_server_name", "rich_tls_handshake_type", "rich_tls_content_type", "rich_tls_version",
)
PAYLOAD = "capture_id string, frame_number bigint, rich_payload_hex string, rich_payload_len int, " + ", ".join(f"{c} string" for c in RICH_TEXT)

#: Flow key, and window key.
K = ("capture_id", "src_ip", "src_port", "dst_ip", "dst_port", "proto")
KW = (*K, "win")

#: Column and field names of the file formats.
EVENT = (
    "offset_ms double, direction string, proto string, len int, payload_len int, flags array<string>, tcp_window int, preview string, application string, text string"
)
#: Column and field names of the file formats.
PAYLOAD_INFO = (
    "total_len bigint, entropy double, ascii_ratio double, head_ascii string, head_hex string, tail_ascii string, tail_hex string, truncated boolean"
)
ENRICHED = f"context_summary string, events array<struct<{EVENT}>>, event_count int, payload struct<{PAYLOAD_INFO}>, protocols array<string>, proto_name string"
#: Fixed values, as above. Numbers in tuple5 arrive as text; features keep any extra scalar as text.
RECORD = "flow_id bigint, tuple5 array<string>, window array<double>, features map<string,string>, label string"
ENRICHED_RECORD = f"{RECORD}, enriched struct<{ENRICHED}>"
