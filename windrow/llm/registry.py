"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from windrow.llm import bpe_chunks, decontamination, language_id, license_scan, lm_scoring, media_png, mixing, prefix_trie, quality, simhash, toxicity, url_filter, whitening

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_toxicity": toxicity.query,
    "op3_quality": quality.query,
    "op4_language_id": language_id.query,
    "op5_simhash": simhash.query,
    "op6_decontamination": decontamination.query,
    "op7_license_scan": license_scan.query,
    "op8_mixing": mixing.query,
    "op9_media_columns": media_png.query,
    "op10_lm_scoring": lm_scoring.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_bpe_chunks": bpe_chunks.query,
    "op13_whitening": whitening.query,
}

ORACLES = {
    "op1_url_filter": url_filter.SQL,
    "op7_license_scan": license_scan.SQL,
}
