"""The queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontamination, divergence, license_scan, line_dedup, merkle, near_dedup, quality_rules, sentencepiece_codec, sharding, suffix_dedup, token_counts, token_output, url_filters

QUERIES = {
    "op1_url_filters": url_filters.query,
    "op2_token_output": token_output.query,
    "op3_license_scan": license_scan.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_sentencepiece": sentencepiece_codec.query,
    "op6_decontamination": decontamination.query,
    "op7_token_counts": token_counts.query,
    "op8_near_dedup": near_dedup.query,
    "op9_quality_rules": quality_rules.query,
    "op10_sharding": sharding.query,
    "op11_merkle_manifest": merkle.query,
    "op12_source_divergence": divergence.query,
    "op13_line_dedup": line_dedup.query,
}
ORACLES = {
    "op1_url_filters": url_filters.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_line_dedup": line_dedup.ORACLE,
}
