"""One query per operator, and SQL twins where SQL can express the whole result."""

from __future__ import annotations

from phonolake.llm import op1_suffix_dedup, op2_simhash, op3_packing, op4_secrets, op5_urls, op6_sharding, op7_decontaminate, op8_warc, op9_paragraphs, op10_quality

_MODULES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash_near_dedup": op2_simhash,
    "op3_best_fit_packing": op3_packing,
    "op4_secret_scans": op4_secrets,
    "op5_url_filters": op5_urls,
    "op6_sharding": op6_sharding,
    "op7_benchmark_decontamination": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_paragraph_dedup": op9_paragraphs,
    "op10_quality_rules": op10_quality,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLE_SQL = {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
