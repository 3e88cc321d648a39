"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, secrets, top_k, toxicity, url_filter
from .common import shipped

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_exact_top_k": top_k.op7_exact_top_k,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_toxicity": toxicity.op10_toxicity,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
ORACLE_SQL = {
    "op2_source_mixing": mixing.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op6_minhash_near_dedup": near_dedup.ORACLE,
    "op7_exact_top_k": top_k.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
