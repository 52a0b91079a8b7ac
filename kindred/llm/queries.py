"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, fixity, html_text, jaccard, licenses, mixing, quality, token_counts, token_store

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.query,
    "op2_chat_formatting": chat.query,
    "op3_token_counts": token_counts.query,
    "op4_token_store": token_store.query,
    "op5_quality_rules": quality.query,
    "op6_benchmark_decontamination": decontaminate.query,
    "op7_license_scans": licenses.query,
    "op8_html_extraction": html_text.query,
    "op9_warc_merkle_fixity": fixity.query,
    "op10_source_mixing": mixing.query,
}

ORACLE_SQL = {
    "op9_warc_merkle_fixity": fixity.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
}
