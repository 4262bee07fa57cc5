"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import (chat, decontaminate, fim, langid, licenses, lm, pieces, quality, secret_scan, simhash, url_rules,
               whitening)

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_language_id": langid.op2_language_id,
    "op3_token_counts": pieces.op3_token_counts,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_lm_scoring": lm.op5_lm_scoring,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_secret_scans": secret_scan.op10_secret_scans,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_url_filters": url_rules.op13_url_filters,
}

SQL = {
    "op4_quality_rules": quality.OP4_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_url_filters": url_rules.OP13_SQL,
}
