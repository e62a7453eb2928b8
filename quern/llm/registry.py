"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import language_id, licenses, media, mixing, near_dedup, piece_dropout, quality_rules, rule_ensemble, token_files, urls

QUERIES = {
    "op1_licenses": licenses.query,
    "op2_media": media.query,
    "op3_urls": urls.query,
    "op4_near_dedup": near_dedup.query,
    "op5_quality_rules": quality_rules.query,
    "op6_token_files": token_files.query,
    "op7_mixing": mixing.query,
    "op8_language_id": language_id.query,
    "op9_rule_ensemble": rule_ensemble.query,
    "op10_piece_dropout": piece_dropout.query,
}


def oracles() -> dict[str, str]:
    return {"op1_licenses": licenses.oracle(), "op3_urls": urls.oracle(), "op5_quality_rules": quality_rules.oracle(), "op7_mixing": mixing.oracle()}
