"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import op1_matroska, op2_secrets, op3_jaccard, op4_decontamination, op5_mixing, op6_katz, op7_reputation, op8_substrings, op9_language, op10_pii, op11_codes, op12_clusters, op13_runs

QUERIES = {
    "op1_matroska": op1_matroska.op1_matroska,
    "op2_secrets": op2_secrets.op2_secrets,
    "op3_jaccard": op3_jaccard.op3_jaccard,
    "op4_decontamination": op4_decontamination.op4_decontamination,
    "op5_mixing": op5_mixing.op5_mixing,
    "op6_katz": op6_katz.op6_katz,
    "op7_reputation": op7_reputation.op7_reputation,
    "op8_substrings": op8_substrings.op8_substrings,
    "op9_language": op9_language.op9_language,
    "op10_pii": op10_pii.op10_pii,
    "op11_codes": op11_codes.op11_codes,
    "op12_clusters": op12_clusters.op12_clusters,
    "op13_runs": op13_runs.op13_runs,
}

ORACLES: dict[str, str] = {
    "op3_jaccard": op3_jaccard.ORACLE,
    "op5_mixing": op5_mixing.ORACLE,
    "op7_reputation": op7_reputation.ORACLE,
    "op8_substrings": op8_substrings.ORACLE,
    "op11_codes": op11_codes.ORACLE,
    "op12_clusters": op12_clusters.ORACLE,
    "op13_runs": op13_runs.ORACLE,
}
