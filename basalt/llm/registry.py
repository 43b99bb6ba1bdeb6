"""Queries of the corpus operators and their SQL for comparison."""

from __future__ import annotations

from . import alignment, centroids, decontaminate, langid, lines, mixing, neardup, packing, quality, secrets, substrings, tokens, topk

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_quality": quality.op2_quality,
    "op3_secrets": secrets.op3_secrets,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_topk": topk.op8_topk,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_token_counts": tokens.op10_token_counts,
    "op11_alignment": alignment.op11_alignment,
    "op12_centroids": centroids.op12_centroids,
    "op13_packing": packing.op13_packing,
}

SQL = {
    "op3_secrets": secrets.OP3_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_line_dedup": lines.OP7_SQL,
    "op8_topk": topk.OP8_SQL,
    "op12_centroids": centroids.OP12_SQL,
}
