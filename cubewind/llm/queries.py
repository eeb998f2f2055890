"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubewind.llm import centroids, chat, decontaminate, exact_dedup, html, jaccard, language, lm, pack, secrets, token_counts, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": lm.op1,
    "op2_chat_windows": chat.op2,
    "op3_html_text": html.op3,
    "op4_jaccard_join": jaccard.op4,
    "op5_secrets": secrets.op5,
    "op6_toxicity": toxicity.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_token_counts": token_counts.op8,
    "op9_pack": pack.op9,
    "op10_decontaminate": decontaminate.op10,
    "op11_centroids": centroids.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_language": language.op13,
}

ORACLE: dict[str, str] = {
    "op4_jaccard_join": jaccard.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_centroids": centroids.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
