"""The registered queries of this subpackage, and SQL of the same meaning where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomdex.llm import bpe, exact_dedup, html_text, jaccard_join, language, licenses, lm_score, mixing, neighbours, paragraphs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lm_score.query,
        "op2_mix_sources": mixing.query,
        "op3_language_id": language.query,
        "op4_nearest_neighbours": neighbours.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_bpe_encoding": bpe.query,
        "op7_license_scan": licenses.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_html_extraction": html_text.query,
        "op10_paragraph_dedup": paragraphs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op7_license_scan": licenses.SQL,
    }
