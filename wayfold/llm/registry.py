"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import exact_dedup, html_extract, mixing, neighbours, quality, secrets_scan, sentencepieces, simhash, substring_dedup, suffix_dedup


def queries() -> dict:
    return {
        "op1_quality": quality.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_sentencepiece": sentencepieces.query,
        "op6_secret_scan": secrets_scan.query,
        "op7_neighbours": neighbours.query,
        "op8_simhash": simhash.query,
        "op9_source_mixing": mixing.query,
        "op10_html_extract": html_extract.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op3_suffix_dedup": suffix_dedup.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op9_source_mixing": mixing.oracle(),
    }
