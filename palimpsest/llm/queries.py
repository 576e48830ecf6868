"""The corpus operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import class_lm, decontamination, line_dedup, minhash_dedup, neighbours, packing, quality, substring_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_neighbours": neighbours.op5_neighbours,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
        "op8_class_lm": class_lm.op8_class_lm,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE,
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op4_decontamination": decontamination.ORACLE,
        "op7_minhash_dedup": minhash_dedup.ORACLE,
    }
