"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import centroids, decontaminate, divergence, html_text, lines, packing, personal, ppm, quality, simhash, substrings, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_warc": warc.op1,
        "op2_quality_rules": quality.op2,
        "op3_decontamination": decontaminate.op3,
        "op4_ppm": ppm.op4,
        "op5_personal": personal.op5,
        "op6_lines": lines.op6,
        "op7_html_text": html_text.op7,
        "op8_simhash": simhash.op8,
        "op9_substrings": substrings.op9,
        "op10_packing": packing.op10,
        "op11_token_counts": token_counts.op11,
        "op12_centroids": centroids.op12,
        "op13_divergence": divergence.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_centroids": centroids.SQL, "op13_divergence": divergence.SQL}
