"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from linkspark.llm import classifier, lines, mixing, neighbours, packing, rules, sharding, simhash, substrings, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        lines.op1_line_dedup, mixing.op2_mix_sources, simhash.op3_simhash_dedup, urls.op4_url_filter, classifier.op5_quality_classifier,
        substrings.op6_repeated_strings, rules.op7_quality_rules, neighbours.op8_posting_lists, sharding.op9_hilbert_shards, packing.op10_curve_packing,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": lines.ORACLE, "op2_mix_sources": mixing.ORACLE, "op4_url_filter": urls.ORACLE, "op9_hilbert_shards": sharding.ORACLE}
