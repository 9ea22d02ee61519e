"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import licenses, mixing, near, packing, perplexity, quality, repeats, topk, toxic, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_ngram_jaccard_join": near.op2_ngram_jaccard_join,
    "op3_packing": packing.op3_packing,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_url_filter": urls.op6_url_filter,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_substring_dedup": repeats.op8_substring_dedup,
    "op9_toxicity": toxic.op9_toxicity,
    "op10_perplexity_rules": perplexity.op10_perplexity_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": topk.OP1_SQL,
    "op2_ngram_jaccard_join": near.OP2_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op6_url_filter": urls.OP6_SQL,
    "op8_substring_dedup": repeats.OP8_SQL,
}
