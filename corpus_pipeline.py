"""A corpus pipeline: toxic documents, near copies and repeated passages go, then mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. ``run`` writes each stage's result to the shared folder and rereads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvestra.llm import mixing, near, packing, repeats, toxic
from silvestra.llm.common import kept, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go; the lexicon learns from the labels of the corpus."""
    return toxic.without_toxic(docs, toxic.lexicon_for(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by n-gram Jaccard similarity the least doc_id stays."""
    return near.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before are cut from the texts."""
    return repeats.removed(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to the square root of their size; longer words and fewer odd signs weigh more."""
    odd = F.length(F.translate("text", "!#$%&*|", ""))
    return mixing.mixed(docs, F.greatest(F.lit(0.1), 1 - 4 * (F.length("text") - odd) / F.greatest(F.length("text"), F.lit(1))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of packed documents."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", one_of_near_copies), ("substring dedup", cut_repeats), ("source mixing", mix), ("packing", pack)]

#: Packing is a dynamic programme, which SQL can't express; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept(docs)
    return docs
