"""The corpus pipeline: documents to packed sequences in five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from letterbox.llm._common import cut, table
from letterbox.llm.exact_dedup import exact_dedup
from letterbox.llm.mixing import apply_mix
from letterbox.llm.packing import best_fit_pack
from letterbox.llm.quality import quality_filter
from letterbox.llm.queries import vocabulary
from letterbox.llm.shingle_dedup import shingle_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest doc_id."""
    return exact_dedup(docs, keep="max").filter("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles stays, that with the smallest doc_id."""
    return shingle_dedup(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4096 tokens."""
    return best_fit_pack(docs, vocabulary(), room=4096, end_id=1)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("packing", packing)]

#: linked shingle sets and best-fit places are out of SQL's reach; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
