"""The corpus pipeline: quality rules, near-duplicates, personal data, packing.

Every stage is written as Parquet and read again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm._shared import table, written
from tidegauge.llm.packing import pack_documents
from tidegauge.llm.pii import replace_entities, session_key
from tidegauge.llm.quality import quality_filter
from tidegauge.llm.queries import WORD_BPE
from tidegauge.llm.simhash import drop_near_duplicates


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return replace_entities(docs, session_key(spark)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_dedup", drop_copies),
    ("pii_surrogates", hide_personal_data),
    ("best_fit_packing", pack),
]

#: XXH64 fingerprints, keyed surrogates and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
