"""A training-data pipeline over documents: five stages, each of which works on all that the one before kept.

1. toxicity: rows that the classifier rejects go
2. exact_dedup: of equal texts one stays
3. near_dedup: of texts connected by a 5-word-shingle similarity of 0.8 or more one stays
4. mix: each row as often as its source's target asks
5. pack: the kept texts' tokens in sequences of at most 1024

Null and empty texts are documents like others; an empty table passes all stages. All stages but the last return the
columns of documents. Each stage begins by having executors give back the memory that the one before took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideframe.llm.common import relieved, staged
from tideframe.llm.exact_dedup import keep_first
from tideframe.llm.mixing import mix_documents
from tideframe.llm.ngram_join import keep_one
from tideframe.llm.packing import pack_documents
from tideframe.llm.queries import table, vocabulary
from tideframe.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieved(spark)
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieved(spark)
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieved(spark)
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieved(spark)
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieved(spark)
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2, 1024)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Learned scores, shingle sets and packing aren't SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
