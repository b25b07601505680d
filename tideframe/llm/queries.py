"""The registered queries of the training-data operators: thin layers over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import work_path
    from .token_store import read_digests, write_store

    store = write_store(table(spark, sf_dir, "documents"), work_path(spark, "token-store"), vocabulary("word_bpe_49k.json"), 1)
    return read_digests(spark, store)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def op3_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, 1024).drop("copy")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan_mix

    return plan_mix(table(spark, sf_dir, "documents")).drop("times")


def op9_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_rules, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_secret_formats": op3_secret_formats,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_ngram_join": op5_ngram_join,
        "op6_warc": op6_warc,
        "op7_toxicity": op7_toxicity,
        "op8_source_mix": op8_source_mix,
        "op9_suffix_family": op9_suffix_family,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL}
