"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``; the last returns one row per piece of a packed sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternway.llm import exact_dedup, language_id, packing, pii, simhash
from lanternway.llm.common import free_name, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; a missing ``lang`` takes the predicted one."""
    into = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = language_id.labelled(docs, language_id.learn(docs), into=into).where(F.col(f"`{into[0]}`") != language_id.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", F.col(f"`{into[0]}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.ExactDedup(docs).kept()


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the smallest id stays."""
    return simhash.one_of_each(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is masked; ``n_chars`` follows the text."""
    return pii.mask_pii(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed by best-fit decreasing.

    Pieces (without ids) are written first, so that no task runs two Python workers: those of the tokeniser stay with an
    executor, and twice as many of them would take their memory in all later stages.
    """
    pieces = packing.cut_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(written(pieces, "pipeline-pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("personal", personal),
    ("pack", pack),
]

#: Similarity, the trained models and the tokeniser are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
