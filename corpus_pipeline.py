"""A training corpus in five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import compression, language, packing, simhash, suffixes
from graphloom.llm.common import shared_dir, small, written
from graphloom.llm.queries import vocabulary


def without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs`` without the ids all of whose rows ``verdicts`` (id, kept) rejects; rows with one id, null too, stay or go together."""
    gone = verdicts.groupBy(F.col("id").alias("_gone")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("kept")).where("NOT kept")
    gone = small(written(gone.select("_gone"), "gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, language.identify(language.documents(docs)).select("id", "kept"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression.train(docs, labels.where(~compression.held_out("doc_id")))
    return without(docs, compression.score(docs, model).select("id", (F.col("score") >= compression.THRESHOLD).alias("kept")))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, similarity=0.8)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more go from the texts; n_chars follows.  Bytes of a sign of which a part went go as well."""
    return suffixes.without_repeats(docs, words=suffixes.WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_dedup", no_near_copies),
    ("suffix_dedup", no_repeated_passages),
    ("packing", packed),
]

#: The classifier, the fingerprints and the vocabulary have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
