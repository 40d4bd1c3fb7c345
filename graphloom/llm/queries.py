"""The queries of this folder: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import compression, language, packing, pieces, quality_rules, quotes, simhash, suffixes, topk, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(language.documents(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "language", "confidence", "n_trigrams", "kept")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over raw pages, where all four kinds of evidence occur."""
    found = language.identify(language.pages(table(spark, sf_dir, "pages")), entities=True)
    return found.select(F.col("id").alias("page_id"), "language", "confidence", "n_trigrams", "kept")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), finish="digest")
    return found.withColumnRenamed("id", "doc_id")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(table(spark, sf_dir, "documents"), passage=suffixes.PASSAGE, with_kept=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = urls.judge(pages, spark.createDataFrame(urls.RULES, "host string, path string, verdict string"), urls.listed_pages(pages, table(spark, sf_dir, "labels")))
    return found.withColumnRenamed("id", "page_id")


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(quotes.quoting(table(spark, sf_dir, "conversations")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression.train(docs, labels.where(~compression.held_out("doc_id")))
    out = compression.held_out("doc_id")
    return compression.score(docs, model).select(F.col("id").alias("doc_id"), "score").select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= compression.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "page_language": page_language,
    "op2_pieces": op2_pieces,
    "op3_suffixes": op3_suffixes,
    "op4_packing": op4_packing,
    "op5_urls": op5_urls,
    "op6_quotes": op6_quotes,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_topk": op9_topk,
    "op10_compression": op10_compression,
}

ORACLE_SQL: dict[str, str] = {
    "op5_urls": urls.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op9_topk": """
WITH whole AS (
    SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.own <> c.own
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
