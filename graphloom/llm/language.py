"""Language identification by fusing evidence with Bayes' rule.

log P(l | all) = text likelihood + log P(declared | l) + log P(suffix | l) + log P(l | host) + a constant.

The text's likelihood comes from hashed byte trigrams.  The other three come from grouped counts of the languages
that the texts alone suggest: P(declared | l) and P(suffix | l) with additive smoothing, P(l | host) shrunk to its
domain's share and that to the share of all, by PRIOR and DOMAIN pseudo-counts.  One class more, UNKNOWN, takes texts
of no learnt language: its trigrams are dealt evenly but for a share as all languages' together.
"""

from __future__ import annotations

import html
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, small, text_chunks, written

#: Rows of each declared language that a fit uses, about: those whose texts have the least hashes.  Of a text over
#: LONG trigrams all count, together as LONG.
SAMPLE, LONG = 1000, 4000
#: Languages that so many rows of the whole table declare are learnt, the MOST most frequent: a table of 64 KB each.
LEAST, MOST = 5, 128
#: The class of no learnt language, and its share of trigrams that are dealt as those of all together.
UNKNOWN, POOLED = "und", 0.05
BUCKETS = 1 << 14
#: Trigrams are dependent: n of them count as n / (1 + n / TEMPER).
TEMPER = 400.0
SMOOTH, PRIOR, DOMAIN = 1.0, 20.0, 50.0
CONFIDENT = 0.5
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


@dataclass
class Model:
    """languages, and log probabilities of the trigram buckets, one row a language."""

    languages: list[str]
    table: np.ndarray


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each trigram with a letter; trigrams don't cross texts."""
    ends = np.cumsum([len(t) for t in texts])
    x = LETTERS[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    if len(x) < 3:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    bucket = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) >> np.uint32(18)
    who = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    good = (who[:-2] == who[2:]) & ((a != 32) | (b != 32) | (c != 32))
    return who[:-2][good], bucket[good].astype(np.int64)


def plain(texts: pa.Array, entities: bool) -> list[bytes]:
    """The texts' bytes; with ``entities``, what HTML's character references stand for."""
    if not entities:
        return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return [(html.unescape(t) if t and "&" in t else t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def train(rows: DataFrame, sample: int = SAMPLE, entities: bool = False) -> Model:
    """A model of ``rows`` (text, declared): about ``sample`` texts of each language, and whole ones.

    Languages are counted over all rows, so that a rare one is learnt like any other.  Only trigram counts come to the
    driver, at most MOST times BUCKETS.
    """
    known = rows.where("declared IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("declared").count().where(F.col("count") >= LEAST).orderBy(F.desc("count"), "declared").limit(MOST).collect()
    if not sizes:
        return Model([UNKNOWN], np.zeros((1, BUCKETS), dtype=np.float32))
    spark = rows.sparkSession
    shares = spark.createDataFrame([(r["declared"], min(1 << 30, (sample << 30) // r["count"])) for r in sizes], "declared string, share long")
    h = F.xxhash64("text", "declared")
    some = known.join(F.broadcast(shares), "declared").withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < F.col("share")).dropDuplicates(["declared", "h"])

    def count(batches):
        for batch in batches:
            for start, end in text_chunks(batch, 0):
                part = batch.slice(start, end - start)
                names = np.array(part.column(1).to_pylist(), dtype=object)
                who, bucket = trigrams(plain(part.column(0), entities))
                weight = np.minimum(1.0, LONG / np.maximum(1, np.bincount(who, minlength=len(names))))
                for name in sorted(set(names)):
                    counts = np.bincount(bucket[names[who] == name], weights=weight[who[names[who] == name]], minlength=BUCKETS)
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(np.round(counts[at] * 1024), pa.float64())], ["declared", "bucket", "n"])

    counted = some.select("text", "declared").mapInArrow(count, "declared string, bucket int, n double").groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = [r["declared"] for r in sizes]
    counts = np.zeros((len(languages), BUCKETS))
    counts[counted["declared"].map(languages.index).to_numpy(dtype=np.int64), counted["bucket"].to_numpy()] = counted["n"].to_numpy() / 1024
    counts += np.maximum(1, (counts > 0).sum(1, keepdims=True)) / BUCKETS  # as much for what was not seen as there were different trigrams
    shares_ = counts / counts.sum(1, keepdims=True)
    table = np.log(np.concatenate([shares_, [POOLED * shares_.mean(0) + (1 - POOLED) / BUCKETS]]))
    return Model([*languages, UNKNOWN], table.astype(np.float32))


def likelihoods(rows: DataFrame, model: Model, rest: list[str], entities: bool = False) -> DataFrame:
    """Columns ``rest``, n (trigrams) and ll (each language's tempered log likelihood) of column text."""

    def run(batches):
        for batch in batches:
            for start, end in text_chunks(batch, 0):
                part = batch.slice(start, end - start)
                texts = plain(part.column(0), entities)
                who, bucket = trigrams(texts)
                n = np.bincount(who, minlength=len(texts))
                weight = 1.0 / np.maximum(n, 1) * (n / (1 + n / TEMPER))
                ll = np.stack([np.bincount(who, weights=row[bucket], minlength=len(texts)) for row in sent.value], axis=1) * weight[:, None]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n, pa.int64()), pa.array(list(ll), pa.list_(pa.float64()))], [*rest, "n", "ll"])

    sent = rows.sparkSession.sparkContext.broadcast(model.table)
    few = rows.select(F.col("text").cast("string").alias("text"), *rest)
    return few.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema.fields[1:]) + ", n long, ll array<double>")


def declared(value: Column) -> Column:
    """The primary tag of a declared language, in small letters; null where there is none."""
    tag = F.lower(F.regexp_extract(F.trim(value), r"^([A-Za-z]{2,8})(?:[-_].*)?$", 1))
    return F.when(tag != "", tag)


def identify(rows: DataFrame, model: Model | None = None, confident: float = CONFIDENT, id_col: str = "id", entities: bool = False) -> DataFrame:
    """Rows (id, language, confidence, n_trigrams, kept), one for each of ``rows`` (id, text, declared, suffix, host; the last three may be null).

    kept: the text has a trigram with a letter, its language is a learnt one, not UNKNOWN, and that has a probability of
    ``confident`` at least.  ``entities``: the texts come from HTML, with character references.  A null or empty text has no trigrams: its language is that of its other evidence, and it is not kept.  A null declaration or suffix
    is no evidence, a null host has the prior of all.  Null ids and repeated rows are kept, further columns not read; an
    empty table gives no rows.  A host with a third of all rows is counted before the shuffle and split in the join.
    """
    rows = rows.select(F.col(id_col).alias("id"), "text", "declared", "suffix", "host")
    model = model or train(rows, entities=entities)
    languages = model.languages
    few = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    seen = written(likelihoods(few, model, ["id", "declared", "suffix", "host", "domain"], entities), "likelihoods")
    sure = seen.where("n > 0").withColumn("best", F.array_position("ll", F.array_max("ll")))
    sums = [F.sum((F.col("best") == i + 1).cast("long")).cast("double").alias(f"c{i}") for i in range(len(languages))]
    hosts = written(sure.groupBy("host", "domain").agg(*sums), "hosts")
    of_all = hosts.agg(*(F.sum(f"c{i}") for i in range(len(languages)))).first()
    total = [float(x or 0) for x in of_all]
    share = [(x + SMOOTH) / (sum(total) + SMOOTH * len(total)) for x in total]

    def given(name: str) -> DataFrame:
        """log P(value | l) of each value of a column."""
        counts = written(sure.where(F.col(name).isNotNull()).groupBy(name).agg(*sums), name)
        kinds = counts.count()
        return small(counts.select(F.col(name).alias(f"_{name}"), F.array(*(F.log((F.col(f"c{i}") + SMOOTH) / (total[i] + SMOOTH * (kinds + 1))) for i in range(len(total)))).alias(f"p_{name}")))

    wide = hosts.groupBy("domain").agg(*(F.sum(f"c{i}").alias(f"d{i}") for i in range(len(total)))).withColumnRenamed("domain", "_d")
    both = hosts.where("host IS NOT NULL").join(wide, F.col("domain").eqNullSafe(F.col("_d")), "left")
    n_host, n_domain = (sum((F.col(f"{k}{i}") for i in range(len(total))), F.lit(0.0)) for k in "cd")
    shares = [(F.col(f"d{i}") + DOMAIN * s) / (n_domain + DOMAIN) for i, s in enumerate(share)]
    priors = both.select(F.col("host").alias("_host"), F.array(*(F.log((F.col(f"c{i}") + PRIOR * s) / (n_host + PRIOR)) for i, s in enumerate(shares))).alias("p_host"))
    priors = small(written(priors, "priors"))
    out = seen
    for name, table in (("declared", given("declared")), ("suffix", given("suffix")), ("host", priors)):
        out = out.join(table, out[name] == table[f"_{name}"], "left").drop(f"_{name}")
    zero = F.array(*(F.lit(0.0) for _ in languages))
    prior = F.array(*(F.lit(float(np.log(s))) for s in share))
    for i in range(len(languages)):
        terms = [F.col("ll")[i], F.coalesce("p_declared", zero)[i], F.coalesce("p_suffix", zero)[i], F.coalesce("p_host", prior)[i]]
        out = out.withColumn(f"s{i}", sum(terms[1:], terms[0]))
    scores = F.array(*(F.col(f"s{i}") for i in range(len(languages))))
    out = out.select("id", "n", scores.alias("s")).withColumn("top", F.array_max("s"))
    names = F.array(*(F.lit(x) for x in languages))
    odds = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    out = out.select("id", F.element_at(names, F.array_position("s", F.col("top")).cast("int")).alias("language"), (1 / odds).alias("confidence"), F.col("n").alias("n_trigrams"))
    release(hosts)
    return out.withColumn("kept", (F.col("n_trigrams") > 0) & (F.col("language") != UNKNOWN) & (F.col("confidence") >= confident))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Evidence of a document table: its language column is the declaration, its source the host."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), declared(F.col(lang_col).cast("string")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col(source_col).cast("string").alias("host"))


def pages(raw: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Evidence of raw web pages: visible text (with its character references), the markup's lang attribute, the address's last label and its host."""
    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    tag = F.regexp_extract(F.col(html_col), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z0-9_-]+)""", 1)
    text = F.regexp_replace(F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    rows = raw.select(F.col(id_col).alias("id"), text.alias("text"), declared(tag).alias("declared"), F.when(host != "", host).alias("host"))
    return rows.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
