"""Exact removal of long repeated byte strings by sparse suffix sorting.

A byte goes if a string of ``SPAN`` bytes that covers it starts anywhere else too.  Each window of SPAN bytes has
one anchor: the place of its least hash of GRAM bytes.  Which place that is depends on the window's bytes alone, so
equal windows have anchors at equal offsets, and the windows of one anchor start next to each other: all of them make
one context.  Per context, not per byte:

1. Contexts are aggregated by digest; one that came twice is repeated as a whole, and one whose anchor's bytes
   came in no other context is not repeated elsewhere.
2. For the different contexts that share an anchor's bytes, the suffix from the anchor and the reversed prefix before
   it go through :mod:`graphloom.llm.lcpsort`.  The longest prefix r shared by the suffix and l by the reversed prefix
   leave only the windows whose anchor lies SPAN - r to l bytes behind their start; for most contexts none.
3. Digests of the windows that are left are counted: those that came once stay.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import CHUNK_BYTES, forget_shuffles, release, text_chunks, written
from graphloom.llm.lcpsort import digest, longest_shared

SPAN, GRAM = 400, 32
#: A repeated passage has so many words; it is looked for by strings of so many bytes, which words of three letters and a blank reach.
WORDS, PASSAGE = 50, 200
#: Bits of a place in a buffer: a buffer has fewer bytes than that.
PLACE = 20
ODD = 0x100000001B3


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes from each place on."""
    h, base, size = data.astype(np.uint64) + np.uint64(1), ODD, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), 2 * size
    for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ h >> np.uint64(32)


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window from each place on, and the hash at each place.  Of equal hashes in a window the first counts."""
    hashes = gram_hashes(data)
    wide = span - GRAM + 1
    keys = hashes >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= wide:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    if wide > size:
        keys = np.minimum(keys[: size - wide], keys[wide - size :])
    return (keys & np.uint64((1 << PLACE) - 1)).astype(np.int64), hashes


def contexts(texts: list[bytes], span: int = SPAN) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(text, start, windows, offset of the anchor from start, anchor's hash, bytes) of each context of the texts, which have under 2 ** PLACE bytes together."""
    ends = np.cumsum([len(t) for t in texts])
    whole = b"".join(texts)
    if len(whole) < span:
        return
    at, hashes = anchors(np.frombuffer(whole, dtype=np.uint8), span)
    owner = np.searchsorted(ends, np.arange(len(at)), side="right")
    inside = np.arange(len(at)) + span <= ends[owner]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(at))
    good = inside[starts]
    starts, stops = starts[good], stops[good]
    who = owner[starts]
    begins = np.concatenate([[0], ends])[who]
    grams = hashes[at[starts]].view(np.int64)
    for i, a, b, begin, anchor, gram in zip(who.tolist(), starts.tolist(), stops.tolist(), begins.tolist(), at[starts].tolist(), grams.tolist(), strict=True):
        yield i, a - begin, b - a, anchor - a, gram, whole[a : b + span - 1]


def buffers(batch: pa.RecordBatch, column: int, span: int) -> Iterator[tuple[list[int], list[bytes], int]]:
    """(rows, their bytes, bytes before) of a batch in buffers of under 2 ** PLACE bytes; a longer text comes in parts that overlap by span - 1."""
    limit = min(CHUNK_BYTES, 1 << PLACE) - 1
    for start, end in text_chunks(batch, column, limit):
        texts = batch.column(column).slice(start, end - start).cast(pa.binary()).to_pylist()
        texts = [t or b"" for t in texts]
        if end - start > 1 or len(texts[0]) <= limit:
            yield list(range(start, end)), texts, 0
        else:
            step = limit - span + 1
            for at in range(0, max(1, len(texts[0]) - span + 1), step):
                yield [start], [texts[0][at : at + limit]], at


def marks(keyed: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows (k1, k2, runs): for each row of ``keyed`` (k1, k2, text) with repeated strings, pairs (from, to) of bytes that they cover."""

    def find(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for rows, texts, before in buffers(batch, 2, span):
                found = [(rows[i], start + before, n, offset, gram, *digest(s)) for i, start, n, offset, gram, s in contexts(texts, span)]
                if found:
                    who, *rest = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[who], k2[who], *rest)], ["k1", "k2", "at", "n", "off", "g", "s1", "s2"])

    places = written(keyed.mapInArrow(find, "k1 long, k2 long, at long, n long, off long, g long, s1 long, s2 long"), "places")
    kinds = places.groupBy("s1", "s2").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("k1", "k2", "at", "n", "off", "g")))
    kinds = written(kinds, "kinds")
    busy = written(kinds.groupBy("g").count().where("count > 1").select("g"), "busy")
    asked = kinds.join(busy, "g").groupBy("k1", "k2").agg(F.collect_list(F.struct("s1", "s2", "times", "at", "n", "off")).alias("all"))  # as many as the text has
    asked = written(asked, "asked")  # so that the shuffle of all kinds is gone before that of the texts
    forget_shuffles(keyed.sparkSession)
    partly = partial(keyed, asked, span)
    whole = kinds.where("times > 1").select("s1", "s2", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("n") + (span - 1)).alias("b"))).alias("runs"))
    hit = written(whole.unionByName(partly), "hit")
    found = places.join(hit, ["s1", "s2"]).select("k1", "k2", "at", F.explode("runs").alias("run"))
    runs = found.groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("at") + F.col("run.a")).alias("a"), (F.col("at") + F.col("run.b")).alias("b"))).alias("runs"))
    out = written(maximal(runs), "runs")
    release(places, kinds, busy, asked, hit, shuffles=True)
    return out


RUN_TYPE = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def maximal(rows: DataFrame) -> DataFrame:
    """(k1, k2, runs) with the maximal runs that overlapping or touching ones make."""

    def join(batches):
        for batch in batches:
            runs = batch.column(2)
            sizes = np.asarray(pc.list_value_length(runs), dtype=np.int64)
            who = np.repeat(np.arange(len(sizes)), sizes)
            values = runs.flatten()
            a, b = (np.asarray(values.field(k)) for k in (0, 1))
            order = np.lexsort((a, who))
            who, a, b = who[order], a[order], b[order]
            base = who * (int(b.max(initial=0)) + 2)  # so that the rows' runs lie apart
            reach = np.maximum.accumulate(b + base) if len(b) else b
            first = np.flatnonzero(np.concatenate([[True], (a + base)[1:] > reach[:-1]])) if len(b) else who
            last = np.append(first[1:], len(b)) - 1 if len(b) else who
            offsets = np.concatenate([[0], np.cumsum(np.bincount(who[first], minlength=len(sizes)))])
            joined = pa.StructArray.from_arrays([pa.array(a[first]), pa.array(reach[last] - base[last])], fields=list(RUN_TYPE))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), joined)], ["k1", "k2", "runs"])

    return rows.select("k1", "k2", "runs").mapInArrow(join, "k1 long, k2 long, runs array<struct<a: long, b: long>>")


def partial(keyed: DataFrame, asked: DataFrame, span: int) -> DataFrame:
    """Rows (s1, s2, runs) of the asked-for contexts that came once and have repeated windows."""

    def cut(batches):
        for batch in batches:
            out = []
            for text, every in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(x["s1"], x["s2"], x["times"], x["n"], x["off"], text[x["at"] : x["at"] + x["n"] + span - 1]) for x in every]
                if len(out) >= 4096:
                    yield boxed(out)
                    out = []
            if out:
                yield boxed(out)

    def boxed(out):
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 5, pa.binary()), strict=True)], ["s1", "s2", "times", "n", "off", "s"])

    texts = keyed.join(asked.hint("shuffle_hash"), ["k1", "k2"]).select("text", "all")
    cuts = written(texts.mapInArrow(cut, "s1 long, s2 long, times long, n long, off long, s binary").dropDuplicates(["s1", "s2"]), "contexts")

    def both(s: bytes, off: int) -> tuple[bytes, bytes]:
        return b">" + s[off : off + span], b"<" + s[:off][::-1]

    def strings(batch):
        for s, off in zip(batch.column("s").to_pylist(), batch.column("off").to_pylist(), strict=True):
            yield from both(s, off)

    forget_shuffles(keyed.sparkSession)
    shared = longest_shared(cuts, strings, 2 * cuts.count())
    forget_shuffles(keyed.sparkSession)

    def named(batches):
        for batch in batches:
            f1, f2, b1, b2 = [], [], [], []
            for s, off in zip(batch.column("s").to_pylist(), batch.column("off").to_pylist(), strict=True):
                (p, q), (r, t) = map(digest, both(s, off))
                f1.append(p), f2.append(q), b1.append(r), b2.append(t)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("s1", "s2", "times", "n", "off")), *(pa.array(x, pa.int64()) for x in (f1, f2, b1, b2))], ["s1", "s2", "times", "n", "off", "f1", "f2", "b1", "b2"])

    slim = cuts.mapInArrow(named, "s1 long, s2 long, times long, n long, off long, f1 long, f2 long, b1 long, b2 long")
    right = shared.select(F.col("d1").alias("f1"), F.col("d2").alias("f2"), (F.col("shared") - 1).alias("r"))
    left = shared.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), (F.col("shared") - 1).alias("l"))
    limits = slim.join(right, ["f1", "f2"]).drop("f1", "f2").join(left, ["b1", "b2"])
    limits = limits.select("s1", "s2", F.greatest(F.col("off") - F.col("n") + 1, span - F.col("r")).alias("lo"), F.least("off", "l").alias("hi")).where("lo <= hi")
    open_ = written(limits.join(cuts, ["s1", "s2"]).select(F.monotonically_increasing_id().alias("cid"), "s1", "s2", "times", "off", "lo", "hi", "s"), "open")

    def spell(batches):
        for batch in batches:
            w1, w2, ref, weight = [], [], [], []
            for cid, times, off, lo, hi, s in zip(*(batch.column(c).to_pylist() for c in ("cid", "times", "off", "lo", "hi", "s")), strict=True):
                for o in range(lo, hi + 1):
                    a, b = digest(s[off - o : off - o + span] + struct.pack("<I", o))
                    w1.append(a), w2.append(b)
                ref += range(cid << 10 | lo, (cid << 10 | hi) + 1)
                weight += [min(times, 2)] * (hi - lo + 1)
                if len(w1) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (w1, w2, ref, weight)], ["w1", "w2", "ref", "weight"])
                    w1, w2, ref, weight = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (w1, w2, ref, weight)], ["w1", "w2", "ref", "weight"])

    windows = open_.mapInArrow(spell, "w1 long, w2 long, ref long, weight long")
    lone = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("times"), F.min("ref").alias("ref")).where("times = 1")
    lone = lone.groupBy(F.shiftright("ref", 10).alias("cid")).agg(F.collect_list(F.col("ref").bitwiseAND(F.lit(1023))).alias("lone"))  # a context's windows at most
    runs = F.expr(f"transform(filter(sequence(lo, hi), o -> lone IS NULL OR NOT array_contains(lone, o)), o -> struct(off - o AS a, off - o + {span} AS b))")
    out = written(open_.where("times = 1").select("cid", "s1", "s2", "off", "lo", "hi").join(lone, "cid", "left").select("s1", "s2", runs.alias("runs")).where("size(runs) > 0"), "partly")
    release(cuts, shared, open_, shuffles=True)
    return out


def pairs(runs: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Each row's runs, in order."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(runs), 0), dtype=np.int64)
    values = runs.flatten()
    every = list(zip(*(np.asarray(values.field(k)).tolist() for k in (0, 1)), strict=True))
    ends = np.cumsum(sizes).tolist()
    return [sorted(every[end - n : end]) if n else [] for n, end in zip(sizes.tolist(), ends, strict=True)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, text): two hashes of id and text, by which rows that repeat each other are one."""
    columns = [F.col(id_col), F.col(text_col).cast("string")]
    return docs.select(F.xxhash64(*columns).alias("k1"), F.xxhash64(*columns[::-1], F.lit(1)).alias("k2"), columns[1].alias("text"))


def runs_of(docs: DataFrame, id_col: str, text_col: str, span: int, passage: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Tables (k1, k2, runs) of the bytes that strings of ``span`` bytes cover, and of those of ``passage`` bytes.

    Where a shorter ``passage`` is asked for too, it goes first: strings of ``span`` bytes repeat only inside its runs,
    so only those pieces are searched again.
    """
    if not GRAM < min(span, passage or span) <= max(span, passage or span) <= 1000:
        raise ValueError(f"spans are over {GRAM} and at most 1000")
    texts = keyed(docs, id_col, text_col)
    if passage is None:
        return marks(texts, span), None
    if passage > span:
        raise ValueError("a passage is at most as long as the span")
    short = marks(texts, passage)

    def cut_out(batches):
        for batch in batches:
            for start, end in text_chunks(batch, 2):
                part = batch.slice(start, end - start)
                out = [(k1, k2, a, text[a:b]) for k1, k2, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), pairs(part.column(3)), strict=True) for a, b in runs if b - a >= span]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 3, pa.binary()), strict=True)], ["k1", "k2", "at", "text"])

    long_ = short.where(f"exists(runs, r -> r.b - r.a >= {span})")
    pieces = texts.join(long_.hint("shuffle_hash"), ["k1", "k2"]).mapInArrow(cut_out, "k1 long, k2 long, at long, text binary")
    pieces = written(pieces.select(F.xxhash64("k1", "k2", "at").alias("p1"), F.xxhash64("at", "k2", "k1").alias("p2"), "k1", "k2", "at", "text"), "pieces")
    inside = marks(pieces.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "text"), span)
    moved = pieces.select("p1", "p2", "k1", "k2", "at").distinct().join(inside.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "runs"), ["p1", "p2"])
    moved = moved.select("k1", "k2", F.expr("transform(runs, r -> struct(r.a + at AS a, r.b + at AS b))").alias("runs"))
    whole = written(moved.groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs")), "whole")  # a text's own, which lie apart
    release(pieces, inside, shuffles=True)
    return whole, short


def marked(docs: DataFrame, id_col: str, text_col: str, span: int, passage: int | None = None) -> DataFrame:
    """``docs`` with column runs: pairs (from, to) of repeated bytes, or null; with ``passage`` also column passages."""
    whole, short = runs_of(docs, id_col, text_col, span, passage)
    if short is not None:
        whole = short.withColumnRenamed("runs", "passages").join(whole, ["k1", "k2"], "left")
    names = {x: f"{x}_of_the_documents" for x in docs.columns if x in ("k1", "k2", "runs", "passages")}
    own, text = names.get(id_col, id_col), F.col(names.get(text_col, text_col)).cast("string")
    named = docs.withColumnsRenamed(names).withColumns({"k1": F.xxhash64(F.col(own), text), "k2": F.xxhash64(text, F.col(own), F.lit(1))})
    return named.join(whole.hint("shuffle_hash"), ["k1", "k2"], "left").drop("k1", "k2")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes that are left without the spans, which lie apart and in order."""
    if not spans:
        return text
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)], strict=True))


def passages(text: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The spans that have ``words`` words at least."""
    return [(a, b) for a, b in spans if len(text[a:b].split()) >= words]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = PASSAGE, words: int = WORDS, chars_col: str = "n_chars") -> DataFrame:
    """``docs`` (with all its columns) without repeated passages: maximal runs of repeated strings of ``span`` bytes that have ``words`` words at least.

    Every copy goes, that in the same text too.  Parts of cut signs are dropped, and the length follows in ``chars_col``
    where there is one.  Null and empty texts stay as they are; no row goes.
    """
    both = marked(docs, id_col, text_col, span)
    runs_col = both.columns[-1]

    def keep(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, r in zip(texts, runs, strict=True):
            spans = passages(t.encode(), sorted((x["a"], x["b"]) for x in r), words) if t is not None and r is not None else []
            out.append(cut(t.encode(), spans).decode("utf-8", "ignore") if spans else t)
        return pd.Series(out, dtype=object)

    renamed = {f"{x}_of_the_documents": x for x in docs.columns if x in ("k1", "k2", "runs", "passages")}
    left = F.pandas_udf(keep, "string")
    out = both.withColumn("_left", left(F.col({v: k for k, v in renamed.items()}.get(text_col, text_col)).cast("string"), F.col(runs_col))).drop(runs_col).withColumnsRenamed(renamed).withColumn(text_col, F.col("_left")).drop("_left")
    return out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType)).select(*docs.columns) if chars_col in docs.columns else out.select(*docs.columns)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, passage: int | None = None, words: int = WORDS, with_kept: bool = True) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans), one for each row of ``docs``.

    kept: the remaining bytes; spans: the removed runs as pairs (from, to); both only ``with_kept``.  Strings never cross rows and are judged on
    the input.  With ``passage`` also n_passages: maximal runs of repeated strings of ``passage`` bytes (at most
    ``span``) that have ``words`` words at least; they are counted, not removed.  Null or empty text: nothing to remove.
    Null ids are kept; a repeated row is a copy like any other; an empty table gives no rows; other columns are not read.
    """
    both = marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text", span, passage)
    both = both.select("id", "text", "runs", *["passages"] * (passage is not None))

    def remove(batches):
        for batch in batches:
            for start, end in text_chunks(batch, 1):
                part = batch.slice(start, end - start)
                out, found = [], []
                asked = pairs(part.column(3)) if passage is not None else [[]] * part.num_rows
                for text, spans, short in zip(part.column(1).cast(pa.binary()).to_pylist(), pairs(part.column(2)), asked, strict=True):
                    left = cut(text := text or b"", spans)
                    out.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), *[left, [{"a": a, "b": b} for a, b in spans]] * with_kept))
                    found.append(len(passages(text, short, words)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary(), pa.list_(RUN_TYPE)] * with_kept)
                more = [pa.array(found, pa.int64())] * (passage is not None)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)), *more], names)

    kind = both.schema["id"].dataType.simpleString()
    columns = [("id", kind), *((c, "long") for c in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", "string")]
    columns += [("kept", "binary"), ("spans", "array<struct<a: long, b: long>>")] * with_kept + [("n_passages", "long")] * (passage is not None)
    names = [c for c, _ in columns]
    return both.mapInArrow(remove, ", ".join(f"{c} {t}" for c, t in columns))
