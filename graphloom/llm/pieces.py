"""SentencePiece encoding and decoding; giant texts by a parallel max-plus scan.

A sequence of pieces is a text's byte-pair encoding just if each two neighbours encode to themselves.  So the
encoding is the one best path through the lattice of pieces whose steps weigh 0 where neighbours fit and minus infinity
where they don't.  A giant text is cut anywhere in chunks.  A chunk doesn't know the piece that ends last before it, so
it gives, for every such entry state, which exit states it can reach with weight 0: a transfer matrix over max
and plus, kept as one bit set of entries for each exit.  Matrices combine associatively; the states at all cuts follow
from the products, and then each chunk is traced back on its own.

Shorter texts are encoded in units of blanks and what follows them: no piece of these vocabularies has a blank
after another sign, so none spans two units.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, text_chunks, written

BLANK = "▁"
#: Texts of more characters are giant; characters of a chunk.
GIANT, CHUNK = 32_768, 8192
#: Units and pairs of pieces that a worker keeps.
CACHE, PAIRS, LONGEST = 1_000_000, 400_000, 64
#: Matrices that one task combines.
FAN = 64
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: No piece spans the place behind the first of these signs.
SYNC = re.compile(f"[^{BLANK}](?={BLANK})")


class Codec:
    """A byte-pair model file with byte fallback whose normaliser changes nothing but blanks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.scores = {names[i]: self.model.get_score(i) for i in plain}
        self.ids = {names[i]: i for i in plain}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("a piece has a blank inside")
        self.bytes = {self.model.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        self.of_byte = {b: i for i, b in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.units: dict[str, bytes] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}

    def unit(self, unit: str) -> bytes:
        """Ids of one unit, as little-endian 32-bit integers; the library puts the first blank itself."""
        body = unit[1:] if unit[0] == BLANK else None
        if body == "":
            found = [self.ids[BLANK]]
        elif body is None:
            found = self.model.encode(unit)[1:] if self.model.encode(unit)[:1] == [self.ids.get(BLANK)] else self.walk(unit)
        else:
            found = self.model.encode(body.replace(BLANK, " "))
        return np.array(found, dtype="<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.array([], dtype="<i4")
        units = UNIT.findall(marked(text))
        found = list(map(self.units.get, units))
        if None in found:
            lack = [i for i, x in enumerate(found) if x is None]
            fresh = {u: self.unit(u) for u in {units[i] for i in lack}}
            if len(self.units) + len(fresh) > CACHE:
                self.units.clear()
            self.units.update(itertools.islice(((u, x) for u, x in fresh.items() if len(u) <= LONGEST), CACHE))
            for i in lack:
                found[i] = fresh[units[i]]
        return np.frombuffer(b"".join(found), dtype="<i4")

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short string: always the best neighbours, of equal ones the first."""
        parts = list(text)
        while True:
            best = max(((self.scores[x], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str | None, b: str) -> bool:
        key = (a, b)
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged((a or "") + b) == [x for x in key if x is not None]
        return found

    def ending(self, text: str, end: int, low: int = 0) -> Iterator[str]:
        """Pieces and single characters that end at a place of a text and don't begin before ``low``."""
        yield text[end - 1 : end]
        for n in range(2, min(self.longest, end - low) + 1):
            if (piece := text[end - n : end]) in self.ids:
                yield piece

    def entries(self, text: str, begin: int) -> list[tuple[int, str | None]]:
        """States at a cut: (place, piece that ends there) for the last end at or before ``begin``."""
        if begin == 0:
            return [(0, None)]
        return [(p, x) for p in range(max(1, begin - self.longest + 1), begin + 1) for x in self.ending(text, p) if self.fits(None, x)]

    def lattice(self, text: str, begin: int, end: int, entries: list[tuple[int, str | None]]) -> dict[int, dict[str | None, int]]:
        """Of each place in (begin, end] the pieces that may end there, each with the bit set of entries that lead to it."""
        nodes: dict[int, dict[str | None, int]] = {}
        for i, (p, x) in enumerate(entries):
            nodes.setdefault(p, {})[x] = nodes.get(p, {}).get(x, 0) | 1 << i
        low = min(nodes)
        for p in range(begin + 1, end + 1):
            here: dict[str | None, int] = {}
            for x in self.ending(text, p, low):
                mask = 0
                for y, bits in nodes.get(p - len(x), {}).items():
                    if self.fits(y, x):
                        mask |= bits
                if mask:
                    here[x] = mask
            if here:
                nodes[p] = here
        return nodes

    def syncs(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and last place in [begin, end] that no piece spans: the text's start, and a blank after another sign."""
        first = 0 if begin == 0 else next((m.start() + 1 for m in SYNC.finditer(text, begin - 1, min(len(text), end + 1))), None)
        if first is None or first > end:
            return None
        last = end
        while last > first and not (last < len(text) and text[last] == BLANK != text[last - 1]):
            last -= 1
        return first, last

    def before(self, text: str, last: int) -> tuple[int, str | None]:
        """The state at a place that no piece spans: the piece that ends there."""
        if last == 0:
            return (0, None)
        start = last - 1
        while start > 0 and not (text[start] == BLANK != text[start - 1]):
            start -= 1
        (piece,) = self.lattice(text, start, last, [(start, None)])[last]
        return (last, piece)

    def transfer(self, text: str, begin: int, end: int, last: bool) -> dict[tuple[int, str | None], tuple]:
        """Exit state -> entry states with weight 0.

        No way leads past a place that no piece spans but through it, so there the matrix is a product of a column (from
        the entries to the first such place) and a row (from the last one to the exits): the lattice is built for those
        ends alone.  Without such a place it is built for the whole chunk.
        """
        entries = self.entries(text, begin)
        places = self.syncs(text, begin, end)
        if places is None:
            nodes = self.lattice(text, begin, end, entries)
            begun, same = begin, None
        else:
            head = self.lattice(text, begin, places[0], entries)
            mask = 0
            for bits in head.get(places[0], {}).values():
                mask |= bits
            same = tuple(entries[i] for i in range(mask.bit_length()) if mask >> i & 1)
            begun = places[1]
            nodes = self.lattice(text, begun, end, [(begun, None)])
        out = {}
        for p in range(end if last else max(begun, end - self.longest + 1), end + 1):
            if p == begun and places is not None:
                if p > places[0] or p == 0:
                    out[self.before(text, p)] = same
                else:
                    out |= {(p, x): tuple(entries[i] for i in range(bits.bit_length()) if bits >> i & 1) for x, bits in head[p].items()}
                continue
            for x, bits in nodes.get(p, {}).items() if p > begun else ():
                out[p, x] = same if same is not None else tuple(entries[i] for i in range(bits.bit_length()) if bits >> i & 1)
        return out

    def along(self, text: str, begin: int, end: int, entry: tuple[int, str | None], leave: tuple[int, str | None]) -> list[str]:
        """The pieces between two states by the lattice."""
        nodes = self.lattice(text, begin, end, [entry])
        out: list[str] = []
        p, x = leave
        while (p, x) != entry:
            out.append(x)
            p -= len(x)
            x = next(y for y in nodes[p] if self.fits(y, x))
        return out[::-1]

    def trace(self, text: str, begin: int, end: int, entry: tuple[int, str | None], leave: tuple[int, str | None]) -> list[int]:
        """The chunk's ids between two states: units where no piece spans their ends, the lattice at the chunk's ends."""
        places = self.syncs(text, begin, end)
        if places is None or leave[0] < places[1]:
            return self.numbers(self.along(text, begin, end, entry, leave))
        first, last = places
        out: list[int] = []
        if entry[0] < first:
            (piece,) = self.lattice(text, begin, first, [entry])[first]
            out += self.numbers(self.along(text, begin, first, entry, (first, piece)))
        for unit in UNIT.findall(text, first, last):
            if (found := self.units.get(unit)) is None:
                found = self.units[unit] = self.unit(unit)
                if len(self.units) > CACHE:
                    self.units.clear()
            out += np.frombuffer(found, dtype="<i4").tolist()
        if leave[0] > last:
            out += self.numbers(self.along(text, last, end, (last, None), leave))
        return out

    def numbers(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character that is none becomes its bytes."""
        out: list[int] = []
        for x in pieces:
            if (i := self.ids.get(x)) is not None:
                out.append(i)
            else:
                out += [self.of_byte[b] for b in x.encode("utf-8", "surrogatepass")]
        return out

    def walk(self, text: str) -> list[int]:
        """A text without the leading blank, by the lattice."""
        last = next(iter(self.lattice(text, 0, len(text), [(0, None)])[len(text)]))
        return self.numbers(self.along(text, 0, len(text), (0, None), (len(text), last)))


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def marked(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


Relation = dict[tuple, tuple]


def compose(a: Relation, b: Relation) -> Relation:
    """The max-plus product: exit of b -> entries of a, over a state where both have weight 0."""
    out = {}
    for leave, entries in b.items():
        if found := {x for e in entries if e in a for x in a[e]}:
            out[leave] = tuple(found)
    return out


def product(relations: list[Relation]) -> Relation:
    """All of them, combined as a tree."""
    while len(relations) > 1:
        pairs = [compose(a, b) for a, b in zip(relations[::2], relations[1::2], strict=False)]
        relations = pairs + relations[len(pairs) * 2 :]
    return relations[0]


def states(relations: list[Relation], enter: tuple | None = None, leave: tuple | None = None) -> list[tuple]:
    """The state at each cut, the start and the end included: from products of the chunks before, then back from the end.

    ``enter`` and ``leave`` are the states at both ends where they are known; at a text's end there is one exit.
    """
    before = list(itertools.accumulate(relations, compose))
    at = leave if leave is not None else next(iter(before[-1]))
    out = [at]
    for k in range(len(relations) - 1, -1, -1):
        if k:
            at = next(e for e in relations[k][at] if e in before[k - 1] and (enter is None or enter in before[k - 1][e]))
        else:
            at = enter if enter is not None else relations[0][at][0]
        out.append(at)
    return out[::-1]


STATE = "struct<p: long, x: string>"


def giants(texts: DataFrame, path: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(uid, ids) of rows (uid, text) with long texts.

    Chunks are cut in one pass over a text.  Their matrices are combined ``fan`` at a time, level by level, until a text
    has no more than that; then the states at the cuts go down the levels again.  No task has more than ``fan`` matrices.
    """
    tool = codec(path)
    halo = 2 * tool.longest

    def cut(batches):
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = marked(text)
                for k in range(-(-len(s) // chunk)):
                    first = max(0, k * chunk - halo)
                    row = ([uid], [k], [len(s)], [first], [s[first : (k + 1) * chunk]])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["uid", "k", "n", "first", "part"])

    parts = written(texts.select("uid", "text").mapInArrow(cut, "uid long, k long, n long, first long, part string").repartition("uid", "k"), "chunks")

    def bounds(row: dict) -> tuple[str, int, int]:
        return row["part"], row["k"] * chunk - row["first"], min(row["n"], (row["k"] + 1) * chunk) - row["first"]

    def forward(batches):
        tool = codec(path)
        for batch in batches:
            for row in batch.to_pylist():
                text, begin, end = bounds(row)
                last = row["n"] <= (row["k"] + 1) * chunk
                found = [({"p": p + row["first"], "x": x}, [{"p": q + row["first"], "x": y} for q, y in es]) for (p, x), es in tool.transfer(text, begin, end, last).items()]
                one = pa.struct([("p", pa.int64()), ("x", pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array([row["uid"]]), pa.array([row["k"]]), pa.array([[f[0] for f in found]], pa.list_(one)), pa.array([[f[1] for f in found]], pa.list_(pa.list_(one)))], ["uid", "k", "leave", "enter"])

    one = pa.struct([("p", pa.int64()), ("x", pa.string())])
    matrix = f"uid long, k long, leave array<{STATE}>, enter array<array<{STATE}>>"

    def relation(row: dict) -> Relation:
        return {(x["p"], x["x"]): tuple((e["p"], e["x"]) for e in es) for x, es in zip(row["leave"], row["enter"], strict=True)}

    def combine(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        found = product([relation(r) for r in rows])
        leave = [{"p": p, "x": x} for p, x in found]
        enter = [[{"p": p, "x": x} for p, x in es] for es in found.values()]
        return pa.table([pa.array([rows[0]["uid"]], pa.int64()), pa.array([rows[0]["k"] // fan], pa.int64()), pa.array([leave], pa.list_(one)), pa.array([enter], pa.list_(pa.list_(one)))], names=["uid", "k", "leave", "enter"])

    def scan(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        ends = [(rows[0][c]["p"], rows[0][c]["x"]) if rows[0].get(c) else None for c in "ab"]
        at = [{"p": p, "x": x} for p, x in states([relation(r) for r in rows], *ends)]
        return pa.table([pa.array([r[c] for r in rows], pa.int64()) for c in ("uid", "k")] + [pa.array(at[:-1], one), pa.array(at[1:], one)], names=["uid", "k", "a", "b"])

    levels = [written(parts.mapInArrow(forward, matrix), "matrices")]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) >= fan:
        level = levels[-1].withColumn("block", F.expr(f"k div {fan}")).groupBy("uid", "block").applyInArrow(combine, matrix)
        levels.append(written(level, "matrices"))
    out = f"uid long, k long, a {STATE}, b {STATE}"
    known = levels[-1].groupBy("uid").applyInArrow(scan, out)  # at most `fan` of a text
    for level in levels[-2::-1]:
        ends = known.withColumnRenamed("k", "block")
        known = level.withColumn("block", F.expr(f"k div {fan}")).join(ends, ["uid", "block"]).groupBy("uid", "block").applyInArrow(scan, out)
    known = written(known, "states")
    release(*levels)

    def back(batches):
        tool = codec(path)
        for batch in batches:
            for row in batch.to_pylist():
                text, begin, end = bounds(row)
                a, b = ((row[c]["p"] - row["first"], row[c]["x"]) for c in "ab")
                ids = tool.trace(text, begin, end, a, b)
                yield pa.RecordBatch.from_arrays([pa.array([row["uid"]]), pa.array([row["k"]]), pa.array([ids], pa.list_(pa.int32()))], ["uid", "k", "ids"])

    traced = parts.join(known, ["uid", "k"]).mapInArrow(back, "uid long, k long, ids array<int>")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]))
    return traced.groupBy("uid").agg(ids.alias("ids"))


def finished(rows: DataFrame, path: str, finish: str) -> DataFrame:
    """Rows (id, text, ids or null for those to encode here) to (id, ids) or to (id, n_pieces, ids_crc32, round_trip)."""

    def run(batches):
        tool = codec(path)
        for batch in batches:
            for start, end in text_chunks(batch, 1):
                part = batch.slice(start, end - start)
                texts = [t or "" for t in part.column(1).to_pylist()]
                given = part.column(2)
                ids = [np.asarray(given[i].values, dtype="<i4") if given[i].is_valid else tool.encode(t) for i, t in enumerate(texts)]
                if finish == "ids":
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])
                else:
                    same = [tool.decode(x.tolist()) == t.replace(BLANK, " ") for x, t in zip(ids, texts, strict=True)]
                    sums = [zlib.crc32(x.tobytes()) for x in ids]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(sums, pa.int64()), pa.array(same)], ["id", "n_pieces", "ids_crc32", "round_trip"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ("ids array<int>" if finish == "ids" else "n_pieces long, ids_crc32 long, round_trip boolean"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK, finish: str = "ids") -> DataFrame:
    """Rows (id, ids), one for each of ``docs``; with ``finish`` "digest" (id, n_pieces, ids_crc32, round_trip).

    ids_crc32 is of the ids as little-endian 32-bit integers, round_trip whether they decode to the text (whose
    blank marks, if any, are blanks).  A null or empty text has no ids; null ids and repeated rows are kept; an empty
    table gives no rows; other columns are not read.
    """
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    short = few.where(F.coalesce(F.char_length("text"), F.lit(0)) <= giant).withColumn("ids", F.lit(None).cast("array<int>"))
    long = written(few.where(F.char_length("text") > giant).select(F.monotonically_increasing_id().alias("uid"), "id", "text"), "giants")
    if not long.limit(1).count():
        release(long)
        return finished(short, path, finish)
    both = long.join(giants(long.select("uid", "text"), path, chunk), "uid").select("id", "text", "ids")
    return finished(short, path, finish).unionByName(finished(both, path, finish))


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) of rows with ids; null ids give a null text."""

    def run(batches):
        tool = codec(path)
        for batch in batches:
            texts = [None if x is None else tool.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    few = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, text string")
