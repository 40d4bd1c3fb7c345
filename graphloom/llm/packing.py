"""Order-preserving packing of documents into fixed windows.

A partition's documents form one stream of ids in their order.  Windows may end at document ends, at sentence
ends and, in a stretch without either, at stated steps.  The cost of a cut is its truncation penalty (none at a
document's end) plus the padding of the window before it:

    f[i] = penalty[i] + min over j with 0 < p[i] - p[j] <= window of f[j] + window - (p[i] - p[j])

As p[i] is the same for all j, the inner minimum is that of f[j] + p[j] over a sliding window of cuts: a
monotone queue gives it in constant time a cut.  No row is shuffled: each partition packs what it reads.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import give_back, text_chunks

WINDOW = 2048
#: Truncation penalties, in tokens of padding that a cut may save.
SENTENCE, INSIDE = 2, 6
#: Cuts inside a longer sentence are tried at this many tokens from the last possible cut.
STEP = 16
#: Tokens that are packed at once; what the last window of a block holds goes on to the next block.
BLOCK = 1 << 18
#: Words that a worker's cache holds, and bytes of text whose words are looked up together: a worker's memory goes by both.
CACHE, CHUNK = 150_000, 2 << 20
#: Signs after a word that no rule of the splitting joins to letters before them.
SIGNS = ".,!?;:*#$%&|"
#: Patterns of words that end a sentence, and of Latin letters, each of one or two bytes and with one small form.
STOPS, LATIN, LATIN_HEAD, SMALL = "[.!?]$", "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$", "^[a-zA-ZÀ-ÖØ-öø-ÿ]+", "^[a-zß-öø-ÿ]+$"
#: An id for the end of a document.
END_ID = 1
SPACE = re.compile(r"(?:(?![\x1c-\x1f])\s)+")

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Merges:
    """Byte-pair merging of many words at once, one merge a word and step: the leftmost of the pairs of least rank."""

    NONE = np.int32(1 << 30)

    def __init__(self, model: dict):
        vocabulary, suffix, signs = model["vocab"], model["end_of_word_suffix"], byte_signs()
        self.inner = np.array([vocabulary[c] for c in signs], dtype=np.int32)
        self.last = np.array([vocabulary[c + suffix] for c in signs], dtype=np.int32)
        both = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[x] << 32 | vocabulary[y] for x, y in both], dtype=np.int64)
        made = np.array([vocabulary[x + y] for x, y in both], dtype=np.int32)
        self.mask, self.made = (1 << 19) - 1, made
        self.keys, self.ranks = np.full(self.mask + 1, -1, dtype=np.int64), np.full(self.mask + 1, self.NONE, dtype=np.int32)
        rest = np.arange(len(keys))
        at = self.slots(keys)
        while len(rest):  # each slot is taken by one of those that want it, the others try the next
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            win = np.flatnonzero(free)[first]
            self.keys[at[win]], self.ranks[at[win]] = keys[rest[win]], rest[win]
            left = np.ones(len(rest), dtype=bool)
            left[win] = False
            rest, at = rest[left], at[left] + 1 & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x.astype(np.int64) << 32 | y
        at = self.slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], self.NONE)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at_ = at[rest] = at[rest] + 1 & self.mask
            found, wanted = self.keys[at_], keys[rest]
            hit = found == wanted
            out[rest[hit]] = self.ranks[at_[hit]]
            rest = rest[~hit & (found >= 0)]
        return out

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after the other, and how many each has.  Words of a width are merged together."""
        words = pa.concat_arrays([words])
        bounds = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        begin, sizes, data = bounds[:-1], np.diff(bounds), np.frombuffer(words.buffers()[2], dtype=np.uint8)
        rows: list[np.ndarray] = []
        kept = np.zeros(len(words), dtype=np.int64)
        for width in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == width)
            for part in range(0, len(own), 1 << 16):
                some = own[part : part + (1 << 16)]
                signs = data[begin[some][:, None] + np.arange(width)]
                out = self.inner[signs]
                out[:, -1] = self.last[signs[:, -1]]
                kept[some] = self.merge(out)
                rows.append((some, out))
        total = np.cumsum(kept) - kept
        flat = np.empty(int(kept.sum()), dtype="<u4")
        for some, out in rows:
            n = kept[some]
            inside = np.arange(out.shape[1]) < n[:, None]
            flat[(total[some][:, None] + np.arange(out.shape[1]))[inside]] = out[inside]
        return flat, kept

    def merge(self, x: np.ndarray) -> np.ndarray:
        """Merges each row of ``x`` in place; how many ids are left at its beginning."""
        count, width = x.shape
        left = np.full(count, width, dtype=np.int64)
        if width == 1:
            return left
        who, now = np.arange(count), x.copy()
        ranks = np.full((count, width), self.NONE, dtype=np.int32)
        ranks[:, :-1] = self.rank(now[:, :-1].ravel(), now[:, 1:].ravel()).reshape(count, width - 1)
        while len(who):
            at = ranks.argmin(1)
            row = np.arange(len(who))
            best = ranks[row, at]
            live = best < self.NONE
            if not live.all():
                x[who[~live]] = now[~live][:, : x.shape[1]] if now.shape[1] == x.shape[1] else np.pad(now[~live], ((0, 0), (0, x.shape[1] - now.shape[1])))
                who, now, ranks, at, best = who[live], now[live], ranks[live], at[live], best[live]
                if not len(who):
                    break
                row = np.arange(len(who))
            now[row, at] = self.made[best]
            shift = np.arange(now.shape[1] - 1)
            take = shift + (shift > at[:, None])
            now, ranks = np.take_along_axis(now, take, 1), np.take_along_axis(ranks, np.where(shift == at[:, None], shift + 1, take), 1)
            left[who] -= 1
            n = left[who]
            # the pairs on both sides of what was merged have new ranks
            right = np.flatnonzero(at + 1 < n)
            ranks[row, at] = self.NONE
            ranks[right, at[right]] = self.rank(now[right, at[right]], now[right, at[right] + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.rank(now[before, at[before] - 1], now[before, at[before]])
            if now.shape[1] == 1:
                x[who, 0] = now[:, 0]
                break
        return left


class Words:
    """Ids of words, kept in one array: a word is a place in ``begin``, ``size`` and ``stop`` (it ends a sentence).

    The vocabulary's splitting never joins what white space parts, so a text's ids are its words' ids.  A word of
    letters and trailing signs is looked up in parts: the splitting parts them there, and case goes.  Latin letters are
    merged here, many words at once; whatever else there is goes through the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode = whole.encode_batch_fast
        model = json.loads(whole.to_str())["model"]
        self.merges = Merges(model) if model["type"] == "BPE" and model["end_of_word_suffix"] and not model["ignore_merges"] and not model["dropout"] else None
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.string())
        self.ids, self.begin, self.size, self.stop = (np.empty(0, dtype=t) for t in ("<u4", np.int64, np.int64, np.bool_))

    def add(self, words: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, words])
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, flat])
        self.stop = np.concatenate([self.stop, np.asarray(pc.match_substring_regex(words, STOPS))])

    def at(self, words: pa.Array) -> np.ndarray:
        """The place of each word, or -1."""
        return pc.fill_null(pc.index_in(words, self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def of(self, words: pa.Array) -> np.ndarray:
        """The place of each word; fresh ones are added, each once."""
        if len(self.names) > CACHE or len(self.ids) > 8 * CACHE:
            self.clear()
        found = self.at(words)
        lack = np.flatnonzero(found < 0)
        if len(lack):
            fresh = words.take(pa.array(lack)).dictionary_encode()
            self.learn(fresh.dictionary)
            found[lack] = self.at(fresh.dictionary)[np.asarray(fresh.indices)]
        return found

    def learn(self, fresh: pa.Array) -> None:
        """Adds different words that aren't known: first the parts that aren't known either, then the words made of two."""
        base = pc.utf8_rtrim(fresh, SIGNS)
        latin = pc.match_substring_regex(base, LATIN)
        base = pc.if_else(latin, pc.utf8_lower(base), fresh)
        tail = pc.if_else(latin, pc.replace_substring_regex(fresh, LATIN_HEAD, ""), "")
        parts = pc.unique(pa.concat_arrays([base, tail]))
        parts = parts.filter(pa.array(self.at(parts) < 0))
        plain = pc.match_substring_regex(parts, SMALL) if self.merges else pa.array(np.zeros(len(parts), dtype=bool))
        self.add(few := parts.filter(plain), *self.merges.ids(few)) if pc.any(plain).as_py() else None
        if len(other := parts.filter(pc.invert(plain))):
            each = [np.array(x.ids, dtype="<u4") for x in self.encode(other.to_pylist(), add_special_tokens=False)]
            self.add(other, np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each)))
        both = np.flatnonzero(self.at(fresh) < 0)
        if len(both):
            pick = pa.array(both)
            pair = np.array([self.at(base.take(pick)), self.at(tail.take(pick))]).T.ravel()
            self.add(fresh.take(pick), self.ids[spread(self.begin[pair], self.size[pair])], self.size[pair].reshape(-1, 2).sum(1))


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1 ... of each run, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


@functools.lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and all words."""
    data = texts.buffers()[2]
    signs = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    first, last = (int.from_bytes(texts.buffers()[1][8 * i : 8 * i + 8] if pa.types.is_large_string(texts.type) else texts.buffers()[1][4 * i : 4 * i + 4], "little") for i in (texts.offset, texts.offset + len(texts))) if len(texts) else (0, 0)
    if not ((signs[first:last] >= 0x1C) & (signs[first:last] <= 0x1F)).any():
        parted = pc.utf8_split_whitespace(texts)
        return np.asarray(parted.offsets), parted.flatten()
    each = [[w for w in SPACE.split(t) if w] for t in texts.to_pylist()]  # Python and Arrow take these signs for white space, the vocabulary's splitting doesn't
    return np.cumsum([0, *map(len, each)]), pa.array([w for some in each for w in some], pa.string())


def encoded_all(texts: pa.Array, path: str, end_id: int | None = END_ID) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's ids, the end id included, and the offsets after which a sentence has ended; the different words of all texts are looked up once."""
    tail = np.array([] if end_id is None else [end_id], dtype="<u4")
    bounds, every = split(pc.fill_null(texts, ""))
    known = words(path)
    place = known.of(every)
    size = known.size[place]
    ids = known.ids[spread(known.begin[place], size)]
    ends = np.concatenate([[0], np.cumsum(size)])
    stops = np.flatnonzero(known.stop[place]) + 1  # words before each place where a sentence may end
    bounds = bounds - bounds[0]
    at, some = ends[bounds].tolist(), np.searchsorted(stops, bounds, side="right").tolist()
    after = ends[stops]
    for i in range(len(at) - 1):
        yield np.concatenate([ids[at[i] : at[i + 1]], tail]), after[some[i] : some[i + 1]] - at[i]


def encoded(text: str, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    return next(encoded_all(pa.array([text], pa.string()), path, end_id))


def candidates(lengths: list[int], ends: list[np.ndarray], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions where windows may end, ascending from 0, and their penalties."""
    stops = np.cumsum(lengths)
    sizes = np.fromiter(map(len, ends), np.int64, len(ends))
    inner = np.concatenate(ends) + np.repeat(stops - lengths, sizes)
    inner = inner[inner < np.repeat(stops, sizes)]
    known = np.sort(np.concatenate([[0], stops << 2, inner << 2 | 1]))  # the least penalty of a position comes first
    at = known >> 2
    known = known[np.concatenate([[True], at[1:] > at[:-1]])]
    at = known >> 2
    more = (np.diff(at) - 1) // step
    if more.any():
        nth = spread(np.ones(len(more), dtype=np.int64), more)
        known = np.sort(np.concatenate([known, np.repeat(at[:-1], more) + nth * step << 2 | 2]))
    return known >> 2, np.array([0.0, SENTENCE, INSIDE])[known & 3]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> tuple[np.ndarray, list[int]]:
    """The least cost up to each position and the position before it on the way.

    The queue holds cuts whose cost and position together rise; those before ``first`` are over a window back.
    """
    places, sums, back = at.tolist(), [0.0], [0]
    queue, first = [0], 0
    for i, price in enumerate((cost[1:] + window).tolist(), 1):
        low = places[i] - window
        while places[queue[first]] < low:
            first += 1
        j = queue[first]
        value = sums[j] + price
        sums.append(value)
        back.append(j)
        while len(queue) > first and sums[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    return np.array(sums) - at, back


def windows(lengths: list[int], ends: list[np.ndarray], window: int, last: bool) -> list[int]:
    """Where windows end, ascending.  Unless ``last``, less than about a window's tokens are left over at the end."""
    at, cost = candidates(lengths, ends)
    total, back = best_cuts(at, cost, window)
    whole = int(at[-1])
    if last:
        full = np.searchsorted(at, whole - window)  # what is over after the last full window falls into powers of two
        i = min(range(int(full), len(total)), key=lambda k: total[k] + 12 * (whole - int(at[k])).bit_count())
    else:
        lo = int(np.searchsorted(at, whole - window))
        i = min(range(max(lo, 1), len(total)), key=lambda k: total[k] - at[k] * 1e-9)
    cuts = []
    while i:
        cuts.append(int(at[i]))
        i = back[i]
    cuts.reverse()
    if last:
        here = cuts[-1] if cuts else 0
        while here < whole:
            here += 1 << (whole - here).bit_length() - 1
            cuts.append(here)
    return cuts


def packed(docs: Iterator[tuple[object, np.ndarray, np.ndarray]], window: int, prefix: int, block: int = BLOCK) -> Iterator[tuple]:
    """Pieces (doc_id, ids, start, doc_tokens, sequence_id, offset) of a stream of (doc_id, ids, sentence ends)."""
    held: list[tuple[object, np.ndarray, np.ndarray, int, int]] = []  # id, rest of its ids, ends, start of the rest, tokens
    tokens, sequence = 0, prefix

    def flush(last: bool) -> Iterator[tuple]:
        nonlocal held, tokens, sequence
        cuts = windows([len(x[1]) for x in held], [x[2] for x in held], window, last)
        k = used = begun = 0
        for cut in cuts:
            here = begun
            while here < cut:
                name, ids, _, start, whole = held[k]
                take = min(cut - here, len(ids) - used)
                yield name, ids[used : used + take], start + used, whole, sequence, here - begun
                here, used = here + take, used + take
                if used == len(ids):
                    k, used = k + 1, 0
            begun, sequence = cut, sequence + 1
        held = held[k:]
        if used:
            name, ids, ends, start, whole = held[0]
            held[0] = (name, ids[used:], ends[ends > used] - used, start + used, whole)
        tokens -= begun

    for name, ids, ends in docs:
        held.append((name, ids, ends, 0, len(ids)))
        tokens += len(ids)
        if tokens >= block:
            yield from flush(False)
    if held:
        yield from flush(True)


def streamed(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int | None) -> Iterator[tuple[tuple[pa.Array, int], np.ndarray, np.ndarray]]:
    """((ids, row), a document's token ids, its sentence ends) of batches (id, text).  At the end the worker, which goes on to other tasks, keeps no words."""
    used = False
    try:
        for batch in batches:
            for start, end in text_chunks(batch, 1, CHUNK):
                used = True
                part = batch.slice(start, end - start)
                own = part.column(0).take(pa.array(range(part.num_rows)))  # a copy, so that the rows held don't hold the batch
                for i, found in enumerate(encoded_all(part.column(1), vocabulary, end_id)):
                    yield (own, i), *found
    finally:
        if used:
            words(vocabulary).clear()
        give_back()


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` ids, the documents' order in their partition kept.

    One row a piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id and
    offset in the sequence, and the ids themselves where ``with_ids``.  ``vocabulary`` is the path of a file for
    the tokenizers library.  A null or empty text is its end id alone; a null id is kept as null; repeated rows are
    packed each time; an empty table has no pieces; other columns are not read.  The last ids of a partition that do
    not fill a window go to sequences whose lengths are powers of two, which need no padding.
    """

    def run(batches):
        rows: list[tuple] = []

        def picked(names):
            """The ids of places (column, row), whatever their type is."""
            columns = list({id(c): c for c, _ in names}.values())
            begin = dict(zip(map(id, columns), np.cumsum([0, *map(len, columns)]).tolist(), strict=False))
            out = pa.chunked_array(columns).take(pa.array([begin[id(c)] + i for c, i in names], pa.int64()))
            return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out

        def batch_of(rows):
            names, starts, sizes, sums, whole, sequences, offsets, *ids = zip(*rows, strict=True)
            columns = [picked(names), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums, whole, sequences, offsets))]
            return pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.list_(pa.int32())) for x in ids], fields)

        fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for name, ids, start, whole, sequence, offset in packed(streamed(batches, vocabulary, end_id), window, TaskContext.get().partitionId() << 36):
            rows.append((name, start, len(ids), zlib.crc32(ids.tobytes()), whole, sequence, offset, *([ids.astype(np.int32)] * with_ids)))
            if len(rows) >= (512 if with_ids else 8192):
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    name = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(run, PIECES.format(id=name) + ", ids array<int>" * with_ids)
