"""SimHash near-duplicates by pigeonring filtering.

Fingerprints within ``distance`` bits link.  With ``SEGMENTS`` segments on a ring and at most ``distance``
differing bits there is a segment from which every chain of l consecutive segments has at most
l * distance / SEGMENTS differing bits; the longest chains whose budget is still below one bit must be equal
and make the bucket key, the longer ones are held against their budgets before the full Hamming distance.

A bucket of many different fingerprints is not paired.  Two fingerprints are within two bits just if
they share a point within one bit of both, so each emits the 65 points around itself; all that meet at a point
are linked to the smallest of them.  That is exact, linear, and at most 65 rows meet at any point.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, small, text_chunks, written
from graphloom.llm.components import components

SEGMENTS = 7
#: Buckets with more fingerprints than this go by shared points.
PAIRED = 64
SEED = 42


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text, unsigned: bit 1 where over half of its shingles' hashes have it."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        hashes = [digest(b" ".join(found), seed)]
    else:
        hashes = [digest(x, seed) for x in map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = SEED) -> DataFrame:
    """Rows (id, fp long): the fingerprint as a signed long.  A null text counts as empty: 0."""

    def run(batches):
        for batch in batches:
            texts, out = batch.column(1), np.empty(batch.num_rows, dtype=np.uint64)
            for start, end in text_chunks(batch, 1):
                for i, text in enumerate(texts.slice(start, end - start).to_pylist(), start):
                    out[i] = fingerprint(text, words, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, fp long")


def _segments() -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    cut = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def _mask(first: int, count: int) -> int:
    """The bits of ``count`` segments from ``first`` on, around the ring, as a signed long."""
    bits = sum(((1 << n) - 1) << a for a, n in (_segments()[(first + k) % SEGMENTS] for k in range(count)))
    return bits - (1 << 64) if bits >> 63 else bits


def links(prints: DataFrame, distance: int = 2, paired: int = PAIRED) -> DataFrame:
    """Rows (a, b) between different fingerprints of ``prints`` (column fp) that link; each pair within ``distance`` is joined by a path of them."""
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    equal = (SEGMENTS - 1) // distance  # chains of so many segments have a budget below one bit
    keys = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_mask(i, equal))) for i in range(SEGMENTS)))).alias("ring", "key"))
    keys = written(keys, "ring")
    sizes = written(keys.groupBy("ring", "key").count().where("count > 1"), "buckets")

    low = keys.join(sizes.where(F.col("count") <= paired).drop("count"), ["ring", "key"])
    groups = low.groupBy("ring", "key").agg(F.array_sort(F.collect_list("fp")).alias("all"))  # at most `paired`
    pairs = groups.select("ring", "all", F.posexplode("all").alias("at", "a")).select("ring", "a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chains = F.lit(False)
    for i in range(SEGMENTS):
        held = F.lit(True)
        for long in range(equal + 1, SEGMENTS):
            held = held & (F.bit_count(differ.bitwiseAND(F.lit(_mask(i, long)))) <= long * distance // SEGMENTS)
        chains = chains | ((F.col("ring") == i) & held)
    near = pairs.where(chains).where(F.bit_count(differ) <= distance).select("a", "b")

    many = keys.join(sizes.where(F.col("count") > paired).drop("count"), ["ring", "key"]).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << k) - ((1 << 64) if k == 63 else 0)) for k in range(64)))
    meet = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = meet.groupBy("point").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")  # at most 65
    if distance == 1:  # the point itself has to be one of them
        met = met.where(F.array_contains("all", F.col("point")))
        star = met.select(F.col("point").alias("a"), F.explode("all").alias("b")).where("a <> b")
    else:
        star = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    return near.union(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each row of ``docs``.

    component_id is the smallest id reachable over links of ``distance`` bits or fewer, a row's own included.
    Exact copies are one fingerprint from the first aggregate on.  Null or empty text: fingerprint zero, linked
    like any other.  A null id keeps its row and is never the smallest; a repeated row is answered each time.
    An empty table gives no rows.  Other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = written(links(classes.select("fp"), distance), "near")
    joined = components(found)
    whole = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = written(whole, "whole")
    best = written(roots.groupBy("component").agg(F.min("least").alias("component_id")), "best")
    answer = written(roots.join(best, "component").select("fp", "component_id"), "answer")
    release(found, roots, best, classes)
    return prints.join(answer, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Size classes grow by this factor; a text's shingle set meets those of its own class and the next.
GROWTH = 1.25
#: Segments of a shingle set that are looked up.  Of a pair at the similarity asked for, each is equal with odds over
#: 1/e, so that all of TRIED differ for one pair in 60,000; sets of fewer segments have all of them tried.
TRIED = 24


def ring_keys(hashes: np.ndarray, similarity: float) -> list[int]:
    """Keys of a set of shingle hashes: it is dealt to one segment more than similar sets of its size can differ in, and equal segments have equal keys."""
    some = np.unique(hashes)
    mixed = some * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    sums = mixed * np.uint64(0xBF58476D1CE4E5B9)
    out = []
    own = int(np.log(len(some)) / np.log(GROWTH) + 1e-9)
    for size in (own, own + 1):
        count = int(2 * (1 - similarity) / (1 + similarity) * GROWTH ** (size + 1)) + 1
        at = (mixed >> np.uint64(20)) % np.uint64(count)
        tried = at < TRIED
        order = np.argsort(at[tried], kind="stable")
        which, part = at[tried][order], sums[tried][order]
        if len(which):
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            for j, total in zip(which[first].tolist(), np.add.reduceat(part, first).tolist(), strict=True):
                out.append(xxhash.xxh64_intdigest(b"%d %d %d" % (size, j, total)) - (1 << 63))
    return out


def linked(same: np.ndarray, fp: np.ndarray, reach: int, paired: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that join classes of one segment whose fingerprints are within ``reach`` bits, each class to the first found of its component.

    ``fp`` has one column of words for each class, or is one word for each.  Up to ``paired`` classes are held against each
    other at once.  More are searched breadth first: a class is held against all that no component has yet.  Either
    way no pair is passed over but pairs of one component; near copies of one text cost one step for all,
    classes without links half their number squared.
    """
    n = len(same)
    fp = fp.reshape(-1, n)
    if n <= paired:
        near = sum(np.bitwise_count(x[:, None] ^ x[None]) for x in fp) <= reach
        label = np.arange(n)
        while True:
            least = np.where(near, label[None], n).min(1)
            if (least == label).all():
                break
            label = least
        moved = label != np.arange(n)
        return [(same[moved], same[label[moved]])]
    out = []
    left = np.arange(n)
    while len(left):
        root, queue, left = left[0], [left[:1]], left[1:]
        while queue and len(left):
            for x in queue.pop():
                near = np.bitwise_count(fp[:, left] ^ fp[:, x : x + 1]).sum(0) <= reach
                if near.any():
                    found, left = left[near], left[~near]
                    out.append((same[found], np.full(len(found), same[root])))
                    queue.append(found)
    return out


def ring_links(keys: DataFrame, reach: int, paired: int) -> DataFrame:
    """Links (a, b) of rows (same, fp, fp2, key), fingerprints of 128 bits.  All rows of a segment are in one task and are one group."""

    def runs(batches):
        left: list[np.ndarray] = []
        enough = 50_000
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                left.append(np.stack([batch.column(i).to_numpy() for i in range(4)]))
                if sum(x.shape[1] for x in left) < enough:
                    continue
            if not left:
                break
            rows = np.concatenate(left, axis=1)
            cut = np.flatnonzero(np.diff(rows[0])) + 1
            if batch is not None and not len(cut):
                left, enough = [rows], 2 * rows.shape[1]
                continue
            stop = rows.shape[1] if batch is None else int(cut[-1])
            yield rows[:, :stop], np.concatenate([[0], cut[cut < stop], [stop]])
            left, enough = [rows[:, stop:]] if batch is not None else [], max(50_000, 2 * (rows.shape[1] - stop))

    def run(batches):
        for rows, bounds in runs(batches):
            found = []
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                some = slice(bounds[i], bounds[i + 1])
                found += linked(rows[1, some], rows[2:, some].view(np.uint64), reach, paired)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    dealt = keys.select("key", "same", "fp", "fp2").repartition("key").sortWithinPartitions("key", "same")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def shingled(text: str | None, words: int) -> tuple[bytes, np.ndarray]:
    """The text in small letters and single blanks, and the set of its shingles' hashes, ascending."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    few = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in few] if found else [], dtype="<u8")
    return b" ".join(found), np.unique(hashes)


def bound(similarity: float, missed: float = 1e-7) -> int:
    """Bits of 128 that the fingerprints of sets of this similarity exceed with odds under ``missed``."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    odds, bits = 1.0, -1
    while odds > missed:
        bits += 1
        odds -= math.comb(128, bits) * share**bits * (1 - share) ** (128 - bits)
    return bits


def set_print(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingle hashes as two signed longs: the SimHash of the hashes and that of the hashes mixed."""
    mixed = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    both = np.stack([hashes, mixed ^ mixed >> np.uint64(31)], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
    a, b = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view("<i8")
    return int(a), int(b)


class Sets:
    """Shingle sets by place, with the places of each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        self.names, code = np.unique(every, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.who = np.repeat(np.arange(len(sets)), self.size)[order]
        self.begin = np.append(0, np.cumsum(np.bincount(code, minlength=len(self.names))))

    def near(self, some: np.ndarray, similarity: float) -> np.ndarray:
        """Places of the sets whose Jaccard similarity to ``some`` is ``similarity`` at least."""
        at = np.searchsorted(self.names, some)
        at = at[at < len(self.names)]
        at = at[np.isin(self.names[at], some)]
        shared = np.bincount(np.concatenate([self.who[self.begin[k] : self.begin[k + 1]] for k in at] or [self.who[:0]]), minlength=len(self.size))
        return np.flatnonzero((shared > 0) & (shared >= similarity * (self.size + len(some) - shared) - 1e-9))

    def components(self, sets: list[np.ndarray], similarity: float) -> np.ndarray:
        """The first place of each set's component, breadth first."""
        root = np.full(len(sets), -1)
        for start in range(len(sets)):
            if root[start] < 0:
                root[start], queue = start, [start]
                while queue and (root < 0).any():
                    found = self.near(sets[queue.pop()], similarity)
                    found = found[root[found] < 0]
                    root[found] = start
                    queue += found.tolist()
        return root


#: Shingles of a block, about: what a task holds at once when sets are compared.
SHINGLES = 1_000_000


def verified(members: DataFrame, words: int, similarity: float, shingles: int = SHINGLES) -> DataFrame:
    """Links (a, b) between classes of rows (same, text, group, blocks): each pair of a group whose similarity is exactly ``similarity`` at least is joined by a path of them.

    A group of more than ``shingles`` is dealt to blocks.  Those are searched each for itself, then one class of each
    block against the others'.  The classes outside a group's largest component so far then go to all its other blocks.
    """
    placed = members.select("group", F.pmod(F.xxhash64("same"), F.col("blocks")).alias("block"), "blocks", "same", "text")

    def grouped(batches, n: int):
        """Rows of one group and block, which may go over batches; the first ``n`` columns tell groups apart."""
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[-1][:n] != row[:n]:
                    yield rows
                    rows = []
                rows.append(row)
        if rows:
            yield rows

    def batched(pairs):
        while some := list(itertools.islice(pairs, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some, strict=True)], ["a", "b"])

    def inside(n: int):
        def run(batches):
            for rows in grouped(batches, n):
                if len(rows) > 1:
                    sets = [shingled(r[-1], words)[1] for r in rows]
                    root = Sets(sets).components(sets, similarity)
                    yield from ((rows[i][-2], rows[j][-2]) for i, j in enumerate(root.tolist()) if i != j)

        return lambda batches: batched(run(batches))

    def across(batches):
        group, held, same = None, [], []
        for batch in batches:
            for *now, foreign, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != group:
                    group, held, same, ready = now, [], [], None
                some = shingled(text, words)[1]
                if not foreign:
                    held.append(some), same.append(name)
                elif held:
                    ready = ready or Sets(held)
                    yield from ((same[i], name) for i in ready.near(some, similarity).tolist())

    dealt = placed.select("group", "block", "same", "text").repartition("group", "block").sortWithinPartitions("group", "block", "same")
    found = written(dealt.mapInArrow(inside(2), "a long, b long"), "verified")
    large = written(placed.where("blocks > 1"), "large")
    if not large.limit(1).count():
        return found
    heads = large.groupBy("group", "block").agg(F.min(F.struct("same", "text")).alias("h")).select("group", "h.same", "h.text")
    heads = heads.repartition("group").sortWithinPartitions("group", "same").mapInArrow(inside(1), "a long, b long")
    found = written(found.union(heads), "verified")
    joined = components(found)
    part = large.select("group", "same").join(joined, F.col("same") == F.col("node"), "left").select("group", "same", F.coalesce("component", "same").alias("part"))
    part = written(part, "parts")
    most = part.groupBy("group", "part").count().groupBy("group").agg(F.max(F.struct("count", "part")).alias("m")).select("group", F.col("m.part").alias("most"))
    other = part.join(most, "group").where("part <> most").select("same")
    other = large.join(other, "same", "left_semi")
    sent = other.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("`to` <> block")
    both = large.select("group", "block", F.lit(False).alias("foreign"), "same", "text").union(sent.select("group", F.col("to"), F.lit(True), "same", "text"))
    both = both.repartition("group", "block").sortWithinPartitions("group", "block", "foreign")
    return written(found.union(both.mapInArrow(lambda batches: batched(across(batches)), "a long, b long")), "verified")


def resolved(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, paired: int = PAIRED, shingles: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Rows (k1, k2, id, same), one for each row of ``docs``, and (same, component) of each class.  k1 and k2 are hashes of id and text."""

    def run(batches):
        for batch in batches:
            for start, end in text_chunks(batch, 3):
                part = batch.slice(start, end - start)
                rows = []
                for text in part.column(3).to_pylist():
                    plain, hashes = shingled(text, words)
                    some = (*set_print(hashes), len(hashes), ring_keys(hashes, similarity)) if len(hashes) else (0, 0, 0, [])
                    rows.append((xxhash.xxh3_64_intdigest(plain) - (1 << 63), *some))
                kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["k1", "k2", "id", "same", "fp", "fp2", "n", "keys"])

    few = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(few.mapInArrow(run, f"k1 long, k2 long, id {few.schema['id'].dataType.simpleString()}, same long, fp long, fp2 long, n long, keys array<long>"), "prints")
    row = F.min(F.struct("k1", "k2")).alias("row")  # one row stands for the class
    classes = written(prints.groupBy("same").agg(row, *(F.first(c).alias(c) for c in ("fp", "fp2", "n", "keys"))), "classes")
    near = written(contracted(ring_links(classes.select("same", "fp", "fp2", F.explode("keys").alias("key")), bound(similarity), paired)), "near")
    group = components(near).select(F.col("node").alias("same"), F.col("component").alias("group")).join(classes.select("same", "n", "row.k1", "row.k2"), "same")
    group = written(group, "groups")
    blocks = group.groupBy("group").agg(F.ceil(F.sum("n") / shingles).cast("long").alias("blocks"))
    wanted = written(group.join(blocks, "group").select("k1", "k2", "same", "group", "blocks"), "wanted")
    texts = few.select("k1", "k2", "text").join(small(wanted), ["k1", "k2"])
    members = texts.groupBy("same").agg(F.min("text").alias("text"), F.first("group").alias("group"), F.first("blocks").alias("blocks"))
    found = verified(members, words, similarity, shingles)
    joined = components(found)
    whole = written(classes.select("same").join(joined, classes["same"] == joined["node"], "left").select("same", F.coalesce("component", "same").alias("component")), "whole")
    release(near, group, wanted, found, classes)
    return prints.select("k1", "k2", "id", "same"), whole


def contracted(links: DataFrame) -> DataFrame:
    """The same components with about one link a class: a class that links to several roots keeps the least, and those roots link to it."""
    ends = links.groupBy("a").agg(F.collect_set("b").alias("all"))  # one for each segment of the class at most
    least = F.array_min("all")
    return ends.select("a", least.alias("b")).union(ends.where("size(all) > 1").select(F.explode("all").alias("a"), least.alias("b"))).where("a <> b").distinct()


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes of a row's id and text: equal just for rows that repeat both."""
    text = F.col(text_col).cast("string")
    return [F.xxhash64(F.col(id_col), text, F.col(id_col).isNull()).alias("k1"), F.xxhash64(text, F.col(id_col), text.isNull(), F.lit(1)).alias("k2")]


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, paired: int = PAIRED, shingles: int = SHINGLES) -> DataFrame:
    """Rows (id, component_id), one for each row of ``docs``: near-duplicates whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more.

    The ring's segments are made of the shingle set, where similar sets have fewer differences than segments.  Classes
    that share one and whose fingerprints of the set are within :func:`bound` bits make candidate groups; in each of them
    the sets themselves are compared (:func:`verified`).  Texts of the same words are one class from the start.
    Null or empty texts: one class.  A null id keeps its row; an empty table gives no rows; other columns are not read.
    """
    prints, whole = resolved(docs, id_col, text_col, words, similarity, paired, shingles)
    least = prints.groupBy("same").agg(F.min("id").alias("least"))
    best = written(whole.join(least, "same").groupBy("component").agg(F.min("least").alias("component_id")), "best")
    answer = written(whole.join(best, "component").select("same", "component_id"), "answer")
    release(whole, best)
    return prints.select("id", "same").join(answer, "same").select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row left of each group of :func:`similar`: that of the smallest id, null ids last.

    Rows are told apart by id and text, so a text that is like no other stays whatever id it has.  Of rows that
    repeat both one is left.  Null and empty texts are one group; an empty table stays empty; all columns are kept.
    """
    prints, whole = resolved(docs, id_col, text_col, words, similarity)
    classes = prints.groupBy("same").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2")).alias("row"))
    best = written(whole.join(classes, "same").groupBy("component").agg(F.min("row").alias("row")), "best")
    stay = best.select(F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2"))
    counted = written(prints.groupBy("k1", "k2").agg(F.count("*").alias("times")).join(stay.withColumn("stays", F.lit(True)), ["k1", "k2"], "left").where("stays IS NULL OR times > 1"), "counted")
    release(whole, best)
    gone = small(counted.where("stays IS NULL").select("k1", "k2"))
    twice = small(counted.where("stays").select("k1", "k2"))
    names = {x: f"{x}_of_the_documents" for x in docs.columns if x in ("k1", "k2")}
    keyed = docs.withColumnsRenamed(names).select("*", *row_key(names.get(id_col, id_col), names.get(text_col, text_col)))
    kept = keyed.join(gone, ["k1", "k2"], "left_anti")
    once = kept.join(twice, ["k1", "k2"], "left_anti").unionByName(kept.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return once.drop("k1", "k2").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)
