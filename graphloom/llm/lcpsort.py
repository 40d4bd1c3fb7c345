"""Distributed merge sort of strings that never compares a known common prefix again.

Each map task sorts its strings in runs, drops repeats, front-codes the run (the length of the prefix shared with
the string before, then the rest) and sends each run's segment for a key range to that range's task.  There a loser
tree merges the runs: a string's known common prefix with the last winner comes from the front code or from the
comparison it lost, and only where two of them are equal are bytes compared, from that place on.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, written

#: Strings in a run at most, bytes of them at most, and strings meant for one merging task.
RUN, RUN_BYTES, TASK = 32_768, 16 << 20, 60_000
#: Strings looked at for each border between key ranges; they go to the driver.
LOOKS = 8


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix, known to be ``start`` at least."""
    whole = min(len(a), len(b))
    while start < whole:
        x, y = a[start : start + 32], b[start : start + 32]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return start + n - (differ.bit_length() + 7) // 8
        start += len(x)
    return whole


def digest(x: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(x))


def run_of(strings: list[bytes]) -> tuple[list[bytes], list[bool], np.ndarray]:
    """The different strings in order, whether each came more than once, and the prefix each shares with the one before."""
    strings.sort()
    kept: list[bytes] = []
    many: list[bool] = []
    for s in strings:
        if kept and kept[-1] == s:
            many[-1] = True
        else:
            kept.append(s)
            many.append(False)
    shared = np.zeros(len(kept), dtype=np.int64)
    for i in range(1, len(kept)):
        shared[i] = common(kept[i - 1], kept[i])
    return kept, many, shared


def front_coded(kept: list[bytes], many: list[bool], shared: np.ndarray) -> bytes:
    shared = shared.astype("<u4")
    shared[:1] = 0
    tails = [s[n:] for s, n in zip(kept, shared.tolist(), strict=True)]
    head = np.array([len(kept)], dtype="<u4").tobytes() + shared.tobytes() + np.array(many, dtype=np.uint8).tobytes()
    return head + np.fromiter(map(len, tails), "<u4", len(tails)).tobytes() + b"".join(tails)


def decoded(code: bytes) -> Iterator[tuple[bytes, bool, int]]:
    n = int.from_bytes(code[:4], "little")
    shared = np.frombuffer(code, "<u4", n, 4).tolist()
    many = np.frombuffer(code, np.uint8, n, 4 + 4 * n).tolist()
    sizes = np.frombuffer(code, "<u4", n, 4 + 5 * n).tolist()
    at, last = 4 + 9 * n, b""
    for k, flag, size in zip(shared, many, sizes, strict=True):
        last = last[:k] + code[at : at + size]
        at += size
        yield last, bool(flag), k


def merged(runs: list[Iterator[tuple[bytes, bool, int]]]) -> Iterator[tuple[bytes, bool, int]]:
    """All strings of the runs in order, equal ones of different runs next to each other, each with the prefix it shares with the one before."""
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads: list[tuple[bytes, bool] | None] = [None] * size
    known = [0] * size  # the prefix shared with the last winner

    def advance(i: int) -> None:
        if (item := next(runs[i], None)) is None:
            heads[i] = None
        else:
            heads[i], known[i] = item[:2], item[2]

    def wins(i: int, j: int) -> bool:
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if known[i] != known[j]:
            return known[i] > known[j]
        n = common(a[0], b[0], known[i])
        first = a[0][n:] <= b[0][n:]
        known[j if first else i] = n
        return first

    for i in range(len(runs)):
        advance(i)
        known[i] = 0
    losers = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        i, j = play(2 * node), play(2 * node + 1)
        if wins(i, j):
            losers[node] = j
            return i
        losers[node] = i
        return j

    winner = play(1)
    while (top := heads[winner]) is not None:
        yield (*top, known[winner])
        advance(winner)
        node = winner + size >> 1
        while node:
            if not wins(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node >>= 1


def neighbours(runs: list[Iterator[tuple[bytes, bool, int]]]) -> Iterator[tuple[bytes, int]]:
    """Each different string once with the longest prefix it shares with another string of the input: its whole length if it came twice."""
    last: bytes | None = None
    best = 0
    for s, many, shared in merged(runs):
        if last is not None and shared == len(last) == len(s):
            best = len(s)
            continue
        if last is not None:
            yield last, max(best, shared)
        last, best = s, len(s) if many else shared
    if last is not None:
        yield last, best


def longest_shared(rows: DataFrame, strings: Callable[[pa.RecordBatch], Iterable[bytes]], count: int) -> DataFrame:
    """Rows (d1, d2, shared): for each different string of ``rows`` its digest and the longest prefix shared with any other.

    ``strings`` gives the strings of a batch of ``rows``, whose first column is a random long; ``count`` is about how many
    there are.  Equal strings leave a run once, so a string in a third of all rows costs one item a run.  ``LOOKS``
    strings for each key range, and the first and last string of each, come to the driver.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK))
    thin = max(1, count // (LOOKS * parts))

    def look(batches):
        for batch in batches:
            few = batch.filter(pa.array(batch.column(0).to_numpy() % thin == 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(strings(few)), pa.binary())], ["s"])

    seen = sorted(r["s"] for r in rows.mapInArrow(look, "s binary").collect())
    borders = sorted({bytes(seen[i * len(seen) // parts]) for i in range(1, parts)}) if seen else []

    def send(batches):
        def segments(found):
            kept, many, shared = run_of(found)
            at = 0
            for part, border in enumerate([*borders, None]):
                end = len(kept) if border is None else bisect_right(kept, border, at)
                if end > at:
                    yield part, front_coded(kept[at:end], many[at:end], shared[at:end])
                at = end

        found: list[bytes] = []
        held = 0
        for batch in batches:
            for s in strings(batch):
                found.append(s)
                held += len(s)
                if len(found) >= RUN or held >= RUN_BYTES:
                    yield from boxed(segments(found))
                    found, held = [], 0
        if found:
            yield from boxed(segments(found))

    def boxed(found):
        for part, code in found:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([code], pa.binary())], ["part", "code"])

    def merge(key, table):
        ends: list[tuple[int, bytes]] = []
        out: list[tuple[int, int, int]] = []
        for s, shared in neighbours([decoded(c) for c in table.column("code").to_pylist()]):
            out.append((*digest(s), shared))
            ends[1:] = [(1, s)]
            if len(out) == 1:
                ends = [(0, s)]
        first, last = ends[0][1], ends[-1][1]
        n = len(out)
        columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
        return pa.table([*columns, pa.array([key[0].as_py()] * n, pa.int32()), pa.array([first] + [None] * (n - 1), pa.binary()), pa.array([None] * (n - 1) + [last], pa.binary())], names=["d1", "d2", "shared", "part", "first", "last"])

    sent = rows.mapInArrow(send, "part int, code binary")
    sorted_ = written(sent.groupBy("part").applyInArrow(merge, "d1 long, d2 long, shared long, part int, first binary, last binary"), "sorted")
    ends = sorted_.where("first IS NOT NULL OR last IS NOT NULL").select("part", "first", "last").collect()
    firsts = {r["part"]: bytes(r["first"]) for r in ends if r["first"] is not None}
    lasts = {r["part"]: bytes(r["last"]) for r in ends if r["last"] is not None}
    mended = []
    for a, b in zip(order := sorted(firsts), order[1:], strict=False):
        n = common(lasts[a], firsts[b])
        mended += [(*digest(lasts[a]), n), (*digest(firsts[b]), n)]
    slim = sorted_.select("d1", "d2", "shared")
    if mended:
        slim = slim.union(spark.createDataFrame(mended, "d1 long, d2 long, shared long"))
    out = written(slim.groupBy("d1", "d2").agg(F.max("shared").alias("shared")), "shared")
    release(sorted_)
    return out
