"""Exact top-k inner products over an impact-ordered index, a score at a time.

Index rows are blocks of vectors.  A component's impact is its magnitude in ``LEVELS`` steps of the block's largest.
Postings (vector, dimension) whose impacts lie between two bounds of ``SEGMENTS`` are a segment; segments are
processed by descending impact for a batch of queries at once, adding quantised contributions to accumulators.  What is
still missing from the score of vector v for query q is at most |q| times the norm of v's unprocessed part, which the
index holds for each segment.  Processing stops when that proves all but a few members out (or at the last
segment); vectors that are out for all queries of the batch are left out of later segments, and a block whose
largest norm can't reach any query's k-th score is passed over whole.  Every possible member is then scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import release, written

#: Vectors in an index block, queries scored against it at once, queries sent to the executors at once.
BLOCK, BATCH, ROUND = 4096, 256, 16_384
#: Steps of an impact, and the least step of each segment: impacts halve from one to the next.
LEVELS, SEGMENTS = 64, (33, 17, 9, 4, 1)
#: Possible members per query that are cheap enough to score exactly.
FEW = 64
#: Products below this are whole in a double; with larger ones Python's integers are used and nothing is pruned.
WHOLE = float(1 << 50)
LARGEST, LEAST = (1 << 63) - 1, -(1 << 63)


def scaled(values: list | None, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component as a double, which holds it exactly, or None for a vector that takes no part."""
    if values is None or any(x is None for x in values):
        return None
    x = np.asarray(values, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    out = np.floor(x * scale)
    if not np.isfinite(out).all():
        raise ValueError(f"a component times {scale} is no double")
    return out


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed impacts of whole-number components in units, and the norms that are left after each number of segments."""
    unit = float(np.abs(x).max(initial=0)) / LEVELS or 1.0
    steps = np.sign(x) * np.minimum(np.round(np.abs(x) / unit), LEVELS)
    left = np.empty((len(SEGMENTS) + 1, len(x)))
    for k in range(len(SEGMENTS) + 1):
        done = np.abs(steps) >= SEGMENTS[k - 1] if k else np.zeros(x.shape, dtype=bool)
        left[k] = np.sqrt((np.where(done, x - steps * unit, x) ** 2).sum(1))
    return steps * unit, left


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Blocks of vectors: ids (and which are null), dimensions, whole-number components (row-major), quantised ones and the norms left after each segment."""

    def run(batches):
        ids: list[int | None] = []
        rows: list[np.ndarray] = []

        def block():
            x = np.zeros((len(rows), max(map(len, rows))))
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            with np.errstate(over="ignore"):
                impacts, left = quantised(x)
            whole = np.abs(x).max(initial=0) < 1 << 31
            columns = [
                np.array([LARGEST if i is None else i for i in ids], dtype=np.int64).tobytes(), np.array([i is None for i in ids], dtype=np.uint8).tobytes(),
                x.shape[1], bool(whole), x.astype(np.int32).tobytes() if whole else x.tobytes(), impacts.astype(np.float32 if whole else np.float64).tobytes(), left.tobytes(),
            ]
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds, strict=True)], ["ids", "none", "width", "whole", "x", "impacts", "left"])

        for batch in batches:
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := scaled(values, scale)) is not None:
                    ids.append(name)
                    rows.append(x)
                if len(rows) == BLOCK:
                    yield block()
                    ids, rows = [], []
        if rows:
            yield block()

    few = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    blocks = few.mapInArrow(run, "ids binary, none binary, width int, whole boolean, x binary, impacts binary, left binary")
    return written(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "impacts")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are null, and components."""
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    x = np.frombuffer(row["x"], dtype=np.int32 if row["whole"] else np.float64).reshape(len(ids), row["width"])
    return ids, np.frombuffer(row["none"], dtype=np.uint8) > 0, x.astype(np.float64)


def segments(row: dict, count: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each segment's contributions as a matrix (vector, dimension), and the norms left."""
    impacts = np.frombuffer(row["impacts"], dtype=np.float32 if row["whole"] else np.float64).reshape(count, row["width"]).astype(np.float32)
    size = np.abs(impacts)
    unit = float(size.max(initial=0)) / LEVELS or 1.0
    bounds = [np.inf, *((s - 0.5) * unit for s in SEGMENTS)]
    return [np.where((size >= low) & (size < high), impacts, np.float32(0)) for high, low in zip(bounds, bounds[1:], strict=False)], np.frombuffer(row["left"], dtype=np.float64).reshape(len(SEGMENTS) + 1, count)


def possible(q: np.ndarray, parts: list[np.ndarray], left: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no bound rules out.  least: scores that k members of each query are known to reach, -inf where none are."""
    length = np.sqrt((q**2).sum(1))
    reach = length * left[0].max(initial=0) * (1 + 1e-6) >= least
    asked, alive = np.flatnonzero(reach), np.arange(left.shape[1])
    if not len(asked):
        return asked, asked
    qs = q[asked].astype(np.float32)
    sums, bound = np.zeros((len(asked), len(alive)), dtype=np.float32), least[asked]
    for done, part in enumerate(parts, 1):
        sums += qs @ (part if len(alive) == len(part) else part[alive]).T
        # single precision adds at most a millionth of |q| |v| for each segment
        slack = np.outer(length[asked], left[done, alive] * (1 + 1e-6) + left[0, alive] * 1e-5 * len(parts)) + 1e-3
        if len(alive) >= k:
            bound = np.maximum(bound, -np.partition(slack - sums, k - 1, axis=1)[:, k - 1])
        in_ = sums + slack >= bound[:, None]
        if done == len(parts) or in_.sum() <= FEW * len(asked):
            a, b = np.nonzero(in_)
            return asked[a], alive[b]
        some = in_.any(0)
        if some.sum() < 0.8 * len(alive):
            alive, sums = alive[some], sums[:, some]
    raise AssertionError


def exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of pairs of rows; beyond a long they are held at its ends."""
    most = float(np.abs(q[np.unique(a)]).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    out = np.empty(len(a), dtype=np.int64)
    for i in range(0, len(a), 65536):
        part = slice(i, i + 65536)
        if most < WHOLE:
            out[part] = np.einsum("ij,ij->i", q[a[part]], x[b[part]])
        else:
            out[part] = [min(LARGEST, max(LEAST, sum(int(u) * int(v) for u, v in zip(q[m], x[n], strict=True)))) for m, n in zip(a[part].tolist(), b[part].tolist(), strict=True)]
    return out


def best(who: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each ``who``, ties to the smaller id, null ids last, and then to ``own``, in that order."""
    order = np.lexsort((own, ids, none, ~score, who))  # ~x falls as x rises, at the ends of a long too
    who = who[order]
    begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.array([], dtype=np.int64)
    rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
    return order[rank < k]


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k highest whole-number inner products, ties to the smaller id.

    Queries are the rows whose id ``every`` divides, candidates all rows but the query's own, a row with a null id too
    (last among equal scores).  Null vectors and vectors with a null, NaN or infinite component take no part; shorter
    vectors count as padded with zeros; repeated rows are rows of their own, as queries too.  Components of any
    size count whole; a score of the result that no long holds raises OverflowError, and a component times ``scale``
    that no double holds ValueError.  Other columns are not read; an empty table gives no rows.
    Queries go to the executors ``ROUND`` at a time; every such round scans the index once, without a shuffle of it.
    """
    blocks = index(vectors, id_col, vector_col, scale)

    def pick(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, none, x = unpacked(row)
                at = np.flatnonzero((ids % every == 0) & ~none)
                yield pa.RecordBatch.from_arrays([pa.array(at + (row["block"] << 20), pa.int64()), pa.array(ids[at]), pa.array([x[i].tobytes() for i in at], pa.binary())], ["own", "id", "x"])

    asked = written(blocks.mapInArrow(pick, "own long, id long, x binary"), "asked")
    rounds = max(1, math.ceil(asked.count() / ROUND))
    parts = [answers(blocks, asked.where(F.pmod(F.xxhash64("own"), F.lit(rounds)) == r), k) for r in range(rounds)]
    every_part = parts[0]
    for p in parts[1:]:
        every_part = every_part.union(p)
    every_part = written(every_part, "answers")
    release(blocks, asked)
    order = Window.partitionBy("own").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    ranked = every_part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # the ends of a long stand for all that is beyond
    held = F.when(F.col("score").isin(LARGEST, LEAST), F.raise_error(F.lit("OverflowError: a score is no long")).cast("long")).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", held.alias("score"))


def answers(blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best k of each task for the queries of one round: (own, query_id, other, vec_id, score).  About ``ROUND`` queries come to the driver."""
    rows = asked.collect()
    width = max((len(r["x"]) // 8 for r in rows), default=0)
    packed = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        packed[i, : len(r["x"]) // 8] = np.frombuffer(r["x"], dtype=np.float64)
    sent = blocks.sparkSession.sparkContext.broadcast((np.array([r["own"] for r in rows], dtype=np.int64), np.array([r["id"] for r in rows], dtype=np.int64), packed))

    def run(batches):
        own, names, queries = sent.value
        who = np.array([], dtype=np.int64)
        held = (who, who, who > 0, who, who)  # query, score, whether the id is null, id, place
        for batch in batches:
            for row in batch.to_pylist():
                ids, none, x = unpacked(row)
                wide = max(x.shape[1], queries.shape[1])
                parts, left = segments(row, len(ids))
                parts = [np.pad(y, ((0, 0), (0, wide - y.shape[1]))) for y in parts]
                x, qs = (np.pad(y, ((0, 0), (0, wide - y.shape[1]))) for y in (x, queries))
                largest = float(np.abs(x).max(initial=0)) * max(1, wide)
                place = np.arange(len(ids)) + (row["block"] << 20)
                found = [held]
                for begin in range(0, len(qs), BATCH):
                    q = qs[begin : begin + BATCH]
                    least = np.full(len(q), -np.inf)
                    mine = (held[0] >= begin) & (held[0] < begin + len(q))
                    last, n = np.unique(held[0][mine], return_counts=True)
                    full = last[n == k]
                    lowest = np.full(len(q), np.inf)
                    np.minimum.at(lowest, held[0][mine] - begin, held[1][mine])
                    least[full - begin] = lowest[full - begin]
                    wild = largest * np.abs(q).max(1, initial=0) >= WHOLE
                    tame = np.flatnonzero(~wild)
                    a, b = possible(q[tame], parts, left, k + 1, least[tame])  # one more: a query's own row is no candidate
                    more = np.flatnonzero(wild)
                    a, b = np.concatenate([tame[a], np.repeat(more, len(x))]), np.concatenate([b, np.tile(np.arange(len(x)), len(more))])
                    a, b = (y[own[begin + a] != place[b]] for y in (a, b))
                    for some in (~wild[a], wild[a]):
                        u, v = a[some], b[some]
                        found.append((u + begin, exact(q, x, u, v), none[v], ids[v], place[v]))
                held = tuple(np.concatenate(y) for y in zip(*found, strict=True))
                keep = best(*held, k)
                held = tuple(y[keep] for y in held)
        who, score, none, ids, other = held
        for i in range(0, len(who), 8192):
            part = slice(i, i + 8192)
            yield pa.RecordBatch.from_arrays([pa.array(own[who[part]]), pa.array(names[who[part]]), pa.array(other[part]), pa.array(ids[part], mask=none[part]), pa.array(score[part])], ["own", "query_id", "other", "vec_id", "score"])

    return blocks.mapInArrow(run, "own long, query_id long, other long, vec_id long, score long")
