"""Rows as arrays: one row a key with its whole vector x, so that an edge or a sample is one row through a join.

Long tables (keys, k, v) are packed once and unpacked at the end.  Sums of vectors are as many sums of one aggregate, with
map-side combine; products with a kernel that the caller holds are matrix products of Arrow batches.  Edges and pairs go in
blocks: a block gets each vector that it needs once, however many of its edges need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import activations

#: Vector components that a block's rows ask for at most (256 MB), so that a task's memory doesn't grow with the tables.
BLOCK = 1 << 25
#: Components of a block that are gathered at once (16 MB).
GATHER = 1 << 21


def width_of(rows: DataFrame, col: str = "k") -> int | None:
    """The vectors' length (that of any row, where there is an array); None without rows."""
    if "x" in rows.columns:
        one = rows.select(F.size("x")).first()
        return None if one is None else one[0]
    most = rows.agg(F.max(col)).first()[0]
    return None if most is None else most + 1


def zeros(width: int, value: float = 0.0) -> Column:
    return F.array_repeat(F.lit(value), width)


def packed(rows: DataFrame, keys: list[str], width: int, col: str = "k") -> DataFrame:
    """(keys, x) of a long table, zero where it has no row; a table that has x as it is."""
    if "x" in rows.columns:
        return rows.select(*keys, "x")
    sums = [F.coalesce(F.sum(F.when(F.col(col) == i, F.col("v"))), F.lit(0.0)).alias(f"_{i}") for i in range(width)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*(F.col(f"_{i}") for i in range(width))).cast("array<double>").alias("x"))


def unpacked(rows: DataFrame, keys: list[str], col: str = "j") -> DataFrame:
    return rows.select(*keys, F.posexplode("x").alias(col, "v"))


def matmul(rows: DataFrame, kernel: np.ndarray, bias: np.ndarray | None = None, by: str | None = None) -> DataFrame:
    """x times the kernel, plus the bias, beside the other columns; ``by`` names the column that chooses one of several kernels."""
    rest = [c for c in rows.columns if c != "x"]
    held = rows.sparkSession.sparkContext.broadcast((np.asarray(kernel, dtype=np.float64), bias))

    def run(batches):
        kernel, bias = held.value
        columns = kernel.shape[-1]
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column(len(rest)).flatten(), dtype=np.float64).reshape(n, kernel.shape[-2])
            if by is None:
                y = x @ kernel
            else:
                which = np.asarray(batch.column(rest.index(by)))
                y = np.empty((n, columns))
                for i in np.unique(which):
                    y[which == i] = x[which == i] @ kernel[i]
            if bias is not None:
                y = y + bias
            out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * columns, pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], out], [*rest, "x"])

    few = rows.select(*rest, F.col("x").cast("array<double>").alias("x"))
    return few.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema.fields))


def reduced(rows: DataFrame, keys: list[str], width: int, how, weight: Column | None = None) -> DataFrame:
    """(keys, x): ``how`` (sum, avg, max) of each component over the rows of a key, each times ``weight``."""
    term = (lambda i: F.col("x")[i]) if weight is None else (lambda i: weight * F.col("x")[i])
    return rows.groupBy(*keys).agg(*(how(term(i)).alias(f"_{i}") for i in range(width))).select(*keys, F.array(*(F.col(f"_{i}") for i in range(width))).alias("x"))


@dataclass
class Blocks:
    """Rows in blocks: ``table`` has one row a block, (_block, _ids, a list for each column); ends are places in _ids."""

    table: DataFrame
    count: int
    rows: int
    ends: list[str]


def blocked(rows: DataFrame, order: list[str], ends: list[str], rest: list[str], width: int) -> Blocks:
    """``rows`` in the order of ``order``, cut into blocks for vectors of ``width`` at columns ``ends``; written once.

    Rows near each other in that order mostly share ends, so that few vectors are asked for by several blocks.  The rows of a
    hub are over many blocks.  Rows with a null end are left out.
    """
    from graphloom.operators.adjacency import saved

    most = max(1, BLOCK // (max(1, width) * len(ends)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    if odd := {kinds[c] for c in ends} - {"tinyint", "smallint", "int", "bigint"}:
        raise TypeError(f"ids are whole numbers, not {', '.join(odd)}")
    few = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ends)).select(*(F.col(c).cast("long").alias(c) for c in ends), *rest)

    def block(at: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        n, lists = table.num_rows, []
        coded = pa.concat_arrays([chunk for c in ends for chunk in table[c].chunks]).dictionary_encode()
        for values in (coded.dictionary, *(coded.indices[i * n : (i + 1) * n] for i in range(len(ends))), *(pa.concat_arrays(table[c].chunks) for c in rest)):
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists], ["_block", "_ids", *ends, *rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, most - n)
                held.append(taken)
                n, batch = n + taken.num_rows, batch.slice(taken.num_rows)
                if n == most:
                    yield block(at, held)
                    at, held, n = at + 1, [], 0
        if n:
            yield block(at, held)

    schema = ", ".join(["_block long, _ids array<long>", *(f"`{c}` array<int>" for c in ends), *(f"`{c}` array<{kinds[c]}>" for c in rest)])
    table = saved(few.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), maxRecordsPerFile=4)  # a reader holds a file's rows at once
    count, n = table.agg(F.count("*"), F.coalesce(F.sum(F.size(ends[0])), F.lit(0))).first()
    return Blocks(table, count, n, ends)


def sums(blocks: Blocks, end: str) -> DataFrame:
    """(id, d): the sum of column w over the rows that have the id at ``end``; 0 for ids at other ends alone."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, at, w = (batch.column(c)[row].values for c in range(3))
                d = np.bincount(np.asarray(at), np.asarray(w.fill_null(0.0)), len(ids))
                yield pa.RecordBatch.from_arrays([ids, pa.array(d)], ["id", "d"])

    return blocks.table.select("_ids", end, "w").mapInArrow(run, "id long, d double").groupBy("id").agg(F.sum("d").alias("d"))


def over(blocks: Blocks, x: DataFrame, width: int, run: Callable[[dict, np.ndarray, list[np.ndarray], np.ndarray], pa.Table], schema: str, null: float = np.nan) -> DataFrame:
    """``run``(columns, rows, places, vectors) of each block: the block's rows joined with x(id, x) at each of its ends.

    rows are the block's rows that have vectors (repeated where an id has several), places[i] their vectors' at end i;
    ``null`` stands for null components.
    """
    ends = blocks.ends
    asked = blocks.table.select(F.col("_block").alias("_for"), F.explode("_ids").alias("id"))
    found = asked.join(x.where("x IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")), "id").select("_for", "id", "x")

    def each(block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows or not found.num_rows:
            return run({}, np.zeros(0, np.int64), [np.zeros(0, np.int64)] * len(ends), np.zeros((0, width)))
        columns = {c: pa.concat_arrays([chunk.flatten() for chunk in block[c].chunks]) for c in block.column_names if c != "_block"}
        have = np.asarray(found["id"])
        values = pa.concat_arrays([chunk.flatten() for chunk in found["x"].chunks])
        vectors = np.asarray(values.fill_null(null) if values.null_count else values).reshape(len(have), width)
        order = np.argsort(have, kind="stable")
        have = have[order]
        ids = np.asarray(columns["_ids"])
        first = np.searchsorted(have, ids, "left")
        times = np.searchsorted(have, ids, "right") - first
        rows, places = np.arange(len(columns[ends[0]])), []
        for c in ends:
            at = np.asarray(columns[c])[rows]
            n = times[at]
            if not (n == 1).all():
                again = np.repeat(np.arange(len(at)), n)
                rows, places, at = rows[again], [p[again] for p in places], at[again]
                step = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            else:
                step = 0
            places.append(first[at] + step)
        return run(columns, rows, [order[p] for p in places], vectors)

    count = max(1, blocks.count)
    left, right = blocks.table.repartition(count, "_block"), found.repartition(count, "_for")
    return left.groupBy("_block").cogroup(right.groupBy("_for")).applyInArrow(each, schema)


def edge_blocks(adj: DataFrame, width: int) -> Blocks:
    """Blocks of adj(src, dst, w) for :func:`spmm`, which several products can share."""
    return blocked(adj.where("w IS NOT NULL AND src IS NOT NULL").select(F.col("src").cast("long").alias("src"), "dst", F.col("w").cast("double").alias("w")), ["src", "dst"], ["dst"], ["src", "w"], width)


def spmm(adj: DataFrame | Blocks, x: DataFrame, width: int, nodes: DataFrame | None = None) -> DataFrame:
    """Sparse times dense: (id, x); with ``nodes`` rows without entries are zero.

    A block of edges gives a sum for each of its rows; a row that lies in several blocks gets them added.
    """
    blocks = adj if isinstance(adj, Blocks) else edge_blocks(adj, width)
    step = max(1, GATHER // max(1, width))

    def multiply(columns, rows, places, vectors):
        if not len(rows):
            return pa.table({"src": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64()))})
        src, w = (np.asarray(columns[c])[rows] for c in ("src", "w"))
        heads = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        out = np.zeros((len(heads), width))
        for a in range(0, len(src), step):
            b = min(a + step, len(src))
            lo, hi = np.searchsorted(heads, a, "right") - 1, np.searchsorted(heads, b, "left")
            terms = vectors[places[0][a:b]] * w[a:b, None]
            out[lo:hi] += np.add.reduceat(terms, np.maximum(heads[lo:hi], a) - a, axis=0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(heads) + 1) * width, pa.int32()), pa.array(out.ravel()))
        return pa.table({"src": pa.array(src[heads]), "x": lists})

    out = reduced(over(blocks, x, width, multiply, "src long, x array<double>", 0.0), ["src"], width, F.sum).withColumnRenamed("src", "id")
    return out if nodes is None else on(nodes.select("id"), out, ["id"], width)


def on(keys: DataFrame, rows: DataFrame, names: list[str], width: int, empty: float = 0.0) -> DataFrame:
    """A row for each of ``keys``: that of ``rows``, or ``empty`` in each place."""
    return keys.join(rows, names, "left").withColumn("x", F.coalesce("x", zeros(width, empty)))


def plus(x: Column | str, y: np.ndarray | Column) -> Column:
    """The sum of two vectors, of which one may be a small array that the caller holds."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.array(*(F.lit(float(v)) for v in y)) if isinstance(y, np.ndarray) else y
    return F.zip_with(x, y, lambda a, b: a + b)


def activated(rows: DataFrame, name: str | None) -> DataFrame:
    """The activation on x; softmax is over the vector."""
    name = activations.check(name)
    if name == "linear":
        return rows
    if name != "softmax":
        return rows.withColumn("x", F.transform("x", lambda v: activations.scalar(name, v)))
    e = F.transform("x", lambda v: F.exp(v - F.array_max("x")))
    rows = rows.withColumn("x", e).withColumn("_sum", F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    return rows.withColumn("x", F.transform("x", lambda v: v / F.col("_sum"))).drop("_sum")


def normalized(rows: DataFrame) -> DataFrame:
    """x over its norm, or over 1e-7 where that is greater."""
    rows = rows.withColumn("_norm", F.greatest(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)), F.lit(1e-7)))
    return rows.withColumn("x", F.transform("x", lambda v: v / F.col("_norm"))).drop("_norm")
