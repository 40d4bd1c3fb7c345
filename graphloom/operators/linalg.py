"""Products, reductions and gathers over long tables.

Adjacency (src, dst, w), features (id, k, v), kernel (k, j, v), bias (j, v).  Every product is an equi-join and a sum
with map-side combine.  A kernel is broadcast only where it has at most KERNEL entries; a larger one is joined by shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import activations
from graphloom.operators import wide

#: Entries (24 bytes each) of a weight table that may be broadcast: 24 MB.
KERNEL = 1 << 20


def weights(spark: SparkSession, block: np.ndarray, names: str = "kj") -> DataFrame:
    """A small array that the caller holds, as a table of its places and values, broadcast if it is small enough."""
    block = np.asarray(block, dtype=np.float64)
    places = np.indices(block.shape).reshape(block.ndim, -1)
    rows = list(zip(*(p.tolist() for p in places), block.ravel().tolist(), strict=True))
    table = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", v double")
    return F.broadcast(table) if block.size <= KERNEL else table


def product(a: DataFrame, b: DataFrame, on: str, keep_a: list[str], keep_b: list[str]) -> DataFrame:
    """Sum over ``on`` of a.v * b.v by the columns that are kept: ``dot`` of long tables."""
    left = a.select(*keep_a, on, F.col("v").alias("_a"))
    right = b.select(*keep_b, on, F.col("v").alias("_b"))
    return left.join(right, on).groupBy(*keep_a, *keep_b).agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(i, k, v) times b(k, j, v): (i, j, v)."""
    return product(a, b, "k", ["i"], ["j"])


def dot_vec(a: DataFrame, x: DataFrame) -> DataFrame:
    """a(i, k, v) times x(k, v): (i, v)."""
    return product(a, x, "k", ["i"], [])


def spmm(adj: DataFrame, x: DataFrame, nodes: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """Sparse times dense: (id, k, v).  Duplicate entries all count; with ``nodes`` rows without entries are zero.

    An edge is one row with the whole vector of its end through the join (:mod:`graphloom.operators.wide`).
    """
    width = width if width is not None else wide.width_of(x) or 0
    if not width:
        return x.select("id", "k", "v").where("false")
    return wide.unpacked(wide.spmm(adj, wide.packed(x, ["id"], width), width, nodes), ["id"], "k")


def sparse_matmul_dense(adj: DataFrame, x: DataFrame, n_rows: int, n_cols: int, nodes: DataFrame | None = None) -> DataFrame:
    """:func:`spmm` after checks: an entry outside the shape is an IndexError, a row of ``x`` beyond it a ValueError."""
    if adj.where((F.col("dst") < 0) | (F.col("dst") >= n_cols) | (F.col("src") < 0) | (F.col("src") >= n_rows)).limit(1).count():
        raise IndexError("an entry lies outside the shape")
    if (x.agg(F.max("id")).first()[0] or 0) + 1 > n_cols:
        raise ValueError("the dense side has more rows than the sparse side has columns")
    return spmm(adj, x, nodes)


def spmv(adj: DataFrame, x: DataFrame) -> DataFrame:
    """Sparse times vector x(id, v): (id, v), rows without entries left out."""
    return adj.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def softmax(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Max-shifted softmax of ``value`` over the rows with equal keys; repeated rows are separate logits.

    Both reductions combine map-side, so a key with many rows isn't gathered as a window would."""
    top = rows.groupBy(*keys).agg(F.max(value).alias("_top"))
    shifted = rows.join(top, keys).withColumn("_e", F.exp(F.col(value) - F.col("_top")))
    total = shifted.groupBy(*keys).agg(F.sum("_e").alias("_total"))
    return shifted.join(total, keys).withColumn(value, F.col("_e") / F.col("_total")).drop("_top", "_e", "_total")


def sparse_softmax(adj: DataFrame) -> DataFrame:
    """Softmax over the stored entries of each row."""
    return softmax(adj, ["src"], "w")


def l2_normalize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """v over the row's norm, or over 1e-7 where that is greater."""
    norm = rows.groupBy(*keys).agg(F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.lit(1e-7)).alias("_norm"))
    return rows.join(norm, keys).withColumn("v", F.col("v") / F.col("_norm")).drop("_norm")


def normalization(rows: DataFrame, keys: list[str], normalize: str | None = "l2") -> DataFrame:
    if normalize in (None, "none", "None"):
        return rows
    if normalize != "l2":
        raise ValueError(f"unknown normalisation {normalize!r}")
    return l2_normalize(rows, keys)


def add_bias(rows: DataFrame, bias: DataFrame | None, col: str = "j") -> DataFrame:
    if bias is None:
        return rows
    return rows.join(bias.select(col, F.col("v").alias("_b")), col).withColumn("v", F.col("v") + F.col("_b")).drop("_b")


def activate(rows: DataFrame, name: str | None, keys: list[str], value: str = "v") -> DataFrame:
    """The activation on ``value``; softmax is over the rows with equal keys."""
    if activations.check(name) == "softmax":
        return softmax(rows, keys, value)
    return rows.withColumn(value, activations.scalar(name, F.col(value)))


def dense(x: DataFrame, kernel: DataFrame, bias: DataFrame | None = None, activation: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """act(x W + b): (keys, j, v) of x(keys, k, v)."""
    keys = keys or ["id"]
    return activate(add_bias(product(x, kernel, "k", keys, ["j"]), bias), activation, keys)


def gather(rows: DataFrame, out: DataFrame | None, final: bool = True, nodes: DataFrame | None = None) -> DataFrame:
    """The rows of out(pos, id), repeats kept, with their pos; all rows where the layer isn't final or the list is empty."""
    if not final or out is None or not out.limit(1).count():
        return rows
    if nodes is not None:
        from graphloom.sources.graph import check_ids

        check_ids(out, nodes)
    return out.join(rows, "id")


def concat(blocks: list[DataFrame], widths: list[int], col: str = "j") -> DataFrame:
    """Blocks side by side: each block's columns go behind those before."""
    at, out = 0, None
    for block, width in zip(blocks, widths, strict=True):
        moved = block.withColumn(col, (F.col(col) + at).cast("int"))
        out = moved if out is None else out.unionByName(moved)
        at += width
    return out


def average(blocks: list[DataFrame], keys: list[str]) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out.groupBy(*keys).agg((F.sum("v") / len(blocks)).alias("v"))


def to_long(table: DataFrame, id_col: str, vector: Column) -> DataFrame:
    """(id, k, v) of a column of arrays."""
    return table.select(F.col(id_col).alias("id"), F.posexplode(vector).alias("k", "v")).withColumn("v", F.col("v").cast("double"))


def to_arrays(rows: DataFrame, col: str = "k") -> DataFrame:
    """(id, x): the values in the order of their column."""
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(col, "v"))), lambda s: s["v"]).alias("x"))
