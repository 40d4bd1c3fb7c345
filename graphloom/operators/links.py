"""Scores and embeddings of node pairs."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.functions import activations
from graphloom.operators import wide

#: Element-wise embeddings of two arrays.
ELEMENTS = {
    "l1": lambda a, b: np.abs(a - b),
    "l2": lambda a, b: (a - b) * (a - b),
    "mul": lambda a, b: a * b,
    "hadamard": lambda a, b: a * b,
    "avg": lambda a, b: (a + b) * 0.5,
}


def link_inference(output_dim=1, output_act="linear", edge_embedding_method="ip", clip_limits=None, name="link_inference", kernel=None, bias=None):
    """f(pairs, embeddings) -> (pos, j, v) for pairs(pos, src, dst) and embeddings(id, k, v) or (id, x).

    ip and dot: the inner product, of width 1.  l1, l2 (squares), mul or hadamard, avg and concat are followed by kernel
    and bias.  Then the activation and, with ``clip_limits``, a clipped slope of 0.1 outside them.
    """
    method = edge_embedding_method
    activations.check(output_act)
    if method in ("ip", "dot"):
        if output_dim != 1:
            warnings.warn("an inner product has one column", stacklevel=2)
            output_dim = 1
    elif method not in ELEMENTS and method != "concat":
        raise NotImplementedError(f"unknown edge embedding {method!r}")
    elif kernel is None:
        raise ValueError(f"{method} needs a kernel")
    if kernel is not None:
        kernel = np.asarray(kernel, dtype=np.float64)
        if kernel.ndim != 2 or kernel.shape[1] != output_dim:
            raise ValueError(f"the kernel has to have {output_dim} columns")
    if bias is not None:
        bias = np.asarray(bias, dtype=np.float64)
        if bias.shape != (output_dim,):
            raise ValueError(f"the bias has to have {output_dim} entries")
    print(f"link_inference: {method} edge embedding, {output_act} activation")

    def finish(rows: DataFrame) -> DataFrame:
        rows = wide.unpacked(wide.activated(rows, output_act), ["pos"])
        if clip_limits is not None:
            rows = rows.withColumn("v", activations.leaky_clipped(F.col("v"), clip_limits[0], clip_limits[1]))
        return rows

    def joined(pairs: DataFrame, nodes: DataFrame, width: int, embed, columns: int) -> DataFrame:
        """(pos, x) with ``columns`` in x, what ``embed`` makes of the vectors of both ends; a block of pairs gets each vector once."""
        kind = dict(pairs.dtypes)["pos"]
        blocks = wide.blocked(pairs, ["src", "dst"], ["src", "dst"], ["pos"], width)
        step = max(1, wide.GATHER // max(1, width))

        def run(held, rows, places, vectors):
            out = np.empty((len(rows), columns))
            for a in range(0, len(rows), step):
                first, second = (vectors[p[a : a + step]] for p in places)
                out[a : a + step] = embed(first, second)
            pos = held["pos"].take(pa.array(rows)) if held else pa.array([], pos_type)
            return pa.table({"pos": pos, "x": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * columns, pa.int32()), pa.array(out.ravel()))})

        pos_type = to_arrow_type(pairs.schema["pos"].dataType)
        return wide.over(blocks, nodes, width, run, f"pos {kind}, x array<double>")

    def edges(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
        width = wide.width_of(embeddings)
        vectors = wide.packed(embeddings, ["id"], width or 1)
        if method == "concat":
            half = len(kernel) // 2
            if len(kernel) % 2:
                raise ValueError("a concatenation needs an even number of kernel rows")
            # the kernel is split where the second node's columns begin: each node is multiplied once, pairs add the products
            if width is not None and width != half:
                raise ValueError(f"embeddings have {width} columns, the kernel {len(kernel)} rows")
            sides = wide.matmul(vectors, np.concatenate([kernel[:half], kernel[half:]], axis=1))
            rows = joined(pairs, sides, 2 * output_dim, lambda a, b: a[:, :output_dim] + b[:, output_dim:], output_dim)
            return finish(rows if bias is None else rows.withColumn("x", wide.plus("x", bias)))
        if method in ("ip", "dot"):
            return finish(joined(pairs, vectors, width or 1, lambda a, b: np.einsum("ij,ij->i", a, b)[:, None], 1))
        if width is not None and width != len(kernel):
            raise ValueError(f"embeddings have {width} columns, the kernel {len(kernel)} rows")
        element, added = ELEMENTS[method], 0.0 if bias is None else bias
        return finish(joined(pairs, vectors, width or len(kernel), lambda a, b: element(a, b) @ kernel + added, output_dim))

    return edges


def link_classification(output_dim=1, output_act="sigmoid", edge_embedding_method="ip"):
    """Without a kernel, so that only the inner product works."""
    return link_inference(output_dim, output_act, edge_embedding_method, name="link_classification")


def link_regression(output_dim=1, clip_limits=None, edge_embedding_method="ip"):
    return link_inference(output_dim, "linear", edge_embedding_method, clip_limits, name="link_regression")
