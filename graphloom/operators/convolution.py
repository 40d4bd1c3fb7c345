"""Graph convolution and personalised-PageRank propagation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import activations
from graphloom.operators import adjacency as adj_ops
from graphloom.operators import wide
from graphloom.operators.linalg import gather
from graphloom.sources.graph import FullBatchNodeGenerator

#: Propagation steps between written tables.
CADENCE = 5


def glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    bound = np.sqrt(6.0 / (shape[-2] + shape[-1]))
    return rng.uniform(-bound, bound, shape)


class GraphConvolution:
    """act((A X) W + b), then the rows asked for.  Multiplies by W first where that leaves fewer columns to shuffle."""

    def __init__(self, units: int, activation: str | None = None, use_bias: bool = True, final_layer: bool = False):
        self.units, self.activation, self.use_bias, self.final_layer = units, activations.check(activation), use_bias, final_layer
        self.kernel: np.ndarray | None = None
        self.bias: np.ndarray | None = None

    def build(self, input_dim: int) -> GraphConvolution:
        self.kernel = np.zeros((input_dim, self.units))
        self.bias = np.zeros(self.units) if self.use_bias else None
        return self

    def call(self, features: DataFrame, adj: DataFrame, nodes: DataFrame, out_indices: DataFrame | None = None) -> DataFrame:
        """(id, j, v), with pos where rows are asked for.  features: (id, k, v) or (id, x)."""
        return gather(wide.unpacked(self.vectors(features, adj, nodes), ["id"]), out_indices, self.final_layer, nodes)

    def vectors(self, features: DataFrame, adj: DataFrame, nodes: DataFrame, width: int | None = None) -> DataFrame:
        """(id, x)."""
        width = wide.width_of(features) if width is None else width
        if self.kernel is None:
            self.build(width or 0)
        if width is not None and width != len(self.kernel):
            raise ValueError(f"features have {width} columns, the kernel {len(self.kernel)} rows")
        bias = self.bias if self.use_bias else None
        if width is None:
            rows = nodes.select("id", wide.zeros(self.units).alias("x"))
            rows = rows if bias is None else rows.withColumn("x", wide.plus("x", bias))
        elif self.units < width:
            rows = wide.spmm(adj, wide.matmul(wide.packed(features, ["id"], width), self.kernel), self.units, nodes)
            rows = rows if bias is None else rows.withColumn("x", wide.plus("x", bias))
        else:
            rows = wide.matmul(wide.spmm(adj, wide.packed(features, ["id"], width), width, nodes), self.kernel, bias)
        return wide.activated(rows, self.activation)


class GCN:
    """A stack of graph convolutions over a full-batch generator; dropout has no effect."""

    def __init__(self, layer_sizes, generator: FullBatchNodeGenerator, bias: bool = True, dropout: float = 0.0, activations=None):  # noqa: A002
        activations = ["relu"] * len(layer_sizes) if activations is None else list(activations)
        if len(activations) != len(layer_sizes):
            raise ValueError("as many activations as layers are needed")
        self.generator, self.dropout = generator, dropout
        self.layers = [GraphConvolution(n, a, bias, i == len(layer_sizes) - 1) for i, (n, a) in enumerate(zip(layer_sizes, activations, strict=True))]

    def build(self, input_dim: int, seed: int = 0) -> GCN:
        rng = np.random.default_rng(seed)
        for layer in self.layers:
            layer.build(input_dim)
            layer.kernel = glorot(rng, input_dim, layer.units)
            input_dim = layer.units
        return self

    def __call__(self, out_indices: DataFrame | None = None) -> DataFrame:
        g = self.generator
        adj = adj_ops.preprocess(g.adj, g.graph.nodes) if g.method == "none" else g.adj
        x, width = g.features, wide.width_of(g.features)
        if self.layers[0].kernel is None:
            self.build(width or 1)
        if len(self.layers) > 1:  # made once for all layers; a product is as wide as the narrower side of its layer
            adj = wide.edge_blocks(adj, max(min(a, b) for a, b in zip([width or 1, *(layer.units for layer in self.layers)], (layer.units for layer in self.layers), strict=False)))
        for layer in self.layers:
            x, width = layer.vectors(x, adj, g.graph.nodes, width), layer.units
        return gather(wide.unpacked(x, ["id"]), out_indices, self.layers[-1].final_layer, g.graph.nodes)

    def node_model(self):
        n, f = len(self.generator), wide.width_of(self.generator.features) or 1
        return (((n, f),), None)


class PPNPPropagationLayer:
    """A X, then the rows asked for."""

    def __init__(self, units: int, final_layer: bool = False):
        self.units, self.final_layer = units, final_layer

    def call(self, features: DataFrame, adj: DataFrame, nodes: DataFrame, out_indices: DataFrame | None = None) -> DataFrame:
        width = wide.width_of(features) or 1
        return gather(wide.unpacked(wide.spmm(adj, wide.packed(features, ["id"], width), width, nodes), ["id"], "k"), out_indices, self.final_layer, nodes)


def propagated(prop: DataFrame, x: DataFrame, adj: DataFrame | wide.Blocks, nodes: DataFrame, alpha: float, width: int) -> DataFrame:
    """(1 - alpha) A prop + alpha x of tables (id, x)."""
    step = wide.spmm(adj, prop, width, nodes).withColumnRenamed("x", "_step")
    both = step.join(x, "id", "left")
    return both.select("id", F.zip_with("_step", F.coalesce("x", wide.zeros(width)), lambda a, b: a * (1 - alpha) + b * alpha).alias("x"))


class APPNPPropagationLayer:
    def __init__(self, units: int, teleport_probability: float = 0.1, final_layer: bool = False):
        if not 0 <= teleport_probability <= 1:
            raise ValueError("teleport_probability lies between 0 and 1")
        self.units, self.teleport_probability, self.final_layer = units, teleport_probability, final_layer

    def call(self, prop: DataFrame, features: DataFrame, adj: DataFrame | wide.Blocks, nodes: DataFrame, out_indices: DataFrame | None = None) -> DataFrame:
        width = wide.width_of(features) or 1
        z = propagated(wide.packed(prop, ["id"], width), wide.packed(features, ["id"], width), adj, nodes, self.teleport_probability, width)
        return gather(wide.unpacked(z, ["id"], "k"), out_indices, self.final_layer, nodes)


class _DenseStack:
    def __init__(self, layer_sizes, activations, generator, bias=True, dropout=0.0, kernel_regularizer=None):
        if not isinstance(generator, FullBatchNodeGenerator):
            raise TypeError("a FullBatchNodeGenerator is needed")
        if len(layer_sizes) != len(activations):
            raise ValueError("as many activations as layers are needed")
        self.layer_sizes, self.activations = list(layer_sizes), list(activations)
        self.generator, self.bias, self.dropout, self.kernel_regularizer = generator, bias, dropout, kernel_regularizer
        self.kernels: list[np.ndarray] = []
        self.biases: list[np.ndarray] = []

    def build(self, input_dim: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.kernels, self.biases = [], []
        for n in self.layer_sizes:
            self.kernels.append(glorot(rng, input_dim, n))
            self.biases.append(np.zeros(n))
            input_dim = n
        return self

    def stack(self) -> DataFrame:
        """(id, x)."""
        x = self.generator.features
        width = wide.width_of(x) or 1
        if not self.kernels:
            self.build(width)
        x = wide.packed(x, ["id"], width)
        for kernel, bias, act in zip(self.kernels, self.biases, self.activations, strict=True):
            x = wide.activated(wide.matmul(x, kernel, bias if self.bias else None), act)
        return x


class PPNP(_DenseStack):
    def __call__(self, out_indices: DataFrame | None = None) -> DataFrame:
        return PPNPPropagationLayer(self.layer_sizes[-1], True).call(self.stack(), self.generator.adj, self.generator.graph.nodes, out_indices)


class APPNP(_DenseStack):
    def __init__(self, layer_sizes, activations, generator, bias=True, dropout=0.0, teleport_probability=0.1, kernel_regularizer=None, approx_iter=10):
        super().__init__(layer_sizes, activations, generator, bias, dropout, kernel_regularizer)
        if not isinstance(approx_iter, int) or isinstance(approx_iter, bool) or approx_iter <= 0:
            raise ValueError("approx_iter is a positive integer")
        if not 0 <= teleport_probability <= 1:
            raise ValueError("teleport_probability lies between 0 and 1")
        self.teleport_probability, self.approx_iter = teleport_probability, approx_iter

    def propagate(self, x: DataFrame, adj: DataFrame | wide.Blocks, k: int, nodes: DataFrame | None = None) -> DataFrame:
        """k steps from x; a written table every CADENCE steps keeps the lineage short."""
        nodes = self.generator.graph.nodes if nodes is None else nodes
        return propagate(x, adj, nodes, k, self.teleport_probability)

    def __call__(self, out_indices: DataFrame | None = None) -> DataFrame:
        g = self.generator
        x, adj = adj_ops.saved(self.stack()), wide.edge_blocks(g.adj, self.layer_sizes[-1])
        near = wide.packed(self.propagate(x, adj, self.approx_iter - 1), ["id"], self.layer_sizes[-1])
        return APPNPPropagationLayer(self.layer_sizes[-1], self.teleport_probability, True).call(near, x, adj, g.graph.nodes, out_indices)


def propagate(x: DataFrame, adj: DataFrame | wide.Blocks, nodes: DataFrame, k: int, alpha: float = 0.1) -> DataFrame:
    """k steps z = (1 - alpha) A z + alpha x from x: (id, k, v), or (id, x) where x is such a table."""
    as_it_was = "x" in x.columns
    width = wide.width_of(x) or 1
    x = wide.packed(x, ["id"], width)
    if k > 1:  # made once for all steps
        x, adj = adj_ops.saved(x), adj if isinstance(adj, wide.Blocks) else wide.edge_blocks(adj, width)
    z = held = x
    for step in range(1, k + 1):
        z = propagated(z, x, adj, nodes, alpha, width)
        if step % CADENCE == 0 and step < k:
            z, last = adj_ops.saved(z), held
            if last is not x:
                adj_ops.dropped(last)
            held = z
            adj_ops.forget_shuffles(z.sparkSession)
    return z if as_it_was else wide.unpacked(z, ["id"], "k")
