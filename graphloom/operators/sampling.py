"""Aggregation of sampled neighbourhoods, of one kind of node (GraphSAGE) and of several (HinSAGE).

A sampled tensor is a table (b, h, s, k, v): batch row, head, sample, feature; or (b, h, s, x) with whole vectors, which
is what layers hand on.  With several relations there is r too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import activations
from graphloom.operators import wide
from graphloom.operators.adjacency import saved
from graphloom.operators.convolution import glorot

NAN = float("nan")
KEY = ["b", "h"]


def shares(width: int, groups: int) -> list[int]:
    """Columns of each group: an equal part, what is over to the first."""
    return [width // groups + (width % groups if g == 0 else 0) for g in range(groups)]


class Aggregator:
    """weights: one kernel a group.  call() puts the groups side by side, adds the bias and activates."""

    def __init__(self, output_dim: int, bias: bool = True, act: str = "relu"):
        self.output_dim, self.has_bias, self.act = output_dim, bias, activations.check(act)
        self.w_group: list[np.ndarray] = []
        self.bias: np.ndarray | None = None

    def build(self, dims: list[int], seed: int = 0):
        """dims: rows of each group's kernel (for group 0 samples times features)."""
        rng = np.random.default_rng(seed)
        self.w_group = [glorot(rng, d, n) for d, n in zip(dims, shares(self.output_dim, len(dims)), strict=True)]
        self.bias = np.zeros(self.output_dim) if self.has_bias else None
        return self

    def group_aggregate(self, x: DataFrame, g: int, heads: DataFrame | None = None, width: int | None = None) -> DataFrame:
        raise NotImplementedError

    def flattened(self, x: DataFrame, width: int | None) -> DataFrame:
        """(b, h, x) of group 0: the samples of a head one behind the other."""
        width = width if width is not None else wide.width_of(x) or 1
        rows = len(self.w_group[0])
        if rows != width:
            long = wide.unpacked(x, [*KEY, "s"], "k") if "x" in x.columns else x
            x = wide.packed(long.select(*KEY, (F.col("s") * width + F.col("k")).alias("k"), "v"), KEY, rows)
        return wide.matmul(wide.packed(x, KEY, rows), self.w_group[0])

    def call(self, groups: list[DataFrame], heads: DataFrame | None = None) -> DataFrame:
        """(b, h, j, v)."""
        return wide.unpacked(self.vectors(groups, heads), KEY)

    def vectors(self, groups: list[DataFrame], heads: DataFrame | None = None) -> DataFrame:
        """(b, h, x) for ``heads``, or the heads of group 0."""
        parts = shares(self.output_dim, len(groups))
        for g, part in enumerate(parts):
            if self.w_group[g].shape[1] != part:
                raise ValueError(f"group {g} has {self.w_group[g].shape[1]} columns, its share is {part}")
        blocks = [self.group_aggregate(x, g, heads) for g, x in enumerate(groups)]
        heads = groups[0].select(*KEY).distinct() if heads is None else heads.select(*KEY)
        return self.finished(beside(heads, blocks, parts, [0.0, *[self.empty] * (len(blocks) - 1)]))

    #: What a head without samples has in a group's columns.
    empty = 0.0

    def finished(self, rows: DataFrame) -> DataFrame:
        if self.bias is not None:
            if len(self.bias) != self.output_dim:
                raise ValueError("the bias is not as wide as the output")
            rows = rows.withColumn("x", wide.plus("x", np.asarray(self.bias)))
        return wide.activated(rows, self.act)


def beside(heads: DataFrame, blocks: list[DataFrame], parts: list[int], empty: list[float]) -> DataFrame:
    """(b, h, x) for each head: the blocks' vectors one behind the other, ``empty`` where a block has none."""
    out = heads
    for i, block in enumerate(blocks):
        out = out.join(block.withColumnRenamed("x", f"_x{i}"), KEY, "left")
    return out.select(*KEY, F.concat(*(F.coalesce(f"_x{i}", wide.zeros(n, e)) for i, (n, e) in enumerate(zip(parts, empty, strict=True)))).alias("x"))


class MeanAggregator(Aggregator):
    """The mean of a group's samples times its kernel; of no samples NaN."""

    empty = NAN

    def group_aggregate(self, x, g, heads=None, width=None):
        if g == 0:
            return self.flattened(x, width)
        n = len(self.w_group[g])
        return wide.matmul(wide.reduced(wide.packed(x, [*KEY, "s"], n), KEY, n, F.avg), self.w_group[g])


class PoolingAggregator(Aggregator):
    """relu(x W_pool + b_pool) of each sample, pooled, times the group's kernel."""

    empty = 0.0

    def __init__(self, output_dim, bias=True, act="relu"):
        super().__init__(output_dim, bias, act)
        self.hidden_dim = output_dim
        self.w_pool: dict[int, np.ndarray] = {}
        self.b_pool: dict[int, np.ndarray] = {}

    def build(self, dims, seed=0):
        rng = np.random.default_rng(seed)
        parts = shares(self.output_dim, len(dims))
        self.w_group = [glorot(rng, dims[0], parts[0])]
        for g in range(1, len(dims)):
            self.w_pool[g], self.b_pool[g] = glorot(rng, dims[g], self.hidden_dim), np.zeros(self.hidden_dim)
            self.w_group.append(glorot(rng, self.hidden_dim, parts[g]))
        self.bias = np.zeros(self.output_dim) if self.has_bias else None
        return self

    pool = staticmethod(F.max)

    def group_aggregate(self, x, g, heads=None, width=None):
        if g == 0:
            return self.flattened(x, width)
        hidden = wide.matmul(wide.packed(x, [*KEY, "s"], len(self.w_pool[g])), self.w_pool[g], self.b_pool[g])
        pooled = wide.reduced(wide.activated(hidden, "relu"), KEY, self.w_pool[g].shape[1], self.pool)
        return wide.matmul(pooled, self.w_group[g])


class MaxPoolingAggregator(PoolingAggregator):
    pass


class MeanPoolingAggregator(PoolingAggregator):
    empty = NAN
    pool = staticmethod(F.avg)


class AttentionalAggregator(Aggregator):
    """Attention of the own node over itself and its samples; one pair of attention vectors for all groups."""

    def __init__(self, output_dim, bias=True, act="relu"):
        super().__init__(output_dim, bias, act)
        self.w_attn_s: np.ndarray | None = None
        self.w_attn_g: np.ndarray | None = None

    def build(self, dims, seed=0):
        super().build(dims, seed)
        rng = np.random.default_rng(seed + 1)
        width = self.w_group[-1].shape[1]
        bound = np.sqrt(6.0 / (width + 1))
        self.w_attn_s, self.w_attn_g = rng.uniform(-bound, bound, width), rng.uniform(-bound, bound, width)
        return self

    def group_aggregate(self, x_self, x_g, g, out_size=None):
        """x_self has one sample a head; the candidates are it and the samples.  The scores are columns of the same matrix products."""
        kernel = self.w_group[g]
        n, units = kernel.shape
        both = np.concatenate([kernel, kernel @ self.w_attn_g[:, None], kernel @ self.w_attn_s[:, None]], axis=1)
        own = wide.matmul(wide.packed(x_self.withColumn("s", F.lit(-1).cast("long")), [*KEY, "s"], n), both)
        near = wide.matmul(wide.packed(x_g.withColumn("s", F.col("s").cast("long")), [*KEY, "s"], n), both)
        mine = own.select(*KEY, F.col("x")[units + 1].alias("_s"))
        logits = own.unionByName(near).join(mine, KEY).withColumn("_e", activations.scalar("leaky_relu", F.col("_s") + F.col("x")[units])).drop("_s")
        top = logits.groupBy(*KEY).agg(F.max("_e").alias("_top"))
        p = F.exp(F.col("_e") - F.col("_top"))
        sums = logits.join(top, KEY).withColumn("_p", p).withColumn("x", F.concat(F.slice("x", 1, units), F.array(F.lit(1.0))))
        out = wide.reduced(sums, KEY, units + 1, F.sum, F.col("_p"))
        return out.select(*KEY, F.transform(F.slice("x", 1, units), lambda v: v / F.col("x")[units]).alias("x"))

    def call(self, x_self, x_groups, heads=None):
        return wide.unpacked(self.vectors([x_self, *x_groups], heads), KEY)

    def vectors(self, groups, heads=None):
        x_self, *x_groups = groups
        x_groups = x_groups or [x_self]
        parts = shares(self.output_dim, len(x_groups))
        for g, part in enumerate(parts):
            if self.w_group[g].shape[1] != part:
                raise ValueError(f"group {g} has {self.w_group[g].shape[1]} columns, its share is {part}")
        blocks = [self.group_aggregate(x_self, x, g, n) for g, (x, n) in enumerate(zip(x_groups, parts, strict=True))]
        return self.finished(blocks[0] if len(blocks) == 1 else beside(x_self.select(*KEY).distinct(), blocks, parts, [0.0] * len(blocks)))


class GraphSAGE:
    """Layers over nested neighbourhoods: hop i is x(b, h, k, v) with heads h; head h of hop i has as samples the heads
    h * s to h * s + s - 1 of hop i + 1, s = samples[i].  The result is (b, h, j, v), normalised."""

    def __init__(self, layer_sizes, samples, generator=None, aggregator=MeanAggregator, bias=True, dropout=0.0, normalize="l2", activations=None):  # noqa: A002
        if normalize not in ("l2", "none", "None", None):
            raise ValueError(f"unknown normalisation {normalize!r}")
        if len(layer_sizes) != len(samples):
            raise ValueError("as many sample counts as layers are needed")
        acts = ["relu"] * (len(layer_sizes) - 1) + ["linear"] if activations is None else list(activations)
        if len(acts) != len(layer_sizes):
            raise ValueError("as many activations as layers are needed")
        self.samples, self.normalize, self.dropout, self.generator = list(samples), normalize, dropout, generator
        self.layer_sizes, self.layers = list(layer_sizes), [aggregator(n, bias, a) for n, a in zip(layer_sizes, acts, strict=True)]

    def build(self, input_dim: int, seed: int = 0):
        """One set of weights a layer, used at every hop: group 0 is the node itself."""
        for i, layer in enumerate(self.layers):
            layer.build([input_dim] if isinstance(layer, AttentionalAggregator) else [input_dim, input_dim], seed + i)
            input_dim = layer.output_dim
        return self

    def __call__(self, xin: list[DataFrame]) -> DataFrame:
        if not isinstance(xin, list):
            raise TypeError("a list with a table for each hop is needed")
        if len(xin) != len(self.layers) + 1:
            raise ValueError(f"{len(self.layers) + 1} tables are needed")
        width = wide.width_of(xin[0]) or 1
        h = [wide.packed(x, KEY, width) for x in xin]
        for depth, layer in enumerate(self.layers):
            after = []
            for i in range(len(h) - 1):
                n = self.samples[i]
                near = h[i + 1].select("b", F.expr(f"h div {n}").cast("long").alias("h"), (F.col("h") % n).alias("s"), "x")
                own = h[i].select("b", F.col("h").cast("long").alias("h"), F.lit(0).cast("long").alias("s"), "x")
                after.append(layer.vectors([own, near], own.select(*KEY)))
            last = depth + 1 == len(self.layers)
            h = after if last else [saved(x) for x in after]  # each is read twice by the next layer
        rows = h[0] if self.normalize in (None, "none", "None") else wide.normalized(h[0])
        return wide.unpacked(rows, KEY)


class MeanHinAggregator:
    """Half the columns from the node itself, half the mean over all relations of the relation's mean sample times its kernel (none: 0)."""

    def __init__(self, output_dim: int, nr: int, activation: str = "relu", bias: bool = True):
        assert output_dim % 2 == 0, "output_dim is even"
        self.output_dim, self.nr, self.act, self.has_bias = output_dim, nr, activations.check(activation), bias
        self.half = output_dim // 2
        self.w_self: np.ndarray | None = None
        self.w_neigh: np.ndarray | None = None
        self.bias: np.ndarray | None = None

    def build(self, d_self: int, d_neigh: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w_self, self.w_neigh = glorot(rng, d_self, self.half), glorot(rng, self.nr, d_neigh, self.half)
        self.bias = np.zeros(self.output_dim) if self.has_bias else None
        return self

    def call(self, x_self: DataFrame, x_neigh: DataFrame, relations: int | None = None) -> DataFrame:
        """x_self(b, h, k, v), x_neigh(r, b, h, s, k, v): (b, h, j, v)."""
        if relations is not None and relations != self.nr or x_neigh.where(F.col("r") >= self.nr).limit(1).count():
            raise ValueError(f"{self.nr} relations are expected")
        rows = self.vectors(x_self, x_neigh)
        return wide.unpacked(rows, KEY)

    def vectors(self, x_self: DataFrame, x_neigh: DataFrame) -> DataFrame:
        own = wide.matmul(wide.packed(x_self, KEY, len(self.w_self)), self.w_self)
        n = self.w_neigh.shape[1]
        mean = wide.reduced(wide.packed(x_neigh, ["r", *KEY, "s"], n), ["r", *KEY], n, F.avg)
        each = wide.matmul(mean, np.asarray(self.w_neigh), by="r")
        near = wide.reduced(each, KEY, self.half, F.sum, F.lit(1.0 / self.nr))
        rows = beside(x_self.select(*KEY).distinct(), [own, near], [self.half, self.half], [0.0, 0.0])
        if self.bias is not None:
            rows = rows.withColumn("x", wide.plus("x", np.asarray(self.bias)))
        return wide.activated(rows, self.act)


class HinSAGE:
    """Layers of MeanHinAggregator: the node's columns pass through them, each with raw neighbourhoods of its own."""

    def __init__(self, layer_sizes, generator=None, nr=1, activation="relu", bias=True, normalize="l2", activations=None):  # noqa: A002
        acts = [activation] * (len(layer_sizes) - 1) + ["linear"] if activations is None else list(activations)
        if len(acts) != len(layer_sizes):
            raise ValueError("as many activations as layers are needed")
        self.generator, self.normalize = generator, normalize
        self.layers = [MeanHinAggregator(n, nr, a, bias) for n, a in zip(layer_sizes, acts, strict=True)]

    def build(self, d_self: int, d_neigh: int, seed: int = 0):
        for i, layer in enumerate(self.layers):
            layer.build(d_self, d_neigh, seed + i)
            d_self = layer.output_dim
        return self

    def __call__(self, x_self: DataFrame, neighbourhoods: list[DataFrame]) -> DataFrame:
        if len(neighbourhoods) != len(self.layers):
            raise ValueError("one stack of neighbourhoods a layer is needed")
        if self.layers[0].w_self is None:
            raise ValueError("build() comes first")
        h = x_self
        for layer, near in zip(self.layers, neighbourhoods, strict=True):
            if near.where(F.col("r") >= layer.nr).limit(1).count():
                raise ValueError(f"{layer.nr} relations are expected")
            h = layer.vectors(h, near)
        rows = h if self.normalize in (None, "none", "None") else wide.normalized(h)
        return wide.unpacked(rows, KEY)
