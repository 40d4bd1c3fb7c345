"""Graph attention.  Over edges alone wherever that is exactly the dense layer; a dense block of nodes only where it must be."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import activations
from graphloom.operators import wide
from graphloom.operators.adjacency import dropped, saved, spread
from graphloom.operators.linalg import gather

#: Nodes up to which rows are paired with all nodes (empty rows, weighted masks, saliency with nu).
DENSE = 5000


class GraphAttention:
    """Heads of attention over a graph: softmax of leaky_relu(s_i + t_j), with the mask -1e10 (1 - A) added, over all nodes.

    With 0/1 entries and one in each row at least, masked terms vanish and only edges are read.
    ``saliency_map_support`` reads delta and non_exist_edge instead of the mask.
    """

    sparse = False

    def __init__(self, units, attn_heads=1, attn_heads_reduction="concat", in_dropout_rate=0, attn_dropout_rate=0, activation="relu", use_bias=True, final_layer=False, saliency_map_support=False):
        if attn_heads_reduction not in ("concat", "average"):
            raise ValueError("attn_heads_reduction is concat or average")
        self.units, self.attn_heads, self.attn_heads_reduction = units, attn_heads, attn_heads_reduction
        self.in_dropout_rate, self.attn_dropout_rate = in_dropout_rate, attn_dropout_rate
        self.activation, self.use_bias, self.final_layer, self.saliency_map_support = activations.check(activation), use_bias, final_layer, saliency_map_support
        self.delta, self.non_exist_edge = 1.0, 0.0
        self.kernels: np.ndarray | None = None  # heads, features, units
        self.attn: np.ndarray | None = None  # heads, 2 (self, neighbour), units
        self.bias: np.ndarray | None = None  # heads, units

    def build(self, input_dim: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        bound = np.sqrt(6.0 / (input_dim + self.units))
        self.kernels = rng.uniform(-bound, bound, (self.attn_heads, input_dim, self.units))
        bound = np.sqrt(6.0 / (self.units + 1))
        self.attn = rng.uniform(-bound, bound, (self.attn_heads, 2, self.units))
        self.bias = np.zeros((self.attn_heads, self.units))
        return self

    @property
    def columns(self) -> int:
        return self.attn_heads * self.units

    def projected(self, features: DataFrame, width: int) -> DataFrame:
        """(id, h, s, t): all heads' vectors, and the two scores of each head; one matrix product."""
        own, near = (np.stack([k @ a[i] for k, a in zip(self.kernels, self.attn, strict=True)], axis=1) for i in (0, 1))
        y = wide.matmul(wide.packed(features, ["id"], width), np.concatenate([*self.kernels, own, near], axis=1))
        n, m = self.columns, self.attn_heads
        return y.select("id", F.slice("x", 1, n).alias("h"), F.slice("x", n + 1, m).alias("s"), F.slice("x", n + m + 1, m).alias("t"))

    def logits(self, pairs: DataFrame, nodes: DataFrame, count: int = 0) -> DataFrame:
        """The pairs with e, a logit for each head, and x, the vectors of dst: one row an entry through both joins.

        ``count`` is about how many pairs there are, where that is known: they are dealt to tasks by it.
        """
        right = nodes.select(F.col("id").alias("dst"), F.col("t").alias("_t"), F.col("h").alias("x"))
        left = nodes.select(F.col("id").alias("src"), F.col("s").alias("_s"))
        e = F.zip_with("_s", "_t", lambda a, b: activations.scalar("leaky_relu", a + b))
        return spread(spread(pairs, count, "dst").join(right, "dst"), count, "src").join(left, "src").withColumn("e", e).drop("_s", "_t")

    def call(self, features: DataFrame, adj: DataFrame, nodes: DataFrame, out_indices: DataFrame | None = None) -> DataFrame:
        """(id, j, v).  features: (id, k, v) or (id, x)."""
        width = wide.width_of(features) or 1
        if self.kernels is None:
            self.build(width)
        if width != self.kernels.shape[1]:
            raise ValueError(f"features have {width} columns, the kernels {self.kernels.shape[1]} rows")
        h = saved(self.projected(features, width))
        if self.sparse:
            return self.finished(self.attended(self.logits(adj.select("src", "dst"), h)), nodes, out_indices)
        raw = saved(adj.select("src", "dst", "w"))
        count = raw.count()
        one = saved(spread(raw, count, "src", "dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
        dropped(raw)
        if self.saliency_map_support:
            return self.finished(self.salient(one, nodes, h, count), nodes, out_indices)
        plain = not one.where("w <> 0 AND w <> 1").limit(1).count()
        kept = one.where("w <> 0")
        bare = nodes.select("id").join(kept.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        if plain and not bare.limit(1).count():
            return self.finished(self.attended(self.logits(kept.select("src", "dst"), h, count)), nodes, out_indices)
        # a masked logit of a row with entries of 1 underflows to nothing; rows without entries or with other weights need every node
        masked = grid(bare if plain else nodes, nodes).join(one, ["src", "dst"], "left")
        masked = masked.select("src", "dst", (1e10 * (F.coalesce("w", F.lit(0.0)) - 1)).alias("mask"))
        if plain:
            masked = masked.unionByName(kept.select("src", "dst", F.lit(0.0).alias("mask")))
        every = self.logits(masked, h).withColumn("e", F.transform("e", lambda v: v + F.col("mask")))
        return self.finished(self.attended(every), nodes, out_indices)

    def attended(self, entries: DataFrame) -> DataFrame:
        """(id, x): the softmax-weighted mean of x for each head; numerators and denominators are summed in one pass."""
        heads = range(self.attn_heads)
        top = entries.groupBy("src").agg(*(F.max(F.col("e")[i]).alias(f"_m{i}") for i in heads))
        shifted = entries.join(top, "src").withColumns({f"_p{i}": F.exp(F.col("e")[i] - F.col(f"_m{i}")) for i in heads})
        return self.weighted(shifted, lambda n, d: n / d)

    def weighted(self, entries: DataFrame, ratio) -> DataFrame:
        """(id, x) of the weights _p0, _p1 ...: ratio(sum of weight times x, sum of weights)."""
        places = [(i, j) for i in range(self.attn_heads) for j in range(self.units)]
        numerators = [F.sum(F.col(f"_p{i}") * F.col("x")[i * self.units + j]).alias(f"_n{i}_{j}") for i, j in places]
        sums = entries.groupBy(F.col("src").alias("id")).agg(*numerators, *(F.sum(f"_p{i}").alias(f"_d{i}") for i in range(self.attn_heads)))
        return sums.select("id", F.array(*(ratio(F.col(f"_n{i}_{j}"), F.col(f"_d{i}")) for i, j in places)).alias("x"))

    def salient(self, one: DataFrame, nodes: DataFrame, h: DataFrame, count: int) -> DataFrame:
        """Weights delta A e (1 - nu) + nu (A + delta (1 - A) + I) e, where e is shifted by the row's maximum over all nodes; a row without weight is NaN."""
        nu, delta, heads = float(self.non_exist_edge), float(self.delta), range(self.attn_heads)
        most = h.agg(*(F.max(F.col("t")[i]) for i in heads)).first()
        top = h.select(F.col("id").alias("src"), *(activations.scalar("leaky_relu", F.col("s")[i] + F.lit(most[i])).alias(f"_m{i}") for i in heads))
        pairs = one if nu == 0 else grid(nodes, nodes).join(one, ["src", "dst"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        entries = self.logits(pairs, h, count if nu == 0 else 0).join(top, "src")
        own = (F.col("src") == F.col("dst")).cast("double")
        weight = delta * F.col("w") * (1 - nu) + nu * (F.col("w") + delta * (1 - F.col("w")) + own)
        entries = entries.withColumns({f"_p{i}": weight * F.exp(F.col("e")[i] - F.col(f"_m{i}")) for i in heads})
        nan = F.lit(float("nan"))
        rows = self.weighted(entries, lambda n, d: F.when(d != 0, n / d).otherwise(nan))
        return wide.on(nodes.select("id"), rows, ["id"], self.columns, float("nan"))

    def finished(self, rows: DataFrame, nodes: DataFrame, out_indices: DataFrame | None) -> DataFrame:
        """Head biases, concatenation or mean, activation, gather; a node without any entry has its biases alone."""
        rows = wide.on(nodes.select("id"), rows, ["id"], self.columns)
        if self.use_bias:
            rows = rows.withColumn("x", wide.plus("x", self.bias.ravel()))
        if self.attn_heads_reduction == "average":
            means = [sum((F.col("x")[i * self.units + j] for i in range(1, self.attn_heads)), F.col("x")[j]) / self.attn_heads for j in range(self.units)]
            rows = rows.withColumn("x", F.array(*means))
        return gather(wide.unpacked(wide.activated(rows, self.activation), ["id"]), out_indices, self.final_layer, nodes)


class GraphAttentionSparse(GraphAttention):
    """Softmax over stored entries, whose values have no effect; repeated entries are logits of their own; saliency has no effect."""

    sparse = True


def grid(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each of ``rows`` beside every node; ValueError beyond DENSE nodes, as the result grows with their square."""
    if nodes.limit(DENSE + 1).count() > DENSE:
        raise ValueError(f"rows without entries, weighted masks and saliency with non_exist_edge are limited to {DENSE} nodes")
    every = nodes.select(F.col("id").alias("dst"), F.lit(0).alias("_one"))
    return rows.select(F.col("id").alias("src"), F.lit(0).alias("_one")).join(F.broadcast(every), "_one").drop("_one")
