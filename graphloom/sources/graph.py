"""Graphs as tables: nodes(id), edges(pos, src, dst, w), features(id, k, v)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Graph:
    """nodes(id), edges(pos, src, dst[, w]) and features(id, k, v); an undirected graph lists both directions.

    ``pos`` is the order in which edges were given: it decides which weight is the last and aligns weights.
    ``entries``, where it is known, is about how many edges there are; they are dealt to tasks by it.
    """

    nodes: DataFrame
    edges: DataFrame
    features: DataFrame | None = None
    entries: int = 0

    @property
    def weighted(self) -> bool:
        return "w" in self.edges.columns


def check_endpoints(edges: DataFrame, nodes: DataFrame) -> None:
    """IndexError where an edge ends at no node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()  # each task sends an end once
    if ends.join(nodes, "id", "left_anti").limit(1).count():
        raise IndexError("an edge ends at no node")


def check_ids(ids: DataFrame, nodes: DataFrame) -> None:
    """IndexError where a listed id is no node."""
    if ids.select("id").join(nodes, "id", "left_anti").limit(1).count():
        raise IndexError("an id is no node")


def check_weights(edges: DataFrame) -> None:
    """ValueError for null, negative or non-finite weights (walks only)."""
    odd = F.col("w").isNull() | (F.col("w") < 0) | F.isnan("w") | (F.abs("w") == float("inf"))
    if edges.where(odd).limit(1).count():
        raise ValueError("edge weights have to be finite and not negative")


def ilocs(nodes: DataFrame) -> DataFrame:
    """(id, iloc): dense positions in the order of ids.

    Positions inside range partitions are counted apart and offset by the sizes of those before, so no task has all ids.
    """
    ranged = nodes.select("id").repartitionByRange("id").select("id", F.spark_partition_id().alias("part"))
    sizes = ranged.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("place")).alias("iloc"))


def ranked(edges: DataFrame) -> DataFrame:
    """(src, dst, pos, w, rank, degree): a node's edges numbered by dst and then pos, duplicates kept.

    Places in the whole order are counted by range partitions, and a node's first place is taken off them: the edges of
    a hub are over many tasks.
    """
    from graphloom.operators.adjacency import dropped, saved

    rows = edges.select("src", "dst", "pos", *["w"] * ("w" in edges.columns))
    parts = saved(rows.repartitionByRange("src", "dst", "pos").withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy("src", "dst", "pos")) - 1
    whole = parts.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("_place", (F.col("_before") + F.col("_place")).cast("long"))
    first = whole.groupBy("src").agg(F.min("_place").alias("_first"), F.count("*").alias("degree"))
    out = saved(whole.join(first, "src").withColumn("rank", F.col("_place") - F.col("_first")).select(*rows.columns, "rank", "degree"))
    dropped(parts)
    return out


def csr(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indptr, colind): indptr(id, degree, start, stop) for each node, colind(src, rank, dst, pos) with duplicates kept.

    Ranks count within a node, by dst and then pos; with start they are places in the row-major list.
    """
    check_endpoints(edges, nodes)
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    every = ilocs(nodes).join(degree, "id", "left").select("id", "iloc", F.coalesce("degree", F.lit(0)).alias("degree"))
    buckets = every.withColumn("bucket", F.expr("iloc div 65536"))
    sums = buckets.groupBy("bucket").agg(F.sum("degree").alias("n"))
    before = sums.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # one row for 65,536 nodes
    run = F.sum("degree").over(Window.partitionBy("bucket").orderBy("iloc"))
    indptr = buckets.join(before, "bucket").withColumn("stop", F.col("before") + run).select("id", "degree", (F.col("stop") - F.col("degree")).alias("start"), "stop")
    return indptr, ranked(edges).select("src", "rank", "dst", "pos")


def csr_from_edges(spark: SparkSession, edges, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`csr` of a list of pairs, a flat list of ends, or an array of either; nodes are 0 to n - 1, or to the greatest end.

    ValueError for a flat list of odd length, IndexError for ends outside the nodes.
    """
    flat = np.asarray(edges, dtype=np.int64).ravel()
    if len(flat) % 2:
        raise ValueError("a flat list has two ends for each edge")
    ends = flat.reshape(-1, 2)
    n = n if n is not None else int(ends.max(initial=-1)) + 1
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(ends)], "pos long, src long, dst long")
    return csr(rows, spark.range(n))


def graph_from_csr(spark: SparkSession, indptr, colind, weights=None) -> Graph:
    """A graph of row pointers and ends that the caller holds; a row whose pointers fall has no edges.

    ValueError where the last pointer lies beyond the ends, or weights are not as many as those.
    """
    indptr, colind = np.asarray(indptr, dtype=np.int64), np.asarray(colind, dtype=np.int64)
    if len(indptr) and indptr[-1] > len(colind):
        raise ValueError("the last pointer lies beyond the ends")
    if weights is not None and len(weights) != len(colind):
        raise ValueError("there are not as many weights as ends")
    n = max(0, len(indptr) - 1)
    rows = [(k, i, int(colind[k]), *([float(weights[k])] if weights is not None else [])) for i in range(n) for k in range(int(indptr[i]), int(indptr[i + 1]))]
    return Graph(spark.range(n), spark.createDataFrame(rows, "pos long, src long, dst long" + ", w double" * (weights is not None)))


def neighbors(edges: DataFrame, node: int) -> DataFrame:
    """The ends of a node's edges, ascending, repeats kept."""
    return edges.where(F.col("src") == node).select("dst").orderBy("dst")


def sparse_tensor(rows: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(src, dst, w, pos) in row-major order, duplicates as separate entries; ``rows`` has pos for the order given."""
    if rows.where((F.col("src") < 0) | (F.col("src") >= n_rows) | (F.col("dst") < 0) | (F.col("dst") >= n_cols)).limit(1).count():
        raise IndexError("an entry lies outside the shape")
    return rows.select("src", "dst", "w", "pos").orderBy("src", "dst", "pos")


def from_dense(spark: SparkSession, block: np.ndarray) -> DataFrame:
    """The entries of a small dense block that are not zero."""
    r, c = np.nonzero(block)
    return spark.createDataFrame([(int(a), int(b), float(block[a, b]), i) for i, (a, b) in enumerate(zip(r, c, strict=True))], "src long, dst long, w double, pos long")


def from_scipy(spark: SparkSession, matrix) -> DataFrame:
    """The entries of a matrix with ``tocoo`` (SciPy's sparse ones), in its order, duplicates as separate entries."""
    coo = matrix.tocoo()
    rows = zip(coo.row.tolist(), coo.col.tolist(), np.asarray(coo.data, dtype=np.float64).tolist(), range(len(coo.data)), strict=True)
    return spark.createDataFrame([(int(a), int(b), float(w), i) for a, b, w, i in rows], "src long, dst long, w double, pos long")


def indices(entries: DataFrame) -> DataFrame:
    """(pos, src, dst): the place of each entry in row-major order, without the values."""
    return ranked_places(entries).select("pos", "src", "dst")


def ranked_places(entries: DataFrame) -> DataFrame:
    """Entries with pos as the place in row-major order, duplicates in the order given; counted by range partitions."""
    ranged = entries.repartitionByRange("src", "dst", "pos").withColumn("_part", F.spark_partition_id())
    from graphloom.operators.adjacency import saved

    parts = saved(ranged)
    sizes = parts.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy("src", "dst", "pos")) - 1
    return parts.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("pos", (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_before", "_place")


def n_entries(entries: DataFrame) -> int:
    """How many entries are stored."""
    return entries.count()


def toarray(entries: DataFrame, n_rows: int, n_cols: int, limit: int = 1 << 24) -> np.ndarray:
    """The dense form on the driver, duplicates added; ValueError beyond ``limit`` places, which the caller holds."""
    if n_rows * n_cols > limit:
        raise ValueError(f"a dense form is limited to {limit} places; summed() has its entries")
    out = np.zeros((n_rows, n_cols))
    rows = summed(entries).toPandas()
    out[rows["src"].to_numpy(), rows["dst"].to_numpy()] = rows["w"].to_numpy()
    return out


def summed(entries: DataFrame) -> DataFrame:
    """The dense form's entries: those of one place are added."""
    return entries.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def row_sums(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("v"))


def adjacency(graph: Graph, weighted: bool = False) -> DataFrame:
    """(src, dst, w) by assignment: repeated edges are one, of weights the last given counts (of equal
    places the greatest), a zero weight is no edge."""
    check_endpoints(graph.edges, graph.nodes)
    if not weighted:
        from graphloom.operators.adjacency import spread

        return spread(graph.edges.select("src", "dst"), graph.entries, "src", "dst").distinct().withColumn("w", F.lit(1.0))
    if not graph.weighted:
        raise ValueError("the graph has no edge weights")
    last = graph.edges.groupBy("src", "dst").agg(F.max_by("w", F.struct("pos", "w")).alias("w"))
    return last.where("w <> 0")


class FullBatchNodeGenerator:
    """Features and a transformed adjacency of a whole graph.

    method: gcn and sgc (normalised, sgc to the k-th power), gat and self_loops (ones on the diagonal), ppnp (personalised
    PageRank, dense only), none (as it is).  ``transform(features=, A=)`` goes before all of them.
    """

    def __init__(self, G, name=None, method="gcn", k=1, sparse=True, transform=None, teleport_probability=0.1, weighted=False):
        from graphloom.operators import adjacency as ops

        if getattr(G, "edges", None) is None:
            raise TypeError("the graph has no edges")
        self.graph, self.name, self.method, self.k, self.use_sparse = G, name, method, k, sparse
        adj = adjacency(G, weighted)
        if transform is not None:
            self.features, self.adj = transform(features=G.features, A=adj)
        elif method in ("gcn", "sgc"):
            self.features, self.adj = ops.gcn_adj_feats(G.features, adj, G.nodes, k=k, method=method)
        elif method in ("gat", "self_loops"):
            self.features, self.adj = G.features, ops.add_self_loops(adj, G.nodes)
        elif method == "ppnp":
            if sparse:
                raise ValueError("ppnp makes a dense matrix: use sparse=False")
            self.features, self.adj = ops.ppnp_adj_feats(G.features, adj, G.nodes, teleport_probability)
        elif method in ("none", None):
            self.features, self.adj = G.features, adj
        else:
            raise ValueError(f"unknown method {method!r}")

    def __len__(self) -> int:
        return self.graph.nodes.count()

    def num_batch_dims(self) -> int:
        return 1

    def default_corrupt_input_index_groups(self) -> list[list[int]]:
        return [[0]]

    def flow(self, node_ids, targets=None, use_ilocs=False):
        """(ids, features, adjacency); targets and use_ilocs have no effect."""
        return node_ids, self.features, self.adj
