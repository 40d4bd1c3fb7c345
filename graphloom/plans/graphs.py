"""Graphs, features and fixed weights over the TPC-H-like tables, for the registered queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.adjacency import spread
from graphloom.sources.graph import Graph

#: Components of the embeddings.
WIDTH = 64
#: Bytes of a table that is broadcast at most.
BROADCAST = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kernel(rows: int, columns: int, shift: int = 0) -> np.ndarray:
    """A fixed weight matrix of exact decimals."""
    k, j = np.indices((rows, columns))
    return ((31 * k + 17 * j + shift) % 101 - 50) / 500.0


def bias(columns: int) -> np.ndarray:
    return ((13 * np.arange(columns)) % 11 - 5) / 100.0


def trade_lines(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, w, pos): a line's quantity from the customer's to the supplier's nation."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    found = lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey")
    return found.select("src", "dst", F.col("l_quantity").alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Directed and weighted: lines from nation to nation."""
    return trade_lines(spark, d).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def ends(src: str, dst: str, **more) -> Column:
    return F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), *(F.col(v).alias(k) for k, v in more.items()))


def line_ends(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): a line's part and supplier, repeats too."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): the different pairs of a part and a supplier, dealt by their number."""
    return spread(line_ends(spark, d), table(spark, d, "lineitem").count(), "src", "dst").distinct()


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts (even ids) and suppliers (odd ids), both directions."""
    both = F.array(ends("src", "dst"), ends("dst", "src"))
    return part_pairs(spark, d).select(F.explode(both).alias("e")).select("e.src", "e.dst").withColumn("w", F.lit(1.0))


def weighted_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers, directed and weighted: to the supplier with the lines, back with their quantity, which suppliers 3, 9, 15 ... don't have."""
    lines = table(spark, d, "lineitem")
    rows = spread(lines.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), "l_quantity"), lines.count(), "src", "dst")
    half = rows.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").cast("double").alias("q"))
    there, back = ends("src", "dst", w="n"), ends("dst", "src", w="q")
    return half.select(F.explode(F.when(F.col("dst") % 3 != 0, F.array(there, back)).otherwise(F.array(there))).alias("e")).select("e.*")


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All parts and suppliers, those of no line too."""
    p = table(spark, d, "part").select((F.col("p_partkey") * 2).alias("id"))
    return p.unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id")))


def features(spark: SparkSession, d: str, nodes: DataFrame) -> DataFrame:
    """(id, x): the embedding that the id falls to, by the remainder over their number."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    n = vectors.count()
    few = F.broadcast(vectors) if n * 8 * (WIDTH + 4) <= BROADCAST else vectors
    return nodes.join(few, F.col("id") % n == F.col("vec_id")).select("id", "x")


def long_features(spark: SparkSession, d: str, nodes: DataFrame) -> DataFrame:
    """(id, k, v)."""
    return features(spark, d, nodes).select("id", F.posexplode("x").alias("k", "v"))


def part_graph(spark: SparkSession, d: str) -> Graph:
    nodes = part_nodes(spark, d)
    edges = parts(spark, d).select((F.col("src") * 1_000_000 + F.col("dst")).alias("pos"), "src", "dst", "w")
    return Graph(nodes, edges, features(spark, d, nodes), 2 * table(spark, d, "lineitem").count())


def first_ends(pairs: DataFrame, keys: list[str], end: str, samples: int, count: int = 0) -> DataFrame:
    """(keys, s, id): the ``samples`` least different ends of each key; ``count`` is about how many pairs there are, repeats too."""
    order = Window.partitionBy(*keys).orderBy(end)
    ranked = spread(pairs.select(*keys, end), count, *keys).distinct().withColumn("s", F.row_number().over(order) - 1)
    return ranked.where(F.col("s") < samples).select(*keys, F.col("s").cast("long").alias("s"), F.col(end).alias("id"))


def sampled(spark: SparkSession, d: str, samples: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, own, near): parts, their features, and those of their first suppliers, as sampled tensors of vectors."""
    near = first_ends(line_ends(spark, d).withColumnRenamed("src", "b"), ["b"], "dst", samples, table(spark, d, "lineitem").count())
    heads = table(spark, d, "part").select((F.col("p_partkey") * 2).alias("b"), F.lit(0).cast("long").alias("h"))
    own = features(spark, d, heads.select(F.col("b").alias("id"))).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("s"), "x")
    x = near.join(features(spark, d, part_nodes(spark, d)), "id").select("b", F.lit(0).cast("long").alias("h"), "s", "x")
    return heads, own, x


def bought(spark: SparkSession, d: str, samples: int = 3) -> tuple[DataFrame, DataFrame]:
    """(x_self, x_neigh): customers, and the suppliers (relation 0) and parts (1) of their first orders."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("b")), "l_orderkey")
    ends = lines.select("b", F.explode(F.array(F.struct(F.lit(0).alias("r"), (F.col("l_suppkey") * 2 + 1).alias("id")), F.struct(F.lit(1).alias("r"), (F.col("l_partkey") * 2).alias("id")))).alias("e")).select("b", "e.r", "e.id")
    first = first_ends(ends, ["b", "r"], "id", samples)
    neigh = first.join(features(spark, d, part_nodes(spark, d)), "id").select("r", "b", F.lit(0).cast("long").alias("h"), "s", "x")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    own = features(spark, d, people).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("h"), "x")
    return own, neigh


def pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
