from __future__ import annotations

import numpy as np
import pytest
from graphloom.operators import adjacency, links, wide
from pyspark.sql import functions as F

from tests.helpers import entries, graph, nodes


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def read(df, n, width):
    out = np.full((n, width), np.nan)
    for r in df.collect():
        out[r["id"]] = r["x"]
    return out


def shuffled_bytes(spark):
    tracker = spark.sparkContext._jsc.sc()
    tracker.listenerBus().waitUntilEmpty(30_000)
    return tracker.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("most", [1, 40, 1 << 25])
def test_products_in_blocks(spark, monkeypatch, most):
    """A hub over many blocks, rows without entries, repeated and missing ends, null weights."""
    monkeypatch.setattr(wide, "BLOCK", most)
    monkeypatch.setattr(wide, "GATHER", 20)
    rng = np.random.default_rng(1)
    a = graph(12, 0.3, 2, weighted=True, directed=True)
    a[3], a[7] = rng.uniform(1, 2, 12), 0
    x = rng.normal(size=(12, 4))
    adj = entries(spark, a)
    adj = adj.unionByName(adj).unionByName(spark.createDataFrame([(3, 99, 1.0), (None, 1, 1.0), (3, None, 1.0), (3, 1, None)], adj.schema))
    got = wide.spmm(adj, vectors(spark, x), 4, nodes(spark, 12))
    assert np.allclose(read(got, 12, 4), 2 * a @ x)
    assert wide.spmm(adj.where("false"), vectors(spark, x), 4).count() == 0
    with pytest.raises(TypeError):
        wide.spmm(adj.withColumn("dst", F.col("dst").cast("string")), vectors(spark, x), 4)


def test_products_send_a_vector_once_for_a_block(spark, many_partitions):
    """Groups of 40 nodes that are all linked: no vector, or sum, goes through a shuffle for each partition."""
    ids = spark.range(1200)
    adj = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.expr("id div 40 * 40"), F.expr("id div 40 * 40 + 39"))).alias("dst")).withColumn("w", F.lit(1.0))
    x = ids.select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.rand(3) + k).alias("x"))
    before = shuffled_bytes(spark)
    assert wide.spmm(adj, x, 64, ids).count() == 1200
    assert shuffled_bytes(spark) - before < 8 * 1200 * 64 * 8


@pytest.mark.parametrize("method", ["ip", "l1", "l2", "mul", "avg", "concat"])
def test_pairs_in_blocks(spark, monkeypatch, method):
    """Repeated pairs and null positions stay, pairs without both vectors go; a position may be a text."""
    monkeypatch.setattr(wide, "BLOCK", 24)
    rng = np.random.default_rng(4)
    x, kernel, bias = rng.normal(size=(9, 3)), rng.normal(size=(6 if method == "concat" else 3, 2)), np.array([0.5, -1])
    rows = [(f"p{i}", int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 9, (30, 2)))] + [("again", 1, 2), ("again", 1, 2), (None, 1, 2), ("none", 1, 99), ("null", None, 2)]
    made = {"ip": lambda a, b: [a @ b], "l1": lambda a, b: abs(a - b) @ kernel + bias, "l2": lambda a, b: (a - b) ** 2 @ kernel + bias, "mul": lambda a, b: a * b @ kernel + bias, "avg": lambda a, b: (a + b) / 2 @ kernel + bias, "concat": lambda a, b: np.r_[a, b] @ kernel + bias}[method]
    call = links.link_inference() if method == "ip" else links.link_inference(2, "linear", method, kernel=kernel, bias=bias)
    got = call(spark.createDataFrame(rows, "pos string, src long, dst long"), vectors(spark, x)).collect()
    want = [(str(p), j, v) for p, a, b in rows if a is not None and b < 9 for j, v in enumerate(made(x[a], x[b]))]
    got, want = sorted((str(r["pos"]), r["j"], r["v"]) for r in got), sorted(want)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_pairs_send_a_vector_once_for_a_block(spark):
    x = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.rand(5) + k).alias("x"))
    pairs = spark.range(20_000).select(F.col("id").alias("pos"), F.expr("id % 50").alias("src"), F.expr("id % 59").alias("dst"))
    before = shuffled_bytes(spark)
    assert links.link_inference()(pairs, x.hint("merge")).count() == 20_000
    assert shuffled_bytes(spark) - before < 20_000 * 64 * 8 / 4


def test_symmetrize_sends_a_pair_once(spark, many_partitions):
    """Both directions of a pair meet before the shuffle; single, repeated, negative and diagonal entries as before."""
    pairs = spark.range(40_000).select(F.expr("id * 7919 % 1000003").alias("a"), F.expr("2000000 + id").alias("b"))
    adj = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").withColumn("w", F.lit(1.0))
    before = shuffled_bytes(spark)
    assert adjacency.symmetrize(adj).count() == 80_000
    once = shuffled_bytes(spark) - before
    assert adj.groupBy("src", "dst").agg(F.max("w")).count() == 80_000
    assert once < 0.75 * (shuffled_bytes(spark) - before - once)
    odd = spark.createDataFrame([(1, 2, -3.0), (3, 4, -1.0), (3, 4, -2.0), (5, 5, -4.0), (6, 7, 2.0), (7, 6, 5.0), (8, 9, 0.0)], adj.schema)
    got = sorted((r["src"], r["dst"], r["w"]) for r in adjacency.symmetrize(odd).collect())
    assert got == [(3, 4, -1.0), (4, 3, -1.0), (5, 5, -4.0), (6, 7, 5.0), (7, 6, 5.0)]


@pytest.mark.parametrize("most", [32, 1 << 25])
def test_scaling_in_blocks(spark, monkeypatch, most):
    """Ends without a row of their own, repeated entries, sums that aren't positive; blocks of one entry too."""
    monkeypatch.setattr(wide, "BLOCK", most)
    a = graph(9, 0.4, 5, weighted=True, directed=True)
    a[2] = -1
    a[8] = 0
    d = a.sum(1)
    r = np.where(d > 0, np.abs(np.where(d == 0, 1, d)) ** -0.5, 0)
    ids, adj = nodes(spark, 9), entries(spark, a)
    got = np.zeros((9, 9))
    rows = adjacency.normalize_adj(adj, ids).collect()
    for e in rows:
        got[e["src"], e["dst"]] += e["w"]
    assert len(rows) == np.count_nonzero(a) and np.allclose(got, (a * r[:, None] * r).T)
    assert adjacency.normalize_adj(adj.unionByName(adj), ids, symmetric=False).count() == 2 * len(rows)


def test_tasks_by_size(spark, monkeypatch):
    assert adjacency.spread(spark.range(10), 10, "id").rdd.getNumPartitions() != 25
    monkeypatch.setattr(adjacency, "ROWS", 4)
    assert adjacency.spread(spark.range(100), 100, "id").rdd.getNumPartitions() == 25


def test_samples_by_size(spark, monkeypatch):
    """The pairs of keys and ends go to tasks by their number, with the same samples."""
    from graphloom.plans import graphs

    monkeypatch.setattr(adjacency, "ROWS", 50)
    pairs = spark.range(1000).select(F.expr("id % 90").alias("b"), F.expr("id * 7 % 31").alias("dst"))
    plain, dealt = graphs.first_ends(pairs, ["b"], "dst", 3), graphs.first_ends(pairs, ["b"], "dst", 3, 1000)
    assert dealt.rdd.getNumPartitions() == 20 and sorted(plain.collect()) == sorted(dealt.collect())
