"""Adjacency and Laplacian algebra over (src, dst, w); an entry that isn't there is zero."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import wide

#: Rows of a task where tables are dealt by their size.
ROWS = 1 << 20
#: Nodes up to which a dense inverse is made by one task; the result has the square of it entries.
DENSE = 4096
#: Nodes up to which power iteration runs on the driver.
SMALL = 500


def saved(df: DataFrame, **options) -> DataFrame:
    """``df`` written below spark.checkpoint.dir and read again, which ends its lineage; ``options`` are the writer's.

    Without that setting a local session gets a folder of its own, deleted at exit; a cluster a ValueError.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by :func:`saved` that no later result reads."""
    if path := getattr(df, "_graphloom_path", None):
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Has the driver's JVM look for plans that nothing refers to any more; Spark deletes their shuffle files."""
    spark.range(1).agg(F.count("*")).collect()  # takes the place of the last query, to which the scheduler refers
    spark._jvm.System.gc()


def identity(nodes: DataFrame, value: float = 1.0) -> DataFrame:
    return nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(float(value)).alias("w"))


def transposed(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def add_self_loops(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """The diagonal set to one; an own weight there is replaced."""
    return adj.where("src <> dst").select("src", "dst", "w").unionByName(identity(nodes))


def symmetrize(adj: DataFrame) -> DataFrame:
    """The greater of each entry and its mirror image, where one that isn't there is zero."""
    # both directions of a pair are one row: a pair goes through the shuffle once
    turned = F.col("src") > F.col("dst")
    pairs = adj.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("_a"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("_b"), "w").groupBy("_a", "_b")
    own = F.col("_a") == F.col("_b")  # a diagonal entry meets itself, which changes nothing
    top = F.when((F.count("*") > 1) | own, F.max("w")).otherwise(F.greatest(F.max("w"), F.lit(0.0)))
    there, back = (F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("_a", "_b"), ("_b", "_a")))
    ends = F.explode(F.when(own, F.array(there)).otherwise(F.array(there, back)))
    return pairs.agg(top.alias("w")).where("w <> 0").select(ends.alias("_e"), "w").select("_e.src", "_e.dst", "w")


def spread(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """``rows``, of which there are about ``count``, by ``keys`` in tasks of about ROWS where the session's number of partitions is too small for that."""
    n = -(-count // ROWS)
    return rows if n <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(n, *keys)


def positive(d: Column, power: float) -> Column:
    """d to a negative power; zero where d isn't positive."""
    return F.when(d > 0, F.pow(d, F.lit(power))).otherwise(0.0)


def scaled(adj: DataFrame, power: float, both: bool, side: str = "src") -> tuple[DataFrame, int]:
    """w times the sum of its row (``side`` dst: its column) to ``power`` and, with ``both``, that of the other end's; and the number of entries.

    Entries go in blocks, which are written once: a block adds its part of the sums, and gets those of its ends once.
    """
    blocks = wide.blocked(adj.select("src", "dst", F.col("w").cast("double").alias("w")), ["src", "dst"], ["src", "dst"], ["w"], 16)
    factor = wide.sums(blocks, side).select("id", F.array(positive(F.col("d"), power)).alias("x"))

    def multiply(columns, rows, places, factors):
        if not len(rows):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
        ids, (src, dst) = columns["_ids"], (pa.array(np.asarray(columns[c])[rows]) for c in ("src", "dst"))
        w = pc.multiply(columns["w"].take(pa.array(rows)), pa.array(factors[places[0], 0]))
        w = pc.multiply(w, pa.array(factors[places[1], 0])) if both else w
        return pa.table({"src": ids.take(src), "dst": ids.take(dst), "w": w})

    return wide.over(blocks, factor, 1, multiply, "src long, dst long, w double"), blocks.rows


def normalize_adj(adj: DataFrame, nodes: DataFrame, symmetric: bool = True, self_loops: bool = False) -> DataFrame:
    """Row sums d; symmetric: the transpose scaled by d ** -1/2 on both sides, else each row over d.  Sums that aren't positive give zeros."""
    adj = add_self_loops(adj, nodes) if self_loops else adj
    if symmetric:
        return transposed(scaled(adj, -0.5, True)[0])
    return scaled(adj, -1.0, False)[0]


def normalized_laplacian(adj: DataFrame, nodes: DataFrame, symmetric: bool = True) -> DataFrame:
    """The identity less :func:`normalize_adj`, an entry on the diagonal for each node."""
    entries, count = scaled(adj, -0.5, True) if symmetric else scaled(adj, -1.0, False)
    less = (transposed(entries) if symmetric else entries).withColumn("w", -F.col("w"))
    return spread(identity(nodes).unionByName(less), count, "src", "dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def calculate_laplacian(adj: DataFrame) -> DataFrame:
    """Scaled by column sums to the power -1/2 on both sides; no transpose, no identity."""
    return scaled(adj, -0.5, True, "dst")[0]


def rescale_laplacian(laplacian: DataFrame, nodes: DataFrame, largest_eigval: float | None = None) -> DataFrame:
    """2 / lambda times it less the identity; lambda by power iteration where none is given, and 2 where that finds 0."""
    value = largest_eigval if largest_eigval is not None else power_iteration(laplacian, nodes) or 2.0
    scale = 2.0 / value if value > 0 else 1.0
    return laplacian.withColumn("w", F.col("w") * scale).select("src", "dst", "w").unionByName(identity(nodes, -1.0)).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def power_iteration(a: DataFrame, nodes: DataFrame, max_iter: int = 100, tol: float = 1e-10) -> float:
    """The norm of A v after steps v = A v / |A v| from sin(i + 1) / sqrt(n): never negative.

    A driver loop whose steps are a join and a sum; only the norm and the change come to the driver.  The entries of
    graphs of up to SMALL nodes, SMALL ** 2 at most, come there whole.
    """
    from graphloom.operators.linalg import spmv
    from graphloom.sources.graph import ilocs

    n = nodes.count()
    if not n:
        return 0.0
    places = ilocs(nodes)
    if n <= SMALL:
        rows = placed(a, places).toPandas()
        block = np.zeros((n, n))
        np.add.at(block, (rows["i"].to_numpy(), rows["j"].to_numpy()), rows["w"].to_numpy())
        v = np.sin(np.arange(n) + 1.0) / np.sqrt(n)
        value = 0.0
        for _ in range(max_iter):
            u = block @ v
            value = float(np.sqrt((u * u).sum()))
            if value == 0:
                return 0.0
            if np.abs(u / value - v).sum() < tol:
                break
            v = u / value
        return value
    a = saved(a.select("src", "dst", "w"))
    held = v = saved(places.select("id", (F.sin(F.col("iloc") + 1.0) / F.lit(float(np.sqrt(n)))).alias("v")))
    value = 0.0
    for _ in range(max_iter):
        u = saved(nodes.join(spmv(a, v), "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v")))
        value = float(np.sqrt(u.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0))
        if value == 0:
            return 0.0
        new = u.withColumn("v", F.col("v") / value)
        change = new.join(v.withColumnRenamed("v", "_v"), "id").agg(F.sum(F.abs(F.col("v") - F.col("_v")))).first()[0]
        dropped(held)
        held, v = u, new
        if change < tol:
            break
    dropped(held)
    dropped(a)
    return value


def placed(a: DataFrame, places: DataFrame) -> DataFrame:
    """(i, j, w): entries by the dense positions of their nodes."""
    rows = a.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    rows = rows.join(places.select(F.col("id").alias("src"), F.col("iloc").alias("i")), "src")
    return rows.join(places.select(F.col("id").alias("dst"), F.col("iloc").alias("j")), "dst").select("i", "j", "w")


def inverted(block: np.ndarray) -> np.ndarray:
    """The inverse; LinAlgError where elimination meets a pivot of 1e-15 of the largest entry or less."""
    n, bound = len(block), 1e-15 * np.abs(block).max(initial=0.0)
    work = np.concatenate([block, np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.argmax(np.abs(work[k:, k])))
        if abs(work[p, k]) <= bound:
            raise np.linalg.LinAlgError("Singular matrix")
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        rows = work[:, k].copy()
        rows[k] = 0
        work -= np.outer(rows, work[k])
    return work[:, n:]


def invert(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """The dense inverse (src, dst, w), by one task; ValueError beyond DENSE nodes: its result grows with their square.

    A singular matrix raises LinAlgError.  Entries reach the task, and the inverse leaves it, in Arrow batches; the driver
    has neither.
    """
    from graphloom.sources.graph import ilocs

    if nodes.limit(DENSE + 1).count() > DENSE:
        raise ValueError(f"a dense inverse is limited to {DENSE} nodes; propagate instead")
    places = saved(ilocs(nodes))
    n = places.count()
    if not n:
        return a.select("src", "dst", "w").where("false")

    def run(batches):
        block = np.zeros((n, n))
        for batch in batches:
            i, j, w = (np.asarray(c) for c in batch.columns)
            np.add.at(block, (i, j), w)
        try:
            out = inverted(block)
        except np.linalg.LinAlgError:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.float64())], ["i", "j", "w"])
            return
        for i in range(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.arange(n)), pa.array(out[i])], ["i", "j", "w"])

    one = a.sparkSession.range(1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("w"))  # the task runs without entries too
    found = saved(placed(a, places).unionByName(one).repartition(1).mapInArrow(run, "i long, j long, w double"))
    if found.where("i IS NULL").limit(1).count():
        raise np.linalg.LinAlgError("Singular matrix")
    named = found.join(F.broadcast(places.select(F.col("id").alias("src"), F.col("iloc").alias("i"))), "i")
    return named.join(F.broadcast(places.select(F.col("id").alias("dst"), F.col("iloc").alias("j"))), "j").select("src", "dst", "w")


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("src").alias("dst"), F.col("dst").alias("_d"), F.col("w").alias("_w"))
    return a.join(right, "dst").groupBy("src", "_d").agg(F.sum(F.col("w") * F.col("_w")).alias("w")).withColumnRenamed("_d", "dst")


def gcn_adjacency(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    return normalize_adj(symmetrize(adj), nodes, True, True)


def gcn_adj_feats(features: DataFrame, adj: DataFrame, nodes: DataFrame, k: int = 1, method: str | None = "gcn") -> tuple[DataFrame, DataFrame]:
    """(features, adjacency).  gcn: symmetrised, with loops, normalised (k has no effect); sgc: that to the k-th power; none: symmetrised."""
    if method == "chebyshev":
        raise ValueError("chebyshev filters are not supported")
    if method in ("none", None):
        return features, symmetrize(adj)
    if method not in ("gcn", "sgc"):
        raise ValueError(f"unknown method {method!r}: use gcn, sgc, none or None")
    one = gcn_adjacency(adj, nodes)
    if method == "sgc":
        if not isinstance(k, int) or k <= 0:
            raise ValueError("k has to be a positive integer")
        out = one
        for _ in range(k - 1):
            out = matrix_product(one, out)
        return features, out
    return features, one


def ppnp_adj_feats(features: DataFrame, adj: DataFrame, nodes: DataFrame, teleport_probability: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """alpha times the inverse of I - (1 - alpha) A, with A as for gcn; alpha 1 gives the identity, 0 the zero matrix (no entries)."""
    alpha = teleport_probability
    if not 0 <= alpha <= 1:
        raise ValueError("teleport_probability lies between 0 and 1")
    if alpha == 1:
        return features, identity(nodes)
    if alpha == 0:
        return features, identity(nodes).where("false")
    less = gcn_adjacency(adj, nodes).withColumn("w", F.col("w") * -(1 - alpha))
    whole = identity(nodes).unionByName(less).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return features, invert(whole, nodes).withColumn("w", F.col("w") * alpha)


def preprocess(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """GraphPreProcessingLayer: symmetrised, with loops, scaled by row sums on both sides."""
    looped = add_self_loops(symmetrize(adj), nodes)
    return scaled(looped, -0.5, True)[0]
