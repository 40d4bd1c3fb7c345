"""Random walks as iterated joins.

A node's edges are in rows of CHUNK, so that a step moves walks and a row a node through its joins, not an edge a row; a hub
has many rows.

Random numbers are a hash of (seed, root's position, walk, step), so that no state runs through the walks, each is
reproducible alone, and a recomputed task draws the same numbers.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.adjacency import saved
from graphloom.sources.graph import Graph, check_endpoints, check_ids, check_weights

#: Steps between written tables, and edges that a biased step tries before it looks at all.
CADENCE, TRIES = 8, 12
#: Edges in a row of a node's edges.
CHUNK = 1024


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1): the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bounded(seed: int, n: Column | int, *parts: Column) -> Column:
    """A whole number from 0 to n - 1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor(uniform(seed, *parts) * n).cast("long"), n.cast("long") - 1)


def shuffled(rows: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """The rows in an order that depends on the seed and their keys alone; rows of equal keys stand together."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))), *keys)


def plain_int(x, least: int, name: str) -> int:
    if type(x) is not int or x < least:
        raise ValueError(f"{name} is an int of at least {least}")
    return x


class GraphWalk:
    def __init__(self, graph: Graph, n: int | None = None, length: int | None = None, seed: int | None = None):
        edges = saved(graph.edges)  # made once for checks and walks
        graph = Graph(graph.nodes, edges, graph.features, graph.entries)
        check_endpoints(edges, graph.nodes)
        self.tables: dict[bool, tuple[DataFrame, DataFrame]] = {}
        self.graph, self.n, self.length, self.seed = graph, n, length, seed
        if seed is not None:
            plain_int(seed, 0, "seed")

    def neighbors(self, node: int) -> DataFrame:
        from graphloom.sources.graph import neighbors

        return neighbors(self.graph.edges, node)

    def resolved(self, n, length, seed) -> tuple[int, int, int]:
        n, length = (own if given is None else given for given, own in ((n, self.n), (length, self.length)))
        if n is None or length is None:
            raise ValueError("n and length are needed here or in the constructor")
        seed = seed if seed is not None else self.seed if self.seed is not None else 0
        return plain_int(n, 1, "n"), plain_int(length, 1, "length"), plain_int(seed, 0, "seed")

    def starts(self, nodes, n: int) -> DataFrame | None:
        """(root_pos, walk, node): roots in order, repeats kept.  nodes: a list, tuple or array, or a table (pos, id)."""
        spark = self.graph.nodes.sparkSession
        if not isinstance(nodes, DataFrame):
            if not isinstance(nodes, (list, tuple, np.ndarray)):
                raise ValueError("roots are a list, tuple, array or table")
            if len(nodes) == 0:
                warnings.warn("no roots are given", RuntimeWarning, stacklevel=3)
                return None
            nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(nodes)], "pos long, id long")
        check_ids(nodes, self.graph.nodes)
        return nodes.select(F.col("pos").alias("root_pos"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("walk"), F.col("id").alias("node"))

    def table(self, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
        """:func:`chunked` of the graph's edges, written once."""
        if weighted not in self.tables:
            self.tables[weighted] = chunked(self.graph.edges, weighted)
        return self.tables[weighted]


def chunked(edges: DataFrame, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """(node, chunk, next[, w]), a node's edges by dst and then pos, CHUNK in a row; and (node, degree, top), how many they are and the greatest weight.

    Rows are cut in the order of range partitions.  Only nodes over several of those are dealt again, by their places.
    """
    columns = ["dst", *["w"] * weighted]
    rows = edges.select("src", *columns, "pos").where("src IS NOT NULL")
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")} | ({"w": F.col("w").cast("double")} if weighted else {}))

    def cut(held, first):
        """Rows of CHUNK, where the first starts at place ``first`` of its node; and how many rows and which place the last, open one has."""
        src = np.asarray(held["src"])
        new = np.r_[True, src[1:] != src[:-1]]
        starts = np.flatnonzero(new)
        place = np.arange(len(src)) - np.repeat(starts, np.diff(np.r_[starts, len(src)]))
        place[: starts[1] if len(starts) > 1 else len(src)] += first
        cuts = np.flatnonzero(new | (place % CHUNK == 0))
        return src, place, cuts

    def run(batches):
        from pyspark import TaskContext

        part, held, first = TaskContext.get().partitionId(), None, 0

        def made(table, src, place, cuts, end):
            at = pa.array(np.r_[cuts, end], pa.int32())
            lists = [pa.ListArray.from_arrays(at, table[c].combine_chunks().slice(0, end)) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), part, np.int64)), pa.array(src[cuts]), pa.array(place[cuts] // CHUNK), *lists], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            one = pa.Table.from_batches([batch.select(["src", *columns])])
            held = (one if held is None else pa.concat_tables([held, one])).combine_chunks()
            src, place, cuts = cut(held, first)
            if len(cuts) > 1:
                yield made(held, src, place, cuts[:-1], int(cuts[-1]))
            first, held = int(place[cuts[-1]]), held.slice(int(cuts[-1]))
        if held is not None:
            src, place, cuts = cut(held.combine_chunks(), first)
            yield made(held.combine_chunks(), src, place, cuts, held.num_rows)

    names = ["_part", "node", "chunk", "next", *["w"] * weighted]
    order = ["src", "dst", "pos"]
    schema = "_part long, node long, chunk long, next array<long>" + ", w array<double>" * weighted
    pieces = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    top = F.max(F.array_max("w")) if weighted else F.lit(1.0)
    degree = saved(pieces.groupBy("node").agg(F.sum(F.size("next")).cast("long").alias("degree"), top.alias("top"), (F.min("_part") < F.max("_part")).alias("_split")))
    split = degree.where("_split").select("node")  # at most one node for each border of range partitions
    if not split.limit(1).count():
        return pieces.drop("_part"), degree.drop("_split")
    far = pieces.join(F.broadcast(split), "node", "left_semi")
    sizes = far.groupBy("node", "_part").agg(F.sum(F.size("next")).alias("n"))
    before = sizes.select("node", "_part", (F.sum("n").over(Window.partitionBy("node").orderBy("_part")) - F.col("n")).alias("before"))
    zipped = F.posexplode(F.arrays_zip("next", *["w"] * weighted)).alias("i", "e")
    each = far.join(before, ["node", "_part"]).select("node", (F.col("before") + F.col("chunk") * CHUNK).alias("at"), zipped)
    each = each.select("node", (F.col("at") + F.col("i")).alias("rank"), "e.*")
    again = each.groupBy("node", F.expr(f"rank div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("rank", "next", *["w"] * weighted))).alias("e"))
    again = saved(again.select("node", "chunk", *(F.col(f"e.{c}").alias(c) for c in names[3:])))
    return pieces.drop("_part").join(F.broadcast(split), "node", "left_anti").unionByName(again), degree.drop("_split")


def neighbourhoods(table: DataFrame, degree: DataFrame) -> DataFrame:
    """(prev, bucket, ends): each node's ends by :func:`bucket`."""
    few = table.where(f"chunk = 0 AND size(next) < {CHUNK}").select(F.col("node").alias("prev"), F.lit(0).cast("long").alias("bucket"), F.col("next").alias("ends"))
    hubs = table.where(f"chunk > 0 OR size(next) = {CHUNK}").select("node", "next").join(degree.select("node", "degree"), "node").select("node", "degree", F.explode("next").alias("next"))
    return few.unionByName(saved(hubs.groupBy(F.col("node").alias("prev"), bucket(F.col("next"), F.col("degree")).alias("bucket")).agg(F.collect_set("next").alias("ends"))))


def bucket(end: Column, degree: Column) -> Column:
    """Where an end is among the ends of a node with that degree: about CHUNK are together."""
    return F.when(degree < CHUNK, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(end), F.ceil(degree / CHUNK)))


def collected(walks: DataFrame) -> DataFrame:
    """(root_pos, walk, nodes): each walk as an array; length steps at most."""
    return walks.groupBy("root_pos", "walk").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda s: s["node"]).alias("nodes"))


class UniformRandomWalk(GraphWalk):
    """Each step goes to a neighbour at random, with repeated edges as often; a walk stops where there is none."""

    def run(self, nodes, *, n=None, length=None, seed=None) -> DataFrame:
        """(root_pos, walk, step, node)."""
        n, length, seed = self.resolved(n, length, seed)
        spark = self.graph.nodes.sparkSession
        start = self.starts(nodes, n)
        if start is None:
            return spark.createDataFrame([], "root_pos long, walk int, step int, node long")
        table, degree = self.table()
        degree = degree.select("node", "degree")
        here = start.withColumn("path", F.array("node"))
        for step in range(1, length):
            drawn = here.join(degree, "node", "left").withColumn("rank", bounded(seed, F.col("degree"), F.col("root_pos"), F.col("walk"), F.lit(step)))
            drawn = drawn.drop("degree").withColumn("chunk", F.expr(f"rank div {CHUNK}"))
            on = drawn.join(table.select("node", "chunk", "next"), ["node", "chunk"], "left").withColumn("next", F.get("next", (F.col("rank") % CHUNK).cast("int")))
            path = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next")))
            here = on.select("root_pos", "walk", F.col("next").alias("node"), path.alias("path"))
            if step % CADENCE == 0 and step + 1 < length:
                here = saved(here)
        return here.select("root_pos", "walk", F.posexplode("path").alias("step", "node"))


class BiasedRandomWalk(GraphWalk):
    """Second-order walks: after a first uniform step a neighbour x of the current node has weight w / p if it is the node
    before, w if that node has an edge to x, else w / q.  A walk stops without neighbours or weight.

    A step draws TRIES edges by rank and takes the first that is accepted with odds of its weight over the greatest: a
    walk costs that many rows, however many edges its node has.  Where none is, the choice is among all edges.
    """

    def __init__(self, graph, n=None, length=None, p=1.0, q=1.0, weighted=False, seed=None):
        super().__init__(graph, n, length, seed)
        self.p, self.q, self.weighted = p, q, weighted

    def run(self, nodes, *, n=None, length=None, p=None, q=None, seed=None, weighted=None) -> DataFrame:
        n, length, seed = self.resolved(n, length, seed)
        p, q = (own if given is None else given for given, own in ((p, self.p), (q, self.q)))
        weighted = self.weighted if weighted is None else weighted
        if not isinstance(weighted, bool):
            raise ValueError("weighted is a bool")
        if p is None or q is None:
            raise ValueError("p and q are needed here or in the constructor")
        for x in (p, q):
            if not x > 0 or not math.isfinite(1 / x):
                raise ValueError("p and q are positive with a finite inverse")
        edges = self.graph.edges
        if weighted:
            if not self.graph.weighted:
                raise ValueError("the graph has no edge weights")
            check_weights(edges)
        first = UniformRandomWalk.run(self, nodes, n=n, length=min(2, length), seed=seed)
        if length < 3:
            return first
        key = ["root_pos", "walk"]
        out = first = saved(first)
        before = first.where("step = 0").select(*key, F.col("node").alias("prev"))
        here = saved(first.where("step = 1").select(*key, "node").join(before, key))
        table, degree = self.table(weighted)
        near = neighbourhoods(table, degree)
        here = here.join(degree.select(F.col("node").alias("prev"), F.col("degree").alias("before")), "prev")
        weight = (lambda at: F.get("w", at)) if weighted else (lambda at: F.lit(1.0))
        factor = lambda end, close: F.when(end == F.col("prev"), 1.0 / p).when(close, 1.0).otherwise(1.0 / q)
        tries = F.sequence(F.lit(0), F.lit(TRIES - 1))
        walk = [*key, "prev", "node", "before", "degree", "top"]
        for step in range(2, length):
            draw = lambda t, which: uniform(seed, F.col("root_pos"), F.col("walk"), F.lit(step), t, F.lit(which))  # noqa: B023, E731
            rank = lambda t: F.least(F.floor(draw(t, 0) * F.col("degree")).cast("long"), F.col("degree") - 1)  # noqa: B023, E731
            chunk = lambda t: F.floor(rank(t) / CHUNK)  # noqa: B023, E731
            # a walk is one row for each row of edges, and then for each bucket of ends, that its tries fall to: mostly one
            at = here.join(degree, "node").withColumn("chunk", F.explode(F.array_distinct(F.transform(tries, chunk)))).join(table, ["node", "chunk"])
            place = lambda t: (rank(t) % CHUNK).cast("int")  # noqa: B023, E731
            made = F.transform(F.filter(tries, lambda t: chunk(t) == F.col("chunk")), lambda t: F.struct(t.alias("try"), F.get("next", place(t)).alias("next"), weight(place(t)).alias("w")))  # noqa: B023
            found = at.select(*walk, made.alias("found"))
            kept = lambda c: bucket(c["next"], F.col("before"))
            found = found.withColumn("bucket", F.explode(F.array_distinct(F.transform("found", kept)))).join(near, ["prev", "bucket"], "left")
            bar = lambda c: draw(c["try"], 1) * F.col("top") * max(1.0 / p, 1.0, 1.0 / q)  # noqa: B023, E731
            good = F.filter("found", lambda c: (kept(c) == F.col("bucket")) & (bar(c) < c["w"] * factor(c["next"], F.array_contains("ends", c["next"]))))  # noqa: B023
            best = F.array_min(F.transform(good, lambda c: F.struct(c["try"].alias("try"), c["next"].alias("next"))))
            after = found.select(*walk, best.alias("t")).groupBy(*key).agg(F.min("t").alias("t"), *(F.first(c).alias(c) for c in walk[2:]))
            after = saved(after.select(*walk, F.col("t.next").alias("next")))
            # the few walks whose tries all fail choose among all edges of their node
            rest = after.where("next IS NULL").drop("next").join(table, "node")
            close = rest.join(near, "prev").groupBy(*key, "chunk").agg(F.flatten(F.collect_list(F.array_intersect("next", "ends"))).alias("close"))
            every = F.transform("next", lambda x, i: F.struct((F.col("chunk") * CHUNK + i).alias("rank"), x.alias("next"), (weight(i) * factor(x, F.array_contains("close", x))).alias("weight")))
            rest = rest.join(close, [*key, "chunk"], "left").select(*walk, F.explode(every).alias("e")).select(*walk, "e.*")
            chosen = pick(rest, key, ["rank"], uniform(seed, F.col("root_pos"), F.col("walk"), F.lit(step)))
            moved = [*key, F.col("node").alias("prev"), F.col("next").alias("node"), F.col("degree").alias("before")]
            now = after.where("next IS NOT NULL").select(*moved).unionByName(chosen.select(*moved))
            here = saved(now)
            out = out.unionByName(here.select(*key, F.lit(step).alias("step"), "node"))
        return out


def pick(rows: DataFrame, key: list[str], order: list[str], u: Column) -> DataFrame:
    """Of the rows of each key the first, in order, whose running weight reaches u times the total; none where that is zero."""
    run = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*key)
    summed = rows.withColumns({"_cum": F.sum("weight").over(run), "_total": F.sum("weight").over(total)})
    reached = summed.where((F.col("_total") > 0) & (F.col("_cum") >= u * F.col("_total")))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return reached.withColumn("_first", first).where("_first = 1").drop("_first", "_cum", "_total")


def naive_weighted_choices(weights, seed: int = 0, size: int | None = None):
    """Index (or ``size`` of them) drawn in proportion to a list of weights; None where there is no weight."""
    w = np.asarray(weights, dtype=np.float64)
    if (w < 0).any():
        raise ValueError("weights are not negative")
    cum = np.cumsum(w)
    if not len(cum) or cum[-1] == 0:
        return None
    draws = np.random.default_rng(seed).random(1 if size is None else size) * cum[-1]
    found = np.searchsorted(cum, draws, side="left")
    return int(found[0]) if size is None else found


def weighted_choice(rows: DataFrame, key: list[str], index: str, seed: int = 0) -> DataFrame:
    """(key, index): one index for each key, drawn in proportion to column weight."""
    if rows.where("weight < 0").limit(1).count():
        raise ValueError("weights are not negative")
    return pick(rows, key, [index], uniform(seed, *(F.col(k) for k in key))).select(*key, index)
