from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from graphloom.operators import walks
from graphloom.sources.graph import Graph, csr_from_edges, graph_from_csr
from pyspark.sql import functions as F

from tests.helpers import nodes


def graph(spark, edges, n, weights=None):
    rows = [(i, a, b, float(w)) for i, ((a, b), w) in enumerate(zip(edges, weights or [1] * len(edges), strict=True))]
    return Graph(nodes(spark, n), spark.createDataFrame(rows, "pos long, src long, dst long, w double"))


def paths(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["root_pos"], r["walk"]][r["step"]] = r["node"]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def test_uniform(spark):
    edges = [(0, 1), (0, 1), (0, 2), (1, 0), (2, 3)]
    g = graph(spark, edges, 5)
    found = paths(walks.UniformRandomWalk(g, n=300, length=4, seed=3).run([0, 4, 0]))
    assert len(found) == 900 and all(found[1, k] == [4] for k in range(300))
    assert all((a, b) in edges for p in found.values() for a, b in zip(p, p[1:], strict=False))
    assert all(len(p) == 4 or p[-1] == 3 for k, p in found.items() if k[0] != 1)
    first = Counter(p[1] for k, p in found.items() if k[0] != 1)
    assert 1.6 < first[1] / first[2] < 2.5
    again = paths(walks.UniformRandomWalk(g).run([0, 4, 0], n=300, length=4, seed=3))
    assert again == found
    assert walks.collected(walks.UniformRandomWalk(g, 1, 2).run([4])).first()["nodes"] == [4]


def test_biased(spark):
    star = [(0, i) for i in range(1, 7)] + [(i, 0) for i in range(1, 7)] + [(1, 2), (2, 1)]
    g = graph(spark, star, 7)
    back = paths(walks.BiasedRandomWalk(g, n=200, length=3, p=1e-6, q=1.0, seed=1).run([1]))
    assert sum(p[2] == 1 for p in back.values()) > 195
    near = paths(walks.BiasedRandomWalk(g, n=300, length=3, p=1e6, q=1e6, seed=2).run([1]))
    assert all(p[2] == 2 for p in near.values() if p[1] == 0)
    heavy = graph(spark, [(0, 1), (1, 2), (1, 3), (2, 1), (3, 1)], 4, [1, 1, 9, 1, 1])
    found = paths(walks.BiasedRandomWalk(heavy, n=500, length=3, weighted=True, seed=4).run([0]))
    share = Counter(p[2] for p in found.values())
    assert 6 < share[3] / share[2] < 14
    dead = graph(spark, [(0, 1), (1, 2)], 3, [1, 0])
    assert paths(walks.BiasedRandomWalk(dead, n=1, length=3, weighted=True).run([0]))[0, 0] == [0, 1]


def test_errors(spark):
    g = graph(spark, [(0, 1), (1, 0)], 2, [1, -1])
    walk = walks.UniformRandomWalk(g)
    for bad in ({}, {"n": 1}, {"n": 0, "length": 1}, {"n": True, "length": 1}, {"n": 1, "length": 1.0}, {"n": 1, "length": 1, "seed": -1}):
        with pytest.raises(ValueError):
            walk.run([0], **bad)
    with pytest.raises(ValueError):
        walk.run("01", n=1, length=1)
    with pytest.raises(IndexError):
        walk.run([5], n=1, length=1)
    with pytest.warns(RuntimeWarning):
        assert walk.run([], n=1, length=1).count() == 0
    for bad in ({"p": 0}, {"q": -1.0}, {"p": 1e-320}, {"weighted": 1}, {"weighted": True}):
        with pytest.raises(ValueError):
            walks.BiasedRandomWalk(g, 1, 3).run([0], **bad)
    with pytest.raises(IndexError):
        walks.UniformRandomWalk(graph(spark, [(0, 9)], 2))
    assert [r["dst"] for r in walk.neighbors(0).collect()] == [1]


def test_choices(spark):
    assert walks.naive_weighted_choices([]) is None and walks.naive_weighted_choices([0, 0]) is None
    assert set(walks.naive_weighted_choices([0, 1, 0], size=20)) == {1} and walks.naive_weighted_choices([3, 0, 0]) == 0
    with pytest.raises(ValueError):
        walks.naive_weighted_choices([1, -1])
    df = spark.createDataFrame([(k, i, w) for k in range(400) for i, w in enumerate((1.0, 0.0, 3.0))], "k long, i int, weight double")
    got = Counter(r["i"] for r in walks.weighted_choice(df, ["k"], "i").collect())
    assert got[1] == 0 and 2 < got[2] / got[0] < 4.5


def test_biased_shares_on_a_hub(spark):
    """Steps from a hub of 400 edges have the shares of their weights, by tries and by the choice among all edges."""
    edges = [(0, i) for i in range(1, 401)] + [(i, 0) for i in range(1, 401)] + [(1, i) for i in range(2, 102)]
    g = graph(spark, edges, 401)
    for tries in (12, 1):
        walks.TRIES = tries
        found = paths(walks.BiasedRandomWalk(g, n=3000, length=3, p=0.05, q=4.0, seed=6).run([1]))
        walks.TRIES = 12
        at = [p for p in found.values() if p[1] == 0]
        share = Counter("back" if p[2] == 1 else "near" if p[2] <= 101 else "far" for p in at)
        total = 20 + 100 + 299 / 4
        for kind, w in (("back", 20), ("near", 100), ("far", 299 / 4)):
            assert abs(share[kind] / len(at) - w / total) < 4 * (w / total / len(at)) ** 0.5 + 0.02, (kind, tries)


def test_graph_from_pointers(spark):
    g = graph_from_csr(spark, [0, 2, 1, 3], [1, 2, 0, 9][:3], [1.0, 2.0, 3.0])
    assert sorted((r["src"], r["dst"], r["w"]) for r in g.edges.collect()) == [(0, 1, 1.0), (0, 2, 2.0), (2, 0, 3.0), (2, 2, 2.0)]
    assert paths(walks.UniformRandomWalk(g, 1, 3).run([1]))[0, 0] == [1]
    with pytest.raises(ValueError):
        graph_from_csr(spark, [0, 4], [1, 2, 3])


def test_csr_of_lists(spark):
    for edges in ([(0, 2), (2, 1), (0, 1), (0, 2)], [0, 2, 2, 1, 0, 1, 0, 2]):
        indptr, colind = csr_from_edges(spark, edges, n=4)
        assert [(r["id"], r["start"], r["stop"]) for r in indptr.orderBy("id").collect()] == [(0, 0, 3), (1, 3, 3), (2, 3, 4), (3, 4, 4)]
        assert [(r["src"], r["dst"]) for r in colind.orderBy("src", "rank").collect()] == [(0, 1), (0, 2), (0, 2), (2, 1)]
    with pytest.raises(ValueError):
        csr_from_edges(spark, [0, 1, 2])
    with pytest.raises(IndexError):
        csr_from_edges(spark, [(0, 7)], n=3)


def test_draws_and_order(spark):
    rows = spark.range(6000).select("id", walks.bounded(5, 7, F.col("id")).alias("r"), walks.bounded(6, 1, F.col("id")).alias("one"))
    got = rows.collect()
    count = Counter(r["r"] for r in got)
    assert sorted(count) == list(range(7)) and {r["one"] for r in got} == {0}
    assert sum((count[k] - 6000 / 7) ** 2 / (6000 / 7) for k in range(7)) < 22.5  # chi squared, six degrees, 0.1 %
    once, again, other = ([r["id"] for r in walks.shuffled(spark.range(200), seed, ["id"]).collect()] for seed in (1, 1, 2))
    assert once == again != other and sorted(once) == sorted(other) == list(range(200))
    assert abs(sum(i * x for i, x in enumerate(once)) / sum(i * i for i in range(200)) - 0.75) < 0.12


@pytest.mark.parametrize("size", [1, 3, 7])
def test_rows_of_edges(spark, monkeypatch, size):
    """Walks don't depend on how many edges are in a row, nor on hubs and repeated edges that lie over several partitions."""
    edges = [(0, i % 40) for i in range(1, 90)] + [(i, 0) for i in range(1, 40)] + [(i, i % 7 + 1) for i in range(5, 40)]
    g = graph(spark, edges, 41, [1 + i % 3 for i in range(len(edges))])
    runs = [lambda: walks.UniformRandomWalk(g, n=5, length=5, seed=3), lambda: walks.BiasedRandomWalk(g, n=5, length=5, p=0.3, q=3.0, seed=4), lambda: walks.BiasedRandomWalk(g, n=5, length=4, p=3.0, q=0.3, weighted=True, seed=5)]
    monkeypatch.setattr(walks, "TRIES", 2)
    want = [paths(make().run(list(range(41)))) for make in runs]
    monkeypatch.setattr(walks, "CHUNK", size)
    assert [paths(make().run(list(range(41)))) for make in runs] == want
    table, degree = walks.chunked(g.edges, True)
    rows = [(r["node"], r["chunk"] * size + i, x, w) for r in table.collect() for i, (x, w) in enumerate(zip(r["next"], r["w"], strict=True))]
    assert all(len(r["next"]) <= size for r in table.collect())
    listed = sorted((a, b, i, float(1 + i % 3)) for i, (a, b) in enumerate(edges))
    place = Counter()
    for a, b, _, w in listed:
        assert (a, place[a], b, w) in rows
        place[a] += 1
    assert len(rows) == len(edges) and {r["node"]: r["degree"] for r in degree.collect()} == dict(place)


def test_edges_are_made_once(spark):
    """However often a walk reads them."""
    g = graph(spark, [(i, (i + 1) % 50) for i in range(50)] + [(i, (i + 2) % 50) for i in range(50)], 50)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    g.edges = g.edges.mapInArrow(count, g.edges.schema)
    found = paths(walks.BiasedRandomWalk(g, n=1, length=5, p=0.5, q=2.0, weighted=True, seed=1).run(list(range(50))))
    assert len(found) == 50 and seen.value == 100
