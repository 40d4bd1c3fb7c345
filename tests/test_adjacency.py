from __future__ import annotations

import numpy as np
import pytest
from graphloom.operators import adjacency as A
from graphloom.sources.graph import FullBatchNodeGenerator, Graph, adjacency, csr, ilocs, sparse_tensor, summed

from tests.helpers import block, entries, gcn, graph, nodes


@pytest.fixture(scope="module")
def directed():
    a = graph(9, 0.3, 1, weighted=True, directed=True)
    a[4] = 0  # no way out
    a[2, 2] = 3.0
    return a


def test_normalisation(spark, directed):
    a, n = directed, len(directed)
    adj, ids = entries(spark, a), nodes(spark, n)
    d = a.sum(1)
    f = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    assert np.allclose(block(A.normalize_adj(adj, ids), n), (a * f[:, None] * f).T, atol=1e-12)
    assert np.allclose(block(A.normalize_adj(adj, ids, symmetric=False), n), a * (f**2)[:, None], atol=1e-12)
    assert np.allclose(block(A.normalized_laplacian(adj, ids), n), np.eye(n) - (a * f[:, None] * f).T, atol=1e-12)
    c = a.sum(0)
    g = np.where(c > 0, 1 / np.sqrt(np.where(c > 0, c, 1)), 0)
    assert np.allclose(block(A.calculate_laplacian(adj), n), a * g[:, None] * g, atol=1e-12)
    looped = a.copy()
    np.fill_diagonal(looped, 1)
    assert np.allclose(block(A.add_self_loops(adj, ids), n), looped)
    assert np.allclose(block(A.symmetrize(adj), n), np.maximum(a, a.T))
    assert np.allclose(block(A.rescale_laplacian(adj, ids, 4.0), n), 0.5 * a - np.eye(n))
    assert np.allclose(block(A.rescale_laplacian(adj, ids, -1.0), n), a - np.eye(n))


def test_lone_negative_edge_vanishes(spark):
    a = np.array([[0, -2.0, 0], [0, 0, 3.0], [0, -1.0, -5.0]])
    want = np.maximum(a, a.T)
    assert np.allclose(block(A.symmetrize(entries(spark, a)), 3), want)


def test_powers_and_pagerank(spark):
    a, n = graph(8, 0.3, 3), 8
    adj, ids = entries(spark, a), nodes(spark, n)
    s = gcn(a)
    assert np.allclose(block(A.gcn_adj_feats(None, adj, ids)[1], n), s, atol=1e-12)
    assert np.allclose(block(A.gcn_adj_feats(None, adj, ids, 3, "sgc")[1], n), np.linalg.matrix_power(s, 3), atol=1e-12)
    assert np.allclose(block(A.preprocess(adj, ids), n), s, atol=1e-12)
    want = 0.1 * np.linalg.inv(np.eye(n) - 0.9 * s)
    assert np.allclose(block(A.ppnp_adj_feats(None, adj, ids)[1], n), want, atol=1e-9)
    assert np.allclose(block(A.ppnp_adj_feats(None, adj, ids, 1)[1], n), np.eye(n))
    assert not A.ppnp_adj_feats(None, adj, ids, 0)[1].count()
    assert abs(A.power_iteration(adj, ids) - np.abs(np.linalg.eigvalsh(a)).max()) < 1e-3


def test_power_iteration_by_joins(spark, monkeypatch):
    a = graph(6, 0.5, 5) + np.eye(6)
    here = A.power_iteration(entries(spark, a), nodes(spark, 6), max_iter=4)
    monkeypatch.setattr(A, "DENSE", 2)
    assert abs(A.power_iteration(entries(spark, a), nodes(spark, 6), max_iter=4) - here) < 1e-9


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.ones((4, 4)), np.diag([1.0, 0.0]), np.arange(1.0, 10).reshape(3, 3)])
def test_singular(spark, a):
    with pytest.raises(np.linalg.LinAlgError):
        A.invert(entries(spark, a) if a.any() else entries(spark, np.eye(3)).where("false"), nodes(spark, len(a)))


def test_inverse(spark):
    a = graph(7, 0.5, 2, weighted=True, directed=True) + 3 * np.eye(7)[::-1]
    assert np.allclose(block(A.invert(entries(spark, a), nodes(spark, 7)), 7) @ a, np.eye(7), atol=1e-9)


def test_generator(spark):
    edges = spark.createDataFrame([(0, 0, 1, 2.0), (1, 0, 1, 5.0), (2, 1, 2, 0.0), (3, 2, 0, 1.0)], "pos long, src long, dst long, w double")
    g = Graph(nodes(spark, 4), edges)
    assert block(adjacency(g), 4)[0, 1] == 1
    assert {(r["src"], r["dst"], r["w"]) for r in adjacency(g, True).collect()} == {(0, 1, 5.0), (2, 0, 1.0)}
    gen = FullBatchNodeGenerator(g, method="none")
    assert len(gen) == 4 and gen.num_batch_dims() == 1 and gen.default_corrupt_input_index_groups() == [[0]]
    assert not np.allclose(block(gen.adj, 4), block(gen.adj, 4).T)
    assert np.allclose(np.diag(block(FullBatchNodeGenerator(g, method="gat").adj, 4)), 1)
    assert FullBatchNodeGenerator(g, transform=lambda features, A: ("f", "a")).flow([1])[1:] == ("f", "a")
    for bad in ({"method": "chebyshev"}, {"method": "x"}, {"method": "ppnp"}, {"method": "sgc", "k": 0}):
        with pytest.raises(ValueError):
            FullBatchNodeGenerator(g, **bad)
    with pytest.raises(TypeError):
        FullBatchNodeGenerator(object())
    with pytest.raises(ValueError):
        FullBatchNodeGenerator(Graph(g.nodes, edges.drop("w")), weighted=True)
    with pytest.raises(IndexError):
        FullBatchNodeGenerator(Graph(nodes(spark, 2), edges))
    with pytest.raises(ValueError):
        A.ppnp_adj_feats(None, edges, g.nodes, 1.5)
    with pytest.raises(ValueError):
        A.gcn_adj_feats(None, edges, g.nodes, method="self_loops")


def test_rows_of_edges(spark):
    edges = spark.createDataFrame([(0, 2, 1), (1, 0, 3), (2, 0, 1), (3, 0, 1)], "pos long, src long, dst long")
    indptr, colind = csr(edges, nodes(spark, 5))
    assert sorted(tuple(r) for r in indptr.collect()) == [(0, 3, 0, 3), (1, 0, 3, 3), (2, 1, 3, 4), (3, 0, 4, 4), (4, 0, 4, 4)]
    assert sorted((r["src"], r["rank"], r["dst"]) for r in colind.collect()) == [(0, 0, 1), (0, 1, 1), (0, 2, 3), (2, 0, 1)]
    assert [tuple(r) for r in ilocs(spark.createDataFrame([(9,), (4,), (70,)], "id long")).orderBy("id").collect()] == [(4, 0), (9, 1), (70, 2)]
    coo = spark.createDataFrame([(1, 0, 2.0, 0), (0, 1, 1.0, 1), (0, 1, 4.0, 2)], "src long, dst long, w double, pos long")
    assert [r["pos"] for r in sparse_tensor(coo, 2, 2).collect()] == [1, 2, 0]
    assert {(r["src"], r["dst"]): r["w"] for r in summed(coo).collect()} == {(0, 1): 5.0, (1, 0): 2.0}
    with pytest.raises(IndexError):
        sparse_tensor(coo, 2, 1)


class Coo:
    """What SciPy's sparse matrices give."""

    row, col, data = np.array([2, 0, 2]), np.array([1, 1, 1]), np.array([1.0, 2.0, 3.0])

    def tocoo(self):
        return self


def test_sparse_inspection(spark):
    from graphloom.sources import graph as src

    got = src.from_scipy(spark, Coo())
    assert [(r["pos"], r["src"], r["dst"]) for r in src.indices(got).orderBy("pos").collect()] == [(0, 0, 1), (1, 2, 1), (2, 2, 1)]
    assert src.n_entries(got) == 3 and src.toarray(got, 3, 2).tolist() == [[0, 2], [0, 0], [0, 4]]
    with pytest.raises(ValueError):
        src.toarray(got, 1 << 20, 1 << 20)


def test_power_iteration_by_joins(spark, monkeypatch):
    a = graph(30, 0.3, 5, weighted=True)
    one = A.power_iteration(entries(spark, a), nodes(spark, 30))
    monkeypatch.setattr(A, "SMALL", 10)
    two = A.power_iteration(entries(spark, a), nodes(spark, 30), max_iter=6)
    v = np.sin(np.arange(30) + 1.0) / np.sqrt(30)
    for _ in range(6):
        u = a @ v
        v = u / np.linalg.norm(u)
    assert abs(one - np.linalg.eigvalsh(a).max()) < 1e-6 and abs(two - np.linalg.norm(u)) < 1e-9
