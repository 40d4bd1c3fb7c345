from __future__ import annotations

import numpy as np
import pytest
from graphloom.functions import activations
from graphloom.operators import attention, convolution, linalg, links, sampling
from graphloom.sources.graph import FullBatchNodeGenerator, Graph
from pyspark.sql import functions as F

from tests.helpers import entries, gcn, graph, long, nodes, rows

RNG = np.random.default_rng(0)
ACTS = {
    "linear": lambda x: x, "relu": lambda x: np.maximum(x, 0), "elu": lambda x: np.where(x >= 0, x, np.expm1(x)), "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "tanh": np.tanh,
    "softplus": lambda x: np.log1p(np.exp(x)), "leaky_relu": lambda x: np.where(x >= 0, x, 0.2 * x), "hard_sigmoid": lambda x: np.clip(0.2 * x + 0.5, 0, 1), "softsign": lambda x: x / (1 + np.abs(x)), "exponential": np.exp,
}


def test_activations(spark):
    x = np.linspace(-4, 4, 17)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1)
    got = df.select(*(activations.scalar(a, F.col("x")).alias(a) for a in ACTS)).toPandas()
    for a, f in ACTS.items():
        assert np.allclose(got[a], f(x), atol=1e-12)
    clip = spark.createDataFrame([(v,) for v in (-3.0, 2.0, 1.0, 3.0, 5.0, 7.5)], "x double").coalesce(1)
    assert np.allclose(clip.select(activations.leaky_clipped(F.col("x"))).toPandas().iloc[:, 0], [0.6, 2, 1, 3, 5, 5.25])
    with pytest.raises(ValueError):
        activations.check("swish")


def softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def test_convolution_and_gather(spark):
    n, a = 12, graph(12, 0.25, 4)
    x = RNG.normal(size=(n, 5))
    for units, act in ((3, "relu"), (7, "softmax")):
        layer = convolution.GraphConvolution(units, act)
        layer.kernel, layer.bias = RNG.normal(size=(5, units)), RNG.normal(size=units)
        want = gcn(a) @ x @ layer.kernel + layer.bias
        want = softmax(want) if act == "softmax" else np.maximum(want, 0)
        got = layer.call(long(spark, x), entries(spark, gcn(a)), nodes(spark, n))
        assert np.allclose(rows(got, n, units), want, atol=1e-9)
    layer.final_layer = True
    out = spark.createDataFrame([(0, 7), (1, 2), (2, 7)], "pos long, id long")
    got = {(r["pos"], r["j"]): r["v"] for r in layer.call(long(spark, x), entries(spark, gcn(a)), nodes(spark, n), out).collect()}
    assert np.allclose([[got[p, j] for j in range(7)] for p in range(3)], want[[7, 2, 7]], atol=1e-9)
    with pytest.raises(IndexError):
        layer.call(long(spark, x), entries(spark, a), nodes(spark, n), spark.createDataFrame([(0, 99)], "pos long, id long"))
    with pytest.raises(ValueError):
        layer.call(long(spark, x[:, :4]), entries(spark, a), nodes(spark, n))


def test_models(spark):
    n, a = 10, graph(10, 0.3, 6)
    x = RNG.normal(size=(n, 4))
    edges = entries(spark, a).withColumn("pos", F.col("src") * 100 + F.col("dst"))
    gen = FullBatchNodeGenerator(Graph(nodes(spark, n), edges, long(spark, x)))
    model = convolution.GCN([5, 3], gen).build(4, seed=1)
    h = x
    for layer in model.layers:
        h = np.maximum(gcn(a) @ h @ layer.kernel, 0)
    assert np.allclose(rows(model(), n, 3), h, atol=1e-9) and model.node_model() == (((10, 4),), None)
    net = convolution.APPNP([4, 2], ["relu", "linear"], gen, approx_iter=7, teleport_probability=0.3).build(4)
    h = np.maximum(x @ net.kernels[0], 0) @ net.kernels[1]
    z = h
    for _ in range(7):
        z = 0.7 * gcn(a) @ z + 0.3 * h
    assert np.allclose(rows(net(), n, 2, "k"), z, atol=1e-9)
    with pytest.raises(TypeError):
        convolution.PPNP([1], ["relu"], None)
    for bad in ({"approx_iter": 0}, {"approx_iter": 1.0}, {"teleport_probability": 2}):
        with pytest.raises(ValueError):
            convolution.APPNP([1], ["relu"], gen, **bad)
    with pytest.raises(ValueError):
        convolution.GCN([1, 2], gen, activations=["relu"])


def dense_attention(x, a, layer, nu=None):
    heads = []
    for w, at, b in zip(layer.kernels, layer.attn, layer.bias, strict=True):
        h = x @ w
        e = (h @ at[0])[:, None] + (h @ at[1])[None]
        e = np.where(e >= 0, e, 0.2 * e)
        if nu is None:
            p = softmax(e - 1e10 * (1 - a))
        else:
            q = np.exp(e - e.max(1, keepdims=True))
            p = layer.delta * a * q * (1 - nu) + nu * (a + layer.delta * (1 - a) + np.eye(len(a))) * q
            with np.errstate(invalid="ignore"):
                p = p / p.sum(1, keepdims=True)
        heads.append(p @ h + b)
    return np.concatenate(heads, 1) if layer.attn_heads_reduction == "concat" else np.mean(heads, 0)


@pytest.mark.parametrize("case", ["plain", "empty rows", "weighted", "saliency", "saliency nu", "average"])
def test_attention(spark, case):
    n, a = 9, graph(9, 0.4, 8) + np.eye(9)
    x = RNG.normal(size=(n, 5))
    if case == "empty rows":
        a[[2, 5]] = 0
    if case == "weighted":
        a[0, 1], a[3] = 0.5, 2 * a[3]
    layer = attention.GraphAttention(3, 2, "average" if case == "average" else "concat", activation="linear", saliency_map_support="saliency" in case).build(5)
    layer.bias = RNG.normal(size=(2, 3))
    if case == "saliency nu":
        layer.non_exist_edge, layer.delta = 0.3, 0.7
    got = layer.call(long(spark, x), entries(spark, a), nodes(spark, n))
    want = dense_attention(x, a, layer, layer.non_exist_edge if "saliency" in case else None)
    assert np.allclose(rows(got, n, want.shape[1]), want, atol=1e-5 if case == "weighted" else 1e-9)


def test_sparse_attention_ignores_values(spark):
    n, a = 8, graph(8, 0.3, 9)
    a[3] = 0
    x = RNG.normal(size=(n, 4))
    layer = attention.GraphAttentionSparse(3, activation="linear").build(4)
    layer.bias = RNG.normal(size=(1, 3))
    want = dense_attention(x, a, layer)
    want[a.sum(1) == 0] = layer.bias[0]
    assert np.allclose(rows(layer.call(long(spark, x), entries(spark, 7 * a), nodes(spark, n)), n, 3), want, atol=1e-9)


def tensor(spark, x, names="bhsk"):
    places = np.indices(x.shape).reshape(x.ndim, -1)
    return spark.createDataFrame(list(zip(*(p.tolist() for p in places), x.ravel().tolist(), strict=True)), ", ".join(f"{n} {'int' if n in 'kr' else 'long'}" for n in names) + ", v double")


def read(df, shape):
    out = np.full(shape, np.inf)
    for r in df.collect():
        out[r["b"], r["h"], r["j"]] = r["v"]
    return out


def test_aggregators(spark):
    own, near = RNG.normal(size=(3, 2, 1, 5)), RNG.normal(size=(3, 2, 4, 5))
    xs, xn = tensor(spark, own), tensor(spark, near)
    heads = xs.select("b", "h").distinct()
    mean = sampling.MeanAggregator(7).build([5, 5])
    want = np.maximum(np.concatenate([own[:, :, 0] @ mean.w_group[0], near.mean(2) @ mean.w_group[1]], -1), 0)
    assert np.allclose(read(mean.call([xs, xn]), (3, 2, 7)), want, atol=1e-9)
    wide = sampling.MeanAggregator(4, act="linear").build([20])
    assert np.allclose(read(wide.call([xn]), (3, 2, 4)), near.reshape(3, 2, 20) @ wide.w_group[0], atol=1e-9)
    for kind, pool, empty in ((sampling.MaxPoolingAggregator, np.max, 0.0), (sampling.MeanPoolingAggregator, np.mean, np.nan)):
        agg = kind(6, act="linear").build([5, 5])
        hidden = pool(np.maximum(near @ agg.w_pool[1] + agg.b_pool[1], 0), 2)
        want = np.concatenate([own[:, :, 0] @ agg.w_group[0], hidden @ agg.w_group[1]], -1)
        assert np.allclose(read(agg.call([xs, xn]), (3, 2, 6)), want, atol=1e-9)
        none = read(agg.call([xs, xn.where("b > 0")], heads), (3, 2, 6))
        want[0, :, 3:] = empty
        assert np.allclose(none, want, atol=1e-9, equal_nan=True)
    att = sampling.AttentionalAggregator(4, act="linear").build([5])
    s, g = own[:, :, 0] @ att.w_group[0], np.concatenate([own, near], 2) @ att.w_group[0]
    e = (s @ att.w_attn_s)[..., None] + g @ att.w_attn_g
    want = (softmax(np.where(e >= 0, e, 0.2 * e))[..., None] * g).sum(2)
    assert np.allclose(read(att.call(xs, [xn]), (3, 2, 4)), want, atol=1e-9)
    att.bias = np.zeros(3)
    with pytest.raises(ValueError):
        att.call(xs, [xn])
    assert sampling.shares(7, 3) == [3, 2, 2]


def test_sage_and_hin(spark):
    hops = [RNG.normal(size=(2, 1, 3)), RNG.normal(size=(2, 2, 3)), RNG.normal(size=(2, 6, 3))]
    model = sampling.GraphSAGE([4, 2], [2, 3]).build(3)
    h = hops
    for layer, relu in zip(model.layers, (True, False), strict=True):
        after = []
        for i in range(len(h) - 1):
            near = h[i + 1].reshape(2, h[i].shape[1], -1, h[i + 1].shape[2]).mean(2)
            y = np.concatenate([h[i] @ layer.w_group[0], near @ layer.w_group[1]], -1)
            after.append(np.maximum(y, 0) if relu else y)
        h = after
    want = h[0] / np.maximum(np.linalg.norm(h[0], axis=-1, keepdims=True), 1e-7)
    assert np.allclose(read(model([tensor(spark, x, "bhk") for x in hops]), (2, 1, 2)), want, atol=1e-9)
    with pytest.raises(TypeError):
        model(None)
    with pytest.raises(ValueError):
        model([None])
    with pytest.raises(ValueError):
        sampling.GraphSAGE([1], [1], normalize="l1")
    own, near = RNG.normal(size=(3, 2, 5)), RNG.normal(size=(2, 3, 2, 3, 4))
    agg = sampling.MeanHinAggregator(8, 2).build(5, 4)
    want = np.maximum(np.concatenate([own @ agg.w_self, sum(near[r].mean(2) @ agg.w_neigh[r] for r in range(2)) / 2], -1), 0)
    assert np.allclose(read(agg.call(tensor(spark, own, "bhk"), tensor(spark, near, "rbhsk")), (3, 2, 8)), want, atol=1e-9)
    with pytest.raises(ValueError):
        sampling.MeanHinAggregator(8, 1).build(5, 4).call(tensor(spark, own, "bhk"), tensor(spark, near, "rbhsk"))
    with pytest.raises(AssertionError):
        sampling.MeanHinAggregator(7, 1)
    with pytest.raises(ValueError):
        sampling.HinSAGE([4], nr=1)(None, [None])


def test_links(spark):
    x = RNG.normal(size=(6, 4))
    pairs = [(0, 1), (3, 3), (5, 0)]
    df, emb = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pos long, src long, dst long"), long(spark, x)
    a, b = (x[[p[i] for p in pairs]] for i in (0, 1))
    kernel, bias = RNG.normal(size=(4, 3)), RNG.normal(size=3)

    def value(f):
        got = {(r["pos"], r["j"]): r["v"] for r in f(df, emb).collect()}
        return np.array([[got[i, j] for j in range(1 + max(k for _, k in got))] for i in range(3)])

    for m, y in (("l1", abs(a - b)), ("l2", (a - b) ** 2), ("mul", a * b), ("hadamard", a * b), ("avg", (a + b) / 2)):
        assert np.allclose(value(links.link_inference(3, "tanh", m, kernel=kernel, bias=bias)), np.tanh(y @ kernel + bias), atol=1e-9)
    both = RNG.normal(size=(8, 3))
    assert np.allclose(value(links.link_inference(3, "linear", "concat", kernel=both)), np.concatenate([a, b], 1) @ both, atol=1e-9)
    assert np.allclose(value(links.link_classification())[:, 0], 1 / (1 + np.exp(-(a * b).sum(1))), atol=1e-9)
    assert np.allclose(value(links.link_inference(output_act="softmax")), 1)
    with pytest.warns(UserWarning):
        links.link_inference(2)
    with pytest.raises(NotImplementedError):
        links.link_inference(edge_embedding_method="cosine")
    for bad in ({"edge_embedding_method": "l1"}, {"edge_embedding_method": "l1", "kernel": kernel}, {"kernel": kernel}, {"output_act": "x"}, {"bias": [1, 2]}):
        with pytest.raises(ValueError):
            links.link_inference(**bad)
    with pytest.raises(ValueError):
        links.link_regression(edge_embedding_method="mul")


def test_products(spark):
    a, x = graph(6, 0.4, 2, weighted=True, directed=True), RNG.normal(size=(6, 3))
    a[2] = 0
    got = linalg.sparse_matmul_dense(entries(spark, a), long(spark, x), 6, 6, nodes(spark, 6))
    assert np.allclose(rows(got, 6, 3, "k"), a @ x, atol=1e-12)
    with pytest.raises(IndexError):
        linalg.sparse_matmul_dense(entries(spark, a), long(spark, x), 6, 3)
    with pytest.raises(ValueError):
        linalg.sparse_matmul_dense(entries(spark, a[:, :2]), long(spark, x), 6, 2)
    with pytest.raises(ValueError):
        linalg.normalization(long(spark, x), ["id"], "l1")
    zero = np.vstack([x, np.zeros(3)])
    assert np.allclose(rows(linalg.l2_normalize(long(spark, zero), ["id"]), 7, 3, "k")[-1], 0)
    assert [r["x"] for r in linalg.to_arrays(long(spark, x)).orderBy("id").collect()] == x.tolist()
