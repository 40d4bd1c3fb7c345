from __future__ import annotations

import numpy as np


def nodes(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "id long")


def entries(spark, a):
    r, c = np.nonzero(a)
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(r, c, strict=True)], "src long, dst long, w double")


def long(spark, x):
    return spark.createDataFrame([(i, k, float(x[i, k])) for i in range(x.shape[0]) for k in range(x.shape[1])], "id long, k int, v double")


def block(df, n, m=None):
    out = np.zeros((n, m or n))
    for r in df.collect():
        out[r["src"], r["dst"]] += r["w"]
    return out


def rows(df, n, width, col="j"):
    out = np.full((n, width), np.nan)
    for r in df.collect():
        out[r["id"], r[col]] = r["v"]
    return out


def graph(n, density, seed, weighted=False, directed=False):
    rng = np.random.default_rng(seed)
    a = (rng.random((n, n)) < density) * (rng.uniform(0.1, 2, (n, n)) if weighted else 1.0)
    np.fill_diagonal(a, 0)
    return a if directed else np.maximum(a, a.T)


def gcn(a):
    s = np.maximum(np.maximum(a, a.T), 0 * a)
    np.fill_diagonal(s, 1)
    d = s.sum(1) ** -0.5
    return (s * d[:, None] * d).T
