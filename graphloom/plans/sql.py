"""DuckDB SQL for the registered queries, put together from named common table expressions."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {
    "lines": "SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, l_quantity AS w, l_orderkey * 10 + l_linenumber AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey",
    "nn_nodes": "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation",
    "nn": "SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM lines GROUP BY src, dst",
    "ps_half": "SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem",
    "ps": "SELECT src, dst, 1e0 AS w FROM ps_half UNION ALL SELECT dst, src, 1e0 FROM ps_half",
    "ps_nodes": "SELECT p_partkey * 2 AS id FROM part UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier",
    "vectors": "SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS r(k)",
    "ps_x": "SELECT id, k, v FROM ps_nodes JOIN vectors ON id % (SELECT count(*) FROM embeddings) = vec_id",
    "cu_x": "SELECT c_custkey AS b, CAST(0 AS BIGINT) AS h, k, v FROM customer JOIN vectors ON c_custkey % (SELECT count(*) FROM embeddings) = vec_id",
    "nn_sym": "SELECT src, dst, w FROM (SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, greatest(coalesce(a.w, 0), coalesce(b.w, 0)) AS w FROM nn a FULL JOIN nn b ON a.src = b.dst AND a.dst = b.src) WHERE w <> 0",
    "pw_half": "SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ALL",
    "pw": "SELECT src, dst, n AS w FROM pw_half UNION ALL SELECT dst, src, q FROM pw_half WHERE dst % 3 <> 0",
    "pw_nodes": "SELECT p_partkey * 2 AS id FROM part UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier",
    "pw_sym": "SELECT src, dst, w FROM (SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, greatest(coalesce(a.w, 0), coalesce(b.w, 0)) AS w FROM pw a FULL JOIN pw b ON a.src = b.dst AND a.dst = b.src) WHERE w <> 0",
    "kernel": "SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, ((31 * k + 17 * j) % 101 - 50) / 500e0 AS v FROM range(128) a(k), range(64) b(j)",
    "bias": "SELECT CAST(j AS INTEGER) AS j, ((13 * j) % 11 - 5) / 100e0 AS v FROM range(64) b(j)",
    "pairs": "SELECT row_number() OVER () AS uid, l_orderkey * 10 + l_linenumber AS pos, l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem",
    "near": "SELECT b, s, id FROM (SELECT src AS b, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS s, dst AS id FROM ps_half) WHERE s < 3",
    "heads": "SELECT p_partkey * 2 AS b FROM part",
    "own_x": "SELECT b, k, v FROM heads JOIN ps_x ON id = b",
    "near_x": "SELECT b, s, k, v FROM near JOIN ps_x USING (id)",
    "hin": "SELECT DISTINCT b, r, id FROM (SELECT o_custkey AS b, 0 AS r, l_suppkey * 2 + 1 AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, 1, l_partkey * 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "hin_x": "SELECT b, r, s, k, v FROM (SELECT *, row_number() OVER (PARTITION BY b, r ORDER BY id) - 1 AS s FROM hin) JOIN ps_x USING (id) WHERE s < 3",
}


def define(name: str, body: str) -> str:
    PARTS[name] = body
    return name


def looped(name: str, nodes: str) -> str:
    return define(f"{name}_loop", f"SELECT src, dst, w FROM {name} WHERE src <> dst UNION ALL SELECT id, id, 1e0 FROM {nodes}")


def normed(name: str) -> str:
    """Symmetric, transposed."""
    define(f"{name}_deg", f"SELECT src AS id, sum(w) AS d FROM {name} GROUP BY src")
    return define(f"{name}_norm", f"SELECT e.dst AS src, e.src AS dst, CASE WHEN a.d > 0 AND coalesce(b.d, 0) > 0 THEN w / sqrt(a.d) / sqrt(b.d) ELSE 0 END AS w FROM {name} e JOIN {name}_deg a ON e.src = a.id LEFT JOIN {name}_deg b ON e.dst = b.id")


NN_GCN = normed(looped("nn_sym", "nn_nodes"))
PS_GCN = normed(looped("ps", "ps_nodes"))
NN_NORM = normed("nn")
PW_NORM = normed("pw")


def product(name: str, a: str, b: str) -> str:
    return define(name, f"SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM {a} a JOIN {b} b ON a.dst = b.src GROUP BY a.src, b.dst")


def spmm(name: str, adj: str, x: str, nodes: str, width: int = 64) -> str:
    define(f"{name}_raw", f"SELECT src AS id, k, sum(w * v) AS v FROM {adj} JOIN {x} ON dst = id GROUP BY src, k")
    return define(name, f"SELECT n.id, CAST(g.k AS INTEGER) AS k, coalesce(r.v, 0) AS v FROM {nodes} n CROSS JOIN range({width}) g(k) LEFT JOIN {name}_raw r ON r.id = n.id AND r.k = g.k")


def dense(name: str, x: str, width: int, units: int, act: str = "greatest(v, 0)", with_bias: bool = True, keys: str = "id") -> str:
    """(keys, k, v): act(x W + b)."""
    b = "JOIN bias USING (j)" if with_bias else ""
    value = "s.v + bias.v" if with_bias else "s.v"
    cols = ", ".join(f"x.{k}" for k in keys.split(", "))
    return define(name, f"SELECT {keys}, j AS k, {act} AS v FROM (SELECT {', '.join(f's.{k}' for k in keys.split(', '))}, j, {value} AS v FROM (SELECT {cols}, kernel.j, sum(x.v * kernel.v) AS v FROM {x} x JOIN kernel ON x.k = kernel.k AND kernel.k < {width} AND kernel.j < {units} GROUP BY {cols}, kernel.j) s {b})")


def whole(final: str) -> str:
    """The statement with the expressions it needs, in the order of their definition."""
    need, todo = set(), [final]
    while todo:
        for word in set(re.findall(r"\w+", todo.pop())):
            if word in PARTS and word not in need:
                need.add(word)
                todo.append(PARTS[word])
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for word in set(re.findall(r"\w+", PARTS[name])) & need - {name}:
            visit(word)
        done.append(name)

    for name in PARTS:
        if name in need:
            visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in done) + "\n" + final if done else final


def out(name: str, keys: str, value: str = "w", digits: int = 6) -> str:
    return whole(f"SELECT {keys}, round({value}, {digits}) + 0e0 AS v FROM {name}")
