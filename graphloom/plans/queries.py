"""The graph queries: name -> query, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import activations
from graphloom.operators import adjacency as A
from graphloom.operators import attention, convolution, linalg, links, sampling, walks, wide
from graphloom.plans import graphs as G
from graphloom.plans import sql as S
from graphloom.sources import graph as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def shown(df: DataFrame, *keys: str, value: str = "w", digits: int = 6) -> DataFrame:
    return df.select(*keys, (F.round(value, digits) + F.lit(0.0)).alias("v"))


# graphs, adjacency


def adjacency_queries(graph: str, norm: str, edges, nodes, suffix: str) -> None:
    """The adjacency and Laplacian operators over a directed, weighted graph; graph, graph_nodes, graph_sym are its SQL names."""
    loops = S.define(f"{graph}_loops", f"SELECT src, dst, w FROM {graph} WHERE src <> dst UNION ALL SELECT id, id, 1e0 FROM {graph}_nodes")
    left = S.define(f"{graph}_left", f"SELECT src, dst, CASE WHEN d > 0 THEN w / d ELSE 0 END AS w FROM {loops} JOIN (SELECT src AS id, sum(w) AS d FROM {loops} GROUP BY src) ON src = id")
    lap = S.define(f"{graph}_lap", f"SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, -w AS w FROM {norm} UNION ALL SELECT id, id, 1e0 FROM {graph}_nodes) GROUP BY src, dst")
    calc = S.define(f"{graph}_calc", f"SELECT src, dst, w / sqrt(a.d) / sqrt(b.d) AS w FROM {graph} JOIN (SELECT dst AS id, sum(w) AS d FROM {graph} GROUP BY dst) a ON src = a.id JOIN (SELECT dst AS id, sum(w) AS d FROM {graph} GROUP BY dst) b ON dst = b.id")
    scaled = S.define(f"{graph}_scaled", f"SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w * (2 / 1.7e0) AS w FROM {lap} UNION ALL SELECT id, id, -1e0 FROM {graph}_nodes) GROUP BY src, dst")
    made = {
        "adj_self_loops": (loops, A.add_self_loops),
        "adj_symmetrize": (f"{graph}_sym", lambda a, n: A.symmetrize(a)),
        "adj_norm_sym": (norm, A.normalize_adj),
        "adj_norm_left": (left, lambda a, n: A.normalize_adj(a, n, symmetric=False, self_loops=True)),
        "laplacian_norm": (lap, A.normalized_laplacian),
        "laplacian_calc": (calc, lambda a, n: A.calculate_laplacian(a).where("w <> 0")),
        "laplacian_rescale": (scaled, lambda a, n: A.rescale_laplacian(A.normalized_laplacian(a, n), n, 1.7)),
        "sum_of_rows": (S.define(f"{graph}_rows", f"SELECT src, src AS dst, sum(w) AS w FROM {graph} GROUP BY src"), lambda a, n: src.row_sums(a).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("v").alias("w"))),
    }
    for name, (sql, operator) in made.items():
        QUERIES[name + suffix] = lambda spark, d, operator=operator: shown(operator(edges(spark, d), nodes(spark, d)), "src", "dst")
        ORACLE_SQL[name + suffix] = S.out(sql, "src, dst")


adjacency_queries("nn", S.NN_NORM, G.trade, G.nations, "")
adjacency_queries("pw", S.PW_NORM, G.weighted_parts, G.part_nodes, "_parts")


@query(S.whole("SELECT src, dst, arg_max(w, pos * 1000 + w) AS v FROM lines GROUP BY src, dst"))
def adj_weighted_last_wins(spark, d):
    graph = src.Graph(G.nations(spark, d), G.trade_lines(spark, d))
    return src.adjacency(graph, weighted=True).withColumnRenamed("w", "v")


@query(S.whole("SELECT id, CAST(degree AS BIGINT) AS degree, CAST(stop - degree AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (SELECT id, degree, sum(degree) OVER (ORDER BY id) AS stop FROM (SELECT n.id, count(e.src) AS degree FROM ps_nodes n LEFT JOIN ps e ON e.src = n.id GROUP BY n.id))"))
def csr_indptr(spark, d):
    graph = G.part_graph(spark, d)
    return src.csr(graph.edges, graph.nodes)[0]


@query(S.whole("SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS BIGINT) AS rank, dst FROM ps"))
def csr_neighbors(spark, d):
    graph = G.part_graph(spark, d)
    return src.csr(graph.edges, graph.nodes)[1].select("src", "rank", "dst")


@query(S.whole("SELECT dst AS v FROM ps WHERE src = 2 ORDER BY dst"))
def node_neighbors(spark, d):
    return src.neighbors(G.part_graph(spark, d).edges, 2).select(F.col("dst").alias("v"))


@query(S.whole("SELECT src, dst, w AS v, pos FROM lines"))
def coo_canonical(spark, d):
    return src.sparse_tensor(G.trade_lines(spark, d), 25, 25).withColumnRenamed("w", "v")


@query(S.whole("SELECT src, dst, sum(w) AS v FROM lines GROUP BY src, dst"))
def coo_duplicates_sum(spark, d):
    return src.summed(G.trade_lines(spark, d)).withColumnRenamed("w", "v")


@query("SELECT * FROM (VALUES (0, 1, 2e0), (1, 0, -1e0), (2, 2, 5e-1)) AS t(src, dst, v)")
def coo_from_dense(spark, d):
    return src.from_dense(spark, np.array([[0, 2.0, 0], [-1.0, 0, 0], [0, 0, 0.5]])).select(F.col("src").cast("int"), F.col("dst").cast("int"), F.col("w").alias("v"))


@query(S.whole("SELECT src AS id, sum(w) AS v FROM nn GROUP BY src"))
def row_sums(spark, d):
    return src.row_sums(G.trade(spark, d))


@query(S.whole("SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS iloc FROM ps_nodes"))
def node_ilocs(spark, d):
    return src.ilocs(G.part_nodes(spark, d))


@query(S.out(S.PS_GCN, "src, dst"))
def gcn_adj(spark, d):
    return shown(src.FullBatchNodeGenerator(G.part_graph(spark, d)).adj, "src", "dst")


@query(S.out(S.PS_GCN, "src, dst"))
def preprocess_adj(spark, d):
    return shown(A.preprocess(G.parts(spark, d), G.part_nodes(spark, d)), "src", "dst")


@query(S.whole("SELECT n.id, 1 AS batch_dims, d.degree, round(x.v, 6) + 0e0 AS v FROM ps_nodes n JOIN (SELECT id, sum((k + 1) * v) AS v FROM ps_x GROUP BY id) x USING (id) LEFT JOIN (SELECT src AS id, count(*) AS degree FROM ps GROUP BY src) d USING (id)"))
def generator_flow(spark, d):
    """What flow gives for all nodes: each id with its vector's weighted sum and its number of entries."""
    gen = src.FullBatchNodeGenerator(G.part_graph(spark, d), method="none")
    ids, x, adj = gen.flow(gen.graph.nodes)
    total = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    rows = ids.join(x.select("id", total.alias("v")), "id").join(adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left")
    return shown(rows.withColumn("batch_dims", F.lit(gen.num_batch_dims())), "id", "batch_dims", "degree", value="v")


@query(S.out(S.product("nn_p2", S.NN_GCN, S.NN_GCN), "src, dst"))
def sgc_power2(spark, d):
    return shown(A.gcn_adj_feats(None, G.trade(spark, d), G.nations(spark, d), 2, "sgc")[1], "src", "dst")


@query(S.out(S.product("nn_p3", S.NN_GCN, "nn_p2"), "src, dst"))
def sgc_power3(spark, d):
    return shown(A.gcn_adj_feats(None, G.trade(spark, d), G.nations(spark, d), 3, "sgc")[1], "src", "dst")


def near_one(df: DataFrame) -> DataFrame:
    return shown(df, "src", "dst").withColumn("v", F.abs("v"))


IDENTITY = S.whole("SELECT a.id AS src, b.id AS dst, CASE WHEN a.id = b.id THEN 1e0 ELSE 0e0 END AS v FROM nn_nodes a CROSS JOIN nn_nodes b")


@query(IDENTITY)
def invert_check(spark, d):
    """A matrix times its inverse."""
    nodes = G.nations(spark, d)
    a = A.gcn_adjacency(G.trade(spark, d), nodes).unionByName(A.identity(nodes, 2.0)).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return near_one(A.matrix_product(a, A.invert(a, nodes)))


@query(IDENTITY)
def ppr_matrix(spark, d):
    """(I - (1 - a) A) times the PageRank matrix, over a."""
    nodes, adj = G.nations(spark, d), G.trade(spark, d)
    ppr = A.ppnp_adj_feats(None, adj, nodes, 0.2)[1]
    less = A.gcn_adjacency(adj, nodes).withColumn("w", F.col("w") * -0.8)
    whole = A.identity(nodes).unionByName(less).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return near_one(A.matrix_product(whole, ppr).withColumn("w", F.col("w") / 0.2))


S.define("pi_mat", "SELECT list(r ORDER BY src) AS m FROM (SELECT a.id AS src, list(coalesce(e.w, 0) ORDER BY b.id) AS r FROM nn_nodes a CROSS JOIN nn_nodes b LEFT JOIN nn_sym e ON e.src = a.id AND e.dst = b.id GROUP BY a.id)")
S.define(
    "pi_it",
    """SELECT 0 AS i, list_transform(range(1, len(m) + 1), lambda x: sin(x) / sqrt(len(m))) AS v, 0e0 AS value, 1e0 AS moved FROM pi_mat
    UNION ALL SELECT i + 1, list_transform(u, lambda x: x / norm), norm, list_sum(list_transform(list_zip(u, v), lambda z: abs(z[1] / norm - z[2])))
    FROM (SELECT *, sqrt(list_dot_product(u, u)) AS norm FROM (SELECT i, v, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM pi_it, pi_mat WHERE i < 100 AND moved >= 1e-10))""",
)


@query(S.whole("SELECT round(value, 6) AS value FROM pi_it ORDER BY i DESC LIMIT 1"))
def power_iteration(spark, d):
    """The greatest eigenvalue of the symmetrised trade, by the same steps in SQL."""
    return spark.createDataFrame([(round(A.power_iteration(A.symmetrize(G.trade(spark, d)), G.nations(spark, d)), 6),)], "value double")


# products, reductions


S.spmm("ps_ax", S.PS_GCN, "ps_x", "ps_nodes")


def gcn_parts(spark, d):
    return A.gcn_adjacency(G.parts(spark, d), G.part_nodes(spark, d))


@query(S.out("ps_ax", "id, k", "v"))
def spmm(spark, d):
    nodes = G.part_nodes(spark, d)
    return shown(linalg.spmm(gcn_parts(spark, d), G.features(spark, d, nodes), nodes, G.WIDTH), "id", "k", value="v")


@query(S.whole("SELECT src AS id, round(sum(w * v), 6) + 0e0 AS v FROM ps_loop_norm JOIN ps_x ON dst = id AND k = 0 GROUP BY src"))
def spmv(spark, d):
    x = G.long_features(spark, d, G.part_nodes(spark, d)).where("k = 0").select("id", "v")
    return shown(linalg.spmv(gcn_parts(spark, d), x), "id", value="v")


@query(S.whole("SELECT id AS i, j, round(sum(x.v * kernel.v), 6) + 0e0 AS v FROM ps_x x JOIN kernel ON x.k = kernel.k WHERE j < 5 GROUP BY id, j"))
def dot(spark, d):
    x = G.long_features(spark, d, G.part_nodes(spark, d)).withColumnRenamed("id", "i")
    return shown(linalg.dot(x, linalg.weights(spark, G.kernel(G.WIDTH, 5))), "i", "j", value="v")


@query(S.whole("SELECT id AS i, round(sum(x.v * bias.v), 6) + 0e0 AS v FROM ps_x x JOIN bias ON x.k = bias.j GROUP BY id"))
def dot_vec(spark, d):
    x = G.long_features(spark, d, G.part_nodes(spark, d)).withColumnRenamed("id", "i")
    return shown(linalg.dot_vec(x, linalg.weights(spark, G.bias(G.WIDTH), "k")), "i", value="v")


@query(S.whole("SELECT src, dst, round(exp(w / 100 - m) / sum(exp(w / 100 - m)) OVER (PARTITION BY src), 6) + 0e0 AS v FROM (SELECT *, max(w / 100) OVER (PARTITION BY src) AS m FROM nn)"))
def sparse_softmax(spark, d):
    return shown(linalg.sparse_softmax(G.trade(spark, d).withColumn("w", F.col("w") / 100)), "src", "dst")


@query(S.whole("SELECT id, k, round(exp(v) / sum(exp(v)) OVER (PARTITION BY id), 6) + 0e0 AS v FROM ps_x"))
def row_softmax(spark, d):
    return shown(linalg.softmax(G.long_features(spark, d, G.part_nodes(spark, d)), ["id"]), "id", "k", value="v")


@query(S.whole("SELECT id, k, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-7), 6) + 0e0 AS v FROM ps_x"))
def l2_normalize(spark, d):
    return shown(linalg.l2_normalize(G.long_features(spark, d, G.part_nodes(spark, d)), ["id"]), "id", "k", value="v")


@query(S.whole("SELECT id, k AS j, round(v + b, 6) + 0e0 AS v FROM ps_x JOIN (SELECT j, v AS b FROM bias) ON k = j"))
def bias_add(spark, d):
    x = G.long_features(spark, d, G.part_nodes(spark, d)).withColumnRenamed("k", "j")
    return shown(linalg.add_bias(x, linalg.weights(spark, G.bias(G.WIDTH), "j")), "id", "j", value="v")


@query(S.whole("SELECT id, k AS j, round(v, 6) + 0e0 AS v FROM ps_x UNION ALL SELECT id, k + 64, round(v * v, 6) + 0e0 FROM ps_x"))
def concat_blocks(spark, d):
    x = G.long_features(spark, d, G.part_nodes(spark, d)).withColumnRenamed("k", "j")
    return shown(linalg.concat([x, x.withColumn("v", F.col("v") * F.col("v"))], [G.WIDTH, G.WIDTH]), "id", "j", value="v")


@query(S.whole("SELECT id, k AS j, round((v + v * v) / 2, 6) + 0e0 AS v FROM ps_x"))
def average_blocks(spark, d):
    x = G.long_features(spark, d, G.part_nodes(spark, d)).withColumnRenamed("k", "j")
    return shown(linalg.average([x, x.withColumn("v", F.col("v") * F.col("v"))], ["id", "j"]), "id", "j", value="v")


# activations

ACTS = {
    "linear": "x", "relu": "greatest(x, 0)", "elu": "CASE WHEN x >= 0 THEN x ELSE exp(x) - 1 END", "sigmoid": "1 / (1 + exp(-x))", "tanh": "(exp(2 * x) - 1) / (exp(2 * x) + 1)",
    "softplus": "ln(1 + exp(x))", "leaky_relu": "CASE WHEN x >= 0 THEN x ELSE 0.2e0 * x END", "hard_sigmoid": "greatest(0, least(1, 0.2e0 * x + 0.5e0))", "softsign": "x / (1 + abs(x))", "exponential": "exp(x)",
}


@query(f"SELECT vec_id, {', '.join(f'round({v}, 6) + 0e0 AS {k}' for k, v in ACTS.items())} FROM (SELECT vec_id, 10 * CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def activations_all(spark, d):
    x = G.table(spark, d, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 10).alias("x"))
    return x.select("vec_id", *((F.round(activations.scalar(a, F.col("x")), 6) + F.lit(0.0)).alias(a) for a in ACTS))


@query("SELECT vec_id, round(x + 0.9e0 * greatest(1 - x, 0) - 0.9e0 * greatest(x - 5, 0), 6) + 0e0 AS v FROM (SELECT vec_id, 30 * CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def leaky_clipped(spark, d):
    x = G.table(spark, d, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 30).alias("x"))
    return shown(x.withColumn("v", activations.leaky_clipped(F.col("x"))), "vec_id", value="v")


# convolution

S.dense("ps_gcn1", "ps_ax", 64, 6)
S.spmm("ps_gcn1_ax", S.PS_GCN, "ps_gcn1", "ps_nodes", 6)
S.dense("ps_gcn2", "ps_gcn1_ax", 6, 4)
S.define("out_idx", "SELECT pos, id FROM (VALUES (0, 6), (1, 2), (2, 3), (3, 6), (4, 1)) AS t(pos, id)")


def conv(units, rows, final=False, activation="relu"):
    layer = convolution.GraphConvolution(units, activation, True, final)
    layer.kernel, layer.bias = G.kernel(rows, units), G.bias(units)
    return layer


@query(S.out("ps_gcn1", "id, k AS j", "v"))
def gcn_conv(spark, d):
    nodes = G.part_nodes(spark, d)
    return shown(conv(6, G.WIDTH).call(G.features(spark, d, nodes), gcn_parts(spark, d), nodes), "id", "j", value="v")


def stack(spark, d, out=None):
    model = convolution.GCN([6, 4], src.FullBatchNodeGenerator(G.part_graph(spark, d)))
    model.build(G.WIDTH)
    for layer, rows in zip(model.layers, (G.WIDTH, 6), strict=True):
        layer.kernel, layer.bias = G.kernel(rows, layer.units), G.bias(layer.units)
    return model(out)


@query(S.out("ps_gcn2", "id, k AS j", "v"))
def gcn_stack(spark, d):
    return shown(stack(spark, d), "id", "j", value="v")


@query(S.whole("SELECT CAST(pos AS BIGINT) AS pos, CAST(id AS BIGINT) AS id, k AS j, round(v, 6) + 0e0 AS v FROM out_idx JOIN ps_gcn2 USING (id)"))
def gcn_gather(spark, d):
    out = spark.createDataFrame([(0, 6), (1, 2), (2, 3), (3, 6), (4, 1)], "pos long, id long")
    return shown(stack(spark, d, out), "pos", "id", "j", value="v")


# attention


def gat_sql(name: str, edges: str, reduction: str = "concat", saliency: bool = False) -> str:
    """Two heads of four columns; kernels shifted by 7 a head, attention by part."""
    S.define("gat_kernel", "SELECT head, CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, ((31 * k + 17 * j + 7 * head) % 101 - 50) / 500e0 AS v FROM range(2) h(head), range(64) a(k), range(4) b(j)")
    S.define("gat_h", "SELECT id, head, j, sum(x.v * g.v) AS v FROM ps_x x JOIN gat_kernel g ON x.k = g.k GROUP BY id, head, j")
    S.define("gat_s", "SELECT id, head, sum(v * ((31 * head + 17 * j + 3) % 101 - 50) / 500e0) AS s, sum(v * ((31 * head + 17 * j + 5) % 101 - 50) / 500e0) AS t FROM gat_h GROUP BY id, head")
    S.define(f"{name}_l", f"SELECT e.src, e.dst, a.head, CASE WHEN s + b.t >= 0 THEN s + b.t ELSE 0.2e0 * (s + b.t) END AS l FROM {edges} e JOIN (SELECT id, head, s FROM gat_s) a ON e.src = a.id JOIN (SELECT id, head, t FROM gat_s) b ON e.dst = b.id AND a.head = b.head")
    S.define(f"{name}_p", f"SELECT src, dst, head, exp(l) / sum(exp(l)) OVER (PARTITION BY src, head) AS p FROM {name}_l")
    S.define(f"{name}_o", f"SELECT src AS id, p.head, j, sum(p * v) AS v FROM {name}_p p JOIN gat_h h ON p.dst = h.id AND p.head = h.head GROUP BY src, p.head, j")
    S.define(f"{name}_n", f"SELECT n.id, CAST(x.head AS INTEGER) AS head, CAST(y.j AS INTEGER) AS j, coalesce(o.v, 0) + ((13 * (x.head * 4 + y.j)) % 11 - 5) / 100e0 AS v FROM ps_nodes n CROSS JOIN range(2) x(head) CROSS JOIN range(4) y(j) LEFT JOIN {name}_o o ON o.id = n.id AND o.head = x.head AND o.j = y.j")
    if reduction == "average":
        return S.whole(f"SELECT id, j, round(greatest(avg(v), 0), 6) + 0e0 AS v FROM {name}_n GROUP BY id, j")
    return S.whole(f"SELECT id, CAST(head * 4 + j AS INTEGER) AS j, round(greatest(v, 0), 6) + 0e0 AS v FROM {name}_n")


def gat(kind=attention.GraphAttention, features=G.WIDTH, **more):
    layer = kind(4, attn_heads=2, **more)
    k, j = np.indices((features, 4))
    h, i = np.indices((2, 4))
    layer.kernels = np.stack([((31 * k + 17 * j + 7 * head) % 101 - 50) / 500.0 for head in range(2)])
    layer.attn = np.stack([((31 * h + 17 * i + s) % 101 - 50) / 500.0 for s in (3, 5)], axis=1)
    layer.bias = G.bias(8).reshape(2, 4)
    return layer


@query(gat_sql("gat_a", "ps"))
def gat_sparse(spark, d):
    nodes = G.part_nodes(spark, d)
    return shown(gat(attention.GraphAttentionSparse).call(G.features(spark, d, nodes), G.parts(spark, d), nodes), "id", "j", value="v")


@query(gat_sql("gat_b", "ps_loop"))
def gat_dense_equiv(spark, d):
    nodes = G.part_nodes(spark, d)
    return shown(gat().call(G.features(spark, d, nodes), A.add_self_loops(G.parts(spark, d), nodes), nodes), "id", "j", value="v")


@query(gat_sql("gat_b", "ps_loop", "average"))
def gat_heads_avg(spark, d):
    nodes = G.part_nodes(spark, d)
    layer = gat(attn_heads_reduction="average")
    return shown(layer.call(G.features(spark, d, nodes), A.add_self_loops(G.parts(spark, d), nodes), nodes), "id", "j", value="v")


@query(gat_sql("gat_b", "ps_loop"))
def gat_saliency(spark, d):
    """With unit weights and without non-existing edges the saliency weights are the softmax."""
    nodes = G.part_nodes(spark, d)
    layer = gat(saliency_map_support=True)
    return shown(layer.call(G.features(spark, d, nodes), A.add_self_loops(G.parts(spark, d), nodes), nodes), "id", "j", value="v")


S.define("few", "SELECT src, dst, 1e0 AS w FROM nn WHERE src < 20 AND dst < src")
S.define("nn_x", "SELECT id, k, v FROM nn_nodes JOIN vectors ON id % (SELECT count(*) FROM embeddings) = vec_id")
S.define("few_all", "SELECT src, dst FROM few UNION ALL SELECT n.id, m.id FROM nn_nodes n CROSS JOIN nn_nodes m WHERE n.id NOT IN (SELECT src FROM few)")


def gat_empty_sql() -> str:
    text = gat_sql("gat_c", "few_all")
    return text.replace("FROM ps_x x JOIN", "FROM nn_x x JOIN").replace("FROM ps_nodes n CROSS JOIN range(2)", "FROM nn_nodes n CROSS JOIN range(2)").replace("WITH RECURSIVE ", f"WITH RECURSIVE nn_x AS ({S.PARTS['nn_x']}),\n" if "nn_x AS" not in text else "WITH RECURSIVE ", 1)


def nation_x_first(text: str) -> str:
    """nn_x needs vectors and nn_nodes before it."""
    head = "WITH RECURSIVE "
    for name in ("nn_x", "vectors", "nn_nodes"):
        body = f"{name} AS ({S.PARTS[name]})"
        text = text.replace(body + ",\n", "", 1)
        text = text.replace(head, f"{head}{body},\n", 1)
    return text


@query(nation_x_first(gat_empty_sql()))
def gat_dense_empty_rows(spark, d):
    """A row without entries attends to all nodes."""
    nodes = G.nations(spark, d)
    few = G.trade(spark, d).where("src < 20 AND dst < src").withColumn("w", F.lit(1.0))
    return shown(gat().call(G.features(spark, d, nodes), few, nodes), "id", "j", value="v")


# sampled neighbourhoods


def sage_sql(name: str, near: str, empty: str = "CAST('NaN' AS DOUBLE)") -> str:
    """Six columns: three from the node, three from ``near`` (b, k, v)."""
    S.define(f"{name}_own", "SELECT b, j, sum(x.v * kernel.v) AS v FROM own_x x JOIN kernel ON x.k = kernel.k AND j < 3 GROUP BY b, j")
    S.define(f"{name}_near", f"SELECT b, j, sum(x.v * kernel.v) AS v FROM {near} x JOIN kernel ON x.k = kernel.k AND j < 3 GROUP BY b, j")
    S.define(f"{name}_both", f"SELECT b, j, v FROM {name}_own UNION ALL SELECT h.b, CAST(y.j + 3 AS INTEGER), coalesce(n.v, {empty}) FROM heads h CROSS JOIN range(3) y(j) LEFT JOIN {name}_near n ON n.b = h.b AND n.j = y.j")
    S.define(f"{name}_out", f"SELECT b, j, greatest(s.v + bias.v, 0) AS v FROM {name}_both s JOIN bias USING (j)")
    return S.whole(f"SELECT b, j, CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) + 0e0 END AS v FROM {name}_out")


def sage(kind):
    agg = kind(6)
    agg.w_group, agg.bias = [G.kernel(G.WIDTH, 3), G.kernel(G.WIDTH, 3)], G.bias(6)
    if isinstance(agg, sampling.PoolingAggregator):
        agg.w_pool, agg.b_pool = {1: G.kernel(G.WIDTH, 6)}, {1: G.bias(6)}
        agg.w_group[1] = G.kernel(6, 3)
    return agg


def no_nan(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


S.define("near_mean", "SELECT b, k, avg(v) AS v FROM near_x GROUP BY b, k")
S.define("near_hidden", "SELECT b, s, h.j, greatest(h.v + bias.v, 0) AS v FROM (SELECT b, s, j, sum(x.v * kernel.v) AS v FROM near_x x JOIN kernel ON x.k = kernel.k AND j < 6 GROUP BY b, s, j) h JOIN bias USING (j)")
S.define("near_max", "SELECT b, j AS k, max(v) AS v FROM near_hidden GROUP BY b, j")
S.define("near_avg", "SELECT b, j AS k, avg(v) AS v FROM near_hidden GROUP BY b, j")


@query(sage_sql("sage_a", "near_mean"))
def sage_mean(spark, d):
    heads, own, near = G.sampled(spark, d)
    return no_nan(shown(sage(sampling.MeanAggregator).call([own, near], heads), "b", "j", value="v"))


@query(sage_sql("sage_b", "near_max", "0"))
def sage_maxpool(spark, d):
    heads, own, near = G.sampled(spark, d)
    return no_nan(shown(sage(sampling.MaxPoolingAggregator).call([own, near], heads), "b", "j", value="v"))


@query(sage_sql("sage_c", "near_avg"))
def sage_meanpool(spark, d):
    heads, own, near = G.sampled(spark, d)
    return no_nan(shown(sage(sampling.MeanPoolingAggregator).call([own, near], heads), "b", "j", value="v"))


S.define("att_c", "SELECT b, s, j, sum(x.v * kernel.v) AS v FROM (SELECT b, -1 AS s, k, v FROM own_x UNION ALL SELECT b, s, k, v FROM near_x) x JOIN kernel ON x.k = kernel.k AND j < 6 GROUP BY b, s, j")
S.define("att_t", "SELECT b, s, sum(v * ((13 * (j + 2)) % 11 - 5) / 100e0) AS t FROM att_c GROUP BY b, s")
S.define("att_s", "SELECT b, sum(v * ((13 * j) % 11 - 5) / 100e0) AS own FROM att_c WHERE s = -1 GROUP BY b")
S.define("att_p", "SELECT b, s, exp(l) / sum(exp(l)) OVER (PARTITION BY b) AS p FROM (SELECT b, s, CASE WHEN own + t >= 0 THEN own + t ELSE 0.2e0 * (own + t) END AS l FROM att_t JOIN att_s USING (b))")
S.define("att_o", "SELECT b, c.j, greatest(sum(p * c.v) + any_value(bias.v), 0) AS v FROM att_c c JOIN att_p USING (b, s) JOIN bias ON bias.j = c.j GROUP BY b, c.j")


@query(S.out("att_o", "b, j", "v"))
def sage_attn(spark, d):
    heads, own, near = G.sampled(spark, d)
    agg = sampling.AttentionalAggregator(6)
    agg.w_group, agg.bias = [G.kernel(G.WIDTH, 6)], G.bias(6)
    agg.w_attn_s, agg.w_attn_g = G.bias(6), G.bias(8)[2:]
    return shown(agg.call(own, [near]), "b", "j", value="v")


S.define("sage_l2", "SELECT b, j, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY b)), 1e-7) AS v FROM sage_d_out")


@query(sage_sql("sage_d", "near_mean").split("\nSELECT b, j, CASE")[0] + "\nSELECT b, j, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY b)), 1e-7), 6) + 0e0 AS v FROM sage_d_out WHERE b IN (SELECT b FROM near)")
def sage_model(spark, d):
    """One layer of GraphSAGE with normalisation, over parts that have suppliers."""
    heads, own, near = G.sampled(spark, d)
    some = near.select("b").distinct()
    model = sampling.GraphSAGE([6], [3], activations=["relu"])
    model.layers[0] = sage(sampling.MeanAggregator)
    hop0 = own.join(some, "b").select("b", "h", "x")
    hop1 = near.select("b", F.col("s").alias("h"), "x")
    return shown(model([hop0, hop1]), "b", "j", value="v")


S.define("hop2", "SELECT a.b, a.s AS h1, c.s, c.id FROM near a JOIN (SELECT src AS up, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS s, dst AS id FROM ps WHERE src % 2 = 1) c ON c.up = a.id WHERE c.s < 2")
S.define("two_x", "SELECT b, h1 * 2 + s AS h, k, v FROM hop2 JOIN ps_x USING (id)")
S.define("layer1_self", "SELECT b, 0 AS h, k, v FROM own_x UNION ALL SELECT b, s + 1, k, v FROM near_x")
S.define("layer1_near", "SELECT b, 0 AS h, k, avg(v) AS v FROM near_x GROUP BY b, k UNION ALL SELECT b, h // 2 + 1, k, avg(v) FROM two_x GROUP BY b, h // 2, k")
S.define("layer1", "SELECT b, h, s.j, greatest(s.v + bias.v, 0) AS v FROM (SELECT b, h, j, sum(x.v * kernel.v) AS v FROM layer1_self x JOIN kernel ON x.k = kernel.k AND j < 3 GROUP BY b, h, j UNION ALL SELECT b, h, j + 3, sum(x.v * kernel.v) FROM layer1_near x JOIN kernel ON x.k = kernel.k AND j < 3 GROUP BY b, h, j) s JOIN bias USING (j) WHERE b IN (SELECT b FROM near)")
S.define("layer2", "SELECT b, j, sum(x.v * kernel.v) AS v FROM (SELECT b, j AS k, v FROM layer1 WHERE h = 0) x JOIN kernel ON x.k = kernel.k AND j < 2 GROUP BY b, j UNION ALL SELECT b, j + 2, sum(x.v * kernel.v) FROM (SELECT b, j AS k, avg(v) AS v FROM layer1 WHERE h > 0 GROUP BY b, j) x JOIN kernel ON x.k = kernel.k AND j < 2 GROUP BY b, j")


@query(S.whole("SELECT b, CAST(l.j AS INTEGER) AS j, round(l.v + bias.v, 6) + 0e0 AS v FROM layer2 l JOIN bias USING (j)"))
def sage_2layer(spark, d):
    """Two layers over nested hops: a part, three suppliers, two parts of each."""
    heads, own, near = G.sampled(spark, d)
    lines, count = G.line_ends(spark, d), G.table(spark, d, "lineitem").count()
    one = G.first_ends(lines.withColumnRenamed("src", "b"), ["b"], "dst", 3, count).select("b", F.col("s").alias("h1"), F.col("id").alias("up"))
    two = G.first_ends(lines.withColumnsRenamed({"src": "end", "dst": "up"}), ["up"], "end", 2, count)
    hop2 = one.join(two, "up").join(G.features(spark, d, G.part_nodes(spark, d)), "id").select("b", (F.col("h1") * 2 + F.col("s")).alias("h"), "x")
    hop0 = own.join(near.select("b").distinct(), "b").select("b", "h", "x")
    hop1 = near.select("b", F.col("s").alias("h"), "x")
    model = sampling.GraphSAGE([6, 4], [3, 2], normalize=None)
    model.layers[0] = sage(sampling.MeanAggregator)
    last = sampling.MeanAggregator(4, act="linear")
    last.w_group, last.bias = [G.kernel(6, 2), G.kernel(6, 2)], G.bias(4)
    model.layers[1] = last
    return shown(model([hop0, hop1, hop2]), "b", "j", value="v")


S.define("hin_mean_x", "SELECT b, r, k, avg(v) AS v FROM hin_x GROUP BY b, r, k")
S.define("hin_near", "SELECT b, j, sum(x.v * ((31 * x.k + 17 * j + 7 * r) % 101 - 50) / 500e0) / 2 AS v FROM hin_mean_x x CROSS JOIN (SELECT CAST(j AS INTEGER) AS j FROM range(3) t(j)) GROUP BY b, j")
S.define("hin_self", "SELECT b, j, sum(x.v * kernel.v) AS v FROM cu_x x JOIN kernel ON x.k = kernel.k AND j < 3 GROUP BY b, j")
S.define("hin_out", "SELECT b, j, greatest(s.v + bias.v, 0) AS v FROM (SELECT b, j, v FROM hin_self UNION ALL SELECT c.c_custkey, CAST(y.j + 3 AS INTEGER), coalesce(n.v, 0) FROM customer c CROSS JOIN range(3) y(j) LEFT JOIN hin_near n ON n.b = c.c_custkey AND n.j = y.j) s JOIN bias USING (j)")


def hin_layer(activation="relu"):
    agg = sampling.MeanHinAggregator(6, 2, activation)
    agg.w_self, agg.bias = G.kernel(G.WIDTH, 3), G.bias(6)
    agg.w_neigh = np.stack([G.kernel(G.WIDTH, 3, 7 * r) for r in range(2)])
    return agg


@query(S.out("hin_out", "b, j", "v"))
def hin_mean(spark, d):
    return shown(hin_layer().call(*G.bought(spark, d)), "b", "j", value="v")


@query(S.whole("SELECT b, j, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY b)), 1e-7), 6) + 0e0 AS v FROM hin_out"))
def hinsage(spark, d):
    own, neigh = G.bought(spark, d)
    model = sampling.HinSAGE([6], nr=2, activations=["relu"])
    model.layers[0] = hin_layer()
    return shown(model(own, [neigh]), "b", "j", value="v")


# personalised PageRank


def appnp_sql(x: str, steps: int, alpha: float, width: int) -> str:
    at = x
    for i in range(1, steps + 1):
        raw = S.spmm(f"{x}_z{i}", S.PS_GCN, at, "ps_nodes", width)
        at = S.define(f"{x}_y{i}", f"SELECT z.id, z.k, {1 - alpha!r}::DOUBLE * z.v + {alpha!r}::DOUBLE * coalesce(x.v, 0) AS v FROM {raw} z LEFT JOIN {x} x ON x.id = z.id AND x.k = z.k")
    return at


@query(S.out(appnp_sql("ps_x", 2, 0.1, 64), "id, k", "v"))
def appnp_k2(spark, d):
    nodes = G.part_nodes(spark, d)
    return shown(wide.unpacked(convolution.propagate(G.features(spark, d, nodes), gcn_parts(spark, d), nodes, 2), ["id"], "k"), "id", "k", value="v")


@query(S.out(appnp_sql("ps_x", 10, 0.1, 64), "id, k", "v", 4))
def appnp_k10(spark, d):
    nodes = G.part_nodes(spark, d)
    return shown(wide.unpacked(convolution.propagate(G.features(spark, d, nodes), gcn_parts(spark, d), nodes, 10), ["id"], "k"), "id", "k", value="v", digits=4)


@query(S.out("ps_ax", "id, k", "v"))
def ppnp_prop(spark, d):
    nodes = G.part_nodes(spark, d)
    return shown(convolution.PPNPPropagationLayer(G.WIDTH).call(G.features(spark, d, nodes), gcn_parts(spark, d), nodes), "id", "k", value="v")


S.dense("ps_d1", "ps_x", 64, 6)
S.dense("ps_d2", "ps_d1", 6, 3, "v")
S.spmm("ps_d2_ax", S.PS_GCN, "ps_d2", "ps_nodes", 3)


def dense_stack(model):
    model.kernels, model.biases = [G.kernel(G.WIDTH, 6), G.kernel(6, 3)], [G.bias(6), G.bias(3)]
    return model


@query(S.out("ps_d2_ax", "id, k", "v"))
def ppnp_dense_stack(spark, d):
    """The dense stack, then one propagation over a generator's adjacency."""
    model = dense_stack(convolution.PPNP([6, 3], ["relu", "linear"], src.FullBatchNodeGenerator(G.part_graph(spark, d))))
    return shown(model(), "id", "k", value="v")


@query(S.out(appnp_sql("ps_d2", 3, 0.2, 3), "id, k", "v"))
def appnp_model(spark, d):
    model = convolution.APPNP([6, 3], ["relu", "linear"], src.FullBatchNodeGenerator(G.part_graph(spark, d)), teleport_probability=0.2, approx_iter=3)
    return shown(dense_stack(model)(), "id", "k", value="v")


# links

PAIR = "pairs p JOIN ps_x a ON a.id = p.src JOIN ps_x b ON b.id = p.dst AND a.k = b.k"
CLIP = "x + 0.9e0 * greatest({lo} - x, 0) - 0.9e0 * greatest(x - {hi}, 0)"


def link(spark, d, method, **more):
    return shown(links.link_inference(edge_embedding_method=method, **more)(G.pairs(spark, d), G.features(spark, d, G.part_nodes(spark, d))), "pos", "j", value="v")


@query(S.whole(f"SELECT pos, 0 AS j, round(1 / (1 + exp(-sum(a.v * b.v))), 6) + 0e0 AS v FROM {PAIR} GROUP BY uid, pos"))
def link_ip(spark, d):
    return shown(links.link_classification()(G.pairs(spark, d), G.features(spark, d, G.part_nodes(spark, d))), "pos", "j", value="v")


@query(S.whole(f"SELECT pos, 0 AS j, round({CLIP.format(lo='-0.05e0', hi='0.05e0')}, 6) + 0e0 AS v FROM (SELECT pos, sum(a.v * b.v) AS x FROM {PAIR} GROUP BY uid, pos)"))
def link_clip(spark, d):
    return shown(links.link_regression(clip_limits=(-0.05, 0.05))(G.pairs(spark, d), G.features(spark, d, G.part_nodes(spark, d))), "pos", "j", value="v")


def link_sql(element: str) -> str:
    return S.whole(f"SELECT pos, j, round(greatest(s.v + bias.v, 0), 6) + 0e0 AS v FROM (SELECT pos, j, sum(({element}) * kernel.v) AS v FROM {PAIR} JOIN kernel ON kernel.k = a.k AND j < 4 GROUP BY uid, pos, j) s JOIN bias USING (j)")


def dense_link(method):
    return lambda spark, d: link(spark, d, method, output_dim=4, output_act="relu", kernel=G.kernel(2 * G.WIDTH if method == "concat" else G.WIDTH, 4), bias=G.bias(4))


for _name, _element in (("l1", "abs(a.v - b.v)"), ("l2", "(a.v - b.v) * (a.v - b.v)"), ("mul", "a.v * b.v"), ("avg", "(a.v + b.v) * 0.5e0")):
    QUERIES[f"link_{_name}"], ORACLE_SQL[f"link_{_name}"] = dense_link(_name), link_sql(_element)
QUERIES["link_concat"] = dense_link("concat")
ORACLE_SQL["link_concat"] = S.whole("SELECT pos, j, round(greatest(s.v + bias.v, 0), 6) + 0e0 AS v FROM (SELECT pos, kernel.j, sum(x.v * kernel.v) AS v FROM (SELECT uid, pos, k, v FROM pairs JOIN ps_x ON id = src UNION ALL SELECT uid, pos, k + 64, v FROM pairs JOIN ps_x ON id = dst) x JOIN kernel ON x.k = kernel.k AND kernel.j < 4 GROUP BY uid, pos, kernel.j) s JOIN bias USING (j)")


# walks

S.define("ranked", "SELECT src AS node, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS rank, count(*) OVER (PARTITION BY src) AS degree, dst AS nxt FROM ps")


def u_sql(seed: int, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 13) AS BIGINT) / 4503599627370496e0"


S.define("roots", "SELECT id // 2 AS root_pos, id FROM ps_nodes WHERE id % 2 = 0")
S.define("uniform_walk", f"SELECT root_pos, CAST(w AS INTEGER) AS walk, 0 AS step, id AS node FROM roots, range(2) t(w) UNION ALL SELECT u.root_pos, u.walk, u.step + 1, r.nxt FROM uniform_walk u JOIN ranked r ON r.node = u.node AND r.rank = least(CAST(floor({u_sql(7, 'u.root_pos', 'u.walk', 'u.step + 1')} * r.degree) AS BIGINT), r.degree - 1) WHERE u.step < 5")


def roots(spark, d):
    return G.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") * 2).alias("id"))


@query(S.whole("SELECT root_pos, walk, step, node FROM uniform_walk"))
def walk_uniform(spark, d):
    return walks.UniformRandomWalk(G.part_graph(spark, d)).run(roots(spark, d), n=2, length=6, seed=7)


def biased_sql(name: str, edges: str, start: str, p: float, q: float, seed: int, length: int) -> str:
    """edges(src, dst, pos, w); start(root_pos, walk, node).  Tries by rank, the first accepted counts; for walks without one the exact choice."""
    most = max(1 / p, 1.0, 1 / q)
    f = f"CASE WHEN {{nxt}} = h.prev THEN {1 / p!r}::DOUBLE WHEN near = 1 THEN 1e0 ELSE {1 / q!r}::DOUBLE END"
    S.define(f"{name}_r", f"SELECT src AS node, row_number() OVER (PARTITION BY src ORDER BY dst, pos) - 1 AS rank, count(*) OVER (PARTITION BY src) AS degree, max(w) OVER (PARTITION BY src) AS top, dst AS nxt, w FROM {edges}")
    S.define(f"{name}_k", f"SELECT DISTINCT src, dst, 1 AS near FROM {edges}")
    S.define(f"{name}_d", f"SELECT DISTINCT node, degree, top FROM {name}_r")
    S.define(f"{name}_1", f"SELECT s.root_pos, s.walk, s.node AS prev, r.nxt AS node FROM {start} s JOIN {name}_r r ON r.node = s.node AND r.rank = least(CAST(floor({u_sql(seed, 's.root_pos', 's.walk', '1')} * r.degree) AS BIGINT), r.degree - 1)")
    for i in range(2, length):
        S.define(f"{name}_t{i}", f"SELECT h.root_pos, h.walk, h.node, h.prev, t, least(CAST(floor({u_sql(seed, 'h.root_pos', 'h.walk', str(i), 't', '0')} * d.degree) AS BIGINT), d.degree - 1) AS rank, {u_sql(seed, 'h.root_pos', 'h.walk', str(i), 't', '1')} * d.top * {most!r}::DOUBLE AS bar FROM {name}_{i - 1} h JOIN {name}_d d ON d.node = h.node CROSS JOIN range({walks.TRIES}) tries(t)")
        S.define(f"{name}_a{i}", f"SELECT h.root_pos, h.walk, any_value(h.node) AS prev, arg_min(r.nxt, t) AS node FROM {name}_t{i} h JOIN {name}_r r ON r.node = h.node AND r.rank = h.rank LEFT JOIN {name}_k k ON k.src = h.prev AND k.dst = r.nxt WHERE h.bar < r.w * {f.format(nxt='r.nxt')} GROUP BY h.root_pos, h.walk")
        S.define(f"{name}_c{i}", f"SELECT h.root_pos, h.walk, h.node AS prev, e.dst AS node, sum(e.w * {f.format(nxt='e.dst')}) OVER (PARTITION BY h.root_pos, h.walk ORDER BY e.dst, e.pos ROWS UNBOUNDED PRECEDING) AS cum, sum(e.w * {f.format(nxt='e.dst')}) OVER (PARTITION BY h.root_pos, h.walk) AS total, e.dst, e.pos FROM {name}_{i - 1} h ANTI JOIN {name}_a{i} a ON a.root_pos = h.root_pos AND a.walk = h.walk JOIN {edges} e ON e.src = h.node LEFT JOIN {name}_k k ON k.src = h.prev AND k.dst = e.dst")
        S.define(f"{name}_{i}", f"SELECT root_pos, walk, prev, node FROM {name}_a{i} UNION ALL SELECT root_pos, walk, prev, node FROM (SELECT *, row_number() OVER (PARTITION BY root_pos, walk ORDER BY dst, pos) AS n FROM {name}_c{i} WHERE total > 0 AND cum >= {u_sql(seed, 'root_pos', 'walk', str(i))} * total) WHERE n = 1")
    steps = " UNION ALL ".join([f"SELECT root_pos, walk, 0 AS step, node FROM {start}"] + [f"SELECT root_pos, walk, {i}, node FROM {name}_{i}" for i in range(1, length)])
    return S.whole(f"SELECT root_pos, walk, CAST(step AS INTEGER) AS step, node FROM ({steps})")


S.define("ps_pos", "SELECT src, dst, src * 1000000 + dst AS pos, 1e0 AS w FROM ps")
S.define("ps_start", "SELECT root_pos, 0 AS walk, id AS node FROM roots")
S.define("nn_pos", "SELECT src, dst, src * 1000 + dst AS pos, w FROM nn")
S.define("nn_start", "SELECT id AS root_pos, CAST(t AS INTEGER) AS walk, id AS node FROM nn_nodes, range(3) r(t)")


@query(biased_sql("bw", "ps_pos", "ps_start", 0.5, 2.0, 11, 4))
def walk_biased(spark, d):
    return walks.BiasedRandomWalk(G.part_graph(spark, d), n=1, length=4, p=0.5, q=2.0, seed=11).run(roots(spark, d))


@query(biased_sql("ww", "nn_pos", "nn_start", 2.0, 0.5, 5, 5))
def walk_biased_weighted(spark, d):
    nodes = G.nations(spark, d)
    graph = src.Graph(nodes, G.trade(spark, d).withColumn("pos", F.col("src") * 1000 + F.col("dst")))
    walk = walks.BiasedRandomWalk(graph, n=3, length=5, p=2.0, q=0.5, weighted=True, seed=5)
    return walk.run(nodes.select(F.col("id").alias("pos"), "id"))


@query(S.whole(f"SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY src) AS total FROM nn) WHERE cum >= {u_sql(3, 'src')} * total) WHERE n = 1"))
def weighted_choice(spark, d):
    return walks.weighted_choice(G.trade(spark, d).withColumnRenamed("w", "weight"), ["src"], "dst", 3)
