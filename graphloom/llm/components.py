"""Connected components of a link table, by minimum labels and pointer jumping; nothing comes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, written


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """Rows (node, component): the smallest node that each linked node reaches.

    ``links`` may hold a link once, in either direction or repeated; nulls and loops are passed over.
    Each round takes the smallest label of the neighbours (an aggregate with map-side combine, so a hub
    costs one row a task), then the label of the label; labels of a chain of d links settle in about log d rounds.
    Both joins read written tables, so that skewed nodes are split.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = written(one.union(one.select("v", "u")).distinct(), "links")
    label = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    for _ in range(rounds):
        near = edges.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = written(label.join(near, "u").select("u", F.col("c").alias("was"), F.least("c", "m").alias("c")), "step")
        up = step.select(F.col("u").alias("c"), F.col("c").alias("cc"))
        after = written(step.join(up, "c").select("u", "was", F.least("c", "cc").alias("c")), "labels")
        moved = after.where("was <> c").limit(1).count()
        release(label, step)
        label = after
        if not moved:
            release(edges)
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
