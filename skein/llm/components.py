"""Connected components of an edge table, in DataFrame operations.

Large-star and small-star steps (Kiveris et al., 2014) alternate until the
edges are stars around each component's least node.  Each step is a minimum
per node, which merges before it shuffles, and a join that adaptive execution
can split where one node has very many edges; no list of neighbours is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import MOST_SENT, cut


def _least(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: numbers); the component is its least node.

    A null end or an edge of a node to itself links nothing; the node itself
    still appears.  Repeated edges count once; no edges give no rows.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = cut(stars)
    before, size = None, stars.count()
    for _ in range(most_rounds):
        # Large star: the larger neighbours of u hang on the least node around u.
        arcs = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node appears in as many rows as it has edges, which no join by node then gathers.
        sent = F.broadcast if 2 * size <= MOST_SENT else lambda df: df
        least = sent(_least(arcs).select("u", F.least("u", "m").alias("m")))
        grown = arcs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours hang on the least of them.
        grown = grown.where("u <> v").distinct()
        least = sent(_least(grown))
        small = (
            grown.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        stars = cut(small, stars)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, size = now, now[0]
    else:
        raise RuntimeError("the components did not settle")
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(F.broadcast(roots) if size <= MOST_SENT else roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
