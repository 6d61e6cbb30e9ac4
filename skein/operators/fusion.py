"""Fusing, cutting and budgeting of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import fts
from skein.operators.search import search
from skein.operators.vectors import nearest

#: Fixed value of reciprocal rank fusion.
K0 = 60


def ranked(hits: DataFrame) -> DataFrame:
    """id and rank (from 1) of a short list of hits (id, score)."""
    return hits.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], most: int = 10, k0: int = K0) -> DataFrame:
    """id and score: the sum of 1 / (k0 + rank) over the lists (id, rank); ties go to the earlier list, then rank."""
    every = None
    for k, one in enumerate(lists):
        part = one.select("id", "rank", F.lit(k).alias("list"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("id").agg(F.sum(1.0 / (F.lit(k0) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return fused.orderBy(F.desc("score"), "first.list", "first.rank").limit(most).select("id", "score")


def hybrid(
    nodes: DataFrame,
    query: str,
    vector: list[float] | None,
    k: int = 10,
    columns: tuple[str, ...] = ("id", "name", "content", "summary"),
    index: fts.Index | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Keyword and vector search, twice ``k`` each, fused; without a vector the keyword list alone.

    ``vectors`` (id, embedding) are the nodes themselves if not given.
    """
    lists = [ranked(search(nodes, query, 2 * k, columns=columns, index=index))]
    if vector:
        lists.append(ranked(nearest(nodes if vectors is None else vectors, vector, 2 * k)))
    return reciprocal_rank_fusion(lists, k)


def within_budget(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int, most: int = 40) -> DataFrame:
    """Of each group the leading rows until the budget is passed; the first always, ``most`` at the utmost.

    The first row that does not fit ends the list, even if a later one would fit.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    total = rows.withColumns({"rn": F.row_number().over(w), "used": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    ended = F.max((F.col("used") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return total.withColumn("ended", ended).where(((F.col("ended") == 0) | (F.col("rn") == 1)) & (F.col("rn") <= most)).drop("ended")


def cap_nodes(nodes: DataFrame, edges: DataFrame, seeds: list[str], cap: int = 40) -> DataFrame:
    """Seeds, all of them, then the other nodes by edges at them, path and id, up to ``cap``."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    rest = nodes.where(~F.col("id").isin(seeds)).join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    chosen = rest.orderBy(F.desc("degree"), "file_path", "id").limit(max(0, cap - len(seeds))).select("id", "degree")
    own = nodes.where(F.col("id").isin(seeds)).join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return own.unionByName(chosen)


def plan_context(sizes: list[int], budget: int, caps: tuple[int, ...] = (2000, 1200, 800, 400)) -> tuple[int, int]:
    """How many of the leading texts, each cut at how many characters, fit the budget: the most texts, then the longest."""
    for count in range(len(sizes), 0, -1):
        for cap in caps:
            if sum(min(s, cap) for s in sizes[:count]) <= budget:
                return count, cap
    return min(1, len(sizes)), caps[-1]
