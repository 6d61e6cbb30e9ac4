"""Walks: layers of a frontier, one step per hop.

``edges`` is an edge table, which every hop reads whole, or a stored adjacency,
of which a hop reads the buckets it stands on.  Edges may lead to ids that no
node has; walks pass through those, and only the final join with the nodes
drops them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.lineage import MOST_SENT, cut
from skein.operators.adjacency import Adjacency, Layer, Steps, depths, edges_within, nodes_within, settle, walk, walkable, without
from skein.operators.store import union_all
from skein.schema import DECLARATION_TYPES, DEPENDENCY_RELATIONS, IMPACT_RELATIONS, STRUCTURAL

Edges = DataFrame | Adjacency


def coupled(most_tier: int | None = None, relations: tuple[str, ...] | None = None) -> Column:
    """Whether an edge expresses coupling: not structural, of the given relations, at most so uncertain."""
    out = ~F.col("relationship").isin(*STRUCTURAL)
    if relations:
        out = out & F.col("relationship").isin(*relations)
    return out if most_tier is None else out & (F.col("provenance") <= most_tier)


def couplings(edges: DataFrame, most_tier: int | None = None, relations: tuple[str, ...] | None = None) -> DataFrame:
    return edges.where(coupled(most_tier, relations))


def subgraph(nodes: DataFrame, edges: Edges, seeds: list[str], hops: int = 2, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` undirected steps, nearest first (then by id), with their depth, and the edges among them.

    With ``cap`` only so many of the nearest.
    """
    graph = walkable(edges, nodes)
    steps = Steps(graph)
    layers = walk(steps.stand_on(graph.nodes_of(steps.stand(seeds))), steps, hops)
    kept = nodes_within(graph, layers)
    if cap is not None:
        kept = cut(kept.orderBy("depth", "id").limit(cap))
    return kept.select(*nodes.columns, "depth").orderBy("depth", "id"), edges_within(graph, layers, kept)


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def shortest_path(nodes: DataFrame, edges: Edges, start: str, goal: str, most_hops: int = 5) -> list[dict] | None:
    """Steps (id, relationship, forward) of a shortest undirected path over nodes that exist, or None.

    Of several, the one whose last step comes from the least (id, relationship)
    at each level.  The walk goes no further than the level of the goal.
    """
    graph = walkable(edges, nodes)
    steps = Steps(graph)
    layers = [steps.stand_on(graph.nodes_of(steps.stand([start])))]
    while layers[-1].size and layers[-1].rows.where(F.col("id") == goal).isEmpty():
        if len(layers) > most_hops:
            return None
        reached = steps.leaving(layers[-1]).groupBy(F.col("v").alias("id")).agg(
            F.min(F.struct(F.col("u").alias("came"), F.col("relationship").alias("via"), "forward")).alias("best"), F.first("v_bucket").alias("bucket")
        )
        fresh = settle(without(reached.select("id", "bucket", "best.*"), layers), few=layers[-1].ids is not None)
        there = graph.nodes_of(fresh).select("id")
        layers.append(settle(fresh.rows.join(F.broadcast(there) if fresh.size <= MOST_SENT else there, "id", "left_semi"), few=fresh.ids is not None))
    if not layers[-1].size:
        return None
    path, at = [], goal
    for k in range(len(layers) - 1, -1, -1):
        row = layers[k].rows.where(F.col("id") == at).first()
        path.append({"id": at, "relationship": row["via"] if k else None, "forward": row["forward"] if k else None})
        at = row["came"] if k else None
    return path[::-1]


def impact(nodes: DataFrame, edges: Edges, seeds: list[str], depth: int = 2, most_tier: int | None = None) -> DataFrame:
    """What depends on the seeds, level by level: id, depth, relation (the least of those that led there)."""
    steps = Steps(walkable(edges), "in", coupled(most_tier))
    layers = [steps.stand(seeds)]
    while len(layers) <= depth and layers[-1].size:
        reached = steps.leaving(layers[-1]).where("v is not null").groupBy(F.col("v").alias("id")).agg(F.first("v_bucket").alias("bucket"), F.min("relationship").alias("relation"))
        layers.append(settle(without(reached, layers), few=layers[-1].ids is not None))
    none = layers[0].rows.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relation")).where(F.lit(False))
    return union_all([none, *(layer.rows.select("id", F.lit(k).alias("depth"), "relation") for k, layer in enumerate(layers) if k)])


def seeds_of(nodes: DataFrame, edges: Edges, target: str) -> list[str]:
    """The ids a walk from ``target`` begins at: what a file (its node's id, or a path) defines, else the node of that id, else the declaration of that name."""
    graph = walkable(edges, nodes)
    defined = nodes.where((F.col("file_path") == target) & F.col("type").isin(*DECLARATION_TYPES)).select("id")
    at = graph.nodes_of(Steps(graph).stand([target])).select("type").first()
    if at is None or at["type"] == "File":
        found = sorted(r["id"] for r in defined.collect())  # one file's declarations
        if found:
            return found
    if at is not None:
        return [target]
    named = nodes.where((F.lower("name") == target.lower()) & F.col("type").isin(*DECLARATION_TYPES))
    return [r["id"] for r in named.select("id").orderBy("id").limit(1).collect()]


@dataclass
class BlastRadius:
    """id, depth and tier of what depends on the seeds; the edges walked (source, target, relationship, provenance); whether deeper ones were cut off."""

    found: DataFrame
    walked: DataFrame
    truncated: bool


def blast_radius(edges: Edges, seeds: list[str], most_depth: int = 5, most_tier: int | None = None) -> BlastRadius:
    """Everything that depends on the seeds, directly or not, by trusted edges.

    Depth and tier are best on their own: the least depth of any path, and the
    least, over paths, of a path's worst tier.  A node is walked again only
    where it is reached with better trust than before.
    """
    steps = Steps(walkable(edges), "in", coupled(most_tier) & F.col("u").isNotNull() & (F.col("u") != F.col("v")))
    start = steps.stand(seeds)
    layer = Layer(start.rows.withColumn("tier", F.lit(0)), start.size, start.buckets, start.ids)
    layers, passed = [layer], []
    while len(layers) <= most_depth and layers[-1].size:
        out = steps.leaving(layers[-1])
        passed.append(out.select(F.col("v").alias("source"), F.col("u").alias("target"), "relationship", "provenance"))
        here = layers[-1].sent().select(F.col("id").alias("u"), "tier")
        reached = out.join(here, "u").groupBy(F.col("v").alias("id")).agg(F.min(F.greatest("tier", "provenance")).alias("tier"), F.first("v_bucket").alias("bucket"))
        before = union_all([x.rows.select("id", "tier") for x in layers]).groupBy("id").agg(F.min("tier").alias("best"))
        before = F.broadcast(before) if sum(x.size for x in layers) <= MOST_SENT else before
        better = reached.join(before, "id", "left").where("best is null or tier < best").select("id", "bucket", "tier")
        layers.append(settle(better, few=layers[-1].ids is not None))
    truncated = len(layers) == most_depth + 1 and bool(layers[-1].size) and not steps.leaving(layers[-1]).isEmpty()
    found = union_all([x.rows.select("id", "tier", F.lit(k).alias("depth")) for k, x in enumerate(layers)])
    found = found.groupBy("id").agg(F.min("depth").alias("depth"), F.min("tier").alias("tier")).where(~F.col("id").isin(seeds))
    return BlastRadius(found, union_all(passed).distinct(), truncated)


def _reach(edges: Edges, seeds: list[str], direction: str, condition: Column, depth: int) -> DataFrame:
    """id and depth of what a walk from the seeds meets, without them."""
    steps = Steps(walkable(edges), direction, condition)
    return depths(walk(steps.stand(seeds), steps, depth)).where("depth > 0")


def call_hierarchy(nodes: DataFrame, edges: Edges, seed: str, direction: str = "callers", depth: int = 3) -> DataFrame:
    return _reach(edges, [seed], "in" if direction == "callers" else "out", F.col("relationship") == "CALLS", depth)


def dependency_tree(edges: Edges, seed: str, depth: int = 2) -> DataFrame:
    """What the seed uses: id and depth over references, implementations and inheritance."""
    return _reach(edges, [seed], "out", coupled(relations=DEPENDENCY_RELATIONS), depth)


def direct_references(nodes: DataFrame, edges: DataFrame, seed: str, incoming: bool = True, most_tier: int | None = None) -> DataFrame:
    """relationship, other end and its name, and how many edges share the relationship."""
    here, there = ("target", "source") if incoming else ("source", "target")
    found = couplings(edges, most_tier).where(F.col(here) == seed).select("relationship", F.col(there).alias("other"), "provenance")
    named = found.join(nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other", "left")
    sizes = found.groupBy("relationship").agg(F.count(F.lit(1)).alias("group_size"))
    return named.join(sizes, "relationship")


def find_usages(nodes: DataFrame, edges: DataFrame, seed: str, most_tier: int | None = None) -> DataFrame:
    """Nodes with a coupling edge to the seed, and the first line of theirs that mentions its name (160 characters at most)."""
    name = nodes.where(F.col("id") == seed).select(F.col("name").alias("wanted"))
    users = couplings(edges, most_tier).where(F.col("target") == seed).select(F.col("source").alias("id"), "relationship", "provenance")
    line = F.try_element_at(F.filter(F.split("content", "\n"), lambda x: F.contains(x, F.col("wanted"))), F.lit(1))
    return users.join(nodes, "id").crossJoin(F.broadcast(name.limit(1))).select("id", "relationship", "provenance", F.substring(F.trim(line), 1, 160).alias("line"))


def implementations_of(edges: DataFrame, name: str) -> DataFrame:
    """Sources of EXTENDS and IMPLEMENTS edges whose target is the bare name."""
    return edges.where((F.col("target") == name) & F.col("relationship").isin("EXTENDS", "IMPLEMENTS")).select(F.col("source").alias("id"), "relationship")


def looks_like_test(path: Column) -> Column:
    p = F.lower(F.coalesce(path, F.lit("")))
    return F.contains(p, F.lit("test")) | F.contains(p, F.lit(".spec.")) | F.contains(p, F.lit("/spec/")) | F.contains(p, F.lit("\\spec\\"))


def related_tests(nodes: DataFrame, edges: Edges, seed: str, depth: int = 3) -> DataFrame:
    found = impact(nodes, edges, [seed], depth)
    return found.join(nodes.select("id", "name", "file_path"), "id").where(looks_like_test(F.col("file_path"))).select("id", "depth", "name", "file_path")


def review_impact(nodes: DataFrame, edges: Edges, paths: list[str], depth: int = 3) -> DataFrame:
    """What depends on anything in the changed files, outside of them: id, depth.

    Nodes of the changed files are starts; one met on the way is not walked again.
    """
    steps = Steps(walkable(edges), "in", coupled(relations=IMPACT_RELATIONS))
    changed = nodes.where(F.col("file_path").isin(paths)).select("id")
    return depths(walk(steps.stand_on(changed), steps, depth)).where("depth > 0")


def rename_plan(nodes: DataFrame, edges: DataFrame, seed: str, new_name: str) -> DataFrame:
    """Files with references to the seed and how many, and how many nodes have the new name already."""
    sites = couplings(edges).where(F.col("target") == seed).select(F.col("source").alias("id"))
    taken = nodes.where(F.col("name") == new_name).agg(F.count(F.lit(1)).alias("collisions"))
    per_file = sites.join(nodes, "id").groupBy("file_path").agg(F.count(F.lit(1)).alias("sites"))
    return per_file.crossJoin(F.broadcast(taken))


def outline(nodes: DataFrame, edges: Edges, root: str, depth: int = 10) -> DataFrame:
    """What the root contains, directly or not: id, depth, name, start_line."""
    graph = walkable(edges, nodes)
    steps = Steps(graph, "out", F.col("relationship") == "CONTAINS")
    return nodes_within(graph, walk(steps.stand([root]), steps, depth)).select("id", "depth", "name", "start_line")


def incident(nodes: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """Edges at the seed, once each, with the other end and whether a node has it."""
    at = edges.where((F.col("source") == seed) | (F.col("target") == seed))
    other = F.when(F.col("source") == seed, F.col("target")).otherwise(F.col("source"))
    known = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    return at.withColumn("other", other).join(known, "other", "left").withColumn("dangling", F.col("other_name").isNull())
