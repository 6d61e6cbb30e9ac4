"""Walks on the stored adjacency against walks on plain tables and plain searches."""

import os
import random
import shutil
from collections import deque

import pytest

from skein.operators import adjacency, traverse
from skein.operators.adjacency import Adjacency, Steps, write_adjacency
from skein.plans import stored
from skein.schema import STRUCTURAL

EDGES = "source string, target string, relationship string, provenance int, properties map<string,string>"
NODES = "id string, type string, name string, content string, file_path string, start_line int"


def random_graph(spark, seed=1, n=120, m=400):
    rng = random.Random(seed)
    kinds = ["CALLS", "REFERENCES_TYPE", "IMPLEMENTS", "CONTAINS", "RELATES_TO"]
    # One hub, ids that no node has (x...), loops and repeated edges.
    name = lambda: rng.choice(["n0", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", f"x{rng.randrange(20)}"])
    edges = [(name(), name(), rng.choice(kinds), rng.randrange(3), {"k": str(k)}) for k in range(m)]
    edges += edges[:5] + [(None, "n1", "CALLS", 0, None), ("n1", None, "CALLS", 0, None)]
    nodes = [(f"n{k}", rng.choice(["Class", "Method", "File"]), f"N{k}", "", f"f{k % 7}.cs", k) for k in range(n)]
    return nodes, edges, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    nodes, edges, node_table, edge_table = random_graph(spark)
    path = str(tmp_path_factory.mktemp("adjacency") / "graph")
    write_adjacency(node_table, edge_table, path, arcs_a_bucket=20)
    return nodes, edges, node_table, edge_table, Adjacency(spark, path)


def neighbours(edges, direction, allowed=lambda e: True):
    out = {}
    for s, t, kind, tier, _ in edges:
        if s is not None and t is not None and allowed((s, t, kind, tier)):
            if direction != "in":
                out.setdefault(s, set()).add(t)
            if direction != "out":
                out.setdefault(t, set()).add(s)
    return out


def breadth_first(near, starts, hops):
    depth = {s: 0 for s in starts}
    queue = deque(starts)
    while queue:
        at = queue.popleft()
        if depth[at] < hops:
            for other in near.get(at, ()):
                if other not in depth:
                    depth[other] = depth[at] + 1
                    queue.append(other)
    return depth


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("seeds, hops", [(["n3"], 1), (["n5", "n9", "nowhere"], 2), (["n0"], 3), (["x1"], 2), ([], 2)])
def test_subgraph(both, seeds, hops):
    nodes, edges, node_table, edge_table, graph = both
    known = {r[0] for r in nodes}
    want = {k: v for k, v in breadth_first(neighbours(edges, "both"), [s for s in seeds if s in known], hops).items() if k in known}
    inside = sorted((s, t) for s, t, *_ in edges if s in want and t in want)
    for used in (edge_table, graph):
        kept, inner = traverse.subgraph(node_table, used, seeds, hops)
        assert {r["id"]: r["depth"] for r in kept.collect()} == want
        assert sorted((r["source"], r["target"]) for r in inner.collect()) == inside
    stored_edges, plain_edges = (traverse.subgraph(node_table, used, seeds, hops)[1].select(*edge_table.columns) for used in (graph, edge_table))
    assert rows(stored_edges) == rows(plain_edges)


@pytest.mark.parametrize("seed", ["n0", "n4", "n17", "x3"])
def test_directed_walks(both, seed):
    nodes, edges, node_table, edge_table, graph = both
    coupled = neighbours(edges, "in", lambda e: e[2] not in STRUCTURAL)
    want = breadth_first(coupled, [seed], 3)
    for used in (edge_table, graph):
        assert {r["id"]: r["depth"] for r in traverse.impact(node_table, used, [seed], 3).collect()} == {k: v for k, v in want.items() if v}
        calls = breadth_first(neighbours(edges, "out", lambda e: e[2] == "CALLS"), [seed], 2)
        assert {r["id"]: r["depth"] for r in traverse.call_hierarchy(node_table, used, seed, "callees", 2).collect()} == {k: v for k, v in calls.items() if v}
    assert rows(traverse.impact(node_table, graph, [seed], 3)) == rows(traverse.impact(node_table, edge_table, [seed], 3))
    assert rows(traverse.outline(node_table, graph, seed)) == rows(traverse.outline(node_table, edge_table, seed))
    assert rows(traverse.review_impact(node_table, graph, ["f1.cs"], 2)) == rows(traverse.review_impact(node_table, edge_table, ["f1.cs"], 2))


def plain_blast(edges, seeds, most_depth):
    depth, tier, walked, truncated = {}, {}, set(), False
    queue = deque((s, 0, 0) for s in seeds)
    while queue:
        at, d, t = queue.popleft()
        for s, target, kind, p, _ in edges:
            if target != at or s in (at, None) or kind in STRUCTURAL:
                continue
            if d + 1 > most_depth:
                truncated = True
                continue
            walked.add((s, at, kind, p))
            better = d + 1 < depth.get(s, 99) or max(t, p) < tier.get(s, 9)
            depth[s], tier[s] = min(depth.get(s, 99), d + 1), min(tier.get(s, 9), max(t, p))
            if better:
                queue.append((s, d + 1, max(t, p)))
    return {k: (depth[k], tier[k]) for k in depth if k not in seeds}, walked, truncated


@pytest.mark.parametrize("seeds, depth", [(["n4"], 2), (["n0", "n8"], 5), (["x2"], 1)])
def test_blast_radius_with_its_edges(both, seeds, depth):
    _, edges, _, edge_table, graph = both
    found, walked, truncated = plain_blast(edges, seeds, depth)
    for used in (edge_table, graph):
        radius = traverse.blast_radius(used, seeds, depth)
        assert {r["id"]: (r["depth"], r["tier"]) for r in radius.found.collect()} == found
        assert {tuple(r) for r in radius.walked.collect()} == walked
        assert radius.truncated == truncated


def test_shortest_paths(both):
    nodes, edges, node_table, edge_table, graph = both
    known = {r[0] for r in nodes}
    near = neighbours([e for e in edges if e[0] in known and e[1] in known], "both")
    for start, goal in (("n3", "n50"), ("n11", "n12"), ("n9", "n9"), ("n1", "nowhere"), ("x1", "n1")):
        want = breadth_first(near, [start], 5).get(goal) if start in known else None
        a, b = (traverse.shortest_path(node_table, used, start, goal) for used in (edge_table, graph))
        assert a == b and (None if a is None else len(a) - 1) == want


def test_seeds_of_files_and_names(both):
    nodes, _, node_table, edge_table, graph = both
    for used in (edge_table, graph):
        assert traverse.seeds_of(node_table, used, "f3.cs") == sorted(r[0] for r in nodes if r[4] == "f3.cs" and r[1] != "File")
        code = next(r for r in nodes if r[1] == "Class")
        assert traverse.seeds_of(node_table, used, code[0]) == [code[0]]
        assert traverse.seeds_of(node_table, used, code[2].lower()) == [code[0]]
        assert traverse.seeds_of(node_table, used, "absent") == []


def test_wide_layers_are_written(both, monkeypatch):
    _, _, node_table, edge_table, graph = both
    want = rows(traverse.subgraph(node_table, edge_table, ["n0"], 2)[0])
    monkeypatch.setattr(adjacency, "MOST_HELD", 3)
    assert rows(traverse.subgraph(node_table, graph, ["n0"], 2)[0]) == want


def test_a_step_reads_the_buckets_it_stands_on_only(spark, both, tmp_path):
    nodes, edges, _, edge_table, graph = both
    copy = str(tmp_path / "graph")
    shutil.copytree(graph.path, copy)
    there = Adjacency(spark, copy)
    steps = Steps(there)
    start = steps.stand(["n3"])
    layer = adjacency.walk(start, steps, 1)[1]
    used = {*start.buckets, *layer.buckets}
    total = len(os.listdir(f"{copy}/arcs"))
    for b in range(there.buckets):  # without all other buckets the walk gives the same
        if b not in used:
            shutil.rmtree(f"{copy}/arcs/bucket={b}", ignore_errors=True)
    assert len(os.listdir(f"{copy}/arcs")) < total
    far = adjacency.depths(adjacency.walk(start, Steps(Adjacency(spark, copy)), 2))
    assert {r["id"]: r["depth"] for r in far.collect()} == breadth_first(neighbours(edges, "both"), ["n3"], 2)
    step = steps.leaving(start)
    assert {f"bucket={b}" for b in start.buckets} == {os.path.basename(os.path.dirname(f)) for f in step.inputFiles()}
    assert "EqualTo(u,n3)]" in step._jdf.queryExecution().executedPlan().toString()


def test_empty_graphs(spark, tmp_path):
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    write_adjacency(nodes, edges, str(tmp_path / "g"))
    graph = Adjacency(spark, str(tmp_path / "g"))
    for used in (edges, graph):
        kept, inner = traverse.subgraph(nodes, used, ["a"], 2)
        assert kept.count() == 0 and inner.count() == 0
        radius = traverse.blast_radius(used, ["a"])
        assert radius.found.count() == 0 and not radius.truncated
        assert traverse.shortest_path(nodes, used, "a", "b") is None


def test_kept_tables_follow_their_input(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    made = []

    def count():
        def write(path):
            made.append(path)
            spark.read.parquet(f"{folder}/t.parquet").write.parquet(path)

        return spark.read.parquet(stored.kept(spark, folder, "copy", write)).count()

    spark.range(1).write.parquet(f"{folder}/t.parquet")
    assert count() == 1 and count() == 1 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert count() == 5 and count() == 5 and len(made) == 2
    spark.range(2).write.mode("append").parquet(f"{folder}/t.parquet")
    assert count() == 7 and len(made) == 3
