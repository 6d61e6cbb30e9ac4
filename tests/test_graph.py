"""Operators on small graphs whose answers are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import analytics, evals, linking, store, traverse, vectors


def graph(spark, text, relationship="CALLS", tier=0, nodes=None):
    pairs = [p.split("-") for p in text.split()]
    edges = spark.createDataFrame([(a, b, relationship, tier) for a, b in pairs], "source string, target string, relationship string, provenance int")
    names = sorted(nodes or {x for p in pairs for x in p})
    return spark.createDataFrame([(n, "Class", n, "", f"{n}.cs") for n in names], "id string, type string, name string, content string, file_path string"), edges


def as_map(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.mark.parametrize(
    ("edges", "between", "degree"),
    [
        ("A-B B-C C-D", {"A": 0, "B": 2, "C": 2, "D": 0}, {"A": 1, "B": 2, "C": 2, "D": 1}),
        ("S-1 S-2 S-3", {"S": 3, "1": 0, "2": 0, "3": 0}, {"S": 3, "1": 1, "2": 1, "3": 1}),
        ("A-B B-A A-B", {"A": 0, "B": 0}, {"A": 1, "B": 1}),
    ],
)
def test_betweenness(spark, edges, between, degree):
    found = analytics.betweenness(*graph(spark, edges)).cache()
    assert as_map(found, "id", "betweenness") == between
    assert as_map(found, "id", "degree") == degree


def test_betweenness_leaves_out_structure_and_unknown_ids(spark):
    nodes, edges = graph(spark, "A-B B-C C-D")
    more = graph(spark, "A-D", "CONTAINS")[1].unionByName(graph(spark, "A-Z")[1])
    assert as_map(analytics.betweenness(nodes, edges.unionByName(more)), "id", "betweenness") == {"A": 0, "B": 2, "C": 2, "D": 0}


def test_components(spark):
    nodes, edges = graph(spark, "A-B B-C A-C D-E E-F D-F", nodes="ABCDEFG")
    assert as_map(analytics.connected_components(nodes, edges), "id", "component") == dict(zip("ABCDEFG", "AAADDDG"))


def test_components_of_a_long_path(spark):
    nodes, edges = graph(spark, " ".join(f"n{i:03d}-n{i + 1:03d}" for i in range(60)))
    assert {r["component"] for r in analytics.connected_components(nodes, edges).collect()} == {"n000"}


def test_louvain_on_bridged_triangles(spark):
    found = as_map(analytics.modularity_communities(*graph(spark, "A-B B-C A-C D-E E-F D-F C-D")), "id", "community")
    assert found == dict(zip("ABCDEF", "AAADDD"))


BLAST = [
    ("B", "A", 0), ("C", "B", 0), ("G", "A", 2), ("M", "A", 2), ("H", "M", 0), ("Q", "A", 0), ("P", "Q", 0), ("P", "A", 2),
    ("cyc2", "A", 0), ("cyc1", "cyc2", 0), ("cyc2", "cyc1", 0),
]


def blast(spark, **options):
    rows = [(s, t, "REFERENCES_TYPE", p) for s, t, p in BLAST] + [("A.cs", "A", "CONTAINS", 0)]
    edges = spark.createDataFrame(rows, "source string, target string, relationship string, provenance int")
    radius = traverse.blast_radius(edges, ["A"], **options)
    return {r["id"]: (r["depth"], r["tier"]) for r in radius.found.collect()}, radius.truncated


def test_blast_radius_takes_depth_and_trust_apart(spark):
    found, truncated = blast(spark)
    assert found == {"B": (1, 0), "C": (2, 0), "G": (1, 2), "M": (1, 2), "H": (2, 2), "Q": (1, 0), "P": (1, 0), "cyc2": (1, 0), "cyc1": (2, 0)}
    assert not truncated


def test_blast_radius_limits(spark):
    found, truncated = blast(spark, most_depth=1)
    assert "B" in found and "C" not in found and truncated
    found, _ = blast(spark, most_tier=0)
    assert found["P"] == (2, 0) and "G" not in found and "H" not in found


def test_subgraph_passes_through_unknown_ids(spark):
    nodes, edges = graph(spark, "A-x B-x", nodes=["A", "B"])
    kept, inner = traverse.subgraph(nodes, edges, ["A"], 2)
    assert as_map(kept, "id", "depth") == {"A": 0, "B": 2} and inner.count() == 0


def test_shortest_path(spark):
    path = traverse.shortest_path(*graph(spark, "A-B C-B C-D A-X X-Y Y-Z Z-D"), "A", "D")
    assert [(p["id"], p["forward"]) for p in path] == [("A", None), ("B", True), ("C", False), ("D", True)]
    assert traverse.shortest_path(*graph(spark, "A-B C-D"), "A", "D") is None


def test_edge_upsert_keeps_trust_and_takes_properties(spark):
    schema = "source string, target string, relationship string, provenance int, properties map<string,string>"
    old = spark.createDataFrame([("a", "b", "CALLS", 0, {"k": "old"})], schema)
    new = spark.createDataFrame([("a", "b", "CALLS", 2, {"k": "new"})], schema)
    row = store.upsert_edges(old, new).first()
    assert (row["provenance"], row["properties"]) == (0, {"k": "new"})


def test_node_upsert(spark):
    schema = "id string, content string, content_hash string, summary string, embedding array<float>, embedding_dim int, embedding_model string, needs_analysis boolean"
    old = spark.createDataFrame([("same", "c", "h", "s", [1.0], 1, "m", False), ("changed", "c", "h", "s", [1.0], 1, "m", False), ("gone", "c", "h", "s", None, None, None, False)], schema)
    new = spark.createDataFrame([("same", "c", "h", None, None, None, None, True), ("changed", "d", "i", None, [2.0], 1, None, True), ("new", "n", "n", None, None, None, None, False)], schema)
    got = {r["id"]: r.asDict() for r in store.upsert_nodes(old, new).collect()}
    assert (got["same"]["summary"], got["same"]["embedding"], got["same"]["needs_analysis"]) == ("s", [1.0], False)
    assert (got["changed"]["summary"], got["changed"]["embedding"], got["changed"]["embedding_model"], got["changed"]["needs_analysis"]) == (None, [2.0], None, True)
    assert got["gone"]["summary"] == "s" and got["new"]["needs_analysis"]


def test_orphan_concepts_and_concept_names(spark):
    nodes = spark.createDataFrame([("n1", "Class", "n", None), ("concept_old", "Concept", "Old", None)], "id string, type string, name string, summary string")
    edges = spark.createDataFrame([], "source string, target string, relationship string, provenance int")
    analysis = spark.createDataFrame([("n1", "does", ["Data Access", "data-access"])], "id string, summary string, concepts array<string>")
    nodes, edges = store.add_concepts(nodes, edges, analysis)
    kept = {r["id"] for r in store.prune_orphan_concepts(nodes, edges).collect()}
    assert kept == {"n1", "concept_dataaccess"} and edges.count() == 1


def test_surprising_pairs(spark):
    rows = spark.createDataFrame([("A", [1.0, 0.0, 0.0]), ("B", [1.0, 0.0, 0.0]), ("C", [0.99, 0.1, 0.0]), ("D", [0.0, 0.0, 1.0])], "id string, embedding array<float>")
    linked = spark.createDataFrame([("C", "A")], "a string, b string")
    found = {(r["a"], r["b"]) for r in vectors.surprising_pairs(rows, linked, 0.9).collect()}
    assert found == {("A", "B"), ("B", "C")}
    in_blocks = {(r["a"], r["b"]) for r in vectors.similar_pairs(rows, 0.9, block=1).collect()}
    assert in_blocks == {("A", "B"), ("A", "C"), ("B", "C")}


def test_unit_length(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<float>").select("id", vectors.unit(F.col("v")).alias("u"))
    got = as_map(rows, "id", "u")
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_similar_pairs_of_regions(spark):
    """Regions that cannot meet are passed over; no pair is lost, whatever the pivots and blocks."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    data = [(k, (centres[k % 6] + rng.normal(size=8) * 0.15).tolist()) for k in range(240)] + [(900, [0.0] * 8), (901, [1.0, 2.0]), (902, [2.0, 4.0]), (903, None), (904, [])]
    rows = spark.createDataFrame(data, "id long, embedding array<double>")
    units = {k: np.array(v) / (np.linalg.norm(v) or 1.0) for k, v in data if v}
    for least in (0.5, 0.95):
        want = {(a, b) for a in units for b in units if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least}
        for block, pivots in ((1000, 1), (20, 12), (7, 40)):
            got = [(r["a"], r["b"]) for r in vectors.similar_pairs(rows, least, block=block, pivots=pivots).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_lines_that_overlap_across_stretches(spark):
    chunks = spark.createDataFrame([("f", "c1", 1, 500), ("f", "c2", 64, 64), ("g", "c3", 1, 9), ("f", "c4", 9, 3)], "file_path string, id string, start_line int, end_line int")
    spans = spark.createDataFrame([("f", "n1", 60, 200), ("f", "n2", 500, 600), ("f", "n3", 501, 502), ("g", "n4", 9, 9)], "file_path string, id string, start_line int, end_line int")
    got = sorted(tuple(r) for r in linking.overlapping_lines(chunks, spans).collect())
    assert got == [("c1", "n1"), ("c1", "n2"), ("c2", "n1"), ("c3", "n4")]


def test_golden_entries(spark):
    golden = spark.createDataFrame([(k, f"Name{k}") for k in range(7)] + [(8, "z")], "case_id long, expected string")
    nodes = spark.createDataFrame([("x/name3.cs", "other"), ("y", "NAME5"), ("name5", "name5"), ("z", None)], "id string, name string")
    assert sorted((r["case_id"], r["id"]) for r in evals.golden_match(golden, nodes).collect()) == [(3, "x/name3.cs"), (5, "name5"), (5, "y"), (8, "z")]



def test_first_of_several_runs(spark):
    runs = spark.createDataFrame([("q", "b", True, 1), ("q", "a", False, 2)], "query string, top1 string, matched boolean, seq long")
    after = spark.createDataFrame([("q", "c", False, 1)], runs.schema)
    assert [tuple(r) for r in evals.compare_runs(runs, after).collect()] == [("q", "b", "c", "broken")]
    assert [tuple(r) for r in evals.compare_runs(runs.drop("seq"), after.drop("seq")).collect()] == [("q", "a", "c", "moved")]


def test_common_names_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 4)
    rows = [(f"{'x' if k < 15 else 'y'}{k}", "Same" if k < 15 else "Other") for k in range(20)] + [("x0", "Other"), ("x0", "Same"), ("y15", "Same"), ("z", " "), ("w", None)]
    nodes = spark.createDataFrame([(i, n, "Class") for i, n in rows], "id string, name string, type string")
    names = {(i, n) for i, n in rows if n and n.strip()}
    wanted = sorted({(a, b) for a, m in names for b, n in names if m == n and a != b})
    found = linking.bind_by_name(nodes, nodes)
    assert sorted(tuple(r)[:2] for r in found.collect()) == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [source" not in plan.split("Join")[0]  # pairs are not made distinct after they met
    once = nodes.where("id <> 'x0' and id <> 'y15'").dropDuplicates(["id"])
    pairs = sorted((a, b) for a, m in names for b, n in names if m == n and a != b and not {"x0", "y15"} & {a, b})
    references = once.select(F.col("name").alias("type_name"), F.col("id").alias("node_id"))
    linked = linking.link_references(references.unionByName(references), once)
    assert sorted(tuple(r)[:2] for r in linked.collect()) == pairs and linked.rdd.getNumPartitions() >= 4
    free = linking.link_unresolved(references.withColumnRenamed("node_id", "enclosing_id"), once)
    assert sorted(tuple(r)[:2] for r in free.collect()) == pairs


def test_copies_of_a_common_names_rows_do_not_grow(spark, monkeypatch):
    """However common a name, it is dealt into no more blocks than keep the tasks busy; all its pairs are made."""
    monkeypatch.setattr(linking, "BLOCK", 4)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for rows in (10, 400, 1200):
        left = spark.range(rows).select(F.lit("a").alias("k"), F.concat(F.lit("s"), "id").alias("source"))
        right = spark.range(rows).select(F.lit("a").alias("k"), F.concat(F.lit("t"), "id").alias("target"))
        joined = linking._met(left, right, "k")
        assert joined.count() == joined.distinct().count() == rows * rows
        blocks = linking._blocks(left, right, "k", tasks, linking.BLOCK).first()
        assert blocks["__m"] * blocks["__n"] <= max(9, 1.3 * tasks * linking.BLOCKS_A_TASK)
