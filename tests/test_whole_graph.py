"""Measures of the whole graph of small tables, against brute force."""

import random
import warnings
from collections import Counter
from itertools import combinations

import pytest

import __spark_entry__
from skein.operators import analytics
from skein.sources import driver_graph

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "EAST"), (1, "WEST")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "A", 0), (1, "B", 1)]),
    "customer": ("c_custkey int, c_name string, c_nationkey int, c_mktsegment string", [(1, "c1", 0, "M"), (2, "c2", 1, "M"), (3, "c3", 1, "M")]),
    "supplier": ("s_suppkey int, s_name string, s_nationkey int", [(1, "s1", 0), (2, "s2", 1), (3, "s3", 1)]),
    "part": (
        "p_partkey int, p_name string, p_type string, p_brand string, p_size int",
        [(1, "p1", "X", "Brand#11", 1), (2, "p2", "X", "Brand#25", 1), (3, "p3", "Y", "Brand#31", 1), (4, "p4", "X", "Brand#32", 1)],
    ),
    "orders": ("o_orderkey int, o_custkey int, o_orderstatus string, o_orderpriority string", [(1, 1, "F", "1-URGENT"), (2, 1, "O", "5-LOW"), (3, 2, "O", "5-LOW")]),
    "lineitem": (
        "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int, l_returnflag string",
        [(1, 1, 1, 1, "N"), (1, 2, 2, 1, "A"), (2, 1, 1, 1, "R"), (2, 2, 2, 2, "N"), (3, 1, 3, 3, "N"), (3, 2, 3, 3, "A")],
    ),
}
LINKS = "O:1-C:1 O:2-C:1 O:3-C:2 O:1-P:1 O:1-P:2 O:2-P:1 O:2-P:2 O:3-P:3 P:1-S:1 P:2-S:1 P:2-S:2 P:3-S:3"
IDS = "R:0 R:1 N:0 N:1 C:1 C:2 C:3 S:1 S:2 S:3 P:1 P:2 P:3 P:4 O:1 O:2 O:3".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def around():
    near = {i: set() for i in IDS}
    for a, b in (p.split("-") for p in LINKS.split()):
        near[a].add(b)
        near[b].add(a)
    return near


def shortest(near, a, b):
    """All shortest paths from a to b."""
    paths = [[a]]
    for _ in IDS:
        if found := [p for p in paths if p[-1] == b]:
            return found
        paths = [[*p, x] for p in paths for x in near[p[-1]] if x not in p]
    return []


def components(near):
    return {a: min(b for b in IDS if shortest(near, a, b)) for a in IDS}


def run(spark, sf, name):
    return [tuple(r) for r in __spark_entry__.queries()[name](spark, sf).collect()]


def test_components_of_the_whole_graph(spark, sf):
    want = components(around())
    assert dict(run(spark, sf, "grf_components")) == want
    sizes = [(c, list(want.values()).count(c), ",".join(sorted(i for i in IDS if want[i] == c)[:10])) for c in set(want.values())]
    assert run(spark, sf, "agg_cluster_sizes") == sorted(sizes, key=lambda r: (-r[1], r[0]))


def test_betweenness_of_the_whole_graph(spark, sf):
    near, want = around(), dict.fromkeys(IDS, 0.0)
    for a, b in combinations(IDS, 2):
        paths = shortest(near, a, b)
        for p in paths:
            for x in p[1:-1]:
                want[x] += 1 / len(paths)
    rows = [(i, round(w, 6), len(near[i])) for i, w in want.items()]
    assert sorted(run(spark, sf, "grf_betweenness")) == sorted(rows)
    nodes, edges = (f(spark, sf) for f in (driver_graph.nodes, driver_graph.edges))
    tables = analytics.betweenness(nodes, edges, most_links=0, parts=3)
    assert sorted((r["id"], round(r["betweenness"], 6), r["degree"]) for r in tables.collect()) == sorted(rows)
    ranked = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], -r[2], r[0]))
    assert run(spark, sf, "rnk_hotspots") == ranked[:10]


def test_communities_of_the_whole_graph(spark, sf):
    found, near = dict(run(spark, sf, "grf_communities")), around()
    parts = components(near)
    assert set(found) == set(IDS) and all(parts[i] == parts[c] for i, c in found.items())
    assert all(found[i] == i for i in IDS if not near[i])
    assert all(any(found[i] == found[x] for x in near[i]) for i in IDS if near[i])


def test_communities_of_planted_groups(spark):
    """Groups that are denser inside than outside are found, and the modularity is near that of the planted ones."""
    rng = random.Random(3)
    group = {f"n{k:02}": k % 4 for k in range(48)}
    links = [(a, b) for a, b in combinations(sorted(group), 2) if rng.random() < (0.6 if group[a] == group[b] else 0.04)]
    nodes = spark.createDataFrame([(i,) for i in group], "id string")
    edges = spark.createDataFrame([(a, b, "CALLS", 0) for a, b in links], "source string, target string, relationship string, provenance int")
    found = {r["id"]: r["community"] for r in analytics.modularity_communities(nodes, edges).collect()}

    def modularity(of):
        degree = {i: sum(i in p for p in links) for i in group}
        inside = sum(of[a] == of[b] for a, b in links) / len(links)
        return inside - sum((sum(degree[i] for i in group if of[i] == c) / (2 * len(links))) ** 2 for c in set(of.values()))

    assert set(found) == set(group) and modularity(found) >= 0.95 * modularity(group)
    assert found == {r["id"]: r["community"] for r in analytics.modularity_communities(nodes.repartition(3), edges.repartition(2)).collect()}


def test_communities_end_where_no_merger_gains(spark):
    """After the first level nothing stops short, and hubs and levels whose places are not sent give the same."""
    rng = random.Random(5)
    ids = [f"n{k:03}" for k in range(150)]
    links = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(330)} | {(ids[0], x) for x in ids[100:]})
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame([(a, b, "CALLS", 0) for a, b in links], "source string, target string, relationship string, provenance int")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        found = {r["id"]: r["community"] for r in analytics.modularity_communities(nodes, edges).collect()}
        again = {r["id"]: r["community"] for r in analytics.modularity_communities(nodes, edges, most_places=0, wide=20).collect()}
    assert sum("communities" in str(t.message) for t in told) <= 2
    assert found == again and all(found[c] == c and c <= i for i, c in found.items())
    between, mass = Counter(), Counter()
    for a, b in links:
        between[frozenset((found[a], found[b]))] += 1
        mass[found[a]] += 1
        mass[found[b]] += 1
    assert len(mass) > 1 and not any(between[frozenset((a, b))] - mass[a] * mass[b] / (2 * len(links)) > 1e-6 for a, b in combinations(mass, 2))


def test_unsettled_components_raise(spark):
    nodes = spark.createDataFrame([(f"n{k:03}",) for k in range(200)], "id string")
    edges = spark.createDataFrame([(f"n{k:03}", f"n{(k + 1):03}", "CALLS", 0) for k in range(199)], "source string, target string, relationship string, provenance int")
    with pytest.raises(RuntimeError, match="settle"):
        analytics.connected_components(nodes, edges, most_rounds=2)


REFERENCES = [(f"P:{a}", f"P:{b}", "REFERENCES_TYPE") for a in (1, 2, 4) for b in (1, 2, 4) if a != b]


@pytest.mark.parametrize("name", ["jon_link_references", "jon_link_unresolved"])
def test_links_to_all_definitions(spark, sf, name):
    assert sorted(run(spark, sf, name)) == [(*r, 2) for r in REFERENCES]


def test_rounds_of_components_read_fewer_links(spark, monkeypatch):
    """Before, the first round wrote most of the links once more, as pairs with least neighbours."""
    rng, written = random.Random(12), []
    pairs = sorted({tuple(sorted(rng.sample(range(200), 2))) for _ in range(2000)})
    nodes = spark.createDataFrame([(f"n{k:03}",) for k in range(203)], "id string")
    edges = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", "CALLS", 0) for a, b in pairs], "source string, target string, relationship string, provenance int")

    def counted(df, *spent, plain=analytics.cut):
        out = plain(df, *spent)
        written.append(out.count())
        return out

    monkeypatch.setattr(analytics, "cut", counted)
    found = {r["id"]: r["component"] for r in analytics.connected_components(nodes, edges).collect()}
    assert found == {f"n{k:03}": "n000" if k < 200 else f"n{k:03}" for k in range(203)}
    assert written[0] == len(pairs) and max(written[1:]) < len(pairs) / 4
