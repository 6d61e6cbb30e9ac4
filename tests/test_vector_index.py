"""The stored vector index against exact searches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import vector_index, vectors
from skein.operators.vector_index import VectorIndex, write_vectors

SCHEMA = "id long, embedding array<float>"


def clustered(n=4000, width=22, clusters=60, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return (centres[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, width))).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = clustered()
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    bad = [(9001, None), (9002, [0.0] * 22), (9003, [float("nan")] * 22), (9004, [1.0]), (9005, []), (9006, [float("inf")] * 22)]
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)] + bad, SCHEMA)
    write_vectors(rows, path)
    return x, rows.where("id < 9000"), VectorIndex(spark, path)


def exact(x, q, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ (q / np.linalg.norm(q))
    return [int(i) for i in np.lexsort((np.arange(len(x)), -score))[:k]]


def test_every_row_is_indexed_and_a_search_reads_a_small_share(index):
    x, _, found = index
    assert found.rows == len(x) == found._cells().count() and found._cells().select("id").distinct().count() == len(x)
    assert found.probes < len(found.sizes) / 4
    largest = sum(sorted(found.sizes.values(), reverse=True)[: found.probes])
    assert largest < 0.25 * len(x)
    files = found._cells([int(c) for c in found.nearest_cells(x[:1], found.probes)[0]]).inputFiles()
    assert len({os.path.dirname(f) for f in files}) <= found.probes


def test_recall(spark, index):
    x, rows, found = index
    few = rows.where("id % 20 = 0")
    told = found.recall(few, 10).first()
    assert told["queries"] == len(x) // 20 and told["recall"] >= 0.9
    assert found.recall(few.limit(50), 10, probes=len(found.sizes)).first()["recall"] >= 0.97


def test_single_searches(index):
    x, _, found = index
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for k in range(0, 200, 20):
        got = found.search([float(c) for c in x[k]], 10).collect()
        assert got[0]["id"] == k and got[0]["score"] == pytest.approx(1, abs=1e-6)
        assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
        hits += len({r["id"] for r in got} & set(exact(x, x[k], 10)))
        assert all(r["score"] == pytest.approx(unit[r["id"]] @ unit[k], abs=1e-5) for r in got)
    assert hits >= 90
    for odd in ([1.0], [0.0] * 22, [float("nan")] * 22):
        assert found.search(odd).count() == 0
    assert all(r["score"] >= 0.95 for r in found.search([float(c) for c in x[0]], 50, least=0.95).collect())


def test_many_searches_are_those_of_one(index, monkeypatch):
    x, rows, found = index
    monkeypatch.setattr(vector_index, "QUERIES", 7)  # several blocks of queries in a cell
    few = rows.where("id % 97 = 0")
    got = {}
    for r in found.search_many(few, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    assert len(got) == few.count()
    for k in list(got)[:5]:
        one = [(r["id"], r["score"]) for r in found.search([float(c) for c in x[k]], 5).collect()]
        assert [i for i, _ in one] == [i for i, _ in got[k]]


def test_large_cells_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    x = clustered(600, 8, 3, seed=5)
    x[:400] = x[0]  # one group of equal vectors
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], SCHEMA)
    write_vectors(rows, str(tmp_path / "i"))
    found = VectorIndex(spark, str(tmp_path / "i"))
    blocks = found._cells().groupBy("cell", "block").count()
    assert blocks.agg(F.max("count")).first()[0] < 120 and blocks.count() >= 10
    got = found.search_many(rows.where("id in (0, 450)"), 10).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: (r["query"], r["rank"])) if r["query"] == 0] == list(range(10))


def test_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], SCHEMA)
    write_vectors(rows, str(tmp_path / "i"))
    found = VectorIndex(spark, str(tmp_path / "i"))
    assert found.rows == 0 and found.search([1.0]).count() == 0 and found.search_many(rows).count() == 0


def test_exact_neighbours_of_many(spark, index):
    x, rows, _ = index
    got = vector_index.nearest_many(rows.where("id < 5"), rows, 4).collect()
    for k in range(5):
        assert [r["id"] for r in sorted(got, key=lambda r: (r["query"], -r["score"], r["id"])) if r["query"] == k] == exact(x, x[k], 4)
    with pytest.raises(ValueError):
        vector_index.nearest_many(rows, rows, 4, most=10)


def test_pairs_of_one_block_and_of_several(spark):
    x = clustered(120, 6, 5, seed=8)
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(500, [1.0]), (501, [2.0]), (502, None)], SCHEMA)
    one, several = ({(r["a"], r["b"]) for r in vectors.similar_pairs(rows, 0.9, block=b).collect()} for b in (2048, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if score[a, b] >= 0.9} | {(500, 501)}
    assert one == several == want
