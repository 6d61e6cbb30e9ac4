"""The segmented index against fresh ones: refreshes, merges, versions, and searches for the best rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import fts, search, segments

SCHEMA = "id long, name string, content string"
COLUMNS = ["name", "content"]
WORDS = ["the", "a", "of"] + [f"w{k}" for k in range(40)] + [f"pre{k}" for k in range(10)]


def documents(seed, ids):
    rng = random.Random(seed)
    rows = []
    for k in ids:
        n = rng.choice([1, 3, 10, 60])
        words = [WORDS[min(int(rng.expovariate(0.12)), len(WORDS) - 1)] for _ in range(n)]
        rows.append((k, rng.choice([None, "", "Név w1", "the pre3"]), rng.choice([" ".join(words)] * 9 + [None])))
    return rows


def written(spark, tmp_path, rows, **options):
    path = str(tmp_path / "index")
    segments.write_index(spark.createDataFrame(rows, SCHEMA).repartition(3), COLUMNS, path, **({"block_rows": 8, "range_postings": 100} | options))
    return segments.open_index(spark, path)


def scores(found):
    return {r["id"]: r["score"] for r in found.collect()}


QUERIES = ["the", "the of", "w1 OR pre3", "pre*", "the NOT a", '"the a"', "name: w1", "of OR w39 OR w20", "w1 AND (the OR of)", "nev", "absent", "absent OR w2"]


def same_as_fresh(spark, index, rows, queries=QUERIES):
    fresh = fts.index_of(spark.createDataFrame(rows, SCHEMA), COLUMNS)
    assert (index.rows, index.mean) == (fresh.rows, pytest.approx(fresh.mean))
    for query in queries:
        parsed = fts.parse(query, COLUMNS)
        want = scores(fts.match(fresh, parsed))
        assert scores(fts.match(index, parsed)) == pytest.approx(want), query
        for most in (1, 5, 1000):
            got = fts.best(index, parsed, most).collect()
            assert [r["score"] for r in got] == pytest.approx(sorted(want.values(), reverse=True)[:most]), (query, most)
            assert all(want[r["id"]] == pytest.approx(r["score"]) for r in got)


def test_best_rows_are_those_of_a_full_search(spark, tmp_path, monkeypatch):
    rows = documents(1, range(300))
    index = written(spark, tmp_path, rows)
    monkeypatch.setattr(segments, "FIRST_BLOCKS", 2)  # so that the second step has work
    same_as_fresh(spark, index, rows)


def rows_scanned(df):
    """Rows that the scans of postings gave to the rest of the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, out = plan.getClass().getSimpleName(), 0
    if text == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()

    def walk(node):
        nonlocal out
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            out += node.metrics().apply("numOutputRows").value()
        if hasattr(node, "plan") and name.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return out


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    """On a common term the postings scanned for ten rows are a small share of the term's."""
    rows = spark.range(40_000).selectExpr(
        "id", "CAST(NULL AS STRING) AS name", "concat(repeat('the ', CAST(1 + id % 3 AS INT)), repeat(concat('x', id % 97, ' '), CAST(5 + id % 400 AS INT))) AS content"
    )
    path = str(tmp_path / "index")
    segments.write_index(rows, COLUMNS, path)
    index = segments.open_index(spark, path)
    parsed = fts.parse("the", COLUMNS)
    counts = []
    scored = fts.scored
    monkeypatch.setattr(fts, "scored", lambda postings, *rest: counts.append(rows_scanned(postings)) or scored(postings, *rest))
    best = fts.best(index, parsed, 10).collect()
    read = sum(counts)
    full = fts.match(index, parsed).orderBy(F.desc("score"), "id").limit(10).collect()
    assert [r["id"] for r in best] == [r["id"] for r in full]
    assert counts[-1] >= 40_000 and read < 0.4 * 40_000, counts


def test_a_prefix_reads_its_ranges_only(spark, tmp_path):
    rows = documents(3, range(200))
    index = written(spark, tmp_path, rows)
    (segment,) = index.manifest.segments
    folders = index._ranges([segment], [], ["pre"])
    assert 0 < len(folders) < len(segment.ranges) / 2
    files = index.postings([], ["pre"]).inputFiles()
    assert {os.path.basename(os.path.dirname(f)) for f in files} == {f.split("/")[1] for f in folders}
    held = {r["term"] for r in index.postings([], ["pre"]).select("term").distinct().collect()}
    there = {w for _, name, text in rows for w in f"{name} {text}".split() if w.startswith("pre")}
    assert len(there) > 2 and there <= held


@pytest.mark.parametrize("block_rows, range_postings", [(1, 10), (16, 40), (1000, 1000)])
def test_layouts_give_the_same(spark, tmp_path, block_rows, range_postings):
    rows = documents(4, range(80))
    same_as_fresh(spark, written(spark, tmp_path, rows, block_rows=block_rows, range_postings=range_postings), rows, ["the of", "pre*", "w39"])


def test_refreshes_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    monkeypatch.setattr(segments, "FIRST_BLOCKS", 2)
    rng = random.Random(9)
    held = {r[0]: r for r in documents(5, range(120))}
    index, old = written(spark, tmp_path, list(held.values())), None
    for step in range(5):
        gone = rng.sample(sorted(held), 4)
        coming = documents(20 + step, rng.sample(sorted(held), 3) + [1000 + 10 * step + k for k in range(5)])
        for i in gone:
            del held[i]
        held |= {r[0]: r for r in coming}
        before = index.manifest.version
        index = segments.refresh(index, spark.createDataFrame([(i,) for i in gone], "id long"), spark.createDataFrame(coming, SCHEMA), block_rows=8, range_postings=100)
        assert index.manifest.version > before and len(index.manifest.segments) < 6
        if step == 1:
            old, kept = segments.open_index(spark, index.path, index.manifest.version), list(held.values())
    same_as_fresh(spark, index, list(held.values()))
    same_as_fresh(spark, old, kept, ["the", "pre*"])  # readers of an old version
    for most in (index.rows, 0):
        if not most:
            index = segments.refresh(index, spark.createDataFrame([(i,) for i in held], "id long"), None)
            assert index.rows == 0 and not index.manifest.segments
            assert fts.best(index, fts.parse("the", COLUMNS), 5).count() == 0


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_a_refresh_writes_in_proportion(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "CAST(NULL AS STRING) AS name", "concat_ws(' ', transform(sequence(1, 60), k -> concat('t', pmod(hash(id, k), 3000)))) AS content")
    path = str(tmp_path / "index")
    segments.write_index(rows, COLUMNS, path)
    whole = size_of(path)
    index = segments.open_index(spark, path)
    segments.refresh(index, rows.where("id % 200 = 7").select("id"), rows.where("id % 200 = 8").withColumn("content", F.upper("content")))
    assert size_of(path) - whole < 0.06 * whole


def test_two_writers(spark, tmp_path):
    rows = documents(6, range(30))
    index = written(spark, tmp_path, rows)
    one = spark.createDataFrame(documents(7, [100]), SCHEMA)
    other = spark.createDataFrame(documents(8, [101]), SCHEMA)
    segments.refresh(index, None, one)
    with pytest.raises(segments.Conflict):
        segments.refresh(index, None, other)
    latest = segments.refresh(segments.open_index(spark, index.path), None, other)
    assert latest.rows == 32


def test_drift_and_catching_up(spark, tmp_path):
    rows = documents(10, range(60))
    index = written(spark, tmp_path, rows)
    table = spark.createDataFrame(rows, SCHEMA)
    assert segments.drift(index, table).in_step and segments.drift(index, table, content=True).in_step
    now = [(r[0], r[1], "changed text") if r[0] == 3 else r for r in rows if r[0] != 5] + documents(11, [77])
    table = spark.createDataFrame(now, SCHEMA)
    assert segments.drift(index, table).in_step  # as many rows: only the content tells
    told = segments.drift(index, table, content=True)
    assert (told.fresh, told.changed, told.gone, told.in_step) == (1, 1, 1, False)
    index = segments.catch_up(index, table)
    assert segments.drift(index, table, content=True).in_step
    same_as_fresh(spark, index, now, ["the", "changed", "w1"])
    assert segments.catch_up(index, table) is index
    segments.forget(spark, index.path)
    assert segments.versions(spark, index.path) == [index.manifest.version]
    same_as_fresh(spark, segments.open_index(spark, index.path), now, ["the", "changed"])


def test_nothing_and_empty_texts(spark, tmp_path):
    index = written(spark, tmp_path, [])
    assert index.rows == 0 and fts.match(index, fts.parse("the", COLUMNS)).count() == 0
    rows = [(1, None, None), (2, "", " .,"), (3, None, "one " * 5000)]
    index = segments.refresh(index, None, spark.createDataFrame(rows, SCHEMA))
    same_as_fresh(spark, index, rows, ["one", "two"])
    index = segments.refresh(index, spark.createDataFrame([(1,), (2,), (99,)], "id long"), None)
    same_as_fresh(spark, index, rows[2:], ["one"])


def test_words_of_a_text():
    assert fts.terms_of("Foo_BAR naïve été ÜNÏ 3x") == ["foo", "bar", "naive", "ete", "uni", "3x"]
    long = "é" * 1000
    assert fts.terms_of(long) == ["e" * 1000]
    assert search.query_terms("A b a") == ["a", "b"]
