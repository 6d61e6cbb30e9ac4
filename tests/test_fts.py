"""Full-text search against the full-text module of SQLite, on the same rows and queries."""

import sqlite3

import pytest

from skein.operators import fts, search, segments

ROWS = [
    ("1", "Alpha One", "foo bar baz foo", "sum up"), ("2", "beta", "bar foo. The end of it", None), ("3", "gamma café", "Résumé of foo_bar; prefix preface", "alpha"),
    ("4", "", "nothing here at all", "foo"), ("5", None, "foo x y z w v u t s r q bar", ""), ("6", "naïve Ünïts", "bar x foo y bar, foo bar", "foo bar"), ("7", "or not", "and or not near", None),
]
QUERIES = [
    "foo", "foo bar", "foo OR gamma", "foo NOT bar", "foo AND bar NOT x", '"foo bar"', "foo + bar", "pre*", "cafe", "resume", "RÉSUMÉ", "name: alpha", "{name summary}: alpha", "- name: alpha", "^foo", "content: ^foo",
    "NEAR(foo bar, 2)", "NEAR(foo bar)", "(foo OR beta) AND (bar OR nothing)", "foo_bar", '"the end" of', "or", '"or"', "unites", "units", "foo NOT (bar OR nothing)", "beta OR foo bar", "content: (foo NOT x)", "naive", "missing",
]
BAD = ["foo (bar)", "dog's", "a.b", "foo AND", "(foo", "nowhere: foo", "#x", "-foo", "foo OR OR bar", "?"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    columns = ["name", "content", "summary"]
    rows = spark.createDataFrame(ROWS, "id string, name string, content string, summary string").repartition(3)
    path = str(tmp_path_factory.mktemp("fts") / "index")
    segments.write_index(rows, columns, path, block_rows=2, range_postings=7)
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, name, content, summary)")
    db.executemany("insert into t values (?, ?, ?, ?)", ROWS)
    return rows, columns, segments.open_index(spark, path), db


@pytest.mark.parametrize("query", QUERIES)
def test_rows_and_scores(tables, query):
    rows, columns, stored, db = tables
    want = {i: -s for i, s in db.execute("select id, bm25(t) from t where t match ?", (query,))}
    parsed = fts.parse(query, columns)
    got = {r["id"]: r["score"] for r in fts.match(stored, parsed).collect()}
    assert set(got) == set(want)
    if "NEAR" not in query:  # where the weight counts all occurrences, not only those that are near
        assert got == pytest.approx(want, rel=1e-6, abs=1e-9)
    fresh = {r["id"]: r["score"] for r in search.bm25(rows, query, columns).collect()} if len(query) < 12 else got
    assert fresh == pytest.approx(got)


@pytest.mark.parametrize("query", BAD)
def test_what_cannot_be_read_is_a_substring(tables, query):
    rows, columns, _, db = tables
    with pytest.raises(sqlite3.OperationalError):
        db.execute("select id from t where t match ?", (query,)).fetchall()
    with pytest.raises(fts.BadQuery):
        fts.parse(query, columns)
    found = {r["id"] for r in search.search(rows, query).collect()}
    assert found == {r[0] for r in ROWS if any(query.lower() in (x or "").lower() for x in r[1:3])}


def test_located(spark):
    nodes = spark.createDataFrame([("a", "Foo", "x", "src/a.cs", 3), ("b", "Bar", "foo foo foo", None, None)], "id string, name string, content string, file_path string, start_line int")
    assert {r["line"] for r in search.locate(nodes, "foo", base="src").collect()} == {"Foo -> @/a.cs:3", "Bar -> b"}
