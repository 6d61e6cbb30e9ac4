"""Substring joins and patterns on stored trigrams against plain comparisons."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import search, substrings


def texts(seed, n=150):
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice("abcABé .%") for _ in range(rng.choice([0, 1, 2, 3, 8, 40])))) for k in range(n)]
    return [*rows, (n, None), (n + 1, "src/common/path.cs"), (n + 2, "SRC/Common/other.cs")]


@pytest.mark.parametrize("sent, salts", [(10_000, 16), (3, 2)])
def test_contained(spark, monkeypatch, sent, salts):
    monkeypatch.setattr(substrings, "NEEDLES_SENT", sent)
    monkeypatch.setattr(substrings, "SALTS", salts)
    monkeypatch.setattr(substrings, "ROWS_A_SALT", 10)
    rows, rng = texts(1), random.Random(2)
    needles = ["", "a", "bc", "src/", "COMMON", "é", "xyz", "abxyz", "%", "path.cs", None]
    needles += [t[i : i + rng.randint(1, 6)] for _, t in rows if t for i in [rng.randrange(len(t))]][:40]
    needles = list(enumerate(needles)) + [(0, ""), (4, "COMMON")]  # repeated rows count once
    want = {(k, i) for k, x in needles for i, t in rows if x is not None and t is not None and x.lower() in t.lower()}
    got = substrings.contained(
        spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(rows, "id long, text string").repartition(3)
    ).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_nothing_is_contained_in_nothing(spark):
    none, some = spark.createDataFrame([], "needle_id long, needle string"), spark.createDataFrame([(1, "abcd")], "id long, text string")
    assert substrings.contained(none, some).count() == 0
    assert substrings.contained(spark.createDataFrame([(1, "abc")], none.schema), some.limit(0)).count() == 0


def scratch(spark):
    """Bytes that shuffles and cuts have written since the session began: of the shared folder, and of all tasks' shuffle files."""
    status = spark.sparkContext._jsc.sc().statusStore()
    stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() + stages.apply(k).outputBytes() for k in range(stages.size()))


@pytest.mark.parametrize("passes", [16, 0])
def test_needles_in_parts_and_by_shuffle(spark, monkeypatch, passes):
    monkeypatch.setattr(substrings, "SENT", 7)
    monkeypatch.setattr(substrings, "PASSES", passes)
    rows = [(k, f"t{k % 50} \U0001f600{k % 7} common") for k in range(120)] + [(0, "another t1 common"), (3, "t3 common")]
    needles = [(k, n) for k, n in enumerate(["common", "COMMON", "t1 \U0001f600", "\U0001f6003 c", "0 common", "t4", "mon", "xyz", *(f"t{k} " for k in range(30))])] + [(0, "t1 ")]
    want = {(k, i) for k, x in needles for i, t in rows if x.lower() in t.lower()}
    got = substrings.contained(spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(rows, "id long, text string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trigrams(spark):
    table = spark.createDataFrame([(t,) for _, t in texts(5)] + [("\U0001f600ab\n\U0001f600ab",), ("a\U0001f600",)], "text string")
    for r in table.select("text", substrings.grams(F.col("text")).alias("grams")).collect():
        assert r["grams"] == (None if r["text"] is None else list(dict.fromkeys(r["text"][k : k + 3] for k in range(len(r["text"]) - 2))))


def test_nothing_of_the_size_of_texts_or_pairs_is_written(spark):
    """200 needles stand in each of 500 texts: before, their trigrams, the texts and the pairs were all shuffled."""
    words = [f"word{k:03}" for k in range(200)]
    table = spark.createDataFrame([(k, " ".join([*words, str(k)])) for k in range(500)], "id long, text string")
    needles = spark.createDataFrame(list(enumerate(words)), "needle_id long, needle string")
    before = scratch(spark)
    assert substrings.contained(needles, table).count() == 100_000
    assert scratch(spark) - before < 300_000


@pytest.mark.parametrize("stretch, step", [(16, substrings.STEP), (64, 1), (substrings.STRETCH, 3)])
def test_many_needles_in_one_reading(monkeypatch, stretch, step):
    """Common beginnings, needles across stretches and texts, and hashes that are equal for needles of equal bytes (step 1)."""
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    monkeypatch.setattr(substrings, "STEP", step)
    monkeypatch.setattr(substrings, "BACK", pow(step, -1, 1 << 64))
    rng = random.Random(4)
    rows = ["".join(rng.choice(["ab", "ba", "src/path/", "é", "\U0001f600", "\0"]) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(80)]
    needles = sorted({t[i : i + rng.randint(1, 40)] for t in rows if t for i in (rng.randrange(len(t)) for _ in range(5))} | {"src/path/ab", "src/path/ba", "abba", "baab", "nowhere at all"})
    want = {(i, k) for i, t in enumerate(rows) for k, n in enumerate(needles) if n in t}
    got = [(int(i), int(k)) for a, b in substrings.Needles(needles).found(pa.array(rows[:3] + rows).slice(3)) for i, k in zip(a, b, strict=True)]
    assert len(got) == len(want) and set(got) == want


def test_trigrams_of_texts_are_not_counted(spark):
    """Before, every text's trigrams were listed twice, whatever the needles were."""
    table = spark.createDataFrame([(1, "some text"), (2, "other")], "id long, text string")
    plan = substrings.contained(spark.createDataFrame([(1, "text")], "needle_id long, needle string"), table)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_patterns(spark, tmp_path):
    rows = [(k, t, "Name%d" % (k % 5)) for k, t in texts(3)]
    table = spark.createDataFrame(rows, "id long, content string, name string")
    substrings.write_grams(table, ["content", "name"], str(tmp_path / "g"), buckets=5)
    stored = substrings.Grams(spark, str(tmp_path / "g"))
    for pattern in ("common", "a_bc", "bca%ab", "ab", "name3", "NAME", "é", "%", "abca", "nowhere"):
        for columns in (["content", "name"], ["name"]):
            a, b = ({r["id"] for r in search.like(table, pattern, columns, grams=g).collect()} for g in (None, stored))
            assert a == b, pattern
    assert stored.candidates("ab_c") is None and stored.candidates("common").count() == 2
