"""Mixing, fill-in-the-middle and whitening against plain computations."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import infill, mixing, whitening

# Mixing ------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, copies int, rate double, draw string"


def plain_mix(rows, weights=mixing.WEIGHTS, most=3):
    """source -> (size, target, rate), by raising the level until no target is above its cap."""
    size = {}
    for _, text, source, *_ in rows:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        free = sum(weight[s] for s in size if s not in capped)
        left = total - sum(most * size[s] for s in capped)
        target = {s: most * size[s] if s in capped else weight[s] * left / free for s in size}
        above = {s for s in size if s not in capped and target[s] > most * size[s]}
        if not above:
            return {s: (size[s], target[s], target[s] / size[s] if size[s] else 0.0) for s in size}
        capped |= above


def plain_draw(key):
    return int(hashlib.sha256(f"mix:{key}".encode()).hexdigest()[:13], 16) / 16**13


def some_documents(seed, sources, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice(sources) if rng.random() < 0.6 else sources[0]
        text = "".join(rng.choice(["a", "bc ", " ", "\t", "\n", "é", " ", "\U0001d11e"]) for _ in range(rng.randint(0, 60)))
        rows.append((k, rng.choice([text, text, text, None, ""]), source, 9, 9.0, "x"))
    return rows


@pytest.mark.parametrize("seed, sources", [(1, ["a", "B", None, "é", "￮", "\U0001d11e"]), (2, ["only"]), (3, [f"s{k}" for k in range(40)])])
def test_mix_against_plain_computation(spark, seed, sources):
    rows = some_documents(seed, sources, 300)
    plan = plain_mix(rows)
    got = {r["doc_id"]: r for r in mixing.mix_counts(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert len(got) == len(rows)
    for doc, text, source, *_ in rows:
        size, target, rate = plan[source]
        r = got[doc]
        assert r["source_size"] == size and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert r["target"] == pytest.approx(target, rel=1e-12) and r["rate"] <= 3
        assert r["copies"] == int(rate + 1e-12) + (plain_draw(doc) < rate - int(rate + 1e-12))
    assert sum(t for _, t, _ in plan.values()) == pytest.approx(sum(s for s, *_ in plan.values()))


def test_taken_words_come_near_the_targets(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randint(1, 30), f"s{k % 3}" if k % 5 else "s0", 0, 0.0, "") for k in range(6000)]
    got = mixing.mix_counts(spark.createDataFrame(rows, DOCS)).selectExpr("source", "target", "copies * size AS taken").groupBy("source", "target").sum("taken").collect()
    assert len(got) == 3
    for source, target, taken in got:
        assert taken == pytest.approx(target, rel=0.05), source


def test_mixed_rows_keep_their_columns_and_reruns_agree(spark):
    rows = some_documents(7, ["a", "b", None], 120) + [(None, "x y", "a", 1, 1.0, ""), (None, "x y z", "a", 1, 1.0, ""), (5, "x", "a", 1, 1.0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    counts = {}
    for r in mixing.mix_counts(docs).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + r["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, again.collect()))
    seen = {}
    for r in mixed.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: v for k, v in counts.items() if v}


def test_mix_by_a_table_of_weights(spark):
    rows = [(k, "a b", s, 0, 0.0, "") for k, s in enumerate("aabbcc")]
    weights = spark.createDataFrame([("a", 1), ("b", 1), ("z", 4)], "source string, weight long")
    got = {r["doc_id"]: r for r in mixing.mix_counts(spark.createDataFrame(rows, DOCS), weights).collect()}
    assert set(got) == {0, 1, 2, 3} and all(r["target"] == 4.0 and r["copies"] == 1 for r in got.values())


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.mix_counts(docs).count() == 0 and mixing.mix(docs).count() == 0
    empty = spark.createDataFrame([(1, None, None, 0, 0.0, ""), (2, " \n", "a", 0, 0.0, "")], DOCS)
    assert [(r["size"], r["target"], r["copies"]) for r in mixing.mix_counts(empty).collect()] == [(0, 0.0, 0)] * 2


def test_many_sources_meet_by_salt(spark, monkeypatch):
    rows = some_documents(11, [f"s{k}" for k in range(30)] + [None], 200)
    docs = spark.createDataFrame(rows, DOCS)
    sent = sorted(map(repr, mixing.mix_counts(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_SENT", 0)
    assert sorted(map(repr, mixing.mix_counts(docs).collect())) == sent


# Fill in the middle --------------------------------------------------------------

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*|^[ \t\n\v\f\r]+", "char": r"(?s)."}


def plain_infill(doc, text, unit):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in infill.MARKERS):
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def infill_rows(seed, n=250):
    rng = random.Random(seed)
    alphabet = ["a", "b", " ", "\n", "\n", "\r", "\t", "é", "€", "\U0001d11e", "<P", ">", "<", " "]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 40])))) for k in range(n)]
    return rows + [(None, "x\ny"), (n, None), (n + 1, "\n"), (n + 2, "a\n<S>b"), (n + 3, "\n" * 3000), (n + 4, "no end"), (n + 4, "no end"), (n + 5, "€\n" * 2000)]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_infill_against_plain_computation(spark, unit):
    rows = infill_rows(len(unit))
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n int, form string")
    got = infill.fill_in_middle(docs.repartition(3), unit).withColumn("back", infill.restored()).collect()
    want = [(doc, *plain_infill(doc, text, unit), text or "") for doc, text in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_cuts_do_not_depend_on_the_block(block):
    rows = [text or "" for _, text in infill_rows(4, 60)]
    rng = np.random.default_rng(1)
    first, second = rng.integers(0, 1 << 32, (2, len(rows)))
    for texts in (pa.array(rows), pa.array(["skipped", *rows]).slice(1)):
        for unit in infill.BOUNDARIES:
            whole = infill.cuts(texts, first, second, unit)
            for x, y in zip(whole, infill.cuts(texts, first, second, unit, block), strict=True):
                assert (x == y).all()


def test_infill_of_nothing_and_of_a_long_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(docs).count() == 0
    long = spark.range(1).selectExpr("id AS doc_id", "repeat('léngth\n', 4000000) AS text")
    r = infill.fill_in_middle(long).selectExpr("n", "form", "length(output) AS size").first()
    assert (r["n"], r["size"]) == (4_000_000, 28_000_009) and r["form"] != "plain"
    assert infill.fill_in_middle(long, rate=0).first()["form"] == "plain"
    with pytest.raises(ValueError):
        infill.fill_in_middle(long, unit="page")


# Whitening -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n string, whitened int"


def plain_whitening(vectors, most=32):
    """Integers, deviations, variances, projections with their signs fixed, from exact sums."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    centred = np.array([[float(Fraction(int(v), n)) for v in row] for row in d])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:most]
    total = float(Fraction(int((d * d).sum()), n**3))
    return [int(s) for s in (d * d).sum(axis=1)], e[order], centred @ v[:, order] / np.sqrt(e[order]), total


@pytest.mark.parametrize("n, width", [(300, 10), (150, 64), (400, 130)])
def test_whitening_against_plain_computation(spark, n, width):
    rng = np.random.default_rng(width)
    scales = 3.0 * 0.9 ** np.arange(width) if width < 64 else 1 + np.arange(width) / 20
    vectors = (rng.normal(size=(n, width)) * scales).astype(np.float32)
    rows = [(k, [float(c) for c in v], "x", 1) for k, v in enumerate(vectors)]
    bad = [(900, None, "", 1), (901, [1.0, None] * (width // 2), "", 1), (902, [float("nan")] * width, "", 1), (903, [float("inf")] * width, "", 1), (904, [1.0], "", 1), (905, [], "", 1)]
    got = whitening.whitened_rows(spark.createDataFrame(rows + bad, VECTORS).repartition(4)).collect()
    deviations, e, projected, total = plain_whitening(vectors)
    assert len(got) == n * len(e) and len(e) == min(32, width)
    for r in got:
        assert (r["n"], r["deviation"]) == (n, deviations[r["vec_id"]])
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / total, rel=1e-9)
        assert r["identity_error"] < 1e-8
    w = np.zeros_like(projected)
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    signs = np.sign((w * projected).sum(axis=0))
    assert np.abs(w - projected * signs).max() < 1e-7


def test_whitening_of_dependent_dimensions_and_of_little(spark):
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(80, 3)) * 64) / 64
    vectors = np.concatenate([base, base[:, :1], np.ones((80, 1))], axis=1)
    rows = [(k % 40, [float(c) for c in v], "", 0) for k, v in enumerate(vectors)] + [(None, [float(c) for c in vectors[0]], "", 0)]
    got = whitening.whitened_rows(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and len(got) == 81 * 3
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)
    for few in ([], [(1, [1.0, 2.0], "", 0)], [(k, [1.0, 2.0], "", 0) for k in range(5)], [(1, None, "", 0)], [(1, [], "", 0)]):
        out = whitening.whitened_rows(spark.createDataFrame(few, VECTORS))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_deviations_are_exact():
    x = np.array([[2**52, 5], [-(2**52), 7], [3, 1]], dtype=np.int64)
    sums = x.sum(axis=0).tolist()
    d = whitening._deviations(x, 3_000, sums)
    want = [[int(v) * 3_000 - s for v, s in zip(row, sums, strict=True)] for row in x]
    assert [[int(v) for v in row] for row in d] == want
    assert whitening._squares(d) == [a * a + b * b for a, b in want]
    small = whitening._deviations(x[:, 1:], 3, sums[1:])
    assert small.dtype == np.int64 and whitening._squares(small) == [int(v) ** 2 for v in small[:, 0]]
