"""The n-gram join against all pairs, and the pipeline stage by stage."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import ngram_join
from skein.llm.components import components
from tests.llm.test_texts import LONG, clashing, contamination, same_groups, table


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def all_pairs(ids, texts, k, num):
    sets = {i: shingles(t, k) for i, t in zip(ids, texts)}
    parent = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(parent, i)) for i in ids}


def edited_texts(seed, hot):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for size, copies in [(rng.choice([0, 1, 2, 3, 5, 12, 20, 30, 60, 120, 300]), rng.choice([1, 2, 3, 8])) for _ in range(20)] + [(150, hot)]:
        base = rng.choices(vocabulary, k=size)
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                if t:
                    at, act = rng.randrange(len(t)), rng.random()
                    t[at : at + 1] = [rng.choice(vocabulary)] if act < 0.4 else [t[at], rng.choice(vocabulary)] if act < 0.7 else []
            out.append(("\n" if rng.random() < 0.5 else " \t").join(t).upper() if rng.random() < 0.2 else " ".join(t))
    return out + [None, "", " ", "é é", LONG, LONG + "x"]


@pytest.mark.parametrize(("seed", "k", "num", "chunk"), [(1, 3, 90, 64), (2, 5, 80, 5)])
def test_join_finds_every_link(spark, seed, k, num, chunk):
    texts = edited_texts(seed, 110)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = ngram_join.jaccard_components(clashing(docs), words=k, num=num, chunk=chunk).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == all_pairs(ids, texts, k, num)


@pytest.mark.parametrize(("seed", "num", "chunk", "levels"), [(3, 80, 8, 6), (4, 90, 4, 6), (5, 80, 4, 1)])
def test_connect_finds_every_link_of_large_blocks(spark, seed, num, chunk, levels):
    """One block of families with edits in common, so that blocks are dealt several levels deep."""
    rng = random.Random(seed)
    sets = []
    for _ in range(3):
        base = rng.sample(range(10**6), 60)
        for branch in range(4):
            own = base[branch * 5 :] + rng.sample(range(10**6), branch * 5)
            for _ in range(25):
                one = list(own)
                for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
                    one[rng.randrange(len(one))] = rng.randrange(10**6)
                sets.append(np.unique(np.array(one, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    rows = [(7, k, len(s), bytearray(s.tobytes())) for k, s in enumerate(sets)]
    state = spark.createDataFrame(rows, "comp long, rep long, n long, grams binary")
    got = {r["rep"]: r["root"] for r in ngram_join.connect(state, num, 100, chunk, levels).collect()}
    alike, parent = [set(s.tolist()) for s in sets], list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(alike[a] & alike[b]) >= num * len(alike[a] | alike[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    want = {k: find(parent, k) for k in range(len(sets))}
    assert {k: got.get(k, k) for k in want} == want and len(set(want.values())) > 3


def test_near_copies_without_an_id_go(spark):
    rows = [(3, "a b c d"), (None, "A B c d"), (None, "x y z"), (4, "p q r s"), (3, "a b c d")]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, same string")
    got = Counter((r["doc_id"], r["text"], r["same"]) for r in ngram_join.drop_near_copies(docs).collect())
    assert got == Counter({(3, "a b c d", "m"): 2, (None, "x y z", "m"): 1, (4, "p q r s", "m"): 1})


def test_join_odd_tables(spark):
    assert ngram_join.jaccard_components(table(spark, [])).count() == 0
    rows = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (1, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(rows).collect())
    assert got == {(3, 3): 2, (None, 3): 1, (1, 1): 1}


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (1, 1), (2, 3), (3, 2), (5, None)] + [(k, k + 1) for k in range(20, 90)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {9: 7, 8: 7, 7: 7, 1: 1, 2: 2, 3: 2, 5: 5} | dict.fromkeys(range(20, 91), 20)


def tables(spark, folder, docs, items):
    table(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = ["the", "and", "over", "river", "stone", "light", "winter", "garden", "music"]

    def prose(n):
        return " ".join(rng.choices(words, k=n)) + f" {rng.randrange(10**6)}"

    item = " ".join(rng.choices(words, k=15))
    base = prose(200)
    docs = [prose(80) for _ in range(12)] + [base, base.replace(" ", "  "), base + " end", None, "12 34 !", prose(30) + " " + item.upper() + " " + prose(20)]
    tables(spark, str(tmp_path), docs, [(1, item)])
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = kept.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"] for r in kept.select("doc_id").collect()})
        assert k == 4 or kept.columns == columns
    everything = set(range(len(docs)))
    # Only every other row has a language, so the language model knows one language.
    assert seen[0] == everything - {15, 16}
    assert seen[1] == {d for d in seen[0] if same_groups(docs)[d][2]}
    links = all_pairs(sorted(seen[1]), [docs[d] for d in sorted(seen[1])], 5, 80)
    assert seen[2] == {d for d in seen[1] if links[d][1] == d}
    dirty = contamination(docs, [(1, item)])
    assert seen[3] == {d for d in seen[2] if not dirty[d][4]} and 17 not in seen[3]
    assert seen[4] == seen[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, kept.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    )


def test_stages_take_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_crc_of_ids(spark):
    from skein.llm.common import crc32_of_id

    assert spark.range(3).select(crc32_of_id("id").alias("c")).first()["c"] == zlib.crc32(b"0")
