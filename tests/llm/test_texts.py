"""Each operator against a plain computation on small tables with the odd cases in them."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from skein.llm import decontaminate, exact_dedup, langid, ngram_join, packing, passages, quality, secrets, sharding, token_file
from skein.llm.tokens import Encoder, default_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word salad " * 60_000


def table(spark, texts, first=0):
    rows = [(first + k, t, ("en", None)[k % 2], None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Extra columns with the names that operators use inside."""
    for c in ("digest", "norm", "cell", "rank", "starts", "node", "key", "label", "keep_id"):
        df = df.withColumn(c, df["text"])
    return df


# Exact dedup -------------------------------------------------------------------


def same_groups(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, size = {}, Counter(norm)
    for k, n in enumerate(norm):
        first.setdefault(n, k)
    return {k: (first[n], size[n], first[n] == k, hashlib.sha256(n.encode()).hexdigest()) for k, n in enumerate(norm)}


TEXTS = ["a  b", "a\t\nb", "a b ", None, "", " ", "\x0b", "é x", "a b", LONG, LONG, "a b"]


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_exact_groups(spark, change):
    got = exact_dedup.exact_groups(change(table(spark, TEXTS))).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == same_groups(TEXTS)


def test_exact_dedup_keeps_whole_rows(spark):
    docs = clashing(table(spark, TEXTS))
    got = exact_dedup.exact_dedup(docs)
    assert got.columns and set(got.columns) == set(docs.columns)
    assert {r["doc_id"] for r in got.collect()} == {k for k, v in same_groups(TEXTS).items() if v[2]}
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0 and exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_exact_groups_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(rows).collect())
    assert got == {(1, 1, 3, True): 2, (None, 1, 3, False): 1, (None, None, 1, True): 1}


# Sharding ------------------------------------------------------------------------


def test_copies_without_an_id_go(spark):
    rows = [(3, "a  b", 1), (None, "a b", 1), (None, "a b", 2), (None, "c", 1), (9, "A b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone long")
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == Counter([(3, "a  b", 1), (None, "c", 1), (9, "A b", 1)])
    want = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert want == {(3, 3, 3), (None, 3, 3), (None, None, 1), (9, 9, 1)}


def test_written_shards_keep_every_column(spark, tmp_path):
    docs = table(spark, ["a", "b", None, "d"]).withColumns({"shard": F.lit("mine"), "slot": F.col("doc_id") * 2, "placed_id": F.lit(1)})
    sharding.write_shards(docs, str(tmp_path / "s"), shards=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*docs.columns, "shard_1"}
    assert {(r["doc_id"], r["shard_1"], r["slot"], r["placed_id"]) for r in back.collect()} == {(k, "mine", 2 * k, 1) for k in range(4)}
    assert Counter(r["shard"] for r in back.collect()) == {0: 2, 1: 2}


def test_shards(spark):
    docs = clashing(table(spark, [None, "", "é", LONG] + ["t"] * 95))
    rows = sharding.shard_rows(docs, 8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(99))
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    by = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}
    assert by[0] == (1, 0) and by[1] == (1, 0) and by[2] == (3, zlib.crc32("é".encode()))
    assert sharding.shard_rows(table(spark, []), 8).count() == 0
    assert sharding.shard_rows(spark.createDataFrame([(None, "a"), (None, "a"), (5, None)], "doc_id long, text string"), 8).count() == 3


def walked(counts, nodes, caps):
    """Where each key of each cell goes, key by key: home if there is room, else on clockwise, after all keys that are at home."""
    room, where, later = list(caps), {}, []
    for cell in sorted(counts):
        home = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        for rank in range(counts[cell]):
            if room[nodes[home][1]]:
                room[nodes[home][1]] -= 1
                where[cell, rank] = nodes[home][1]
            else:
                later.append((home, cell, rank))
    for home, cell, rank in later:
        while not room[nodes[home][1]]:
            home = (home + 1) % len(nodes)
        room[nodes[home][1]] -= 1
        where[cell, rank] = nodes[home][1]
    return where


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 30), max_size=40), st.integers(1, 5), st.sampled_from([0.0, 0.1, 1.0]))
def test_settling_is_the_walk_key_by_key(counts, shards, slack):
    nodes, caps = sharding.ring(shards, vnodes=7, cell_bits=8), sharding.capacities(sum(counts.values()), shards, slack)
    got = {(c, r): s for c, lo, hi, s in sharding.settle(counts, nodes, caps) for r in range(lo, hi)}
    assert got == walked(counts, nodes, caps)


def test_shards_against_the_walk(spark):
    texts = [f"t{k}" if k % 5 else None for k in range(300)]
    docs = table(spark, texts).unionByName(table(spark, ["x"] * 40).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(table(spark, ["twice"], 7))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.shiftrightunsigned(key, 48).alias("cell")).collect()
    cells: dict[int, list] = {}
    for r in sorted(keyed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(r["t"].encode()))):
        cells.setdefault(r["cell"], []).append((r["doc_id"], zlib.crc32(r["t"].encode())))
    where = walked({c: len(v) for c, v in cells.items()}, sharding.ring(6), sharding.capacities(len(keyed), 6))
    want = Counter((*row, where[c, k]) for c, rows in cells.items() for k, row in enumerate(rows))
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.shard_rows(docs, 6).collect()) == want


def test_ring_fills_every_shard_and_moves_little():
    random.seed(1)
    counts = {c: random.randrange(1, 9) for c in random.sample(range(1 << 16), 5000)}
    n = sum(counts.values())

    def homes(shards, slack):
        caps = sharding.capacities(n, shards, slack)
        placed = sharding.settle(counts, sharding.ring(shards), caps)
        load = Counter()
        where = {}
        for cell, lo, hi, shard in placed:
            load[shard] += hi - lo
            for r in range(lo, hi):
                where[cell, r] = shard
        assert len(where) == n and all(load[s] <= caps[s] for s in range(shards))
        return where

    homes(8, 0.0)
    before, after = homes(8, 0.25), homes(9, 0.25)
    assert sum(before[k] != after[k] for k in before) < 0.35 * n


# Decontamination -------------------------------------------------------------------


def contamination(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in enumerate(texts):
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for p, owners in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= owners
        names = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("most_words", [100_000, 15])
def test_decontamination(spark, most_words):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "É", "7"]
    items = [(10 * k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([3, 1, 2, 12, 14, 10, 10, 25])] + [(5, None), (6, "!!"), (7, "b a c")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(40))) for _ in range(40)] + [None, "", "..", items[4][1].upper() + "-" + items[7][1], LONG]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination_report(clashing(table(spark, texts)), benchmark, most_words=most_words).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == contamination(texts, items)
    kept = decontaminate.drop_contaminated(table(spark, texts), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, v in contamination(texts, items).items() if not v[4]}


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_report(table(spark, []), none).count() == 0
    assert not decontaminate.contamination_report(table(spark, ["a b"]), none).first()["contaminated"]
    assert decontaminate.drop_contaminated(table(spark, ["a b"]), none).count() == 1


# Tokens, packing, files ------------------------------------------------------------


ALPHABET = list("aB'sStTrevmld É é́ß×÷…  \n\t.,9²½%$<|>İΣ漢字🙂​﻿\u0085\x1c\x00") + ["<|endoftext|>", "'s ", "don't", "À"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), max_size=5))
def test_encoder_is_the_library(texts):
    tokenizer = test_encoder_is_the_library.__dict__.setdefault("t", __import__("tokenizers").Tokenizer.from_file(default_path()))
    encoder = test_encoder_is_the_library.__dict__.setdefault("e", Encoder())
    assert [list(x) for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets():
    small, large = Encoder(most=3), Encoder()
    for texts in (["a b c d e"], ["f g a"], [None, "a b"]):
        assert [list(x) for x in small.encode(texts)] == [list(x) for x in large.encode(texts)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20), st.just(64))
def test_plan_places_everything(counts, capacity):
    got = Counter()
    for number, contents in packing.plan(counts, capacity):
        assert sum(n * k for n, k in contents) <= capacity
        for n, k in contents:
            got[n] += number * k
    assert got == Counter(counts)


def test_plan_is_near_the_least():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(6, 1.2, 50_000).astype(int) + 1, 2048)
    values, counts = np.unique(lengths, return_counts=True)
    bins = sum(n for n, _ in packing.plan(dict(zip(values.tolist(), counts.tolist()))))
    assert bins <= 1.002 * (lengths.sum() / 2048) + 1


def test_packing(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", LONG[:30_000], "tie", "tie"] + ["w " * rng.randrange(900) for _ in range(60)]
    rows = packing.pack(clashing(table(spark, texts))).collect()
    encoder = Encoder()
    for k, ids in enumerate(encoder.encode(texts)):
        ids = np.append(ids, 0).astype("<u4")
        mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 2048 for r in mine[:-1])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(table(spark, [])).count() == 0
    packing.write_packed(table(spark, texts), str(tmp_path / "p"))
    sizes = Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert sorted(len(r["ids"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == sorted(sizes.values())


@pytest.mark.parametrize("ids", [[], [0], [65_534] * 5000, list(range(3000)), [1, 2, 3] * 2000, [65_535, 65_536, 7, 2**32 - 2] * 300])
def test_chapter_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    raw = token_file.write_chapter(ids, [4, None], [len(ids), 0], 9, block=700)
    names, lengths, before, back = token_file.read_chapter(raw)
    assert names == [4, None] and list(lengths) == [len(ids), 0] and before == 9 and (back == ids).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 65_534) | st.integers(0, 5), max_size=400), st.sampled_from([1, 7, 64]))
def test_coder_round_trip(ids, block):
    ids = np.array(ids, dtype=np.uint32)
    assert (token_file.read_chapter(token_file.write_chapter(ids, [1], [len(ids)], 0, block))[3] == ids).all()


def test_coder_predicts():
    """Fewer bits an id than zlib on the same blocks, and near the entropy of a source without memory."""
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, 201) ** 1.1
    alone = rng.choice(40_000, 200, replace=False)[rng.choice(200, 40_000, p=share / share.sum())].astype("<u4")
    follows = rng.integers(0, 100, (100, 2))
    chain = [0]
    for keep, pick in zip(rng.random(40_000) < 0.6, rng.integers(0, 2, 40_000), strict=True):
        chain.append(int(follows[chain[-1], pick]) if keep else int(rng.integers(0, 100)))
    for ids, whole in ((alone, True), (np.array(chain, dtype="<u4"), False)):
        coded = 8 * len(token_file.write_chapter(ids, [1], [len(ids)], 0)) / len(ids)
        block = token_file.BLOCK
        zipped = sum(8 * len(zlib.compress(ids[a : a + block].astype("<u2").tobytes(), 9)) for a in range(0, len(ids), block)) / len(ids)
        assert coded < 0.9 * zipped
        if whole:
            p = np.bincount(ids)[np.unique(ids)] / len(ids)
            # Each block learns the source anew.
            assert coded < 1.25 * -(p * np.log2(p)).sum()


def test_counts_of_a_section_foretell_its_blocks():
    """Blocks need not learn a source of 2 bits anew, whose ids alone would take 7."""
    rng = np.random.default_rng(4)
    follows = rng.integers(0, 128, (128, 4))
    ids = [0]
    for pick in rng.integers(0, 4, 60_000):
        ids.append(int(follows[ids[-1], pick]))
    ids = np.array(ids, dtype="<u4")
    raw = token_file.write_chapter(ids, [1], [len(ids)], 0, block=500)
    assert 8 * len(raw) / len(ids) < 3
    assert (token_file.read_chapter(raw)[3] == ids).all()


@pytest.mark.parametrize("ids", [np.arange(9000) % 1201, np.full(4100, 2**32 - 1), np.arange(7001) * 613_566])
def test_sections_round_trip(monkeypatch, ids):
    monkeypatch.setattr(token_file, "SECTION", 3)
    raw = token_file.write_chapter(ids.astype("<u4"), [1], [len(ids)], 0, block=700)
    assert (token_file.read_chapter(raw)[3] == ids).all()


def test_damaged_counts_are_noticed():
    raw = bytearray(token_file.write_chapter(np.arange(5000, dtype=np.uint32), [1], [5000], 0))
    raw[4 + struct.calcsize("<IQQI") + 16 + 8 + 40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_file.read_chapter(bytes(raw))


def test_damage_is_noticed():
    raw = bytearray(token_file.write_chapter(np.arange(5000, dtype=np.uint32), [1], [5000], 0))
    raw[-1500] ^= 64
    with pytest.raises(ValueError, match="damaged"):
        token_file.read_chapter(bytes(raw))


def test_token_files(spark, tmp_path):
    texts = ["b a", None, "", LONG[:50_000], "x"] + [f"text {k} again" for k in range(30)]
    docs = clashing(table(spark, texts, 100)).orderBy("text")
    token_file.write_token_files(docs, str(tmp_path / "t"), chapter=500)
    got = {r["doc_id"]: r for r in token_file.read_token_files(spark, str(tmp_path / "t"), with_ids=True).collect()}
    at = 0
    for k, ids in enumerate(Encoder().encode(texts), 100):
        ids = np.append(ids, 1).astype("<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())) and got[k]["ids"] == ids.tolist()
        at += len(ids)
    token_file.write_token_files(table(spark, []), str(tmp_path / "e"))
    assert token_file.read_token_files(spark, str(tmp_path / "e")).count() == 0


# Language and quality ------------------------------------------------------------------


def phrases(sample, text):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=60), st.text("abcd ", max_size=30))
def test_suffix_automaton_parses_greedily(sample, text):
    assert langid.SuffixAutomaton(sample).phrases(text) == phrases(sample, text)


def test_languages_against_plain_parsing(spark):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choices("abcde ÉÖ1" if k % 2 else "cdefg éö!", k=rng.randrange(0, 80))), ("xx", "yy", None)[k % 3]) for k in range(90)] + [(200, None, "xx"), (201, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, chars_per_lang=300)
    assert model.langs == ["xx", "yy"] and all(len(t) <= 302 for t in model.texts)
    for r in langid.identify(docs.drop("lang"), model).collect():
        text = dict((a, b) for a, b, _ in rows)[r["doc_id"]]
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        bits = [sum(phrases(t, f" {w} ") for w in words) * (np.log2(len(t)) + langid.LENGTH_BITS) for t in model.texts]
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == model.langs[int(np.argmin(bits))] and r["score"] == pytest.approx(1 - min(bits) / max(max(bits), 1))


def test_languages(spark):
    rng = random.Random(5)
    words = {"x": ["the", "and", "over"], "y": ["der", "und", "über"]}
    rows = [(k, " ".join(rng.choices(words["xy"[k % 2]], k=12)).upper(), "xy"[k % 2]) for k in range(60)] + [(90, None, "x"), (91, "12 !", None), (92, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert all(got[k][0] == lang for k, t, lang in rows if k < 60) and all(0 <= s <= 1 for _, s in got.values())
    assert {got[k] for k in (90, 91, 92)} == {("und", 0.0)}
    assert langid.keep_language(docs, model).count() == 60
    nothing = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_a_rare_language_leaves_the_others_alone(spark):
    rng = random.Random(5)
    made = {lang: ["".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(40)] for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "efghi"))}
    rows = [(k, " ".join(rng.choices(made[lang], k=60)), lang) for k, lang in enumerate(list(made) * 40)]
    held = [(k, " ".join(rng.choices(made[lang], k=9)), lang) for k, lang in enumerate(list(made) * 30)]
    docs, new = (spark.createDataFrame(r, "doc_id long, text string, lang string") for r in (rows, held))
    rare = docs.unionByName(spark.createDataFrame([(10**6, "xyz", "zz")], docs.schema))
    truth = {k: lang for k, _, lang in held}

    def right(model):
        return sum(r["lang_pred"] == truth[r["doc_id"]] for r in langid.identify(new, model).collect())

    assert right(langid.learn(rare)) >= right(langid.learn(docs)) - 1 >= 0.9 * len(held)
    probe = spark.createDataFrame([(1, "xyz xyz")], "doc_id long, text string")
    assert langid.identify(probe, langid.learn(rare)).first()["lang_pred"] == "zz"


def test_ties_of_languages_are_kept(spark):
    rows = [(1, "abab", "x"), (2, "baba", "y"), (3, "cdcd", "z"), (4, "ab", None), (5, "q", None), (6, "12 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    tied = {r["doc_id"] for r in langid.identify(docs, model).collect() if r["score"] == 0 and r["lang_pred"] != "und"}
    assert 5 in tied
    assert {r["doc_id"] for r in langid.keep_language(docs, model).collect()} == {1, 2, 3, 4, 5}


def test_quality(spark):
    rng = random.Random(6)
    good = ["Plain words make a line of text here.\nAnd then another one follows it." for _ in range(20)]
    bad = ["\n".join("BUY!! NOW!! ### $$$ %%%" for _ in range(rng.randrange(1, 6))) for _ in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad + [None, "", LONG])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(40)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.learn(docs, labels)).collect()}
    assert min(got[k] for k in range(20)) > 0.5 > max(got[k] for k in range(20, 40)) and all(0 <= s <= 1 for s in got.values())
    assert got[40] == got[41]
    assert {r["score"] for r in quality.score_quality(docs, quality.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_line_marginals_by_enumeration():
    rng = np.random.default_rng(7)
    field = quality.LineField(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)))
    texts = ["one line.", "A b\n\nC!! d\ne", "x\ny"]
    lines = quality.Lines(texts)
    emit = lines.x @ field.weights
    want = []
    for a, b in zip(lines.starts, lines.starts[1:]):
        n = b - a
        total, good = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [(bits >> k) & 1 for k in range(n)]
            w = np.exp(sum((2 * y[k] - 1) * emit[a + k] / 2 for k in range(n)) + sum(field.ties[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            good += w * np.array(y)
        want += list(good / total)
    assert np.allclose(field.line_marginals(lines), want)


# Secrets -----------------------------------------------------------------------------


def base_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


SECRETS = ["token", "TOKEN", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abcdef", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef" * 2, "é", "\n", "secret", "x", "tok", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 10]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SECRETS), max_size=12).map("".join), max_size=4))
def test_secret_spans(texts):
    scan = test_secret_spans.__dict__.setdefault("scan", secrets.scanner(secrets.BASE + secrets.MORE))
    for text, spans in zip(texts, scan(texts) if texts else []):
        assert [s for s in spans if s[1] < 3] == base_spans(text)
        more = sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.MORE, 3) for m in re.finditer(r.pattern, text))
        assert [s for s in spans if s[1] >= 3] == more


def test_secrets_report(spark):
    texts = [None, "", 'é token = "abcdef123"', "AKIA" + "A" * 16 + " " + "0" * 24, LONG]
    got = {r["doc_id"]: r for r in secrets.secrets_report(clashing(table(spark, texts))).collect()}
    for k, t in enumerate(texts):
        assert got[k]["base_sha256"] == secrets.base_digest(base_spans(t or ""))
    assert got[2]["spans"] == "assign:2:20" and (got[3]["n_access"], got[3]["n_hex"]) == (1, 1)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(table(spark, texts)).collect()}
    assert clean[2] == 'é [SECRET]"' and clean[0] is None and clean[3] == "[SECRET] [SECRET]"
    assert secrets.secrets_report(table(spark, [])).count() == 0


def test_long_runs_take_linear_time():
    scan = secrets.scanner(secrets.BASE + secrets.MORE)
    jwt = "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10
    texts = ["eyJ" * 350_000 + ".eyJ", "eyJ" * 100_000 + " " + jwt, "AKIA" * 250_000, "token" * 200_000, "password" + " " * 1_000_000, "-----BEGIN " * 100_000]
    began = time.time()
    found = scan(texts)
    assert time.time() - began < 20
    names = [r.kind for r in secrets.BASE + secrets.MORE]
    assert [(names[k], b - a) for a, k, b in found[1] if names[k] == "jwt"] == [("jwt", len(jwt))] and len(found[2]) == 1


# Passages ------------------------------------------------------------------------------


def test_passages_are_found_wherever_they_lie(spark):
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    shared, stock = words(51), words(20)
    texts = [" ".join(words(40) + shared + words(30)), " ".join(words(7) + shared), " ".join(shared).upper(), " ".join(words(300)), " ".join(stock + words(60)), " ".join(stock + words(60)), None, "", " ".join(words(24))]
    near = words(400)
    edited = list(near)
    for k in (100, 300):
        edited[k] = "changed"
    texts += [" ".join(near), " ".join(edited), LONG, " ".join(["same"] * 200)]
    rows = passages.repeated_passages(clashing(table(spark, texts))).cache()
    assert {r["doc_id"] for r in rows.collect()} == {0, 1, 2, 9, 10}
    assert {r["doc_id"] for r in rows.where("kept").collect()} == {0, 9}
    spans = {r["doc_id"]: r["spans"] for r in passages.removal_spans(rows).collect()}
    assert set(spans) == {1, 2, 10} and all(a["end_word"] < b["start_word"] for s in spans.values() for a, b in zip(s, s[1:]))
    assert passages.repeated_passages(table(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 200), st.integers(0, 200), st.integers(50, 80), st.integers(0, 10**6))
def test_shared_runs_share_a_window(before, after, run, seed):
    rng = random.Random(seed)

    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    common, names = words(run), []
    for lead in (before, after):
        text = words(lead) + common + words(3)
        found = passages.Paragraphs([" ".join(words(60)), " ".join(text)], passages.Interned(passages.xxhash.xxh3_64_intdigest), passages.split_words)
        own = found.window_row == 1
        inside = own & (found.window_start >= lead) & (found.window_start + passages.WIDTH <= lead + run)
        names.append(set(found.window_name[inside].tolist()))
    assert names[0] & names[1]


def test_two_texts_among_many_are_found(spark):
    rng = random.Random(2)

    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    shared = words(55)
    texts = [" ".join(words(60)) for _ in range(3000)]
    texts[700] = " ".join(words(20) + shared)
    texts[2100] = " ".join(shared + words(9))
    found = passages.repeated_passages(table(spark, texts)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["kept"]) for r in found} == {(700, 20, 75, True), (2100, 0, 55, False)}


def test_words_are_digested_as_they_are_split():
    rng, split = random.Random(8), passages.split_words
    texts = ["A b\tc\n\nd e\r\nf", "", None, " ", "\n", "x\n", "\nlong é word\x85y\x0bz", "Z" * 3000, "z" * 3000]
    texts += ["".join(rng.choice("aB é\n\t") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for some in (texts, texts[::-1], [None], []):
        digest = passages.Interned(passages.xxhash.xxh3_64_intdigest)
        words, per_line, per_text = passages.digested(some, digest, split)
        plain, lines, sizes = passages.digested(some, digest, lambda t: split(t))
        assert per_text.tolist() == sizes.tolist() and [n for n in per_line if n] == [n for n in lines if n]
        assert len(set(zip(words.tolist(), plain.tolist(), strict=True))) == len(set(words.tolist())) == len(set(plain.tolist()))


@pytest.mark.parametrize("most", [1 << 22, 50])
def test_lines_of_a_block_are_linked_as_by_all_pairs(monkeypatch, most):
    monkeypatch.setattr(passages, "TABLE", most)
    rng, metric = random.Random(4), passages.Metric(80, 100)
    for k in (2, 2, 2, 3, 7, 30):
        bases = [rng.sample(range(400), 60) for _ in range(3)]
        sets = [np.array(sorted(set(rng.choice(bases)) ^ set(rng.sample(range(400), rng.randrange(8)))), dtype=np.uint64) for _ in range(k)]
        groups, want = passages.Union(k), passages.Union(k)
        for a, b in passages.line_links(sets, np.array([len(x) for x in sets]), metric):
            groups.join(a, b)
        for a, b in combinations(range(k), 2):
            if 100 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 80 * len(set(sets[a].tolist()) | set(sets[b].tolist())):
                want.join(a, b)
        assert [groups.find(x) for x in range(k)] == [want.find(x) for x in range(k)]


def test_blocks_of_one_task_are_told_apart():
    """Batches end anywhere, blocks go on over them; each block is handed over once and whole."""
    rng, seen = random.Random(5), []

    def finder(sets, sizes, metric):
        seen.append([int(s[0]) for s in sets])
        return [(0, k) for k in range(1, len(sets))]

    comps = sorted(rng.randrange(12) for _ in range(60))
    rows = pa.table({"comp": comps, "rep": list(range(60)), "n": [1] * 60, "grams": [np.array([k], dtype=np.uint64).tobytes() for k in range(60)]})
    rows = rows.set_column(3, "grams", rows.column("grams").cast(pa.binary()))
    blocks = [[k for k in range(60) if comps[k] == c] for c in sorted(set(comps))]
    for size in (1, 2, 7, 60):
        seen.clear()
        out = pa.Table.from_batches(ngram_join._links(80, 100, finder)(iter(rows.combine_chunks().to_batches(max_chunksize=size)))).to_pydict()
        assert seen == [b for b in blocks if len(b) > 1]
        assert list(zip(out["a"], out["b"], strict=True)) == [(b[0], x) for b in blocks for x in b[1:]]


def test_passages_against_all_pairs(spark):
    """Runs of 50 words and more exactly; lines whose similarity is 0.8 or more, at a recall of 0.9 or more; others not at all."""
    rng = random.Random(21)
    vocabulary = [f"v{k}" for k in range(400)]

    def words(n):
        return rng.choices(vocabulary, k=n)

    def edited(line, n):
        line = list(line)
        for at in rng.sample(range(len(line)), n):
            line[at] = rng.choice(vocabulary)
        return line

    bases = [words(rng.choice([60, 80, 100, 150])) for _ in range(16)]
    texts = []
    for k in range(200):
        lines = [words(rng.choice([3, 12, 30, 70])) for _ in range(rng.randrange(1, 4))]
        act, base = k % 4, rng.choice(bases)
        if act == 0:
            lines.insert(1, edited(base, rng.randrange(0, 1 + len(base) // 30)))
        elif act == 1:
            at = rng.randrange(0, 20)
            lines[0] = lines[0] + base[at : at + rng.choice([30, 45, 49, 50, 58])] + words(8)
        elif act == 2:
            # One edit in the middle, so that no run is long.
            middle = rng.choice([b for b in bases if len(b) in (60, 80)])
            lines.append([*middle[: len(middle) // 2], rng.choice(vocabulary), *middle[len(middle) // 2 + 1 :]])
        texts.append("\n".join(" ".join(w) for w in lines))
    texts += [texts[0], "", None]
    found = passages.repeated_passages(table(spark, texts)).collect()
    split = [(t or "").split() for t in texts]

    def windows(text, size):
        return {tuple(text[a : a + size]): a for a in range(len(text) - size + 1)}

    own = [windows(w, 50) for w in split]
    runs, flagged = set(), {r["doc_id"] for r in found}
    for a in range(len(texts)):
        for b in range(a):
            if own[a].keys() & own[b].keys():
                runs |= {a, b}
    assert len(runs) > 30 and runs <= flagged
    lines = [(k, line.split()) for k, t in enumerate(texts) for line in (t or "").split("\n") if len(line.split()) >= 50]
    sets = [set(windows(w, 5)) for _, w in lines]
    near = {(lines[i][0], lines[j][0]) for i in range(len(lines)) for j in range(i) if lines[i][0] != lines[j][0] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    only = {p for p in near if not (own[p[0]].keys() & own[p[1]].keys())}
    assert len(only) > 20 and sum(a in flagged and b in flagged for a, b in only) >= 0.9 * len(only)
    # Two runs with an edit between them count together, so a text may be found by less than 50 words in a row.
    loose = [windows(w, passages.WIDTH) for w in split]
    related = {k for p in near for k in p} | {k for a in range(len(texts)) for b in range(a) if loose[a].keys() & loose[b].keys() for k in (a, b)}
    assert flagged <= related


def test_common_passages_are_resolved_in_their_tasks(spark):
    rng = random.Random(6)
    shared = " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))
    docs = table(spark, [f"{shared} {k} x{k}" for k in range(500)]).repartition(3)
    found = passages.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} == set(range(1, 500)) and 0 in {r["doc_id"] for r in found if r["kept"]}
    # The lines as wholes, of 62 words, are similar too.
    assert all(r["start_word"] == 0 and r["end_word"] in (60, 62) and r["first_doc_id"] <= r["doc_id"] for r in found)


def test_passages_with_a_row_without_id(spark):
    rng = random.Random(4)
    shared = " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))
    docs = spark.createDataFrame([(None, shared), (1, shared), (2, shared)], "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["kept"]) for r in found} == {(1, True), (2, False)}


def test_passages_are_removed_whole(spark):
    rng = random.Random(12)

    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    texts, want = [], {}
    for k in range(20):
        shared, lead = words(51 + 7 * k), rng.randrange(40)
        texts += [" ".join(words(30) + shared + words(30)), " ".join(words(lead) + shared + words(25))]
        want[2 * k + 1] = [(lead, lead + len(shared))]
    docs = table(spark, texts)
    # Another text with the same id is not where the passage lies.
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.lit(" ".join(words(200)))))
    found = passages.removal_spans(passages.repeated_passages(docs)).collect()
    assert {r["doc_id"] for r in found} == set(want)
    for r in found:
        # A paragraph of similarity 0.8 may hold two words beyond the passage.
        [(start, end)], [(first, last)] = r["spans"], want[r["doc_id"]]
        assert first - 2 <= start <= first and last <= end <= last + 2
