"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text.  A text is parsed
against it into phrases: from each position the longest match found in the
labelled text is one phrase (a letter never seen is a phrase of its own).  The
fewer phrases per letter, the lower the cross-entropy.  A phrase is a pointer
into the labelled text, so counts are normalised by the bits of such a pointer
(``phrase_cost``), as labelled texts may differ in length; the language that needs
least wins.  Words, with a space on either side, are parsed one by one, so a
word's phrase count under every language is remembered while it recurs; the
counts are summed over all words of the whole text.

The automata learn from a bounded sample: about ``docs_per_lang`` labelled
documents of each language, chosen by a hash of the id, and of them the first
``chars_per_lang`` characters in hash order (no document gives more than that,
and only so much of it leaves the executors).  A language with fewer keeps what
it has, and takes nothing from the others.

Defined results: ``und`` with score 0 where the text is null or has no letter;
with one learned language every other text gets it, with score 1; with none
(an empty table) every text is ``und``.  On equal counts the language with
the most labelled rows wins (then the first in the alphabet), with score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Interned, offsets, pieces, resident, small_batches

DOCS_PER_LANG = 100
CHARS_PER_LANG = 40_000
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


class SuffixAutomaton:
    """All substrings of a text; states are numbers, edges one dictionary."""

    def __init__(self, text: str):
        edges: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.letters = {c: k for k, c in enumerate(sorted(set(text)))}
        n = len(self.letters)
        self.edges = {s * n + self.letters[c]: t * n for s, e in enumerate(edges) for c, t in e.items()}

    def phrases(self, text: str) -> int:
        """How many longest matches, one after another, make up ``text``."""
        letters, get = self.letters, self.edges.get
        count, state, fresh = 1, 0, True
        for c in text:
            k = letters.get(c)
            after = None if k is None else get(state + k)
            if after is None:
                count += not fresh
                after = None if k is None else get(k)
                if after is None:  # a letter never seen is a phrase, and another begins
                    count += 1
                    state, fresh = 0, True
                    continue
            state, fresh = after, False
        return count - fresh


#: Bits that tell where a phrase ends, beside those that tell where in the labelled text it lies.
LENGTH_BITS = 8.0


def phrase_cost(text: str) -> float:
    """Bits to point at a phrase of the labelled text: what makes counts of unequal labelled texts comparable."""
    return float(np.log2(max(2, len(text)))) + LENGTH_BITS


class LanguageModel:
    def __init__(self, samples: dict[str, list[str]], counts: dict[str, int], chars: int = CHARS_PER_LANG):
        texts = {}
        for lang, docs in samples.items():
            text = " ".join(chain.from_iterable(letter_words(d) for d in docs))
            if text:
                texts[lang] = text
        self.langs = sorted(texts, key=lambda k: (-counts[k], k))
        self.texts = [f" {texts[k][:chars]} " for k in self.langs]

    def parser(self) -> Parser:
        """The parser of this Python worker, with the words that earlier tasks met."""
        return resident(("languages", *self.langs, *self.texts), lambda: Parser(self.langs, self.texts))


class Parser:
    """The automata, built where they are used, and the words parsed so far."""

    def __init__(self, langs: Sequence[str], texts: Sequence[str]):
        self.langs = list(langs)
        self.automata = [SuffixAutomaton(t) for t in texts]
        self.cost = np.array([phrase_cost(t) for t in texts])
        self.rows = np.zeros((1 << 14, len(self.langs)), dtype=np.int32)
        self.known = Interned(self._parse)

    def _parse(self, word: str) -> int:
        k = len(self.known)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        padded = f" {word} "
        self.rows[k] = [a.phrases(padded) for a in self.automata]
        return k

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        self.known.trim()
        words = [letter_words(t) for t in texts]
        counts = [len(w) for w in words]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=sum(counts))
        sums = np.zeros((len(at) + 1, len(self.langs)), dtype=np.int64)
        np.cumsum(self.rows[at], axis=0, out=sums[1:])
        ends = offsets(counts)
        totals = sums[ends[1:]] - sums[ends[:-1]]
        totals = totals * self.cost
        best = totals.argmin(axis=1)
        least = totals.min(axis=1)
        if len(self.langs) > 1:
            second = np.partition(totals, 1, axis=1)[:, 1]
            score = 1.0 - least / np.maximum(second, 1)
        else:
            score = np.ones(len(texts))
        empty = np.array(counts) == 0
        return ["und" if e else self.langs[b] for b, e in zip(best, empty, strict=True)], np.where(empty, 0.0, score)


def learn(
    docs: DataFrame,
    docs_per_lang: int = DOCS_PER_LANG,
    chars_per_lang: int = CHARS_PER_LANG,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """A model of the labelled rows in ``docs``; null labels and texts teach nothing.

    One count per language comes to the driver, then about ``docs_per_lang``
    documents of each, cut to ``chars_per_lang`` characters.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "lang is not null"
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel({}, {})
    place = F.shiftrightunsigned(F.xxhash64(F.col("i").cast("string")), 11).cast("double") / float(1 << 53)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, docs_per_lang / n).otherwise(share)
    chosen = rows.withColumn("place", place).where(F.col("place") < share).where("text is not null")
    chosen = chosen.select("place", "lang", F.substring("text", 1, chars_per_lang).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["place"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return LanguageModel(samples, counts, chars_per_lang)


def _predict(model: LanguageModel, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = model.parser()
        for batch in pieces(batches):
            lang, score = parser.predict(batch.column(text_at).to_pylist())
            names = batch.schema.names
            kept = [k for k in range(len(names)) if k != text_at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*(names[k] for k in kept), "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, lang_pred string, score double"
    return texts.mapInArrow(_predict(model, 1), schema)


def keep_language(
    docs: DataFrame, model: LanguageModel, least: float = 0.0, langs: list[str] | None = None, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known (and one of ``langs``) with a score of ``least`` at least.

    A tie (score 0) has a winner, so by default only rows without a letter go.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    wanted = set(langs) if langs is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = model.parser()
        for batch in pieces(batches):
            lang, score = parser.predict(batch.column(at).to_pylist())
            keep = [k != "und" and s >= least and (wanted is None or k in wanted) for k, s in zip(lang, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
