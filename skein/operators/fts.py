"""Full-text search: the query language, postings, and BM25 over phrases.

An index gives the postings of a query's terms (term, id, col, positions,
length: of the row, in words) and knows how many rows there are and how long
they are on average.  ``segments`` keeps one on disk; without, the same is
derived from the rows for one query.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.lineage import cut

# Fixed values of the ranking formula.
K1, B = 1.2, 0.75
#: Bytes of words that are sorted at once.
BATCH_BYTES = 8 << 20
SPLIT_BYTES = 128 << 20


def _marked() -> tuple[str, str]:
    """Lower-case letters that are another letter with one mark, and those letters."""
    pairs = []
    for code in range(0xC0, sys.maxunicode + 1):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and unicodedata.combining(parts[1]) and c == c.lower() and unicodedata.category(c).startswith("L"):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _marked()
_TABLE = str.maketrans(_MARKED, _PLAIN)


#: Marks that stand apart from their letter.
_MARKS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Mn")
_WORD = re.compile(r"[^\W_]+")


def _plain(text: str) -> str:
    """Lower case, without separate marks."""
    text = text.lower()
    return text if text.isascii() or _MARKS.isdisjoint(text) else "".join(c for c in text if c not in _MARKS)


def terms_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case, without marks."""
    return [w.translate(_TABLE) for w in _WORD.findall(_plain(text))]


# The query language -------------------------------------------------------------


@dataclass(frozen=True)
class Phrase:
    """Terms in a row; the last may be a prefix; in some columns only; at a column's start only."""

    terms: tuple[str, ...]
    prefix: bool = False
    columns: frozenset[str] | None = None
    first: bool = False


@dataclass
class Query:
    """A tree of ("phrase", k), ("near", [k, ...], words), ("and" | "or" | "not", left, right), or None for what matches nothing."""

    phrases: list[Phrase] = field(default_factory=list)
    tree: tuple | None = None


class BadQuery(ValueError):
    """What the language has no meaning for."""


_LEXER = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:+*^,-]))')


class _Parser:
    def __init__(self, text: str, columns: list[str]):
        self.columns = {c.lower(): c for c in columns}
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _LEXER.match(text, at)
            if not m:
                raise BadQuery(f"unexpected sign at {at}")
            kind = "string" if m[1] is not None else "word" if m[2] is not None else "sign"
            self.tokens.append((kind, m[1].replace('""', '"') if m[1] is not None else m[2] or m[3]))
            at = m.end()
        self.at, self.query = 0, Query()

    def is_sign(self, sign: str, ahead: int = 0) -> bool:
        return self.tokens[self.at + ahead : self.at + ahead + 1] == [("sign", sign)]

    def is_word(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and self.tokens[self.at][1] in words

    def take(self, sign: str) -> None:
        if not self.is_sign(sign):
            raise BadQuery(f"{sign} expected")
        self.at += 1

    def whole(self) -> Query:
        self.query.tree = self.either(None)
        if self.at < len(self.tokens):
            raise BadQuery("something follows the query")
        return self.query

    def joined(self, word: str, below, columns):
        left = below(columns)
        while self.is_word(word):
            self.at += 1
            left = (word.lower(), left, below(columns))
        return left

    # From the loosest to the tightest: OR, AND, NOT, phrases side by side.
    def either(self, columns):
        return self.joined("OR", self.all, columns)

    def all(self, columns):
        return self.joined("AND", self.without, columns)

    def without(self, columns):
        return self.joined("NOT", self.beside, columns)

    def starts(self) -> bool:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        return kind == "string" or (kind == "word" and text not in ("AND", "OR", "NOT")) or (kind == "sign" and text in "^{-")

    def beside(self, columns):
        inner = self.filter_of(columns)
        if self.is_sign("("):
            self.at += 1
            tree = self.either(inner)
            self.take(")")
            return tree
        tree = self.near(inner)
        while self.starts():
            inner = self.filter_of(columns)
            if self.is_sign("("):
                raise BadQuery("an operator must stand before (")
            tree = ("and", tree, self.near(inner))
        return tree

    def filter_of(self, outer):
        """The columns that the next part is held to."""
        begin, negated, names = self.at, False, []
        if self.is_sign("-"):
            self.at, negated = self.at + 1, True
        if self.is_sign("{"):
            self.at += 1
            while self.at < len(self.tokens) and self.tokens[self.at][0] != "sign":
                names.append(self.tokens[self.at][1])
                self.at += 1
            self.take("}")
            self.take(":")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] != "sign" and self.is_sign(":", 1):
            names.append(self.tokens[self.at][1])
            self.at += 2
        else:
            if negated:
                raise BadQuery("a column must follow -")
            self.at = begin
            return outer
        for n in names:
            if n.lower() not in self.columns:
                raise BadQuery(f"no column {n}")
        chosen = frozenset(self.columns[n.lower()] for n in names)
        chosen = frozenset(self.columns.values()) - chosen if negated else chosen
        return chosen if outer is None else chosen & outer

    def near(self, columns):
        if not (self.is_word("NEAR") and self.is_sign("(", 1)):
            return self.phrase(columns)
        self.at += 2
        parts, distance = [], 10
        while not self.is_sign(")") and not self.is_sign(","):
            parts.append(self.phrase(columns))
        if self.is_sign(","):
            self.at += 1
            if self.at >= len(self.tokens) or not self.tokens[self.at][1].isdigit():
                raise BadQuery("a number of words must follow ,")
            distance = int(self.tokens[self.at][1])
            self.at += 1
        self.take(")")
        return ("near", [p[1] for p in parts], distance) if len(parts) > 1 else parts[0] if parts else None

    def phrase(self, columns):
        first = self.is_sign("^")
        self.at += first
        terms: list[str] = []
        while True:
            if self.at >= len(self.tokens) or self.tokens[self.at][0] == "sign" or self.is_word("AND", "OR", "NOT"):
                raise BadQuery("a word expected")
            terms += terms_of(self.tokens[self.at][1])
            self.at += 1
            prefix = self.is_sign("*")
            self.at += prefix
            if not self.is_sign("+"):
                break
            self.at += 1
        self.query.phrases.append(Phrase(tuple(terms), prefix, columns, first))
        return ("phrase", len(self.query.phrases) - 1)


def parse(text: str, columns: list[str]) -> Query:
    """The query that ``text`` stands for; BadQuery if it stands for none."""
    return _Parser(text, columns).whole()


# Postings -----------------------------------------------------------------------

ENTRY = "struct<term: string, col: string, positions: array<int>, times: int, first: boolean>"


class _Coded(dict):
    """word -> number of its term, in the order in which terms are met."""

    def __init__(self) -> None:
        super().__init__()
        self.terms: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        self[word] = code = self.terms.setdefault(word if word.isascii() else word.translate(_TABLE), len(self.terms))
        return code


def _entries(texts: list[list[str | None]], columns: list[str]) -> tuple[pa.Array, pa.Array]:
    """Of rows of texts, one a column: the length of each row, and its entries."""
    coded = _Coded()
    words = [_WORD.findall(_plain(t)) if t else () for row in zip(*texts, strict=True) for t in row]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    code = np.fromiter(map(coded.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
    cell = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = cell // len(columns), cell % len(columns)
    key = row * max(1, len(coded.terms)) + code
    order = np.argsort(key, kind="stable")  # by row and term; columns and positions stay in order
    key, col, pos = key[order], col[order], pos[order]
    new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
    begins = np.flatnonzero(new_key | np.append(True, col[1:] != col[:-1])[: len(key)])
    times = np.diff(np.append(np.flatnonzero(new_key), len(key)))
    first = new_key[begins]

    def named(names: list[str], at: np.ndarray) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(at, pa.int32()), pa.array(names, pa.string())).cast(pa.string())

    found = [
        named(list(coded.terms), code[order][begins]), named(columns, col[begins]),
        pa.ListArray.from_arrays(pa.array(np.append(begins, len(key)), pa.int32()), pa.array(pos, pa.int32())),
        pa.array(times[np.cumsum(first) - 1] if len(first) else [], pa.int32()), pa.array(first, pa.bool_()),
    ]
    entries = pa.StructArray.from_arrays(found, names=["term", "col", "positions", "times", "first"])
    ends = np.searchsorted(row[order][begins], np.arange(len(texts[0]) + 1))
    return pa.array(sizes.reshape(-1, len(columns)).sum(axis=1), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores if they are estimated to be less than a split for each."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows


def analysed(rows: DataFrame, columns: list[str], id_col: str = "id", more: dict[str, Column] | None = None) -> DataFrame:
    """id, length and entries of every row: a term in a column with its positions there, the times it occurs in all columns, and whether this is its first column.

    ``more`` names further columns, put between.  Words are sorted in the rows'
    own task; nothing is shuffled.
    """
    more, rows = more or {}, _spread(rows)
    texts = [F.col(c).cast("string").alias(f"text {k}") for k, c in enumerate(columns)]
    given = rows.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in more.items()), *texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                kept = part.columns[: -len(columns)]
                length, entries = _entries([c.to_pylist() for c in part.columns[-len(columns) :]], columns)
                yield pa.RecordBatch.from_arrays([*kept, length, entries], names=[*part.schema.names[: len(kept)], "length", "entries"])

    kinds = dict(given.dtypes)
    return given.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ["id", *more]) + f", length int, entries array<{ENTRY}>")


@dataclass
class Index:
    """``read`` gives the postings of terms and of prefixes, in a table that may hold those of other terms, too.

    ``frequencies`` gives the number of rows that hold a term, where that is known without its postings.
    """

    columns: list[str]
    rows: int
    mean: float
    read: Callable[[list[str], list[str]], DataFrame]
    frequencies: Callable[[list[str]], dict[str, int]] | None = None
    best: Callable[[Query, int], DataFrame | None] | None = None


def index_of(rows: DataFrame, columns: list[str], id_col: str = "id") -> Index:
    """An index for few queries: the rows are analysed once, and each query reads all postings."""
    found = cut(analysed(rows, columns, id_col))
    told = found.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    postings = found.select("id", "length", F.explode("entries").alias("e")).select("e.term", "id", "e.col", "e.positions", "length")
    return Index(columns, told["n"], told["mean"] or 0.0, lambda terms, prefixes: postings)


# Matching -----------------------------------------------------------------------


def _phrase_hits(phrase: Phrase, held: dict[tuple[str, bool], str]) -> Column:
    """Where the phrase begins, in one column of a row."""
    keys = [(t, phrase.prefix and k == len(phrase.terms) - 1) for k, t in enumerate(phrase.terms)]
    starts = F.col(held[keys[0]])
    if len(keys) > 1:
        starts = F.filter(starts, lambda p: reduce(Column.__and__, (F.array_contains(F.col(held[k]), p + i) for i, k in enumerate(keys) if i)))
    if phrase.first:
        starts = F.filter(starts, lambda p: p == 0)
    if phrase.columns is not None:
        starts = F.when(F.col("col").isin(*phrase.columns), starts).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(starts)


def _near(parts: list[int], distance: int, phrases: list[Phrase]) -> Column:
    """Whether, in one column, all phrases begin within so many words of the end of the first of them."""

    def from_first(a: int) -> Column:
        reach = len(phrases[a].terms) + distance
        return F.exists(f"h{a}", lambda p: reduce(Column.__and__, (F.exists(f"h{b}", lambda q: (q >= p) & (q <= p + reach)) for b in parts if b != a)))

    return reduce(Column.__or__, (from_first(a) for a in parts))


def plain_terms(query: Query) -> list[str] | None:
    """The terms of a query whose phrases are all single words anywhere in a row; else None."""
    if any(len(p.terms) != 1 or p.prefix or p.first or p.columns is not None for p in query.phrases):
        return None
    return [p.terms[0] for p in query.phrases] if query.tree is not None else None


def weight_of(rows: int, having: int) -> float:
    """The weight of a phrase that ``having`` of ``rows`` hold."""
    return max(float(np.log((rows - having + 0.5) / (having + 0.5))), 1e-6)


def gain(times: Column, length: Column, mean: float) -> Column:
    """What a phrase that occurs so often adds, before its weight: more with more occurrences, less in a longer row."""
    return times * (K1 + 1) / (times + K1 * (1 - B + B * length / mean))


def counted(postings: DataFrame, query: Query) -> tuple[DataFrame, Callable[[tuple], Column]]:
    """id, length and t0, t1, ... (the times of each phrase) of the rows in ``postings``, and what tells whether a tree holds for them."""
    phrases = query.phrases
    keys = list(dict.fromkeys((t, p.prefix and k == len(p.terms) - 1) for p in phrases for k, t in enumerate(p.terms)))
    held = {key: f"p{k}" for k, key in enumerate(keys)}

    def is_term(key: tuple[str, bool]) -> Column:
        return F.startswith(F.col("term"), F.lit(key[0])) if key[1] else F.col("term") == key[0]

    rows = postings.where(reduce(Column.__or__, map(is_term, keys))).repartition("id")
    by_column = rows.groupBy("id", "col").agg(
        F.first("length").alias("length"), *(F.flatten(F.collect_list(F.when(is_term(key), F.col("positions")))).alias(name) for key, name in held.items())
    )
    hits = by_column.select("id", "length", *(_phrase_hits(p, held).alias(f"h{k}") for k, p in enumerate(phrases)))
    nears: list[tuple] = []

    def collect(tree: tuple) -> None:
        if tree[0] == "near":
            nears.append(tree)
        elif tree[0] != "phrase":
            collect(tree[1])
            collect(tree[2])

    collect(query.tree)
    found = hits.groupBy("id").agg(
        F.first("length").alias("length"),
        *(F.sum(F.size(f"h{k}")).alias(f"t{k}") for k in range(len(phrases))),
        *(F.max(_near(parts, distance, phrases)).alias(f"n{k}") for k, (_, parts, distance) in enumerate(nears)),
    )

    def truth(tree: tuple) -> Column:
        if tree[0] == "phrase":
            return F.col(f"t{tree[1]}") > 0
        if tree[0] == "near":
            return F.col(f"n{next(k for k, n in enumerate(nears) if n is tree)}")
        left, right = truth(tree[1]), truth(tree[2])
        return left & right if tree[0] == "and" else left | right if tree[0] == "or" else left & ~right

    return found, truth


def scored(postings: DataFrame, query: Query, weights: list[float], mean: float) -> DataFrame:
    """id and score of the rows in ``postings`` that the query matches."""
    found, truth = counted(postings, query)
    return found.where(truth(query.tree)).select("id", _score(weights, mean).alias("score"))


def _score(weights: list[float], mean: float) -> Column:
    score = F.lit(0.0)
    for k, weight in enumerate(weights):
        score = score + F.lit(weight) * gain(F.col(f"t{k}").cast("double"), F.col("length"), mean)
    return score


def match(index: Index, query: Query) -> DataFrame:
    """id and score of the rows that the query matches.  A phrase's weight is by the rows that hold it; more occurrences count for more."""
    phrases = query.phrases
    nothing = query.tree is None or not index.rows or any(not p.terms for p in phrases)
    whole = [t for p in phrases for k, t in enumerate(p.terms) if not (p.prefix and k == len(p.terms) - 1)]
    postings = index.read([] if nothing else whole, [] if nothing else [p.terms[-1] for p in phrases if p.prefix])
    if nothing:
        return postings.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    terms = plain_terms(query)
    if terms is not None and index.frequencies is not None:
        having = index.frequencies(terms)
        return scored(postings, query, [weight_of(index.rows, having.get(t, 0)) for t in terms], index.mean)
    found, truth = counted(postings, query)
    found = cut(found)  # read for the weights, then for the scores
    have = found.agg(*(F.count_if(F.col(f"t{k}") > 0).alias(f"d{k}") for k in range(len(phrases)))).first()
    weights = [weight_of(index.rows, n) for n in have]
    return found.where(truth(query.tree)).select("id", _score(weights, index.mean).alias("score"))


def best(index: Index, query: Query, most: int) -> DataFrame:
    """The ``most`` best rows that the query matches: id and score, by score, then id."""
    found = index.best(query, most) if index.best is not None else None
    return (match(index, query) if found is None else found).orderBy(F.desc("score"), "id").limit(most)
