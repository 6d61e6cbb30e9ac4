"""Secret scans through a trigram inverted index.

Every rule's regex is turned into a Boolean query over trigrams (of ASCII
lower-cased bytes) that each text with a match satisfies.  For each batch of
texts an inverted index lists, for every trigram that some rule names, the
texts that have it; the queries intersect and unite these postings, and only
the candidates meet the regex.  A rule without mandatory trigrams scans all
texts of the batch.

Spans are counted in code points of the whole text, the end exclusive.

Defined results: a null text counts as empty and has no spans; rows that
repeat are answered each; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import pieces, small_batches

#: A query is True (any text), ("tri", bytes), ("and", [queries]) or ("or", [queries]).
Query = object
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    accept: Callable[[re.Match], bool] = field(default=lambda m: True)


BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
        lambda m: len(m[2]) >= 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Not inside a longer run, where each of very many starts would scan the rest of it.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def both(parts: list) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def either(parts: list) -> Query:
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def of_string(text: str) -> Query:
    raw = text.encode()
    return both([("tri", t) for t in dict.fromkeys(raw[i : i + 3] for i in range(len(raw) - 2))])


def _choices(items) -> set[str] | None:
    """The strings a character class stands for, ASCII lower-cased, or None for many."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_STRINGS:
            out.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return {c.lower() if c.isascii() else c for c in out}


def _walk(nodes, ignore_case: bool) -> tuple[set[str] | None, list]:
    """(all strings that ``nodes`` match, or None if too many, queries that any match satisfies)."""
    exact: set[str] | None = {""}
    needs: list = []

    def close() -> None:
        nonlocal exact
        if exact is not None and exact != {""}:
            needs.append(either([of_string(s) for s in sorted(exact)]))
        exact = {""}

    def extend(strings: set[str] | None) -> None:
        nonlocal exact
        if strings is None or len(strings) > MOST_STRINGS:
            close()
        elif len(exact) * len(strings) > MOST_STRINGS:
            close()
            exact = strings
        else:
            exact = {a + b for a, b in product(exact, strings)}

    whole = True
    for kind, value in nodes:
        if kind is op.LITERAL:
            c = chr(value)
            # Non-ASCII letters under ignore-case have several byte forms.
            strings = None if ignore_case and not c.isascii() else {c.lower() if c.isascii() else c}
        elif kind is op.IN:
            strings = _choices(value)
        elif kind is op.SUBPATTERN:
            strings, inner = _walk(value[3], ignore_case)
            if strings is None:
                needs.extend(inner)
        elif kind is op.BRANCH:
            found = [_walk(b, ignore_case) for b in value[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*(s for s, _ in found))
            else:
                strings = None
                needs.append(either([both(q) if s is None else either([of_string(x) for x in s]) for s, q in found]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            strings, inner = _walk(body, ignore_case)
            if low == high == 1:
                pass
            elif (low, high) == (0, 1) and strings is not None:
                strings = strings | {""}
            else:
                if low and strings is not None and len(strings) ** low <= MOST_STRINGS:
                    extend({"".join(p) for p in product(strings, repeat=low)})
                elif low:
                    needs.extend(inner)
                strings = None
        elif kind is op.AT:
            continue
        else:
            strings = None
        if strings is None:
            whole = False
        extend(strings)
    if whole and not needs:
        return exact, []
    close()
    return None, needs


def trigram_query(rule: Rule) -> Query:
    ignore_case = bool(rule.flags & re.IGNORECASE)
    exact, needs = _walk(parser.parse(rule.pattern, rule.flags), ignore_case)
    return both(needs) if exact is None else either([of_string(s) for s in sorted(exact)])


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


class TrigramIndex:
    """Postings of the chosen trigrams over a list of texts."""

    def __init__(self, texts: list[str], chosen: list[bytes], number: np.ndarray):
        raw = [t.encode().lower() for t in texts]
        flat = np.frombuffer(b"\0\0".join(raw), dtype=np.uint8)
        starts = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(r) + 2 for r in raw], out=starts[1:])
        self.n = len(texts)
        self.postings: dict[bytes, np.ndarray] = {}
        hits, names = [], []
        for at in range(0, max(0, len(flat) - 2), 1 << 20):
            part = flat[at : at + (1 << 20) + 2].astype(np.uint32)
            found = number[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            where = np.flatnonzero(found)
            hits.append(where + at)
            names.append(found[where])
        if hits:
            hits, names = np.concatenate(hits), np.concatenate(names)
            row = np.searchsorted(starts, hits, side="right") - 1
            for k, t in enumerate(chosen, 1):
                self.postings[t] = np.unique(row[names == k])

    def ask(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings.get(query[1], np.zeros(0, dtype=np.int64))
        found = [self.ask(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        out = found[0]
        for f in found[1:]:
            out = np.intersect1d(out, f, assume_unique=True)
        return out


def scanner(rules: tuple[Rule, ...]) -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
    """A function from texts to each text's spans (start, rule number, end), sorted."""
    queries = [trigram_query(r) for r in rules]
    chosen = sorted(set().union(*map(trigrams, queries)))
    if len(chosen) > 65_000:
        raise ValueError("too many distinct trigrams for one index")
    number = np.zeros(1 << 24, dtype=np.uint16)
    for k, t in enumerate(chosen, 1):
        number[int.from_bytes(t)] = k
    compiled = [re.compile(r.pattern, r.flags) for r in rules]

    def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        index = TrigramIndex(texts, chosen, number)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex) in enumerate(zip(rules, compiled, strict=True)):
            for row in index.ask(queries[k]):
                spans[row] += [(m.start(), k, m.end()) for m in regex.finditer(texts[row]) if rule.accept(m)]
        for s in spans:
            s.sort()
        return spans

    return scan


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in pieces(batches):
            found = scan([t or "" for t in batch.column(1).to_pylist()])
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return run


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and spans (array of kind, start, end; by start, then in the order of the rules) of every row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, spans array<struct<kind: string, start: int, end: int>>"
    return texts.mapInArrow(_scan(rules), schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by ``mark``."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in pieces(batches):
            texts = batch.column(at).to_pylist()
            out = []
            for text, spans in zip(texts, scan([t or "" for t in texts]), strict=True):
                parts, done = [], 0
                for a, _, b in spans:
                    if a >= done:
                        parts += [text[done:a], mark]
                    done = max(done, b)
                out.append("".join([*parts, text[done:]]) if spans else text)
            columns = batch.columns
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def secrets_report(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (joined) of every row."""
    found = find_secrets(docs, BASE + more)
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, kinds), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def base_digest(spans: list[tuple[int, int, int]]) -> str:
    """What base_sha256 must be for the spans (start, number of the base rule, end)."""
    return hashlib.sha256(",".join(f"{BASE[k].kind}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()
