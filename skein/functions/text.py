"""Scalar functions over text, as column expressions; the few that keep state also as Python functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE_CLASS = "[\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]"
_RUN = re.compile(_WIDE_CLASS + r"|[^\W_]+|[^\w\s]|_")
_WIDE = re.compile(_WIDE_CLASS)
#: A run of letters longer than this is no word.
LONGEST_WORD = 40


def estimate_tokens(text: str | None) -> int:
    """Tokens at most: a sign or wide letter one, a word a quarter of its letters, other runs one a letter."""
    total = 0
    for part in _RUN.findall(_WIDE.sub(lambda m: f" {m[0]} ", text or "")):
        if len(part) == 1 and not part.isalnum() or _WIDE.match(part):
            total += 1
        elif len(part) > LONGEST_WORD or any(c.isdigit() for c in part):
            total += len(part)
        else:
            total += -(-len(part) // 4)
    return total


def token_estimate(text: Column) -> Column:
    """``estimate_tokens`` as an expression, for texts without wide letters beside others in one run."""
    wide = r"[\x{3000}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), f"({wide})", " $1 ")
    runs = F.regexp_extract_all(spaced, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"), F.lit(1))

    def cost(run: Column) -> Column:
        word = run.rlike(r"^[\p{L}\p{N}]+$") & ~run.rlike(f"^{wide}$")
        whole = run.rlike(r"\p{Nd}") | (F.length(run) > LONGEST_WORD)
        return F.when(~word, 1).when(whole, F.length(run)).otherwise(F.ceil(F.length(run) / 4)).cast("int")

    return F.aggregate(runs, F.lit(0), lambda a, r: a + cost(r))


def tokens_of_chars(chars: Column, per_token: float = 3.5) -> Column:
    """Tokens of so many characters, rounded up: what a budget reckons with."""
    return F.ceil(chars / F.lit(per_token)).cast("int")


def trim_middle(text: str, most_tokens: int, mark: str = "\n…\n") -> str:
    """Head (60 %) and tail of a text, cut at line ends, so that both and the mark fit the budget."""
    if estimate_tokens(text) <= most_tokens:
        return text
    low, high = 0, len(text)
    best = ""
    while low <= high:
        keep = (low + high) // 2
        head = text[: keep * 6 // 10]
        tail = text[len(text) - (keep - keep * 6 // 10) :] if keep else ""
        head = head[: head.rfind("\n")] if "\n" in head else head
        tail = tail[tail.find("\n") + 1 :] if "\n" in tail else tail
        if estimate_tokens(tried := head + mark + tail) <= most_tokens:
            best, low = tried, keep + 1
        else:
            high = keep - 1
    return best


def first_lines(text: Column, most: int) -> Column:
    """At most so many characters, ended at a line's end where there is one."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), "\n")
    snapped = F.when(F.instr(head, "\n") > 0, F.substring(head, F.lit(1), at.cast("int"))).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(snapped)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


_GUID = r"(?i)\{?([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})\}?"


def _dashed(hit: Column) -> Column:
    plain = F.replace(F.lower(hit), F.lit("-"), F.lit(""))
    return F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def guid(text: Column) -> Column:
    """Lower-case digits of the first GUID, with dashes and braces or without; null without one."""
    hit = F.regexp_extract(text, _GUID, 1)
    return F.when(hit != "", _dashed(hit))


def guids(text: Column) -> Column:
    """All GUIDs of a text, as ``guid`` gives one, each once, in the order of their first places."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_GUID), F.lit(1)), _dashed))


def handle(path: Column, base: str) -> Column:
    """A path below ``base`` as ``@/…``."""
    prefix = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.concat(F.lit("@/"), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))).otherwise(path)


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.greatest(F.length(text), F.lit(1)))))


def citation(name: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), name, F.lit(" @ "), F.element_at(F.split(path, "/"), -1), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("]"))


def fence(text: Column, most: int = 200) -> Column:
    """Untrusted text on one line: control characters as spaces, cut."""
    return F.substring(F.trim(F.regexp_replace(text, r"\p{Cntrl}", " ")), 1, most)


def mentions(text: Column, word: str) -> Column:
    """Whether the word occurs between word boundaries."""
    return text.rlike(r"\b" + re.escape(word) + r"\b")


def line_slice(text: Column, start: int, end: int | None = None) -> Column:
    """Lines from ``start`` (1 is the first) to ``end``, or 40 of them."""
    first = max(1, start)
    last = end if end is not None else first + 39
    return F.array_join(F.slice(F.split(text, "\n"), first, max(0, last - first + 1)), "\n")


# Highlighting names of file endings.
LANGUAGES = {
    ".cs": "csharp", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".md": "markdown",
    ".php": "php", ".json": "json", ".xml": "xml", ".config": "xml", ".yml": "yaml", ".yaml": "yaml", ".graphql": "graphql", ".py": "python",
}


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))), F.lit("text"))


def doc_query(comment: Column, name: Column, least_words: int = 5, most: int = 240) -> Column:
    """A documentation comment as a question: no tags, no entities, no symbol name; null if too short."""
    text = F.regexp_replace(comment, "<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = squeeze(F.replace(text, name, F.lit("")))
    return F.when(F.size(F.split(text, " ")) >= least_words, F.substring(text, 1, most))


def embedding_document(kind: Column, name: Column, signature: Column, summary: Column, body: Column, head: int = 900, tail: int = 600) -> Column:
    """What is embedded for a node: type and name, signature, summary, and the body's head and tail."""
    short = F.when(F.length(body) <= head + tail, body).otherwise(F.concat(F.substring(body, 1, head), F.lit("\n…\n"), F.right(body, F.lit(tail))))
    return F.concat_ws("\n", F.concat_ws(" ", kind, name), F.when(signature != "", signature), F.when(summary != "", summary), short)


#: Tokens of a body that an embedder's window takes.
BODY_TOKENS = 375


def within_tokens(text: Column, most_tokens: int = BODY_TOKENS) -> Column:
    """``trim_middle`` of a column, in Arrow batches; only texts that may be too long are looked at word by word."""

    def trim(texts: pd.Series) -> pd.Series:
        # A text of no more characters than tokens fits whatever it holds.
        return texts.map(lambda t: t if t is None or len(t) <= most_tokens else trim_middle(t, most_tokens))

    return F.pandas_udf(trim, "string")(text)


def embedding_document_by_tokens(kind: Column, name: Column, signature: Column, summary: Column, body: Column, most_tokens: int = BODY_TOKENS) -> Column:
    """What is embedded for a node: type and name, signature, summary, and of the body what fits the tokens."""
    def said(c: Column) -> Column:
        return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)

    return F.concat_ws("\n", F.concat_ws(" ", kind, name), said(signature), said(summary), within_tokens(F.coalesce(body, F.lit("")), most_tokens))


def concept_document(name: Column, summary: Column, names: Column) -> Column:
    """What is embedded for a concept, which has no body: its name, summary, and the names linked to it (an array; blank ones left out)."""
    near = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(F.coalesce(n, F.lit(""))) != "")
    told = F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", summary)
    return F.concat_ws("\n", F.concat(F.lit("Concept "), name), told, F.when(F.size(near) > 0, F.concat(F.lit("Related: "), F.array_join(near, ", "))))


def map_to_json(properties: Column) -> Column:
    """A map as a JSON object; null or empty is {}."""
    return F.coalesce(F.to_json(properties), F.lit("{}"))


def map_from_json(text: Column) -> Column:
    """The map of a JSON object of strings; empty where the text is null or no such object."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(F.coalesce(text, F.lit("{}")), "map<string,string>"), empty)


def lenient_number(value: Column, fallback: float, low: float | None = None, high: float | None = None, whole: bool = False) -> Column:
    """A number given as such or as text, ``fallback`` where it is neither, held between ``low`` and ``high``.

    A whole number's text must be one; a fraction given as a number is cut.
    """
    given = F.trim(value.cast("string"))
    plain = given.rlike(r"^[+-]?\d+(\.0*)?$") if whole else given.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    kind = "bigint" if whole else "double"
    out = F.coalesce(F.when(plain, given.try_cast("double")), F.lit(float(fallback)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return out.cast(kind)


def signature(kind: Column, name: Column, properties: Column) -> Column:
    """A declaration on one line: modifiers, then what kind of thing it is asks for; parts that are blank leave no space."""

    def part(text: Column) -> Column:
        return F.when(F.trim(text) != "", F.trim(text))

    def of(key: str) -> Column:
        return F.coalesce(F.try_element_at(properties, F.lit(key)), F.lit(""))

    call = F.concat(F.coalesce(name, F.lit("")), F.lit("("), F.trim(of("parameters")), F.lit(")"))
    modifiers, returned = part(of("modifiers")), part(of("returnType"))
    return (
        F.when(kind.isin("Method", "Constructor"), F.concat_ws(" ", modifiers, returned, call))
        .when(kind == "Property", F.concat_ws(" ", modifiers, returned, part(name)))
        .otherwise(F.concat_ws(" ", modifiers, part(F.lower(kind)), part(name)))
    )


def location(name: Column, id: Column, path: Column, start_line: Column, summary: Column, base: str = "") -> Column:
    """Where a thing is, on one line: name -> path:line | summary."""
    place = F.coalesce(F.when(path != "", path), id)
    place = handle(place, base) if base else place
    line = F.coalesce(F.concat(F.lit(":"), start_line.cast("string")), F.lit(""))
    told = F.when(summary != "", F.concat(F.lit(" | "), summary)).otherwise("")
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" -> "), place, line, F.coalesce(told, F.lit("")))


# Folders that hold what an evaluation is made of.
META_FOLDERS = ("bench/golden", "tickets", "review")


def under(path: Column, folder: str) -> Column:
    """Whether a path lies in a folder of this name, at the top or further down, whatever the case and the slashes."""
    plain = F.concat(F.lit("/"), F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))))
    return F.contains(plain, F.lit(f"/{folder.lower()}/"))


def is_evaluation_meta(path: Column, indexed: bool = True) -> Column:
    """Files that would leak the questions into an evaluation; with ``indexed`` also notes that stay in the index."""
    hit = F.lit(False)
    for folder in META_FOLDERS:
        hit = hit | under(path, folder)
    return hit | (under(path, "bench") & F.coalesce(F.endswith(F.lower(path), F.lit(".md")), F.lit(False))) if indexed else hit
