"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of WINDOW consecutive words of a benchmark text (a
shorter text is one pattern of its own length).  Patterns of one length share
a search table:

* the shift table maps each block of BLOCK words inside some pattern to its
  least distance from a pattern's end; a block in no pattern lets the search
  jump by the whole length less the block;
* patterns that end in a block (shift 0) wait in that block's bucket under
  their last words;
* each candidate is compared word by word.

The patterns travel to the tasks in blocks of at most PATTERN_WORDS words, so
what a task holds does not grow with the benchmark; each block is one pass over
the documents that widens the hits of the passes before it.

Defined results: a null text has no words and no hits; an empty benchmark hits
nothing; texts that repeat, in either table, are answered for each row; items
with a null id count under the empty name.  Only the id and text columns are
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, pieces, small_batches

WINDOW = 10
BLOCK = 3
PATTERN_WORDS = 100_000
#: Passes that run within one another before the rows are written down.
PASSES = 4

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class WuManber:
    """Search table for patterns (tuples of words) that all have one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int, block: int = BLOCK):
        self.length, self.block = length, min(block, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        #: By the last words of a pattern, then by its first.
        self.bucket: dict[tuple[bytes, ...], dict[bytes, list[tuple[tuple[bytes, ...], list[int]]]]] = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket.setdefault(pattern[length - self.block :], {}).setdefault(pattern[0], []).append((pattern, owners))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, owners) of every occurrence."""
        at, n, size, shift, jump = self.length, len(text), self.block, self.shift, self.jump
        get = shift.get
        while at <= n:
            key = tuple(text[at - size : at])
            step = get(key, jump)
            if step:
                at += step
                continue
            for pattern, owners in self.bucket[key].get(text[at - self.length], ()):
                if all(a == b for a, b in zip(pattern, text[at - self.length : at], strict=True)):
                    yield at - self.length, owners
            at += 1


def patterns_of(item_words: list[list[bytes]], window: int = WINDOW) -> dict[int, dict[tuple[bytes, ...], list[int]]]:
    """Patterns by length, each with the numbers of the items that have it."""
    out: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for owner, w in enumerate(item_words):
        size = min(window, len(w))
        for start in range(len(w) - size + 1 if w else 0):
            owners = out.setdefault(size, {}).setdefault(tuple(w[start : start + size]), [])
            if not owners or owners[-1] != owner:
                owners.append(owner)
    return out


def _search(tables: list[WuManber], names: list[str], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts, starts, ends, items = [], [], [], []
            before = batch.select(["starts", "ends", "items"]).to_pylist()
            for text, old in zip(batch.column(1).to_pylist(), before, strict=True):
                w = words(text)
                counts.append(len(w))
                spans = list(zip(old["starts"] or (), old["ends"] or (), strict=True))
                owners = set(old["items"] or ())
                for table in tables:
                    for start, who in table.find(w):
                        spans.append((start, start + table.length))
                        owners.update(names[o] for o in who)
                spans = merge(spans)
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                items.append(sorted(owners))
            text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    text,
                    pa.array(counts, pa.int64()),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc_id", "text", "n_words", "starts", "ends", "items"],
            )

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, most_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's (name, words), partition by partition, in bounded blocks."""
    block, size = [], 0
    chosen = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in chosen.toLocalIterator():
        w = words(row["t"])
        if not w:
            continue
        if block and size + len(w) > most_words:
            yield block
            block, size = [], 0
        block.append((row["i"] or "", w))
        size += len(w)
    yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_words: int = PATTERN_WORDS,
) -> DataFrame:
    """Per document: doc_id, n_words, starts and ends (hit word spans), items (names as strings, sorted)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string, n_words long, starts array<int>, ends array<int>, items array<string>"
    none = F.lit(None)
    rows = rows.withColumns(
        {"n_words": none.cast("long"), "starts": none.cast("array<int>"), "ends": none.cast("array<int>"), "items": none.cast("array<string>")}
    )
    # Two blocks of the benchmark are held at a time.
    blocks = benchmark_blocks(benchmark, item_id, item_text, most_words)
    block, k = next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        tables = [WuManber(p, n) for n, p in sorted(patterns_of([w for _, w in block], window).items())]
        rows = rows.mapInArrow(_search(tables, [n for n, _ in block], after is None), schema)
        if k % PASSES == PASSES - 1 and after is not None:
            rows = cut(rows)
        block, k = after, k + 1
    return rows.drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no pattern occurs."""
    small_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns
    for k, block in enumerate(benchmark_blocks(benchmark.select(F.lit("").alias("i"), F.col(item_text).alias("t")), "i", "t", PATTERN_WORDS), 1):
        tables = [WuManber(p, n) for n, p in sorted(patterns_of([w for _, w in block], window).items())]

        def run(batches: Iterator[pa.RecordBatch], tables: list[WuManber] = tables) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                texts = [words(t) for t in batch.column(at).to_pylist()]
                clean = [all(next(table.find(w), None) is None for table in tables) for w in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if k % PASSES == 0:
            docs = cut(docs)
    return docs.select(names)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    found = find_contamination(docs, benchmark, **options)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )

