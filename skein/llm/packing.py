"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so how many pieces have each
length (at most ``capacity`` numbers, whatever the input) settles the whole
packing.  The plan is made from these counts:

* pieces above a third of the capacity fit at most twice in a bin: from the
  longest on, each is matched with the longest other large piece that still
  fits;
* smaller pieces, from the longest on, go to the bin with the least gap that
  holds them, or open a new bin.

Bins with equal contents are one entry of the plan with a count.  Each piece
then finds its place from its rank among the pieces of its length; the ranks
come from one shuffle of piece sizes without texts, each length being dealt
over CELLS groups.

Defined results: a null or empty text is the end id alone; rows that repeat
(even with their id) are pieces of their own; an empty table gives an empty
result; a document longer than the capacity is cut, every other stays whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut, pieces, small_batches
from skein.llm.tokens import worker_encoder

CAPACITY = 2048
#: Cells of a length at least, and rows of one that are ranked in one task at most, but for chance.
CELLS, CELL_ROWS = 256, 50_000


def _cut_pieces(path: str | None, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in pieces(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, tokens in enumerate(encoder.encode(batch.column(1).to_pylist())):
                tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                for p, a in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[a : a + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part)
            columns = {
                "doc_id": batch.column(0).take(pa.array(row, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def token_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = 0,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return texts.mapInArrow(_cut_pieces(tokenizer, end_id, capacity, with_ids), schema + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, how many of it in each bin)]) covering ``counts``."""
    left = {n: k for n, k in counts.items() if k}
    bins: list[tuple[int, int, list[tuple[int, int]]]] = []  # gap, number, contents
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        long = large[-1]
        n = left[long]
        other = next((m for m in reversed(large) if m + long <= capacity), None)
        if other is None:
            bins.append((capacity - long, n, [(long, 1)]))
            used = {long: n}
        elif other == long and n == 1:
            # its only equal is itself: look for a shorter partner
            other = next((m for m in reversed(large) if m < long), None)
            bins.append((capacity - long - (other or 0), 1, [(long, 1)] + ([(other, 1)] if other else [])))
            used = {long: 1} | ({other: 1} if other else {})
        elif other == long:
            bins.append((capacity - 2 * long, n // 2, [(long, 2)]))
            used = {long: n - n % 2}
        else:
            k = min(n, left[other])
            bins.append((capacity - long - other, k, [(long, 1), (other, 1)]))
            used = {long: k, other: k}
        for m, k in used.items():
            left[m] -= k
        large = [m for m in large if left[m]]
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for gap, number, contents in bins:
        by_gap.setdefault(gap, []).append((number, contents))
    for small in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[small]
        while n:
            gap = min((g for g in by_gap if g >= small), default=None)
            if gap is None:
                each = capacity // small
                number, contents = -(-n // each), []
                gap = capacity
            else:
                number, contents = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                each = gap // small
            full = min(number, n // each)
            if full:
                by_gap.setdefault(gap - each * small, []).append((full, [*contents, (small, each)]))
                n -= full * each
                number -= full
            if number and n and n < each:
                by_gap.setdefault(gap - n * small, []).append((1, [*contents, (small, n)]))
                n, number = 0, number - 1
            if number and contents:
                by_gap.setdefault(gap, []).append((number, contents))
    return [entry for gap in sorted(by_gap) for entry in by_gap[gap]]


def segments(planned: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, how many in each sequence, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for number, contents in planned:
        offset = 0
        for length, each in contents:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, each, offset))
            used[length] = rank + number * each
            offset += length * each
        sequence += number
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def _place(where: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(length), np.zeros_like(length)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                table = where[int(n)]
                first, start, each, begin = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1].T
                step = rank[rows] - first
                sequence[rows] = start + step // each
                offset[rows] = begin + step % each * n
            kept = batch.select(batch.schema.names[:-1])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def place(parts: DataFrame, capacity: int = CAPACITY, cells: int = CELLS) -> DataFrame:
    """``parts`` (doc_id, piece, length and more) with sequence_id and offset.  Read twice: write it down first."""
    totals = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    # The commonest length (whole pieces, as a rule) decides how many cells keep every cell's rows few.
    cells = max(cells, *(-(-r["n"] // CELL_ROWS) for r in totals), 1)
    parts = parts.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    counted = parts.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    where = segments(plan({r["length"]: r["n"] for r in totals}, capacity))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    columns = [c for c in parts.columns if c != "cell"]
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        parts.withColumn("within", F.row_number().over(order) - 1)
        .join(base, ["length", "cell"])
        .select(*columns, (F.col("base") + F.col("within")).alias("rank"))
    )
    kinds = ", ".join(f"{c} {t}" for c, t in ranked.dtypes[:-1])
    return ranked.mapInArrow(_place(where), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(cut(token_pieces(docs, capacity, **options)), capacity)


def write_packed(docs: DataFrame, path: str, capacity: int = CAPACITY, per_file: int = 4096, **options) -> None:
    """The packed sequences as Parquet: sequence_id, ids (the pieces in offset order).

    A sequence has at most ``capacity`` ids, so its group is bounded.
    """
    parts = place(cut(token_pieces(docs, capacity, with_ids=True, **options)), capacity)
    rows = parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids")
    )
    rows.repartition(F.floor(F.col("sequence_id") / per_file)).write.parquet(path)
