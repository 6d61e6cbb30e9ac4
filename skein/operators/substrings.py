"""Substrings by trigrams: which texts contain which needles, and stored postings for patterns.

In a join the needles go to the texts, a bounded number at once, and are sought
together where a text is read: where their first bytes stand, the hashes of as
many bytes as a needle has tell which it may be, and the bytes decide.  Neither
trigrams nor pairs are written down.

A text that contains a needle contains all of its trigrams.  Needles that would
take more than PASSES readings of the texts wait at the one of their trigrams that
fewest texts have, and meet texts with that trigram by a shuffle; a needle with
a trigram that no text has is not compared at all.  Needles of fewer than three
characters, which have no trigram, are sought in all texts.

Stored postings lie in buckets of the trigram.  A pattern's literal runs give
the trigrams that a match must have; texts that have all of them are verified.

All comparisons are of lower-case texts.  Nulls contain nothing; the empty
needle is contained in every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from skein.lineage import MOST_SENT, cut
from skein.operators.store import union_all

GRAM = 3
#: Needles that are sent to the texts at once, and how many times the texts are read for that at most.
SENT, PASSES = 200_000, 16
#: Tasks that the texts of one trigram are dealt to at most, one for so many texts; short needles that are sent at once; buckets of stored postings.
SALTS, ROWS_A_SALT, NEEDLES_SENT, BUCKETS = 16, 100_000, 10_000, 64


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; a shorter one has none."""
    # At every place but the second half of a surrogate pair.
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?![\uDC00-\uDFFF])(?=(...))"), F.lit(1)))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (needle_id, id) of ``needles`` (needle_id, needle) and ``texts`` (id, text) where the text contains the needle, once each.

    Ids of needles may be of any type that can be compared.
    """
    wanted = cut(needles.where("needle is not null").select("needle_id", F.lower("needle").alias("needle")).distinct())
    there = texts.where("text is not null").select("id", F.lower("text").alias("text"))
    long, short = wanted.where(F.length("needle") >= GRAM), cut(wanted.where(F.length("needle") < GRAM))
    passes = -(-long.count() // SENT)
    found = [_sought(some, there) for some in _parts(long, passes)] if passes <= PASSES else [_dealt(long, there)]
    for some in _parts(short, -(-short.count() // NEEDLES_SENT)):
        found.append(there.join(F.broadcast(some), F.contains("text", F.col("needle"))).select("needle_id", "id"))
    if not found:
        return wanted.join(there.select("id").limit(0)).select("needle_id", "id")
    out = union_all(found)
    # A pair can come twice only where an id or a needle's id has several rows.
    return out.distinct() if _repeats(wanted, "needle_id") or _repeats(there, "id") else out


def _dealt(long: DataFrame, there: DataFrame) -> DataFrame:
    """needle_id and id where a needle's rarest trigram and the text's bring them together by a shuffle."""
    met = there.select("id", F.explode(grams(F.col("text"))).alias("gram"))
    asked = long.select("needle", F.explode(grams(F.col("needle"))).alias("gram")).distinct()
    named = cut(asked.select("gram").distinct())
    sent = F.broadcast(named) if named.count() <= MOST_SENT else named
    counts = met.join(sent, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # The needle's rarest trigram; of a needle with one that no text has, none.
    least = asked.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    salts = F.least(F.lit(SALTS), F.ceil(F.col("best.n") / ROWS_A_SALT)).cast("int").alias("salts")
    waiting = cut(long.join(least.where("best.n > 0"), "needle").select("needle_id", "needle", F.col("best.gram").alias("gram"), salts), named)
    places = cut(waiting.select("gram", "salts").distinct())
    dealt = met.join(F.broadcast(places) if places.count() <= MOST_SENT else places, "gram")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts").cast("long")).cast("int")).drop("salts")
    spread = waiting.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    pairs = dealt.join(spread, ["gram", "salt"]).select("needle_id", "needle", "id")
    return pairs.join(there, "id").where(F.contains("text", F.col("needle"))).select("needle_id", "id")


def _sought(some: DataFrame, there: DataFrame) -> DataFrame:
    """needle_id and id where a text contains a needle; equal needles are sought once, the ids come after."""
    spark = some.sparkSession
    once = some.select("needle").distinct().toArrow().column("needle").combine_chunks()  # SENT rows at most
    sent = spark.sparkContext.broadcast(Needles(once.to_pylist()))
    names = spark.createDataFrame(pa.table({"number": pa.array(range(len(once)), pa.int32()), "needle": once}))
    names = some.join(names, "needle").select("number", "needle_id")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, numbers in sent.value.found(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(numbers.astype(np.int32))], ["id", "number"])

    schema = there.select("id").schema.add("number", IntegerType())
    return there.select("id", "text").mapInArrow(seek, schema).join(F.broadcast(names), "number").select("needle_id", "id")


#: Bytes of texts that are gone through at once; bytes of a needle's beginning by which its places are found.
STRETCH, HEAD = 1 << 20, 8
#: An odd number whose powers weigh the bytes of a hash (modulo 2 ** 64), and the number that undoes it; one that spreads beginnings over BITS bits.
STEP = 0x9E3779B97F4A7C15
BACK, SPREAD, BITS = pow(STEP, -1, 1 << 64), 0xD6E8FEB86659FD93, 20


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _words(data: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from each place on as one number; HEAD more bytes than places are there."""
    words = np.ndarray(len(data) - HEAD, dtype="<u8", buffer=data, strides=(1,))
    return words & np.uint64((1 << 8 * width) - 1)


class Needles:
    """Distinct, not empty needles that are sought in texts all at once."""

    def __init__(self, needles: list[str]):
        self.needles = [n.encode() for n in needles]
        self.sizes = sizes = np.array([len(n) for n in self.needles], dtype=np.int64)
        self.most = int(sizes.max(initial=0))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(self.needles), dtype=np.uint8)
        weights = _powers(STEP, self.most)
        place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        hashes = np.add.reduceat(data * weights[place], ends - sizes) if len(data) else np.zeros(0, dtype=np.uint64)
        order = np.lexsort((sizes, hashes))
        self.order, self.hashes = order, hashes[order]
        heads = np.array([int.from_bytes(n[:HEAD], "little") for n in self.needles], dtype=np.uint64)
        self.by_width = []
        for width in np.unique(np.minimum(sizes, HEAD)).tolist():
            # Each beginning, and the lengths of the needles that begin so.
            here = np.minimum(sizes, HEAD) == width
            ways = np.unique(np.rec.fromarrays([heads[here], sizes[here]], names="head,size"))
            known, first = np.unique(ways["head"], return_index=True)
            marked = np.zeros(1 << BITS, dtype=bool)
            marked[self._spread(known)] = True
            self.by_width.append((width, known, np.append(first, len(ways)), ways["size"].astype(np.int64), marked))

    @staticmethod
    def _spread(words: np.ndarray) -> np.ndarray:
        return (words * np.uint64(SPREAD)) >> np.uint64(64 - BITS)

    def found(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``texts`` (no nulls) and numbers of the needles that they contain, each pair once."""
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not self.needles or not len(texts) or bounds[-1] == bounds[0]:
            return
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        row = 0
        while row < len(texts):
            # Whole texts of a stretch; a longer one by itself, stretch by stretch.
            after = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STRETCH, "right")) - 1)
            begin, end = int(bounds[row]), int(bounds[after])
            pairs = [self._in(data[at : min(at + STRETCH + self.most, end)], min(STRETCH, end - at), at, bounds[row : after + 1]) for at in range(begin, end, STRETCH)]
            if pairs:
                together = np.unique(np.concatenate(pairs))
                if len(together):
                    yield row + together // len(self.needles), together % len(self.needles)
            row = after

    def _in(self, data: np.ndarray, places: int, at: int, bounds: np.ndarray) -> np.ndarray:
        """Row times needles plus needle, of those that begin at the first ``places`` bytes of ``data``, which is at ``at`` in the texts that ``bounds`` part."""
        padded = np.append(data, np.zeros(HEAD, dtype=np.uint8))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(data * _powers(STEP, STRETCH + self.most)[: len(data)], out=sums[1:])
        back, raw, out = _powers(BACK, STRETCH), data.tobytes(), [np.zeros(0, dtype=np.int64)]
        for width, known, first, lengths, marked in self.by_width:
            words = _words(padded, width)[:places]
            hit = np.flatnonzero(marked[self._spread(words)])
            which = np.minimum(np.searchsorted(known, words[hit]), len(known) - 1)
            same = known[which] == words[hit]
            hit, which = hit[same], which[same]
            ways = first[which + 1] - first[which]
            # So many hits at once that no more than a stretch of lengths is tried, and one hit's.
            parts = [0, *(np.searchsorted(np.cumsum(ways), np.arange(STRETCH, int(ways.sum()) + STRETCH, STRETCH)) + 1).tolist()]
            for low, high in zip(parts, parts[1:], strict=False):
                out.append(self._those(hit[low:high], first[which[low:high]], ways[low:high], lengths, sums, back, raw, at, bounds))
        return np.concatenate(out)

    def _those(self, hit: np.ndarray, first: np.ndarray, ways: np.ndarray, lengths: np.ndarray, sums: np.ndarray, back: np.ndarray, raw: bytes, at: int, bounds: np.ndarray) -> np.ndarray:
        size = lengths[np.repeat(first - (np.cumsum(ways) - ways), ways) + np.arange(int(ways.sum()))]
        place = np.repeat(hit, ways)
        row = np.searchsorted(bounds, place + at, "right") - 1
        inside = place + at + size <= bounds[row + 1]
        place, size, row = place[inside], size[inside], row[inside]
        told = (sums[place + size] - sums[place]) * back[place]
        low, high = (np.searchsorted(self.hashes, told, side) for side in ("left", "right"))
        # More than one only where hashes of different needles are equal.
        n = high - low
        needle = self.order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        place, row, size = np.repeat(place, n), np.repeat(row, n), np.repeat(size, n)
        same = self.sizes[needle] == size
        place, row, needle = place[same], row[same], needle[same]
        pair, where = np.unique(row * len(self.needles) + needle, return_index=True)
        needles, sure = self.needles, np.zeros(len(pair), dtype=bool)
        for k, (p, x, r) in enumerate(zip(place[where].tolist(), needle[where].tolist(), row[where].tolist(), strict=True)):
            # Where the first place only has the hash, the rest of the text decides.
            sure[k] = raw.startswith(needles[x], p) or raw.find(needles[x], p, int(bounds[r + 1]) - at) >= 0
        return pair[sure]


def _parts(rows: DataFrame, number: int) -> list[DataFrame]:
    """``rows`` (needle_id, needle and more) in so many parts."""
    return [rows.where(F.pmod(F.xxhash64("needle", "needle_id"), F.lit(number)) == k) for k in range(number)]


def _repeats(rows: DataFrame, column: str) -> bool:
    return not rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


# Stored postings ------------------------------------------------------------------


def write_grams(rows: DataFrame, columns: list[str], path: str, id_col: str = "id", buckets: int = BUCKETS) -> None:
    """The trigrams of each of the ``columns`` with the ids that have them, under path/grams by bucket, and the number of buckets."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), grams(F.lower(c)).alias("grams")) for c in columns)))
    posted = rows.select(F.col(id_col).alias("id"), each.alias("e")).select("id", "e.col", F.explode("e.grams").alias("gram"))
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = posted.select("gram", "col", "id", bucket).repartitionByRange("bucket", "gram", "col", "id").sortWithinPartitions("bucket", "gram", "col", "id")
    dealt.write.partitionBy("bucket").parquet(f"{path}/grams")
    rows.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/about")


class Grams:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.buckets = spark.read.parquet(f"{path}/about").first()["buckets"]

    def candidates(self, pattern: str) -> DataFrame | None:
        """id and col of the texts that have all trigrams a match of ``%pattern%`` must have; None if it need not have any."""
        runs = re.split(r"[%_\\]", pattern.lower())
        wanted = sorted({run[k : k + GRAM] for run in runs for k in range(len(run) - GRAM + 1)})
        if not wanted:
            return None
        numbers = self.spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(g)), F.lit(self.buckets)).cast("int") for g in wanted)).first()
        rows = self.spark.read.parquet(f"{self.path}/grams").where(F.col("bucket").isin(*set(numbers)) & F.col("gram").isin(*wanted))
        return rows.groupBy("id", "col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("id", "col")
