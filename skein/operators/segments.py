"""A search index on disk: segments that are never changed, and manifests that say which of them count.

A segment holds the rows of one refresh in three tables.  Postings lie in ranges
of the term, so that a term or a prefix reads its ranges only; within a range
they are sorted by term and block.  A block is a few hundred rows of like
length; for every term and block there is a bound of what the term can add to a
score there (the most occurrences in one row, the least length), so a search
for the best rows passes over the blocks that cannot reach them.  The third
table has the rows themselves: id, length, terms and a mark of the content.

A refresh writes a segment of the new and changed rows, and for each older
segment the ids that have gone from it with the counts of their terms.  Every
count that a score needs is therefore exact, whatever the number of segments.
When ``FAN`` segments of one size class have come together, they are merged.

A manifest is a small file named by its version.  It is created only if there is
none of that name, so of two writers one fails and has to begin again from the
other's version.  Readers of an older version keep reading what it names.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.lineage import MOST_SENT, cut, release, remove
from skein.operators import fts

#: Rows a block has about; postings a range has about, and how many ranges there are at least and at most.
BLOCK_ROWS, RANGE_POSTINGS, LEAST_RANGES, MOST_RANGES = 256, 1_000_000, 8, 65_536
#: Segments of one size class that are merged; rows of the least class.
FAN, LEAST_CLASS = 8, 1_000
#: Blocks that a search for the best rows begins with, and ranges of blocks that a filter lists.
FIRST_BLOCKS, MOST_SPANS = 32, 32
#: Beyond so many wanted rows a search scores all.
MOST_BEST = 10_000
_SHOWN = 200


class Conflict(RuntimeError):
    """Another writer made this version; open the index again."""


@dataclass(frozen=True)
class Segment:
    """rows and words as written, the least and greatest term of each range, and what has gone since."""

    name: str
    rows: int
    words: int
    ranges: list[list[str]]
    gone: list[str] = field(default_factory=list)
    gone_rows: int = 0
    gone_words: int = 0

    @property
    def live(self) -> int:
        return self.rows - self.gone_rows

    def holding(self, least: str, greatest: str) -> list[int]:
        """The ranges that may hold terms from ``least`` to ``greatest``."""
        return [k for k, (lo, hi) in enumerate(self.ranges) if lo <= greatest and least <= hi]


@dataclass(frozen=True)
class Manifest:
    version: int
    columns: list[str]
    kind: str
    segments: list[Segment]

    @property
    def rows(self) -> int:
        return sum(s.live for s in self.segments)

    @property
    def words(self) -> int:
        return sum(s.words - s.gone_words for s in self.segments)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    where, fs = _folder(spark, f"{path}/manifests")
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(where)) if fs.exists(where) else []


def _commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    where, fs = _folder(spark, f"{path}/manifests/{manifest.version:08d}.json")
    try:
        out = fs.create(where, False)
    except Exception as failed:  # py4j wraps what the file system raises
        if "AlreadyExists" in str(failed) or "already exists" in str(failed):
            raise Conflict(f"version {manifest.version} of {path} exists") from failed
        raise
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()


def _manifest(spark: SparkSession, path: str, version: int) -> Manifest:
    where, fs = _folder(spark, f"{path}/manifests/{version:08d}.json")
    stream = fs.open(where)
    told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return Manifest(told["version"], told["columns"], told["kind"], [Segment(**s) for s in told["segments"]])


# Writing ------------------------------------------------------------------------


def _mark(columns: list[str]) -> Column:
    """A digest of a row's indexed columns."""
    return F.xxhash64(*(F.coalesce(F.col(c), F.lit("\x00")) for c in columns))


def _length_class(length: Column) -> Column:
    return F.floor(F.log2(length + 1) * 4).cast("int")


def _block(classes: dict[int, int], ident: Column, length: Column, block_rows: int) -> Column:
    """The block of a row: those of shorter rows come first; within a class of lengths the id's hash decides."""
    first, at = {}, 0
    for c, n in sorted(classes.items()):
        first[c] = (at, -(-n // block_rows))
        at += first[c][1]
    if not first:
        return F.lit(0)
    every = range(max(first) + 1)
    starts, counts = (F.array(*(F.lit(first.get(c, (0, 1))[k]) for c in every)) for k in (0, 1))
    kind = _length_class(length) + 1
    return (F.element_at(starts, kind) + F.pmod(F.xxhash64(ident), F.element_at(counts, kind).cast("long"))).cast("int")


def _write(spark: SparkSession, path: str, rows: DataFrame, postings_of: Callable[[Column], DataFrame], total: int, block_rows: int, range_postings: int) -> Segment | None:
    """A segment of ``rows`` (id, length, terms, mark) and the postings, about ``total``, that are given for what tells a row's block; None without rows.

    Postings are term, block, id, col, positions, times, first, length.
    """
    name = f"s{uuid.uuid4().hex}"
    told = rows.groupBy(_length_class(F.col("length")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")).collect()
    if not told:
        return None
    block = _block({r["kind"]: r["n"] for r in told}, F.col("id"), F.col("length"), block_rows).alias("block")
    rows.select("*", block).write.parquet(f"{path}/rows/seg={name}")
    postings = postings_of(block)
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-total // range_postings)))
    dealt = postings.repartitionByRange(ranges, "term", "block", "id").withColumn("range", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions("range", "term", "block", "id", "col").select("term", "block", "id", "col", "positions", "times", "first", "length", "range")
    folder = f"{path}/postings/seg={name}"
    dealt.write.partitionBy("range").option("parquet.page.row.count.limit", "2048").parquet(folder)
    back = spark.read.schema(dealt.schema).parquet(folder)
    bounds = back.groupBy("range", "term", "block").agg(F.max("times").alias("most"), F.min("length").alias("least"), F.count_if("first").alias("n"))
    bounds.repartition("range").sortWithinPartitions("range", "term", "block").write.partitionBy("range").parquet(f"{path}/blocks/seg={name}")
    blocks = spark.read.schema(bounds.schema).parquet(f"{path}/blocks/seg={name}")
    shown = {r["range"]: [r["lo"], r["hi"]] for r in blocks.groupBy("range").agg(F.substring(F.min("term"), 1, _SHOWN).alias("lo"), F.substring(F.max("term"), 1, _SHOWN).alias("hi")).collect()}
    # A term is as great as its first letters at least, and no greater than these and the greatest letter.
    empty = ["\U0010ffff", ""]
    limits = [[lo, hi + "\U0010ffff"] if len(hi) >= _SHOWN else [lo, hi] for lo, hi in (shown.get(k, empty) for k in range(ranges))]
    return Segment(name, sum(r["n"] for r in told), sum(r["words"] for r in told), limits)


def _segment_of(path: str, rows: DataFrame, columns: list[str], id_col: str, block_rows: int, range_postings: int) -> tuple[Segment | None, str]:
    spark = rows.sparkSession
    found = cut(fts.analysed(rows, columns, id_col, {"mark": _mark(columns)}))
    terms = F.array_distinct(F.transform("entries", lambda e: e["term"])).alias("terms")

    def postings_of(block: Column) -> DataFrame:
        return found.select("id", "length", block, F.explode("entries").alias("e")).select("e.*", "id", "length", "block")

    total = found.agg(F.sum(F.size("entries"))).first()[0] or 0
    made = _write(spark, path, found.select("id", "length", terms, "mark"), postings_of, total, block_rows, range_postings)
    kind = dict(found.dtypes)["id"]
    release(found)
    return made, kind


def write_index(rows: DataFrame, columns: list[str], path: str, id_col: str = "id", block_rows: int = BLOCK_ROWS, range_postings: int = RANGE_POSTINGS) -> None:
    """The first version of an index of ``rows``, whose ids are unique."""
    made, kind = _segment_of(path, rows, columns, id_col, block_rows, range_postings)
    _commit(rows.sparkSession, path, Manifest(1, columns, kind, [made] if made else []))


# Reading ------------------------------------------------------------------------


class SegmentedIndex(fts.Index):
    """The version of an index that a manifest describes."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.manifest = _manifest(spark, path, versions(spark, path)[-1] if version is None else version)
        rows, words = self.manifest.rows, self.manifest.words
        super().__init__(list(self.manifest.columns), rows, words / rows if rows else 0.0, self.postings, self.counts, self.best_rows)

    def _schema(self, name: str) -> StructType:
        kind = self.manifest.kind
        told = {
            "postings": f"term string, block int, id {kind}, col string, positions array<int>, times int, first boolean, length int, seg string, range int",
            "blocks": "term string, block int, most int, least int, n long, seg string, range int",
            "rows": f"id {kind}, length int, terms array<string>, mark long, block int, seg string",
            "gone": f"id {kind}, seg string, part string",
            "gone_terms": "term string, n long, seg string, part string",
        }[name]
        return StructType.fromDDL(told)

    def _read(self, name: str, folders: Iterable[str]) -> DataFrame:
        schema = self._schema(name)
        there = [f"{self.path}/{name}/{f}" for f in folders]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*there)

    def _ranges(self, segments: Iterable[Segment], terms: list[str], prefixes: list[str]) -> list[str]:
        wanted = [(t, t) for t in terms] + [(p, p + "\U0010ffff") for p in prefixes]
        return [f"seg={s.name}/range={k}" for s in segments for k in sorted({k for w in wanted for k in s.holding(*w)})]

    def _live(self, rows: DataFrame, segments: Iterable[Segment]) -> DataFrame:
        """``rows`` (seg, id) without those that have gone."""
        left = [s for s in segments if s.gone]
        if not left:
            return rows
        dead = self._read("gone", (f"seg={s.name}/part={p}" for s in left for p in s.gone)).select("seg", "id")
        return rows.join(F.broadcast(dead) if sum(s.gone_rows for s in left) <= MOST_SENT else dead, ["seg", "id"], "left_anti")

    def _postings(self, segments: list[Segment], terms: list[str], prefixes: list[str]) -> DataFrame:
        return self._read("postings", self._ranges(segments, terms, prefixes))

    def postings(self, terms: list[str], prefixes: list[str]) -> DataFrame:
        return self._live(self._postings(self.manifest.segments, terms, prefixes), self.manifest.segments)

    def lengths(self) -> DataFrame:
        """id and length of every row."""
        segments = self.manifest.segments
        return self._live(self._read("rows", (f"seg={s.name}" for s in segments)), segments).select("id", "length")

    def _bounds(self, terms: list[str]) -> DataFrame:
        return self._read("blocks", self._ranges(self.manifest.segments, terms, [])).where(F.col("term").isin(*set(terms)))

    def counts(self, terms: list[str]) -> dict[str, int]:
        """How many rows hold each term, from the blocks, less those that have gone."""
        if not terms:
            return {}
        found = self._bounds(terms).groupBy("term").agg(F.sum("n").alias("n"))
        left = [f"seg={s.name}/part={p}" for s in self.manifest.segments for p in s.gone]
        if left:
            dead = self._read("gone_terms", left).where(F.col("term").isin(*set(terms))).groupBy("term").agg((-F.sum("n")).alias("n"))
            found = found.unionByName(dead).groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in found.collect()}  # one row a term of the query

    # The best rows --------------------------------------------------------------

    def best_rows(self, query: fts.Query, most: int) -> DataFrame | None:
        """The ``most`` best rows at least, and no wrong ones; None where only scoring all rows can tell.

        Rows in the blocks of the highest bounds are scored first; their
        ``most``-th score is what the bound of another block must reach for its
        rows to be scored, too.
        """
        terms = fts.plain_terms(query)
        if terms is None or not self.rows or any(not p.terms for p in query.phrases) or most > MOST_BEST:
            return None
        having = self.counts(terms)
        weights = [fts.weight_of(self.rows, having.get(t, 0)) for t in terms]
        bounds = self._block_bounds(query, terms, weights)
        first = bounds.orderBy(F.desc("bound")).limit(FIRST_BLOCKS).collect()
        if not first:
            return self.spark.createDataFrame([], f"id {self.manifest.kind}, score double")
        found = self._scored_blocks(query, terms, weights, [(r["seg"], r["block"]) for r in first])
        top = found.orderBy(F.desc("score"), "id").limit(most).toArrow()
        least = top.column("score")[most - 1].as_py() if top.num_rows >= most else -math.inf
        done = self.spark.createDataFrame(top)
        if len(first) < FIRST_BLOCKS or first[-1]["bound"] * (1 + 1e-9) < least:
            return done  # there are no more blocks, or none that reaches it
        seen = F.broadcast(self.spark.createDataFrame([(r["seg"], r["block"]) for r in first], "seg string, block int"))
        rest = bounds.where(F.col("bound") * (1 + 1e-9) >= least).join(seen, ["seg", "block"], "left_anti").select("seg", "block")
        spans = rest.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi")).collect()  # a row a segment
        if not spans:
            return done
        named = {s.name: s for s in self.manifest.segments}
        rest = F.broadcast(rest) if sum(r["n"] for r in spans) <= MOST_SENT else rest
        parts = [self._postings([named[r["seg"]]], terms, []).where(F.col("block").between(r["lo"], r["hi"])) for r in spans]
        chosen = self._live(_union(parts).where(F.col("term").isin(*set(terms))).join(rest, ["seg", "block"], "left_semi"), self.manifest.segments)
        return done.unionByName(fts.scored(chosen, query, weights, self.mean))

    def _block_bounds(self, query: fts.Query, terms: list[str], weights: list[float]) -> DataFrame:
        """seg, block and bound of the blocks whose rows may match."""
        def at(t: str, c: str) -> Column:
            return F.max(F.when(F.col("term") == t, F.col(c)))

        blocks = self._bounds(terms).groupBy("seg", "block").agg(*(at(t, c).alias(f"{c}{k}") for k, t in enumerate(terms) for c in ("most", "least")))
        bound = F.lit(0.0)
        for k, w in enumerate(weights):
            bound = bound + F.coalesce(F.lit(w) * fts.gain(F.col(f"most{k}").cast("double"), F.col(f"least{k}"), self.mean), F.lit(0.0))

        def possible(tree: tuple) -> Column:
            if tree[0] == "phrase":
                return F.col(f"most{tree[1]}").isNotNull()
            if tree[0] == "near":
                return F.lit(True)
            if tree[0] == "not":  # a block that holds the term may have rows without it
                return possible(tree[1])
            left, right = possible(tree[1]), possible(tree[2])
            return left & right if tree[0] == "and" else left | right

        return blocks.where(possible(query.tree)).select("seg", "block", bound.alias("bound"))

    def _scored_blocks(self, query: fts.Query, terms: list[str], weights: list[float], blocks: list[tuple[str, int]]) -> DataFrame:
        """id and score of the matching rows in a few blocks, whose postings are picked by literal blocks."""
        parts = []
        for s in self.manifest.segments:
            if mine := sorted(b for name, b in blocks if name == s.name):
                parts.append(self._postings([s], terms, []).where(F.col("term").isin(*set(terms)) & _in_spans(mine)))
        return fts.scored(self._live(_union(parts), self.manifest.segments), query, weights, self.mean)


def _in_spans(blocks: list[int]) -> Column:
    """Whether the block is one of ``blocks`` (sorted), said in runs of neighbours."""
    runs: list[list[int]] = []
    for b in blocks:
        if runs and b == runs[-1][1] + 1:
            runs[-1][1] = b
        else:
            runs.append([b, b])
    out = F.lit(False)
    for lo, hi in runs[:MOST_SPANS]:
        out = out | F.col("block").between(lo, hi)
    return out if len(runs) <= MOST_SPANS else out | F.col("block").isin(*(b for lo, hi in runs[MOST_SPANS:] for b in range(lo, hi + 1)))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def open_index(spark: SparkSession, path: str, version: int | None = None) -> SegmentedIndex:
    """The latest version of an index, or a given one."""
    return SegmentedIndex(spark, path, version)


# Refreshing ---------------------------------------------------------------------


def refresh(index: SegmentedIndex, gone: DataFrame | None, rows: DataFrame | None, id_col: str = "id", block_rows: int = BLOCK_ROWS, range_postings: int = RANGE_POSTINGS) -> SegmentedIndex:
    """The next version: without the ids in ``gone`` (id), with ``rows``, which replace those of their ids.

    Writes in proportion to what comes and goes; raises Conflict if there is a next version already.
    """
    spark, old, path = index.spark, index.manifest, index.path
    left = [x for x in (gone.select("id") if gone is not None else None, rows.select(F.col(id_col).alias("id")) if rows is not None else None) if x is not None]
    segments = _without(index, _union(left).distinct()) if left else old.segments
    made = _segment_of(path, rows, list(old.columns), id_col, block_rows, range_postings)[0] if rows is not None else None
    segments = [s for s in segments if s.live] + ([made] if made else [])
    _commit(spark, path, Manifest(old.version + 1, old.columns, old.kind, segments))
    return merged(open_index(spark, path, old.version + 1), block_rows, range_postings)


def _without(index: SegmentedIndex, ids: DataFrame) -> list[Segment]:
    """The segments, with what has gone from each written down."""
    segments, part = index.manifest.segments, f"p{uuid.uuid4().hex}"
    ids = cut(ids)
    few = F.broadcast(ids) if ids.count() <= MOST_SENT else ids
    dead = cut(index._live(index._read("rows", (f"seg={s.name}" for s in segments)).join(few, "id", "left_semi"), segments).select("seg", "id", "length", "terms"))
    told = {r["seg"]: r for r in dead.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")).collect()}
    if told:
        label = F.lit(part).alias("part")
        dead.select("id", "seg", label).write.partitionBy("seg", "part").mode("append").parquet(f"{index.path}/gone")
        counts = dead.select("seg", F.explode("terms").alias("term")).groupBy("seg", "term").agg(F.count(F.lit(1)).alias("n"))
        # A segment whose rows have no words has no such counts.
        none = index.spark.createDataFrame([(s, "", 0) for s in told], "seg string, term string, n long")
        counts.unionByName(none).select("term", "n", "seg", label).write.partitionBy("seg", "part").mode("append").parquet(f"{index.path}/gone_terms")
    release(ids, dead)
    return [
        replace(s, gone=[*s.gone, part], gone_rows=s.gone_rows + told[s.name]["n"], gone_words=s.gone_words + told[s.name]["words"]) if s.name in told else s
        for s in segments
    ]


def _size_class(rows: int) -> int:
    return max(0, math.floor(math.log(max(1, rows) / LEAST_CLASS, FAN)))


def merged(index: SegmentedIndex, block_rows: int = BLOCK_ROWS, range_postings: int = RANGE_POSTINGS) -> SegmentedIndex:
    """The index with every ``FAN`` segments of one size class in one, as a next version if there are any.

    A row is written once for each class that it passes, so the logarithm of all rows at most.
    """
    classes: dict[int, list[Segment]] = {}
    for s in index.manifest.segments:
        classes.setdefault(_size_class(s.live), []).append(s)
    due = next((group for _, group in sorted(classes.items()) if len(group) >= FAN), None)
    if due is None:
        return index
    old, names = index.manifest, {s.name for s in due}
    rows = index._live(index._read("rows", (f"seg={s.name}" for s in due)), due).select("id", "length", "terms", "mark")
    every = index._read("postings", (f"seg={s.name}/range={k}" for s in due for k, (lo, hi) in enumerate(s.ranges) if lo <= hi))
    postings = index._live(every, due).select("term", "id", "col", "positions", "times", "first", "length")
    made = _write(index.spark, index.path, rows, lambda block: postings.select("*", block), every.count(), block_rows, range_postings)
    segments = [s for s in old.segments if s.name not in names] + ([made] if made else [])
    _commit(index.spark, index.path, Manifest(old.version + 1, old.columns, old.kind, segments))
    return merged(open_index(index.spark, index.path, old.version + 1), block_rows, range_postings)


@dataclass(frozen=True)
class Drift:
    """Rows of the table and of the index, and how many differ: new, changed, gone."""

    table_rows: int
    index_rows: int
    fresh: int = 0
    changed: int = 0
    gone: int = 0

    @property
    def in_step(self) -> bool:
        return self.table_rows == self.index_rows and not (self.fresh or self.changed or self.gone)


def _compared(index: SegmentedIndex, rows: DataFrame, id_col: str) -> DataFrame:
    """id and what became of it, for ids whose content differs between the index and ``rows``."""
    segments = index.manifest.segments
    kept = index._live(index._read("rows", (f"seg={s.name}" for s in segments)), segments).select("id", F.col("mark").alias("was"))
    now = rows.select(F.col(id_col).alias("id"), _mark(index.columns).alias("mark"))
    state = F.when(F.col("was").isNull(), "fresh").when(F.col("mark").isNull(), "gone").when(F.col("was") != F.col("mark"), "changed")
    return now.join(kept, "id", "full_outer").select("id", state.alias("state")).where("state is not null")


def drift(index: SegmentedIndex, rows: DataFrame, id_col: str = "id", content: bool = False) -> Drift:
    """How far the index is from ``rows``: by their number, or by ids and marks of their ``content``."""
    n = rows.count()
    if not content:
        return Drift(n, index.rows)
    told = {r["state"]: r["count"] for r in _compared(index, rows, id_col).groupBy("state").count().collect()}
    return Drift(n, index.rows, told.get("fresh", 0), told.get("changed", 0), told.get("gone", 0))


def catch_up(index: SegmentedIndex, rows: DataFrame, id_col: str = "id", **options) -> SegmentedIndex:
    """The index brought in step with ``rows``: only what differs is analysed and written."""
    differing = cut(_compared(index, rows, id_col))
    if differing.isEmpty():
        return index
    gone = differing.where("state = 'gone'").select("id")
    coming = differing.where("state <> 'gone'").select(F.col("id").alias(id_col))
    found = refresh(index, gone, rows.join(coming, id_col, "left_semi"), id_col, **options)
    release(differing)
    return found


def forget(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove the manifests but the last ``keep``, and every segment and part that none of these names."""
    known = versions(spark, path)
    kept = [_manifest(spark, path, v) for v in known[-keep:]]
    segments = {f"seg={s.name}" for m in kept for s in m.segments}
    parts = {f"part={p}" for m in kept for s in m.segments for p in s.gone}
    for name in ("postings", "blocks", "rows", "gone", "gone_terms"):
        where, fs = _folder(spark, f"{path}/{name}")
        for status in fs.listStatus(where) if fs.exists(where) else ():
            seg = status.getPath().getName()
            if seg.startswith("seg=") and seg not in segments:
                remove(spark, f"{path}/{name}/{seg}")
            elif seg.startswith("seg=") and name.startswith("gone"):
                for inner in fs.listStatus(status.getPath()):
                    if inner.getPath().getName() not in parts:
                        remove(spark, f"{path}/{name}/{seg}/{inner.getPath().getName()}")
    for v in known[:-keep]:
        remove(spark, f"{path}/manifests/{v:08d}.json")
