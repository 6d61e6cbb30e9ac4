"""A stored vector index: cells around coarse centroids, and short codes of what is left.

A vector (at length 1) lies in the cell of its nearest centroid; the difference
from it is cut into parts, each named by the nearest of 256 words.  A search
goes to the cells nearest to its query, adds up the words' products with the
query from a table of its own, and compares the best of these candidates
exactly.  So it reads codes, not vectors, and those of few cells only.

Centroids and words are fitted to a bounded sample of the rows (by a hash of
their id, ``SAMPLE_NUMBERS`` numbers at most); every row is indexed.  How many
cells a search goes to is measured as the index is written: the least number
that holds ``target`` of the true neighbours of up to ``MEASURED`` rows.

Vectors that are null, of another length than most, not finite, or zero have no
direction and are not indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.lineage import cut, release
from skein.operators.vectors import _unit_rows

#: Numbers (rows times dimensions) that the model is fitted to at most; cells at most; dimensions a code's byte stands for.
SAMPLE_NUMBERS, MOST_CELLS, PART = 1 << 23, 16_384, 4
WORDS, ROUNDS = 256, 10
#: Rows of a block, which one task compares with a block of queries; rows whose true neighbours are measured.
BLOCK, QUERIES, MEASURED = 8_192, 1_024, 500
#: Candidates compared exactly for each row wanted, and at least.
RERANK, LEAST_RERANK = 10, 100


def _nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row (Euclidean), in slices of bounded memory."""
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, (1 << 22) // max(1, len(centres)))
    return np.concatenate([(x[k : k + step] @ centres.T - half).argmax(axis=1) for k in range(0, len(x), step)] or [np.zeros(0, dtype=np.int64)])


def _means(x: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's means of the rows, begun from the first ``count`` distinct ones."""
    centres = np.unique(x, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(count, len(centres))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest_rows(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Model:
    """Centroids (cells x dimensions), and for each part of the dimensions its words."""

    centroids: np.ndarray
    words: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def parts(self) -> list[slice]:
        ends = np.cumsum([0, *(w.shape[1] for w in self.words)])
        return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest_rows(x, self.centroids)
        left = x - self.centroids[cell]
        return cell, np.stack([_nearest_rows(left[:, p], w) for p, w in zip(self.parts(), self.words, strict=True)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """The products of every query with every word: queries x parts x words."""
        out = np.zeros((len(queries), len(self.words), max(len(w) for w in self.words)), dtype=np.float32)
        for k, (p, w) in enumerate(zip(self.parts(), self.words, strict=True)):
            out[:, k, : len(w)] = queries[:, p] @ w.T
        return out


def fit(sample: np.ndarray, cells: int, part: int = PART) -> Model:
    centroids = _means(sample, cells)
    left = sample - centroids[_nearest_rows(sample, centroids)]
    width = sample.shape[1]
    return Model(centroids, [_means(left[:, at : at + part], WORDS) for at in range(0, width, part)])


def _directions(rows: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """id and v (single precision, length 1) of the rows that have a direction, of the commonest length; and that length."""
    v = F.col(vector)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    given = rows.select(F.col(id_col).alias("id"), v.alias("v"), square.alias("square")).where("square > 0 AND square < double('Infinity') AND NOT isnan(square)")
    common = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = common["n"] if common else 0
    scaled = F.transform("v", lambda x: (x / F.sqrt("square")).cast("float"))
    return given.where(F.size("v") == width).select("id", scaled.alias("v")), width


def write_vectors(rows: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", cells: int | None = None, target: float = 0.95, wanted: int = 10) -> None:
    """Index ``rows`` under ``path``: path/cells by cell and block, path/model and path/about."""
    spark = rows.sparkSession
    given, width = _directions(rows, id_col, vector)
    given = cut(given)
    total = given.count()
    most = max(1, SAMPLE_NUMBERS // max(1, width))
    share = min(1.0, 1.1 * most / max(1, total))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    some = given.where(place < share).orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow()
    sample = np.array(some.column("v").to_pylist(), dtype=np.float32).reshape(-1, max(1, width))
    model = fit(sample, cells or min(MOST_CELLS, max(1, math.isqrt(total)))) if total else Model(np.zeros((0, width), np.float32), [])

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code = model.encode(batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1))
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), codes], names=["id", "v", "cell", "code"])

    kind = dict(given.dtypes)["id"]
    coded = cut(given.mapInArrow(place_rows, f"id {kind}, v array<float>, cell int, code binary"), given)
    sizes = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}  # a row a cell
    blocks = F.array(*(F.lit(-(-sizes.get(c, 0) // BLOCK) or 1) for c in range(len(model.centroids)))) if sizes else F.array(F.lit(1))
    block = F.pmod(F.xxhash64("id"), F.element_at(blocks, F.col("cell") + 1).cast("long")).cast("int")
    dealt = coded.withColumn("block", block).repartitionByRange(max(1, min(len(sizes), total // 100_000 + 1)), "cell", "block").sortWithinPartitions("cell", "block", "id")
    dealt.write.partitionBy("cell").parquet(f"{path}/cells")
    words = [[float(x) for x in w.ravel()] for w in model.words]
    spark.createDataFrame([(width, [float(x) for x in model.centroids.ravel()], words)], _MODEL).write.parquet(f"{path}/model")
    release(coded)
    about = [(total, kind, sorted(sizes.items()), 1)]
    spark.createDataFrame(about, _ABOUT).write.parquet(f"{path}/about/0")
    # How far a search has to go, measured on the index itself.
    index = VectorIndex(spark, path)
    probes = index.measure(target, wanted)
    spark.createDataFrame([(*about[0][:3], probes)], _ABOUT).write.parquet(f"{path}/about/1")


_MODEL = "width int, centroids array<float>, words array<array<float>>"
_ABOUT = "rows long, kind string, sizes array<struct<cell: int, n: long>>, probes int"


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        told = spark.read.schema(_MODEL).parquet(f"{path}/model").first()
        width = told["width"]
        centroids = np.array(told["centroids"], dtype=np.float32).reshape(-1, max(1, width))
        parts = [min(PART, width - at) for at in range(0, width, PART)]
        self.model = Model(centroids, [np.array(w, dtype=np.float32).reshape(-1, n) for w, n in zip(told["words"], parts, strict=False)])
        about = spark.read.schema(_ABOUT).option("recursiveFileLookup", "true").parquet(f"{path}/about").orderBy(F.desc("probes")).first()
        self.rows, self.kind, self.probes = about["rows"], about["kind"], about["probes"]
        self.sizes = {r["cell"]: r["n"] for r in about["sizes"]}

    def _cells(self, cells: list[int] | None = None) -> DataFrame:
        schema = f"id {self.kind}, v array<float>, code binary, block int, cell int"
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/cells")
        if cells is None:
            return read.parquet(f"{self.path}/cells")
        there = [f"{self.path}/cells/cell={c}" for c in cells if c in self.sizes]
        return read.parquet(*there) if there else self.spark.createDataFrame([], schema)

    def nearest_cells(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """The cells that a search goes to, nearest first, for each query."""
        near = queries @ self.model.centroids.T - (self.model.centroids**2).sum(axis=1) / 2
        return np.argsort(-near, axis=1, kind="stable")[:, :probes]

    def search(self, query: list[float], k: int = 10, probes: int | None = None, least: float = 0.0) -> DataFrame:
        """id and score (cosine above 0, and ``least`` at least) of about the ``k`` most similar rows."""
        empty = self.spark.createDataFrame([], f"id {self.kind}, score double")
        if not self.rows or len(query) != self.model.width or not np.isfinite(query).all() or not any(query):
            return empty
        q = _unit_rows([query]).astype(np.float32)
        cells = self.nearest_cells(q, probes or self.probes)[0]
        table, base = self.model.tables(q)[0], {int(c): float(q[0] @ self.model.centroids[c]) for c in cells}

        def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                    start = np.array([base[c] for c in batch.column("cell").to_pylist()])
                    about = start + table[np.arange(code.shape[1]), code].sum(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cell"), pa.array(about)], names=["id", "cell", "about"])

        listed = self._cells([int(c) for c in cells]).select("id", "cell", "code").mapInArrow(guess, f"id {self.kind}, cell int, about double")
        best = listed.orderBy(F.desc("about"), "id").limit(max(LEAST_RERANK, RERANK * k)).select("id", "cell").toArrow()
        if not best.num_rows:
            return empty
        ids, there = best.column("id").to_pylist(), sorted(set(best.column("cell").to_pylist()))
        exact = F.aggregate(F.zip_with("v", F.array(*(F.lit(float(x)) for x in q[0])), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        found = self._cells(there).where(F.col("id").isin(ids)).select("id", exact.alias("score"))
        return found.where((F.col("score") > 0) & (F.col("score") >= least)).orderBy(F.desc("score"), "id").limit(k)

    def search_many(self, queries: DataFrame, k: int = 10, probes: int | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
        """query, id, score and rank of about the ``k`` most similar rows of every query.

        Queries meet the blocks of their cells; a block of queries and one of
        rows are compared by one task, so neither a large cell nor one that many
        queries go to gathers in a task.
        """
        schema = f"query {dict(queries.dtypes)[id_col]}, id {self.kind}, score double, rank int"
        if not self.rows:
            return self.spark.createDataFrame([], schema)
        given, width = _directions(queries, id_col, vector)
        if width != self.model.width:
            return self.spark.createDataFrame([], schema)
        model, far, kind = self.model, probes or self.probes, dict(given.dtypes)["id"]
        blocks = {c: -(-n // BLOCK) for c, n in self.sizes.items()}

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                q = np.array(pdf["v"].tolist(), dtype=np.float32).reshape(len(pdf), -1)
                cells = self_cells(q, far)
                n = cells.shape[1]
                out = pd.DataFrame({"query": pdf["id"].repeat(n).to_numpy(), "q": pdf["v"].repeat(n).to_numpy(), "cell": cells.ravel().astype(np.int32)})
                yield out[out["cell"].isin(blocks.keys())]

        self_cells = _Cells(model.centroids)
        sent = cut(given.mapInPandas(go, f"query {kind}, q array<float>, cell int"))
        asked = {r["cell"]: -(-r["count"] // QUERIES) for r in sent.groupBy("cell").count().collect()}  # a row a cell
        sizes = self.spark.createDataFrame([(c, b, asked[c]) for c, b in blocks.items() if c in asked], "cell int, blocks int, groups int")
        none = F.lit(0)
        left = sent.join(F.broadcast(sizes), "cell").withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups").cast("long")).cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(none, F.col("blocks") - 1))).drop("blocks", "groups")
        right = self._cells().join(F.broadcast(sizes), "cell").withColumn("group", F.explode(F.sequence(none, F.col("groups") - 1)))
        keep = max(LEAST_RERANK, RERANK * k)

        def compare(key: tuple, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            if not len(ask) or not len(have):
                return pd.DataFrame({"query": ask["query"][:0], "id": have["id"][:0], "score": []})
            q = np.array(ask["q"].tolist(), dtype=np.float32)
            code = np.frombuffer(b"".join(have["code"]), dtype=np.uint8).reshape(len(have), -1)
            tables, at = model.tables(q), np.arange(code.shape[1])
            x, ids, names, out = np.array(have["v"].tolist(), dtype=np.float32), have["id"].to_numpy(), ask["query"].to_numpy(), []
            for j in range(len(q)):
                about = tables[j][at, code].sum(axis=1)
                some = np.argpartition(-about, keep - 1)[:keep] if len(about) > keep else np.arange(len(about))
                score = x[some].astype(np.float64) @ q[j].astype(np.float64)
                best = np.lexsort((ids[some], -score))[:k]
                out.append(pd.DataFrame({"query": names[j], "id": ids[some][best], "score": score[best]}))
            return pd.concat(out)

        by = ["cell", "block", "group"]
        pairs = left.groupBy(*by).cogroup(right.select(*by, "id", "code", "v").groupBy(*by)).applyInPandas(compare, f"query {kind}, id {self.kind}, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return pairs.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "score", "rank")

    def measure(self, target: float, wanted: int = 10) -> int:
        """The least number of cells that hold ``target`` of the true neighbours of some rows."""
        if not self.rows:
            return 1
        some = self._cells().orderBy(F.xxhash64("id", F.lit(7)), "id").limit(MEASURED).select("id", F.col("v").alias("embedding"))
        some = cut(some)
        true = nearest_many(some, self._cells().select("id", F.col("v").alias("embedding"), "cell"), wanted, ["cell"])
        asked = {r["id"]: r["embedding"] for r in some.collect()}  # MEASURED rows at most
        found = true.collect()  # ``wanted`` rows for each of them
        release(some)
        order = {i: np.argsort(self.nearest_cells(np.array([v], dtype=np.float32), len(self.model.centroids))[0]) for i, v in asked.items()}
        ranks = np.sort([order[r["query"]][r["cell"]] for r in found])
        return int(ranks[max(0, math.ceil(target * len(ranks)) - 1)]) + 1 if len(ranks) else 1

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
        """queries and recall in one row: which share of the exact ``k`` best of the queries, of which there are few, a search finds."""
        named = queries.select(F.col(id_col).alias("id"), F.col(vector).alias("embedding"))
        true = nearest_many(named, self._cells().select("id", F.col("v").alias("embedding")), k)
        found = self.search_many(named, k, probes).select("query", "id", F.lit(1).alias("hit"))
        told = true.join(found, ["query", "id"], "left")
        return told.agg(F.countDistinct("query").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


class _Cells:
    """``VectorIndex.nearest_cells`` for tasks, which have no session."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.half = centroids, (centroids**2).sum(axis=1) / 2

    def __call__(self, queries: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(queries @ self.centroids.T - self.half), axis=1, kind="stable")[:, :probes]


def nearest_many(queries: DataFrame, rows: DataFrame, k: int = 10, more: list[str] | None = None, most: int = 4 * QUERIES) -> DataFrame:
    """query, id, score and the columns ``more`` of the ``k`` most similar ``rows`` (id, embedding) of each of ``most`` queries at most, exactly.

    The queries are held by every task, which keeps its best ``k`` for each.
    """
    more = more or []
    asked = queries.select("id", "embedding").limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} queries: search in several calls")
    names, q = [r["id"] for r in asked], _unit_rows([r["embedding"] for r in asked])
    kinds = dict(rows.dtypes)
    held = pd.Series(names)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or not len(q):
                continue
            score = _unit_rows(pdf["embedding"]) @ q.T
            some = np.argpartition(-score, k - 1, axis=0)[:k] if len(pdf) > k else np.tile(np.arange(len(pdf))[:, None], (1, len(q)))
            at = some.ravel()
            yield pd.DataFrame({"query": np.tile(held.to_numpy(), len(some)), "id": pdf["id"].to_numpy()[at], "score": np.take_along_axis(score, some, 0).ravel(), **{c: pdf[c].to_numpy()[at] for c in more}})

    schema = f"query {dict(queries.dtypes)['id']}, id {kinds['id']}, score double" + "".join(f", {c} {kinds[c]}" for c in more)
    kept: Column = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return rows.select("id", "embedding", *more).mapInPandas(scan, schema).where("score > 0").withColumn("rank", kept).where(F.col("rank") <= k).drop("rank")
