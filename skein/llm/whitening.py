"""Whitening of embeddings: principal components by MLlib, each with variance 1.

1. Vectors become integers (``floor(scale * entry) + offset``), so sums are exact.
2. Per dimension, sums over all rows; a row is centred as (n * x - sum) / n, an
   exact integer divided once, whatever the offset.
3. MLlib's computeSVD on the centred rows: the right singular vectors are the
   components, the squared singular values over n their variances.
4. The total variance does not come from the singular values, of which only some
   are asked for, but from the exact squared deviations of all rows.
5. Rows are projected in Arrow batches and written; the covariance of what was
   written is measured once more by MLlib.

Only numbers per dimension and pairs of dimensions (the Gramian, which tasks add
up in a tree) reach the driver, whatever the number of rows.  Up to
``LAPACK_DIMENSIONS`` more components are asked for than are returned, where
that makes MLlib decompose the Gramian in full precision; beyond, it iterates.

Defined results: rows whose vector is null, or holds null or non-finite entries,
are left out; of vectors of different lengths only those of the commonest length
are kept (of equally common ones the longer); rows that repeat count as often as
they occur; a row without an id has rows with a null vec_id; components whose
variance is below ``LEAST_SHARE`` of the largest one's (constant or dependent
dimensions) are not returned, so equal rows, or a single one, give an empty
result, as does an empty table; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, pieces, release

SCALE, OFFSET = 64, 1_000_000
MOST_COMPONENTS = 32
LEAST_SHARE = 1e-12
LAPACK_DIMENSIONS = 2048
#: Rows of this many numbers are projected at once.
BATCH_NUMBERS = 1 << 20


@dataclass
class Whitening:
    """n rows, their sums per dimension, components (dimensions x count), their variances and the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float


def integers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + offset)


def finite(vector: Column) -> Column:
    """Whether there is a vector and all its entries are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def fit_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x of the rows that count, written down."""
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    sizes = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = sizes["size"] if sizes else 0
    return cut(kept.where(F.size("v") == width).select("vec_id", integers(F.col("v"), scale, offset).alias("x")))


def _matrix(rows: DataFrame) -> RowMatrix:
    """The only column of ``rows``, an array of doubles, as a distributed matrix; nothing passes through Python."""
    (name,) = rows.columns
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(name)).alias("row")), "row"))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, in 64 bits where that is certain to hold them, else in Python's integers."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if n * largest + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(d: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    most = int(np.abs(d).max(initial=0))
    if d.dtype == object or most * most * d.shape[1] >= 1 << 63:
        return [sum(int(v) * int(v) for v in row) for row in d]
    return (d * d).sum(axis=1).tolist()


def _rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def total_deviation(rows: DataFrame, n: int, sums: list[int]) -> int:
    """The sum over rows and dimensions of (n * x - sum) ** 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = sum(_squares(_deviations(_rows_of(batch, "x"), n, sums)))
                # Limbs of 30 bits, so that sums of longs stay exact.
                limbs = [(whole >> (30 * k)) & ((1 << 30) - 1) for k in range(8)]
                yield pa.RecordBatch.from_pydict({"limb": pa.array(range(8), pa.int32()), "s": pa.array(limbs, pa.int64())})

    added = rows.select("x").mapInArrow(run, "limb int, s long").groupBy("limb").agg(F.sum("s").alias("s")).collect()
    return sum(r["s"] << (30 * r["limb"]) for r in added)


def fit(rows: DataFrame, most: int = MOST_COMPONENTS, least_share: float = LEAST_SHARE) -> Whitening:
    """Of ``rows`` (x: integers, all of one length)."""
    added = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count("v").alias("n")).orderBy("at").collect()
    if not added:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    n, sums = added[0]["n"], [r["s"] for r in added]
    total = total_deviation(rows, n, sums)
    if not total:
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    width = len(sums)
    centred = F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in sums)), lambda x, s: (x * n - s) / float(n))
    asked = min(width, max(most, width // 2 + 1 if width <= LAPACK_DIMENSIONS else 0))
    svd = _matrix(rows.select(centred.alias("row"))).computeSVD(asked, rCond=float(np.sqrt(least_share)))
    variances = np.array(svd.s.toArray()) ** 2 / n
    components = svd.V.toArray()
    kept = np.argsort(-variances, kind="stable")[:most]
    components, variances = components[:, kept], variances[kept]
    # One of the two signs: the entry that is largest in size is positive.
    largest = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    return Whitening(n, sums, components * np.where(largest < 0, -1.0, 1.0), variances, float(Fraction(total, n**3)))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (an array, one entry a component) of ``rows`` (vec_id, x), written down."""
    weights = model.components / np.sqrt(model.variances)
    n, sums = model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, max(1, BATCH_NUMBERS // max(1, len(sums)))):
            d = _deviations(_rows_of(batch, "x"), n, sums)
            squares = [s if s < 1 << 63 else None for s in _squares(d)]
            whitened = (d.astype(np.float64) / n) @ weights
            ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * weights.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(squares, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return cut(rows.select("vec_id", "x").mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, deviation long, whitened array<double>"))


def identity_error(whitened: DataFrame) -> float | None:
    """The largest entry of the covariance (centred, divisor n) of the arrays ``whitened`` minus the identity, in size; null without rows."""
    rows = whitened.select("whitened")
    means, n = rows.select(array_to_vector("whitened").alias("v")).agg(Summarizer.mean(F.col("v")), F.count(F.lit(1))).first()
    if not n:
        return None
    centred = F.zip_with("whitened", F.array(*(F.lit(float(m)) for m in means)), lambda w, m: w - m)
    covariance = _matrix(rows.select(centred.alias("row"))).computeGramianMatrix().toArray() / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened_rows(
    vectors: DataFrame,
    most: int = MOST_COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """One row per kept row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = fit_rows(vectors, id_col, vector_col, scale, offset)
    model = fit(rows, most)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(model.variances):
        return spark.createDataFrame([], schema)
    done = whiten(rows, model)
    release(rows)
    error = identity_error(done)
    explained = F.array(*(F.lit(float(e / model.total)) for e in model.variances))
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
