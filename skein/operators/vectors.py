"""Vector search and similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.lineage import cut


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """At length 1; a vector of length zero, or none that is finite, stays as it is."""
    n = norm(v)
    bad = (n == 0) | F.isnan(n) | (n == float("inf"))
    return F.when(bad, v).otherwise(F.transform(v, lambda x: (x / n).cast("float")))


def dot(v: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)


def cosine(v: Column, w: Column) -> Column:
    scale = norm(v) * norm(w)
    return F.when(scale == 0, 0.0).otherwise(dot(v, w) / scale)


def nearest(rows: DataFrame, query: list[float], k: int = 10, least: float = 0.0, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """id and score of the ``k`` rows most similar to ``query``; other sizes, NaN and scores of 0 or below ``least`` drop out."""
    size = math.sqrt(sum(x * x for x in query)) or 1.0
    literal = F.array(*(F.lit(x / size) for x in query))
    scored = rows.where(F.size(vector) == len(query)).select(F.col(id_col).alias("id"), dot(F.col(vector), literal).alias("score"))
    return scored.where(~F.isnan("score") & (F.col("score") > 0) & (F.col("score") >= least)).orderBy(F.desc("score"), "id").limit(k)


#: Rows of one block of the similarity join, and rows that stand for the regions that blocks lie in.
BLOCK, PIVOTS = 2048, 256


def similar_pairs(rows: DataFrame, least: float, id_col: str = "id", vector: str = "embedding", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """a < b and score for all pairs with cosine of ``least`` or more.

    Every row belongs to the region of its nearest pivot (some rows, by a hash).  Two regions whose
    pivots are further apart than their radii and the angle of ``least`` together hold no such
    pair, by the triangle inequality, and never meet.  Regions that may are packed into blocks; every pair of
    blocks is one matrix product in one task, of two blocks' memory.  The result is exact; how much is
    passed over depends on how the vectors cluster.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    given = cut(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where(F.col(vector).isNotNull()))
    wanted = max(1, min(pivots, math.ceil(given.count() / block)))
    chosen = [r["v"] for r in given.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()]
    centres = [_unit_rows([v])[0] if len(v) else np.zeros(0) for v in chosen]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            region, angle = np.full(len(pdf), -1), np.full(len(pdf), math.pi)
            lengths = pdf["v"].map(len).to_numpy()
            for n in np.unique(lengths):
                like = [k for k, c in enumerate(centres) if len(c) == n]
                at = np.flatnonzero(lengths == n)
                if like:
                    near = np.clip(_unit_rows(pdf["v"].iloc[at]) @ np.stack([centres[k] for k in like]).T, -1.0, 1.0)
                    best = near.argmax(axis=1)
                    region[at], angle[at] = np.array(like)[best], np.arccos(near[np.arange(len(at)), best])
            yield pdf.assign(region=region, angle=angle)

    if wanted == 1:  # all rows fit one block, which meets itself only
        found = given.select("id", "v", F.lit(0).alias("side")).withColumns({c: F.lit(0) for c in ("i", "j", "left", "right")})
        return found.groupBy("i", "j", "left", "right").applyInPandas(_compare(least), f"a {kind}, b {kind}, score double")
    kept = cut(given.mapInPandas(place, f"id {kind}, v {dict(given.dtypes)['v']}, region long, angle double"), given)
    told = {r["region"]: (r["n"], r["radius"]) for r in kept.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    reach = math.acos(max(-1.0, min(1.0, least))) + 1e-6

    def may_meet(i: int, j: int) -> bool:
        if i == j or -1 in (i, j):
            return True
        if len(centres[i]) != len(centres[j]):
            return False
        apart = math.acos(max(-1.0, min(1.0, float(centres[i] @ centres[j]))))
        return apart <= told[i][1] + told[j][1] + reach

    pairs = [(i, j, math.ceil(told[i][0] / block), math.ceil(told[j][0] / block)) for i in told for j in told if i <= j and may_meet(i, j)]
    meets = F.broadcast(spark.createDataFrame(pairs, "i long, j long, mine long, theirs long"))
    none = F.lit(0).cast("long")

    def dealt(side: int) -> DataFrame:
        own, other = ("i", "j") if side == 0 else ("j", "i")
        count, others = ("mine", "theirs") if side == 0 else ("theirs", "mine")
        placed = kept.join(meets, F.col("region") == F.col(own)).withColumn("own", F.pmod(F.xxhash64("id"), count))
        met = placed.withColumn("other", F.explode(F.sequence(none, F.col(others) - 1)))
        # Within a region a block meets itself and those after it.
        met = met.where((F.col("i") != F.col("j")) | (F.col("own") <= F.col("other") if side == 0 else F.col("other") < F.col("own")))
        ends = ("own", "other") if side == 0 else ("other", "own")
        return met.select("i", "j", F.col(ends[0]).alias("left"), F.col(ends[1]).alias("right"), "id", "v", F.lit(side).alias("side"))

    both = dealt(0).unionByName(dealt(1))
    return both.groupBy("i", "j", "left", "right").applyInPandas(_compare(least), f"a {kind}, b {kind}, score double")


def _compare(least: float):
    """What finds the pairs of two blocks (side 0 and 1), or of one with itself."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, alone = [], key[0] == key[1] and key[2] == key[3]
        for _, same in pdf.groupby(pdf["v"].map(len)):
            a, b = same[same["side"] == 0], same[same["side"] == 1]
            m, n = _unit_rows(a["v"]), _unit_rows(b["v"])
            mine, theirs = a["id"].to_numpy(), b["id"].to_numpy()
            if alone:
                n, theirs = m, mine
            if not len(m) or not len(n):
                continue
            score = m @ n.T
            x, y = np.nonzero(score >= least)
            first, second, s = mine[x], theirs[y], score[x, y]
            if alone:
                up = first < second
                first, second, s = first[up], second[up], s[up]
            swap = first > second
            found.append(pd.DataFrame({"a": np.where(swap, second, first), "b": np.where(swap, first, second), "score": s}))
        empty = pd.Series([], dtype=pdf["id"].dtype)
        return pd.concat(found) if found else pd.DataFrame({"a": empty, "b": empty, "score": pd.Series([], dtype=float)})

    return run


def _unit_rows(vectors: Iterator) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    if not len(m):
        return m
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def surprising_pairs(rows: DataFrame, linked: DataFrame, least: float = 0.85, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Similar pairs that no edge (a, b in either order) links."""
    known = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return similar_pairs(rows, least, id_col, vector).join(known, ["a", "b"], "left_anti")
