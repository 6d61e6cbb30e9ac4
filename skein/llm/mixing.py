"""Mixing sources to target weights.

1. Sizes are added up per source (a partial sum in every task, so a source that
   holds a third of all rows costs no more than another).
2. Every source has a weight; together they share out the words of all rows.  A
   target stops at ``most`` times what its source has, and what is left over is
   shared out again by weight among the others until no target is above.
3. A source's rate is its target over its size.  A document is taken floor(rate)
   times, and once more if its draw, a number in [0, 1) from the hash of its id,
   lies below the rate's fraction.  Draws are independent of the order of rows,
   of partitions and of the other documents, so reruns agree.

The table of sources stays distributed: ranks come from ranges of the sorted
sources, targets from rounds of one aggregate each.  It is sent to the rows
where it is counted to be small, else they meet by (source, salt).

Defined results: a null text has size 0 and is taken with its source's rate all
the same; null is a source of its own, the last one; a source without words has
target 0 and none of its rows are taken; rows that repeat an id share its draw;
a row without an id draws by its text; an empty table gives an empty result.
Other columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import MOST_SENT, cut

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SALTS = 16
SEED = "mix"
_DRAW_DIGITS = 13


def words(text: str = "text") -> Column:
    """Number of words (runs of other than the six ASCII white space characters); null has none."""
    marks = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the SHA-256 of ``seed:key``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, _DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / float(16**_DRAW_DIGITS)


def weigh(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``sources`` (one row each, null too) with a weight: the given ones in turn, by code point of the source, null last."""
    ranges = sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source")
    ranges = cut(ranges.withColumn("range", F.spark_partition_id()))
    counts = sorted((r["range"], r["count"]) for r in ranges.groupBy("range").count().collect())  # one row a range
    before = dict(zip((r for r, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    first = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.lit(None).cast("map<int,int>")
    inside = F.row_number().over(Window.partitionBy("range").orderBy("last", "source")) - 1
    place = F.pmod(F.element_at(first, F.col("range")) + inside, F.lit(len(weights)))
    turn = F.array(*(F.lit(w).cast("long") for w in weights))
    return ranges.withColumn("weight", F.element_at(turn, place.cast("int") + 1)).drop("range", "last")


def targets(sources: DataFrame, most: int = MOST_TIMES) -> DataFrame:
    """``sources`` (source, source_size, weight: positive) with target and rate."""
    cap = F.col("source_size") * most
    total, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return sources.withColumns({"target": F.lit(0.0), "rate": F.lit(0.0)})
    level, capped = total / free, 0
    while True:  # each round caps at least one source more, or is the last
        above = F.col("weight") * F.lit(level) > cap
        now, filled, free = sources.agg(
            F.count_if(above), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        if now == capped:
            break
        capped, level = now, (total - filled) / free
    target = F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return sources.withColumns({"target": target, "rate": rate})


def _drawn(id_col: str, text_col: str) -> Column:
    """The draw of a row: by its id, or by its text where it has none."""
    text = F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return draw(F.when(F.col(id_col).isNull(), text).otherwise(F.col(id_col).cast("string")))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"), _drawn(id_col, text_col).alias("draw"))


def _plan(sized: DataFrame, weights: Sequence[int] | DataFrame, most: int) -> DataFrame:
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        named = weights.select(F.col("source").alias("named"), F.col("weight").cast("long").alias("weight"))
        sources = cut(sources.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named").where("weight > 0"))
    else:
        sources = cut(weigh(sources, weights))
    return cut(targets(sources, most))


def _with_plan(rows: DataFrame, plan: DataFrame, source: Column, salted: Column) -> DataFrame:
    """``rows`` with their source's columns of ``plan``, whose source is named plan_source."""
    if plan.count() <= MOST_SENT:
        return rows.join(F.broadcast(plan), source.eqNullSafe(plan["plan_source"]))
    spread = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, source.eqNullSafe(spread["plan_source"]) & (F.pmod(F.xxhash64(salted), F.lit(SALTS)) == spread["plan_salt"])).drop("plan_salt")


def _copies(drawn: Column) -> Column:
    whole = F.floor("rate")
    return (whole + F.when(drawn < F.col("rate") - whole, 1).otherwise(0)).cast("int")


def mix_counts(
    docs: DataFrame,
    weights: Sequence[int] | DataFrame = WEIGHTS,
    most: int = MOST_TIMES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, rate (of its source), copies.

    ``weights`` are dealt to the sources in turn, or are a table (source,
    weight) with one row a source; sources that it lacks are left out.
    """
    sized = cut(_sized(docs, id_col, text_col, source_col))
    plan = _plan(sized, weights, most).withColumnRenamed("source", "plan_source")
    met = _with_plan(sized, plan, sized["source"], sized["draw"])
    return met.select("doc_id", "source", "size", "source_size", "target", "rate", _copies(F.col("draw")).alias("copies"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] | DataFrame = WEIGHTS,
    most: int = MOST_TIMES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    plan = _plan(cut(_sized(docs, id_col, text_col, source_col)), weights, most)
    plan = plan.select(F.col("source").alias("plan_source"), "rate")
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"),
        F.col(source_col).alias("source"),
        _drawn(id_col, text_col).alias("draw"),
    )
    met = _with_plan(packed, plan, packed["source"], packed["draw"])
    copies = _copies(F.col("draw"))
    return met.where(copies > 0).select("whole", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).select("whole.*")


ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sums),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
-- Sources in the order in which they reach their cap as the level rises.
ordered AS (
  SELECT *, row_number() OVER w AS k, coalesce(sum(3 * source_size) OVER before, 0) AS filled, sum(weight) OVER rest AS free
  FROM weighed
  WINDOW w AS (ORDER BY source_size / weight, place),
         before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT arg_min((total - filled) / free, k) AS level
  FROM ordered, (SELECT sum(source_size) AS total FROM sums)
  WHERE weight * ((total - filled) / free) <= 3 * source_size),
plan AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(CAST(weight * level AS DOUBLE), CAST(3 * source_size AS DOUBLE)) END AS target FROM weighed, level),
rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate,
         CAST(concat('0x', substr(sha256(concat('mix:', CAST(doc_id AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS draw
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
