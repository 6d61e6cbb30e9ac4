"""Exact deduplication with skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after each run of the six ASCII white
space characters becomes one space.  The combine has three levels, each of
which compares the whole text next to its digest:

1. every task merges equal texts that it read (the partial half of the first
   aggregate), so a text repeated by a third of all rows leaves a task once;
2. the merged rows meet by (digest, salt, text), the salt spreading one digest
   over several tasks;
3. the winners of the salts meet by (digest, text).

The outcome goes back the same way, to every (digest, salt) that occurs.

Defined results: a null text counts as empty; rows that repeat a doc_id with
equal texts all carry the same answer; a null doc_id never wins against a
number, and a group of null ids only keeps them all; an empty table gives an
empty result.  Other columns of the input are not looked at, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import MOST_SENT, cut, join_ids

SALTS = 16


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.  Up to 62 ``salts``."""
    # Rows without an id are told apart by what else they have.
    others = [c for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind and kind not in ("void", "variant")]
    bare = F.xxhash64(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0).cast("long")
    salt = F.pmod(F.when(F.col(id_col).isNull(), bare).otherwise(F.xxhash64(id_col)), F.lit(salts))
    base = docs.select(F.col(id_col).alias("doc_id"), salt.alias("salt"), normalised(text_col).alias("norm"))
    base = base.withColumn("digest", F.unhex(F.sha2(F.col("norm"), 256)))
    salted = base.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    # The salts that occur, as the bits of a number.
    bits = F.array(*(F.lit(1 << k).cast("long") for k in range(salts)))
    met = F.bit_or(F.element_at(bits, F.col("salt").cast("int") + 1))
    whole = salted.groupBy("digest", "norm").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"), met.alias("met"))
    # The texts have been compared; from here on the digest names its text.  Two
    # texts under one digest (a SHA-256 collision) stop the query, never mix.
    one = F.when(F.count(F.lit(1)) == 1, F.min("keep_id")).otherwise(
        F.raise_error(F.lit("two different texts have one SHA-256 digest")).cast("long")
    )
    groups = whole.groupBy("digest").agg(one.alias("keep_id"), F.min("group_size").alias("group_size"), F.bit_or("met").alias("met"))
    # The answer goes to each salt under which the digest occurs, and the rows meet it there.
    there = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.element_at(bits, s + 1).bitwiseAND(F.col("met")) != 0)
    answers = groups.select("digest", "keep_id", "group_size", F.explode(F.transform(there, lambda s: s.cast("long"))).alias("salt")).repartition("digest", "salt")
    return base.select("doc_id", "digest", "salt").join(answers, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only texts whose digest occurs more than once take part in the combining.
    Rows that repeat the winning doc_id with the same text all stay.
    """
    digest = F.unhex(F.sha2(normalised(text_col), 256))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest.alias("digest"))
    repeated = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    copies = cut(join_ids(keyed, cut(repeated), ["digest"], "left_semi").select("doc_id", "text"))
    losers = cut(exact_groups(copies).where("not kept").select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone")).distinct())
    few = F.broadcast(losers) if losers.count() <= MOST_SENT else losers
    return docs.join(few, docs[id_col].eqNullSafe(losers["gone_id"]) & (digest == losers["gone"]), "left_anti")


ORACLE_SQL = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
