"""The queries of this package, bound to the tables under a scale-factor folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, exact_dedup, infill, langid, mixing, ngram_join, packing, passages, quality, secrets, sharding, token_file, whitening
from skein.llm.common import crc32_of_id, shared_folder, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_file.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_file.read_token_files(spark, path)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(crc32_of_id() % 5 != 0))
    held_out = F.coalesce(crc32_of_id() % 5 == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = quality.learn(docs, labels.where(crc32_of_id() % 3 != 1))
    held_out = F.coalesce(crc32_of_id() % 3 == 1, F.lit(False)).alias("held_out")
    return quality.score_quality(docs, field).select("doc_id", held_out, "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)
    return rows.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256")
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_ngram_join, op3_passages, op4_token_files, op5_language, op6_quality, op7_packing, op8_secrets, op9_sharding, op10_exact_dedup, op11_mixing, op12_fill_in_middle, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": exact_dedup.ORACLE_SQL, "op11_mixing": mixing.ORACLE_SQL, "op12_fill_in_middle": infill.ORACLE_SQL}
