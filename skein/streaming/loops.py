"""Polling loops as Structured Streaming micro-batches with durable queues.

Each loop reads a folder of change records and hands every micro-batch to a
function; the folder's checkpoint makes a batch that was interrupted run again,
so the functions are idempotent: they write a batch's outcome under its number.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.lineage import cut
from skein.operators.reindex import reindex, reindex_closure  # noqa: F401  (the closure is part of this module's interface)
from skein.operators.store import add_concepts, first_per, prune_orphan_concepts, set_embeddings
from skein.sources import parsers
from skein.sources.files import drift, pushed_files


def each_batch(
    spark: SparkSession, schema: str, folder: str, checkpoint: str, work: Callable[[DataFrame, int], None], seconds: int | None = None
) -> StreamingQuery:
    """Start a loop over the Parquet files that arrive in ``folder``; without ``seconds`` it ends when all have been read."""
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def enrichment_work(analyse: Callable[[DataFrame], DataFrame], out: str, batch: int = 16) -> Callable[[DataFrame, int], None]:
    """Drain queued nodes (id, content, needs_analysis): ``analyse`` turns them into id, summary, concepts.

    ``batch`` nodes share one call of the model at most, which ``analyse`` sees as the column ``call``.
    """

    def work(rows: DataFrame, number: int) -> None:
        queued = rows.where("needs_analysis and type <> 'Concept'").dropDuplicates(["id"])
        calls = queued.withColumn("call", F.floor(F.monotonically_increasing_id() / batch))
        analyse(calls).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return work


def store_work(
    folder: str, analyse: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] | None = None, model: str = "", batch: int = 16
) -> Callable[[DataFrame, int], None]:
    """Analyse queued nodes (id) and write the outcome back: batch k makes version k + 1 of the tables under ``folder`` from version k.

    A batch that runs again makes the same version again.  When nothing waits any more, concepts that no edge
    reaches go, and with ``embed`` (id, content to id, embedding) those without a vector get one.
    """

    def work(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        nodes, edges = (spark.read.parquet(f"{folder}/v{number}/{t}") for t in ("nodes", "edges"))
        waits = F.col("needs_analysis") & (F.col("type") != "Concept")
        queued = nodes.where(waits).join(rows.select("id").distinct(), "id", "left_semi")
        calls = queued.withColumn("call", F.floor(F.monotonically_increasing_id() / batch))
        nodes, edges = add_concepts(nodes, edges, cut(analyse(calls)))
        nodes = cut(nodes)
        if nodes.where(waits).isEmpty():
            nodes = prune_orphan_concepts(nodes, edges)
            if embed is not None:
                bare = nodes.where((F.col("type") == "Concept") & F.col("embedding").isNull()).select("id", F.coalesce("content", "name").alias("content"))
                nodes = set_embeddings(nodes, embed(bare), model)
        for name, rows_of in (("nodes", nodes), ("edges", edges)):
            rows_of.write.mode("overwrite").parquet(f"{folder}/v{number + 1}/{name}")

    return work


def patient(work: Callable[[DataFrame, int], None], tries: int = 5, wait: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """``work``, tried again after ``backoff`` when it fails; the last failure ends the loop, whose checkpoint repeats the batch."""

    def run(rows: DataFrame, number: int) -> None:
        for failures in range(tries):
            try:
                return work(rows, number)
            except Exception:
                if failures == tries - 1:
                    raise
                wait(backoff(failures))

    return run


def mock_analysis(rows: DataFrame) -> DataFrame:
    """A stand-in for a model: the first line as summary, the longest words as concepts."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"([A-Z][\p{L}]{3,})"), F.lit(1)))
    return rows.select("id", F.substring(F.split("content", "\n")[0], 1, 120).alias("summary"), F.slice(words, 1, 5).alias("concepts"))


def backoff(failures: int, base: float = 30.0, most: float = 900.0) -> float:
    """Seconds to wait after so many failures in a row: doubled each time, 15 minutes at most."""
    return min(most, base * 2 ** max(0, failures))


def drift_work(indexed: Callable[[], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """Compare listings (file_path, content_hash) with what is indexed; write what is not fresh."""

    def work(rows: DataFrame, number: int) -> None:
        latest = rows.dropDuplicates(["file_path"])
        drift(indexed(), latest).where("state <> 'fresh'").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return work


def push_work(folder: str, read: Callable[[DataFrame], DataFrame], parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Index the files that push payloads name anew: batch k makes version k + 1 of the graph under ``folder`` from version k.

    ``read`` gives path and text of the files (file_path) that still exist, and
    ``parse`` what ``parse_files`` makes of them.  A file that is gone, or of no
    known kind, loses its nodes.  A batch that runs again makes the same version
    again, and payloads without files carry the version over.
    """

    def work(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        nodes, edges = (spark.read.parquet(f"{folder}/v{number}/{t}") for t in ("nodes", "edges"))
        pushed = cut(pushed_files(rows).select(F.col("file").alias("file_path")))
        if not pushed.isEmpty():
            parsed = cut(parse(read(pushed)))
            fresh = [_as(nodes, parsers.nodes_of(parsed, properties=True)), _as(edges, parsers.edges_of(parsed, properties=True))]
            nodes, edges = reindex(nodes, edges, pushed, *fresh)
        for name, rows_of in (("nodes", nodes), ("edges", edges)):
            rows_of.write.mode("overwrite").parquet(f"{folder}/v{number + 1}/{name}")

    return work


def _as(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table``; what they lack is null."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in table.dtypes))


def freshness(indexed: DataFrame, present: DataFrame, paths: DataFrame) -> DataFrame:
    """Fresh, Stale, Untracked or Deleted for each of ``paths`` (file_path) that is known anywhere."""
    names = F.create_map(*(F.lit(x) for x in ("fresh", "Fresh", "changed", "Stale", "new", "Untracked", "deleted", "Deleted")))
    return drift(indexed, present).join(paths, "file_path", "left_semi").select("file_path", names[F.col("state")].alias("freshness"))


def grounding(hits: DataFrame, diagnostics: DataFrame, floor: float, most: int = 20) -> DataFrame:
    """Hits (id, score) that may ground an answer: the best of each id above the floor, ``most`` of them, injected ones flagged.

    An empty result means: abstain.
    """
    best = first_per(hits.where(F.col("score") >= floor), ["id"], [F.desc("score")])
    kept = best.orderBy(F.desc("score"), "id").limit(most)
    flagged = diagnostics.where("code like 'security.%'").select(F.col("node_id").alias("id")).distinct().withColumn("injected", F.lit(True))
    return kept.join(flagged, "id", "left").select("id", "score", F.coalesce("injected", F.lit(False)).alias("injected")).orderBy(F.desc("score"), "id")
