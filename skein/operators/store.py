"""The graph store: upserts, deletes and updates, each a new snapshot of a table.

A snapshot is a DataFrame; nothing is changed in place.  Keys: a node's id; an
edge's source, target and relationship.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.schema import DEFINITION_TYPES, EXTRACTED, INFERRED

EDGE_KEY = ["source", "target", "relationship"]


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per key, with the best trust of its rows."""
    return edges.groupBy(*EDGE_KEY).agg(F.min("provenance").alias("provenance"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows join the old: the better trust stays, properties are the latest written.

    ``new`` may have a ``seq`` column that orders rows of one key.
    """
    if "seq" not in new.columns:
        new = new.withColumn("seq", F.lit(0))
    both = old.select("*", F.lit(-1).cast("long").alias("seq")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    return both.groupBy(*EDGE_KEY).agg(F.min("provenance").alias("provenance"), F.max_by("properties", "seq").alias("properties"))


def stamp_provenance(edges: DataFrame, default: int) -> DataFrame:
    """A parser's default tier only ever lowers trust, and never that of containment."""
    raised = F.greatest("provenance", F.lit(default))
    return edges.withColumn("provenance", F.when(F.col("relationship").isin("CONTAINS", "DEFINED_IN"), F.col("provenance")).otherwise(raised))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id.

    Enrichment (summary, embedding) of the old row stays only where neither the
    content nor its hash changed; a row that changed, or is new, needs analysis.
    An embedding that comes with the new row wins and clears the model's name.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    absent = F.col("n.id").isNull()
    same = F.col("o.id").isNotNull() & F.col("o.content_hash").eqNullSafe(F.col("n.content_hash")) & F.col("o.content").eqNullSafe(F.col("n.content"))

    def core(c: str) -> Column:
        return F.when(absent, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    def enriched(c: str) -> Column:
        kept = F.when(same, F.col(f"o.{c}"))
        return F.when(absent, F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"n.{c}"), kept)).alias(c)

    model = F.when(absent, F.col("o.embedding_model")).when(F.col("n.embedding").isNotNull(), F.lit(None)).when(same, F.col("o.embedding_model"))
    needs = F.when(absent | same, F.col("o.needs_analysis")).otherwise(F.lit(True))
    replaced = {"summary": enriched, "embedding": enriched, "embedding_dim": enriched}
    columns = [replaced.get(c, core)(c) for c in old.columns if c not in ("embedding_model", "needs_analysis")]
    if "embedding_model" in old.columns:
        columns.append(model.alias("embedding_model"))
    if "needs_analysis" in old.columns:
        columns.append(needs.alias("needs_analysis"))
    return both.select(*columns).select(*old.columns)


def type_references(nodes: DataFrame) -> DataFrame:
    """type_name, node_id, file_path from each node's comma-separated referenced types."""
    return (
        nodes.select(F.explode(F.split(F.col("properties")["referencedTypes"], ",")).alias("t"), F.col("id").alias("node_id"), "file_path")
        .select(F.trim("t").alias("type_name"), "node_id", "file_path")
        .where("type_name <> ''")
        .dropDuplicates(["type_name", "node_id"])
    )


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the files (``file_path``) go, and every edge that has one at either end."""
    gone = nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("gone"))
    kept = nodes.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(*nodes.columns)
    left = edges.join(gone, edges["source"] == gone["gone"], "left_anti")
    return kept, left.join(gone, left["target"] == gone["gone"], "left_anti")


def clear_for_reindex(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the files go with their outgoing edges; edges that come from elsewhere stay."""
    files = paths.select("file_path").distinct()
    gone = nodes.join(files, "file_path", "left_semi").select(F.col("id").alias("source"))
    return nodes.join(files, "file_path", "left_anti").select(*nodes.columns), edges.join(gone, "source", "left_anti").select(*edges.columns)


def delete_outgoing(nodes: DataFrame, edges: DataFrame, paths: DataFrame, relationship: str) -> DataFrame:
    """Edges of one relationship that leave a node of the files go."""
    from_files = nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("source"), F.lit(relationship).alias("relationship"))
    return edges.join(from_files, ["source", "relationship"], "left_anti").select(*edges.columns)


def replace_diagnostics(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """All of one source's findings are exchanged."""
    return old.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(new.withColumn("source", F.lit(source)).select(*old.columns))


def concept_id(name: Column) -> Column:
    return F.concat(F.lit("concept_"), F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]", ""))


def add_concepts(nodes: DataFrame, edges: DataFrame, analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``analysis`` (id, summary, concepts): summaries are set, concepts become nodes with RELATES_TO edges of tier inferred.

    A concept that exists stays as it is, and so does the edge to it but for its tier.  Where ``analysis`` has them,
    prompt_tokens, completion_tokens and latency_ms go into the properties, and embedding with embedding_model into the node.
    """
    pairs = analysis.select("id", F.explode("concepts").alias("concept")).where(F.trim("concept") != "").withColumn("cid", concept_id(F.col("concept")))
    fresh = pairs.groupBy("cid").agg(F.min("concept").alias("concept")).join(nodes.select(F.col("id").alias("cid")), "cid", "left_anti")
    blank = {c: F.lit(None).cast(t) for c, t in nodes.dtypes}
    concepts = fresh.select(*(({"id": F.col("cid"), "type": F.lit("Concept"), "name": F.col("concept")} | {}).get(c, blank[c]).alias(c) for c in nodes.columns))
    done = analysis.select("id", F.col("summary").alias("__summary"))
    told = nodes.join(done, "id", "left").withColumn("summary", F.coalesce("__summary", "summary"))
    if "needs_analysis" in nodes.columns:
        told = told.withColumn("needs_analysis", F.when(F.col("__summary").isNotNull(), F.lit(False)).otherwise(F.col("needs_analysis")))
    relates = pairs.select(
        F.col("id").alias("source"), F.col("cid").alias("target"), F.lit("RELATES_TO").alias("relationship"), F.lit(INFERRED).alias("provenance")
    ).distinct()
    old = edges.withColumn("__old", F.lit(1))
    merged = old.join(relates.withColumn("__new", F.col("provenance")).drop("provenance"), EDGE_KEY, "full_outer")
    tier = F.coalesce(F.when(F.col("__old").isNotNull(), F.least("provenance", "__new")), F.col("__new"))
    edges_out = merged.withColumn("provenance", tier).select(*edges.columns)
    return _measured(told.select(*nodes.columns), analysis).unionByName(concepts), edges_out


# What the properties of an analysed node are called.
MEASURES = {"PromptTokens": "prompt_tokens", "CompletionTokens": "completion_tokens", "LatencyMs": "latency_ms"}


def _measured(nodes: DataFrame, analysis: DataFrame) -> DataFrame:
    """Nodes with what was measured of their analysis, and the vector that came with it."""
    found = {k: c for k, c in MEASURES.items() if c in analysis.columns}
    vector = "embedding" in analysis.columns and "embedding" in nodes.columns
    if not (found and "properties" in nodes.columns) and not vector:
        return nodes
    told = analysis.select(F.col("id").alias("told_id"), *(F.col(c).cast("string").alias(f"told_{c}") for c in found.values()), *(F.col(c).alias(f"told_{c}") for c in ("embedding", "embedding_model") if vector))
    both = nodes.join(told, nodes["id"] == told["told_id"], "left")
    changed = {}
    if found and "properties" in nodes.columns:
        entries = F.create_map(*(x for k, c in found.items() for x in (F.lit(k), F.col(f"told_{c}"))))
        rest = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*found))
        changed["properties"] = F.when(F.col("told_id").isNull(), F.col("properties")).otherwise(F.map_concat(rest, F.map_filter(entries, lambda k, v: v.isNotNull())))
    if vector:
        there = F.size("told_embedding") > 0
        new = {"embedding": F.col("told_embedding"), "embedding_dim": F.size("told_embedding"), "embedding_model": F.col("told_embedding_model")}
        changed |= {c: F.when(F.col("told_id").isNull(), F.col(c)).when(there, x.cast(dict(nodes.dtypes)[c])) for c, x in new.items() if c in nodes.columns}
    return both.withColumns(changed).select(*nodes.columns)


def set_embeddings(nodes: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """``vectors`` (id, embedding): stored at unit length, with their size and model."""
    from skein.operators.vectors import unit

    fresh = vectors.select("id", unit(F.col("embedding")).alias("__v"))
    hit = F.col("__v").isNotNull()
    joined = nodes.join(fresh, "id", "left")
    return joined.withColumns(
        {
            "embedding": F.when(hit, F.col("__v")).otherwise(F.col("embedding")),
            "embedding_dim": F.when(hit, F.size("__v")).otherwise(F.col("embedding_dim")),
            "embedding_model": F.when(hit, F.lit(model)).otherwise(F.col("embedding_model")),
        }
    ).select(*nodes.columns)


def mark_stale_embeddings(nodes: DataFrame, dim: int, model: str | None = None) -> DataFrame:
    """Embeddings of another size or model are taken away; an unknown size or model is no mismatch."""
    stale = F.coalesce(F.col("embedding_dim") != dim, F.lit(False))
    if model is not None:
        stale = stale | F.coalesce(F.col("embedding_model") != model, F.lit(False))
    stale = stale & F.col("embedding").isNotNull()
    return nodes.withColumn("stale", stale).withColumns(
        {c: F.when(~F.col("stale"), F.col(c)) for c in ("embedding", "embedding_dim", "embedding_model")}
    )


def prune_orphan_concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts that no RELATES_TO edge reaches go (edges they have themselves stay)."""
    reached = edges.where(F.col("relationship") == "RELATES_TO").select(F.col("target").alias("id"))
    orphans = nodes.where(F.col("type") == "Concept").join(reached, "id", "left_anti").select("id")
    return nodes.join(orphans, "id", "left_anti").select(*nodes.columns)


def record_memory(nodes: DataFrame, edges: DataFrame, record: dict, connected: DataFrame, relationship: str = "AFFECTS") -> tuple[DataFrame, DataFrame]:
    """A memory node, and edges to it from those ``connected`` ids that exist.  Name and content are cut at 512 and 8192 characters."""
    spark = nodes.sparkSession
    row = spark.createDataFrame([(record["id"], record["type"], record["name"][:512], record["content"][:8192])], "id string, type string, name string, content string")
    blank = {c: F.lit(None).cast(t) for c, t in nodes.dtypes}
    memory = row.select(*((F.col(c) if c in row.columns else blank[c]).alias(c) for c in nodes.columns))
    there = connected.join(nodes.select("id"), "id", "left_semi").distinct()
    drawn = there.select(
        F.col("id").alias("source"), F.lit(record["id"]).alias("target"), F.lit(relationship).alias("relationship"), F.lit(EXTRACTED).alias("provenance")
    )
    extra = {c: F.lit(None).cast(t) for c, t in edges.dtypes if c not in drawn.columns}
    return nodes.unionByName(memory), edges.unionByName(drawn.withColumns(extra) if extra else drawn)


def set_status(nodes: DataFrame, ids: list[str], status: str) -> DataFrame:
    """``status`` in the properties of some nodes."""
    rest = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: k != "status")
    changed = F.map_concat(rest, F.create_map(F.lit("status"), F.lit(status)))
    return nodes.withColumn("properties", F.when(F.col("id").isin(ids), changed).otherwise(F.col("properties")))


def definitions_by_name(nodes: DataFrame, names: DataFrame, types: tuple[str, ...] = DEFINITION_TYPES) -> DataFrame:
    """name and the sorted ids of the definitions that have it (case matters, blank names have none)."""
    wanted = names.select("name").where("trim(name) <> ''").distinct()
    return nodes.where(F.col("type").isin(*types)).join(wanted, "name").groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
