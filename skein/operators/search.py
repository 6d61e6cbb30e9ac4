"""Keyword search: BM25 over pooled columns, with its fallbacks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import location
from skein.lineage import MOST_SENT, cut
from skein.operators import fts
from skein.operators.substrings import Grams
from skein.schema import DECLARATION_TYPES


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def bm25(rows: DataFrame, query: str, columns: list[str], id_col: str = "id", index: fts.Index | None = None) -> DataFrame:
    """id and score of the rows that ``query`` matches, in the query language (words side by side must all occur).

    Row count, mean length and document frequencies are over all rows.  Without an index one is derived from the rows.
    """
    return fts.match(index or fts.index_of(rows, columns, id_col), fts.parse(query, columns))


def search(
    nodes: DataFrame,
    query: str,
    limit: int = 20,
    offset: int = 0,
    kind: str | None = None,
    columns: tuple[str, ...] = ("id", "name", "content", "summary"),
    index: fts.Index | None = None,
) -> DataFrame:
    """id and score: everything for ``*`` or ``all``, BM25 where the query language can read the query, else a substring match."""
    pooled = [c for c in columns if c in nodes.columns]
    if query.strip().lower() in ("*", "all"):
        found = nodes.select("id", F.lit(1.0).alias("score"))
    else:
        try:
            parsed = fts.parse(query, pooled) if query.strip() else None
        except fts.BadQuery:
            parsed = None
        if parsed is not None:
            index = index or fts.index_of(nodes, pooled)
            # Which rows are best is known from few postings only where nothing else picks among them.
            found = fts.match(index, parsed) if kind is not None else fts.best(index, parsed, offset + limit)
        else:
            found = like(nodes, query, [c for c in ("name", "content", "file_path") if c in nodes.columns])
    if kind is not None:
        found = found.join(nodes.where(F.col("type") == kind).select("id"), "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def like(rows: DataFrame, query: str, columns: list[str], id_col: str = "id", grams: Grams | None = None) -> DataFrame:
    """Rows with the query as a substring of a column, whatever the case (% and _ are wildcards); score 1.

    With stored ``grams`` of the columns only rows that have the query's trigrams are looked at.
    """
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    some = grams.candidates(query) if grams is not None else None
    if some is not None:
        ids = cut(some.where(F.col("col").isin(*columns)).select(F.col("id").alias(id_col)).distinct())
        rows = rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, id_col, "left_semi")
    return rows.where(hit).select(F.col(id_col).alias("id"), F.lit(1.0).alias("score"))


def locate(nodes: DataFrame, query: str, limit: int = 15, base: str = "", **options) -> DataFrame:
    """The hits of a query in order, each as one line that tells where it is; ``options`` as of ``search``."""
    hits = search(nodes, query, limit, **options).join(nodes, "id")
    absent = {c: F.lit(None).cast(t) for c, t in (("start_line", "int"), ("summary", "string")) if c not in nodes.columns}
    hits = hits.withColumns(absent) if absent else hits
    line = location(F.col("name"), F.col("id").cast("string"), F.col("file_path"), F.col("start_line"), F.col("summary"), base)
    return hits.select("id", "score", line.alias("line")).orderBy(F.desc("score"), "id")


def attach_edges(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Every hit with its edges, either direction, a loop once: id, source, target, relationship."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), "source", "target", "relationship")
    return hits.select("id").join(ends, "id")


def resolve_definition(nodes: DataFrame, symbol: str, candidates: int = 8, index: fts.Index | None = None) -> DataFrame:
    """The best of the first hits: exact name and declaration, exact name, declaration, any; its rank says which.

    A script component has no edges of its own but its file's; where there is
    such a file node (whose id is the component's path), that stands for it.
    """
    hits = search(nodes, symbol, candidates, index=index).join(nodes, "id")
    exact, declared = F.lower("name") == symbol.strip('"').lower(), F.col("type").isin(*DECLARATION_TYPES)
    rank = F.when(exact & declared, 0).when(exact, 1).when(declared, 2).otherwise(3)
    best = hits.withColumn("rank", rank).orderBy("rank", F.desc("score"), "id").limit(1)
    if "file_path" not in nodes.columns:
        return best.select("id", "name", "type", "rank")
    files = nodes.where("type = 'File'").select(F.col("id").alias("file_id"), F.col("name").alias("file_name"), F.col("type").alias("file_type"))
    carrier = F.when(F.col("type") == "JSComponent", F.col("file_path"))
    found = files.join(F.broadcast(best.select("id", "name", "type", "rank", carrier.alias("file_id"))), "file_id", "right")
    return found.select(*(F.coalesce(f"file_{c}", c).alias(c) if c != "id" else F.coalesce(F.when(F.col("file_name").isNotNull(), F.col("file_id")), "id").alias("id") for c in ("id", "name", "type")), "rank")


def verify_exists(nodes: DataFrame, symbol: str, candidates: int = 8, nearest: int = 5) -> DataFrame:
    """Hits with exactly this name (any case); where there is none, the nearest distinct names."""
    hits = search(nodes, symbol, candidates).join(nodes.select("id", "name"), "id").withColumn("exact", F.lower("name") == symbol.lower())
    any_exact = hits.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("found"))
    named = hits.crossJoin(F.broadcast(any_exact)).where("exact or not found")
    return named.groupBy("name", "exact").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "name").limit(nearest)


def rank_chunks(chunks: DataFrame, query: str, text: str = "text", id_col: str = "id") -> DataFrame:
    """BM25 order of chunks; where the query language cannot read the query, chunks with any term of more than two letters."""
    try:
        return bm25(chunks, query, [text], id_col)
    except fts.BadQuery:
        pass
    hit = F.lit(False)
    for t in query_terms(query):
        if len(t) > 2:
            hit = hit | F.contains(F.lower(text), F.lit(t))
    return chunks.where(hit).select(F.col(id_col).alias("id"), F.lit(1.0).alias("score"))
