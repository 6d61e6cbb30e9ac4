"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import analytics, evals, linking, store, traverse
from skein.plans import stored
from skein.sources import driver_graph, files
from skein.sources.driver_graph import oracle, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return stored.graph(spark, sf)


# Scans and filters ---------------------------------------------------------


@query(oracle("SELECT * FROM nodes"))
def src_nodes(spark, sf):
    return driver_graph.nodes(spark, sf)


@query(oracle("SELECT * FROM edges"))
def src_edges(spark, sf):
    return driver_graph.edges(spark, sf)


@query("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) <= 5242880")
def src_size_guard(spark, sf):
    size = F.octet_length("text")
    return table(spark, sf, "documents").where(size <= files.MOST_BYTES).select("doc_id", size.cast("long").alias("bytes"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '\r\n|[\r\x{0085}\x{2028}\x{2029}\f]', chr(10), 'g')) AS content_hash FROM documents")
def src_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", files.fingerprint(files.normalise_lines(F.col("text"))).alias("content_hash"))


@query(
    "SELECT doc_id, length(CASE WHEN length(text) > 100000 THEN substr(text, 1, 100000) || chr(10) || chr(10) || '… [truncated]' ELSE text END) AS stored FROM documents"
)
def src_stored_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(files.stored_content(F.col("text"))).cast("long").alias("stored"))


@query(
    """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    c AS (SELECT doc_id, l, unnest(range(0, CAST(floor((len(l) - 1) / 40) AS BIGINT) + 1)) AS chunk FROM l)
    SELECT doc_id AS id, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * 40 + 1 AS INTEGER) AS start_line,
      CAST(least((chunk + 1) * 40, len(l)) AS INTEGER) AS end_line, sha256(array_to_string(l[chunk * 40 + 1 : chunk * 40 + 40], chr(10))) AS text_hash
    FROM c WHERE trim(replace(replace(array_to_string(l[chunk * 40 + 1 : chunk * 40 + 40], chr(10)), chr(10), ''), chr(9), '')) <> ''
    """
)
def src_line_chunks(spark, sf):
    chunks = evals.line_chunks(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return chunks.select("id", "chunk", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"))


@query("SELECT DISTINCT f AS file FROM (SELECT unnest(['user' || user_id || '.cs', event_type || '.cs']) AS f FROM events)")
def src_pushed_files(spark, sf):
    events = table(spark, sf, "events")
    commit = F.struct(F.array(F.concat(F.lit("user"), "user_id", F.lit(".cs"))).alias("added"), F.array(F.concat("event_type", F.lit(".cs"))).alias("removed"))
    return files.pushed_files(events.select(F.to_json(F.struct(F.array(commit).alias("commits"))).alias("payload")))


@query(oracle("SELECT * FROM nodes WHERE id = 'S:1'"))
def flt_node_by_id(spark, sf):
    return driver_graph.nodes(spark, sf).where("id = 'S:1'")


@query(oracle("SELECT * FROM nodes WHERE type IN ('Region', 'Supplier')"))
def flt_nodes_by_type(spark, sf):
    return driver_graph.nodes(spark, sf).where(F.col("type").isin("Region", "Supplier"))


@query(oracle("SELECT id, name FROM nodes WHERE file_path = 'src/sales/building.cs'"))
def flt_nodes_by_file(spark, sf):
    return driver_graph.nodes(spark, sf).where("file_path = 'src/sales/building.cs'").select("id", "name")


@query(oracle("SELECT source, target, provenance FROM edges WHERE relationship = 'CALLS'"))
def flt_edges_by_relationship(spark, sf):
    return driver_graph.edges(spark, sf).where("relationship = 'CALLS'").select("source", "target", "provenance")


@query(oracle("SELECT name, array_to_string(list_sort(list(id)), ',') AS ids FROM nodes WHERE type = 'Part' AND name IN (SELECT p_name FROM part WHERE p_size = 7) AND trim(name) <> '' GROUP BY name"))
def flt_definitions_by_name(spark, sf):
    names = table(spark, sf, "part").where("p_size = 7").select(F.col("p_name").alias("name"))
    found = store.definitions_by_name(driver_graph.nodes(spark, sf), names, ("Part",))
    return found.select("name", F.array_join("ids", ",").alias("ids"))


@query("SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 50")
def flt_nodes_with_embeddings(spark, sf):
    return table(spark, sf, "embeddings").where("embedding is not null").orderBy("vec_id").limit(50).select("vec_id", "label")


@query(oracle("SELECT source, target, relationship, provenance FROM edges WHERE provenance <= 1 AND relationship NOT IN ('CONTAINS', 'BELONGS_TO_MODULE')"))
def flt_trusted_couplings(spark, sf):
    return traverse.couplings(driver_graph.edges(spark, sf), most_tier=1)


@query(oracle("SELECT id FROM nodes WHERE contains(lower(file_path), 'test')"))
def flt_test_paths(spark, sf):
    return driver_graph.nodes(spark, sf).where(traverse.looks_like_test(F.col("file_path"))).select("id")


# Aggregates ------------------------------------------------------------------


@query(
    oracle(
        """SELECT 'nodes' AS kind, '' AS key, count(*) AS count FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges
        UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'relationship', relationship, count(*) FROM edges GROUP BY relationship"""
    )
)
def agg_statistics(spark, sf):
    return analytics.statistics(*_graph(spark, sf))


@query(
    oracle(
        """SELECT t.provenance, count(e.source) AS edges, round(100.0 * count(e.source) / greatest(1, (SELECT count(*) FROM edges)), 6) AS percent
        FROM (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS provenance) t LEFT JOIN edges e ON e.provenance = t.provenance GROUP BY 1"""
    )
)
def agg_trust_mix(spark, sf):
    return analytics.trust_mix(driver_graph.edges(spark, sf))


@query(
    oracle(
        """SELECT relationship, count(*) FILTER (provenance = 0) AS extracted, count(*) FILTER (provenance = 1) AS inferred, count(*) FILTER (provenance = 2) AS ambiguous,
        relationship IN ('RELATES_TO', 'IMPORTS', 'OVERRIDES_BLOCK', 'BINDS_TO') AND count(*) FILTER (provenance = 0) > 0 AS suspect FROM edges GROUP BY relationship"""
    )
)
def agg_provenance_pivot(spark, sf):
    return analytics.provenance_by_relationship(driver_graph.edges(spark, sf))


@query(oracle("SELECT id, count(*) AS degree, count(*) FILTER (i) AS in_degree FROM (SELECT source AS id, FALSE AS i FROM edges UNION ALL SELECT target, TRUE FROM edges) GROUP BY id"))
def agg_degrees(spark, sf):
    return analytics.degrees(driver_graph.edges(spark, sf))


MODULE = "CASE WHEN string_split(file_path, '/')[1] = 'src' AND len(string_split(file_path, '/')) > 2 THEN string_split(file_path, '/')[2] ELSE string_split(file_path, '/')[1] END"


@query(
    oracle(
        f""", p AS (SELECT id, type, {MODULE} AS module FROM nodes),
        i AS (SELECT target AS id, count(*) AS n FROM edges WHERE relationship NOT IN ('CONTAINS', 'BELONGS_TO_MODULE') GROUP BY 1),
        r AS (SELECT module, p.id, row_number() OVER (PARTITION BY module ORDER BY n DESC, p.id) AS rn FROM p JOIN i USING (id)),
        t AS (SELECT module, string_agg(id, ',' ORDER BY rn) AS top_ids FROM r WHERE rn <= 6 GROUP BY module)
        SELECT p.module, count(*) AS nodes, count(DISTINCT type) AS types, any_value(t.top_ids) AS top_ids FROM p LEFT JOIN t USING (module) GROUP BY p.module"""
    )
)
def agg_architecture(spark, sf):
    return analytics.architecture(*_graph(spark, sf))


@query(
    oracle(
        f""", p AS (SELECT id, {MODULE} AS module FROM nodes)
        SELECT a.module AS from_module, b.module AS to_module, count(*) AS edges FROM edges JOIN p a ON a.id = source JOIN p b ON b.id = target
        WHERE relationship NOT IN ('CONTAINS', 'BELONGS_TO_MODULE') AND a.module <> b.module GROUP BY 1, 2"""
    )
)
def agg_cross_module_edges(spark, sf):
    return analytics.cross_module_edges(*_graph(spark, sf))


@query(
    oracle(
        """SELECT name, count(*) AS definitions FROM nodes n WHERE type = 'Part' AND trim(name) <> '' GROUP BY name HAVING count(*) > 1
        AND name IN (SELECT name FROM nodes WHERE type = 'Part' AND id IN (SELECT target FROM edges WHERE relationship = 'CALLS'))"""
    )
)
def agg_ambiguous_names(spark, sf):
    nodes, edges = _graph(spark, sf)
    calls = edges.where("relationship = 'CALLS'").withColumn("relationship", F.lit("REFERENCES_TYPE"))
    return linking.ambiguous_names(nodes, calls, ("Part",))


@query("SELECT name, CASE WHEN bool_or(r) AND bool_or(NOT r) THEN 'ambiguous' WHEN bool_or(r) THEN 'reference' ELSE 'text' END AS kind FROM (SELECT p_type AS name, p_size > 25 AS r FROM part) GROUP BY name")
def agg_field_types(spark, sf):
    return linking.classify_fields(table(spark, sf, "part").select(F.col("p_type").alias("name"), (F.col("p_size") > 25).alias("is_reference")))


@query("SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS median, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS max FROM events GROUP BY event_type")
def agg_latency(spark, sf):
    return evals.nearest_rank(table(spark, sf, "events"), "value", ["event_type"])


@query(
    """SELECT CAST(sum(floor(n_chars / 4)) AS BIGINT) AS naive_tokens, CAST(sum(floor(least(n_chars, 1200) / 4)) AS BIGINT) AS capsule_tokens,
    round(100.0 * (1 - sum(floor(least(n_chars, 1200) / 4)) / sum(floor(n_chars / 4))), 6) AS percent FROM documents"""
)
def agg_token_reduction(spark, sf):
    return evals.token_reduction(table(spark, sf, "documents").select(F.col("n_chars").alias("naive_chars"), F.least("n_chars", F.lit(1200)).alias("capsule_chars")))


# The k-th passage of a document is its k-th hit: the rank is the place of the benchmark item among those of equal first word.
_GOLDEN_SQL = """
g AS (SELECT item_id AS case_id, item_id AS id FROM benchmark),
r AS (SELECT a.item_id AS case_id, b.item_id AS id, row_number() OVER (PARTITION BY a.item_id ORDER BY length(b.text) DESC, b.item_id) AS rank
      FROM benchmark a JOIN benchmark b ON lower(string_split(a.text, ' ')[1]) = lower(string_split(b.text, ' ')[1]))"""


@query(
    f"""WITH {_GOLDEN_SQL}, h AS (SELECT g.case_id, min(rank) AS f, count(r.id) AS n FROM g LEFT JOIN r ON r.case_id = g.case_id AND r.id = g.id AND rank <= 10 GROUP BY 1),
    m AS (SELECT count(*) AS cases, avg(CASE WHEN f = 1 THEN 1.0 ELSE 0.0 END) AS p, avg(n / 10.0) AS pk, avg(least(1.0, n)) AS rec, avg(coalesce(1.0 / f, 0)) AS mrr FROM h)
    SELECT cases, round(p, 9) AS p_at_1, round(pk, 9) AS p_at_k, round(rec, 9) AS recall_at_k, round(mrr, 9) AS mrr, round(1.96 * sqrt(p * (1 - p) / cases), 9) AS ci95 FROM m"""
)
def agg_retrieval_metrics(spark, sf):
    items = table(spark, sf, "benchmark").withColumn("w", F.lower(F.split("text", " ")[0]))
    pairs = items.select(F.col("item_id").alias("case_id"), "w").join(items.select(F.col("item_id").alias("id"), F.length("text").alias("n"), "w"), "w")
    ranked = evals.first_by(pairs, ["case_id"], [F.desc("n"), "id"])
    out = evals.retrieval_metrics(ranked, items.select(F.col("item_id").alias("case_id"), F.col("item_id").alias("id")))
    return out.select("cases", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query("SELECT metric, v AS value, b AS was FROM (SELECT user_id AS metric, avg(value) FILTER (event_type IN ('view', 'click')) AS v, avg(value) AS b FROM events GROUP BY 1) WHERE v < 0.95 * b")
def agg_regression_gate(spark, sf):
    events = table(spark, sf, "events")
    now = events.where(F.col("event_type").isin("view", "click")).groupBy(F.col("user_id").alias("metric")).agg(F.avg("value").alias("value"))
    was = events.groupBy(F.col("user_id").alias("metric")).agg(F.avg("value").alias("value"))
    return evals.regressions(now, was)
