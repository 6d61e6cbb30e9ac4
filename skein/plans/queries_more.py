"""Queries of parsing, linking, reindexing and presentation, beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import evals, fts, fusion, linking, reindex, search, store, traverse, vectors
from skein.plans.queries import _graph, query
from skein.plans.queries_graph import _COS, _FTS_COLUMNS, _SELF, _bm25, _docs, _index, _probe, _vectors
from skein.sources import parsers
from skein.sources.driver_graph import oracle, table

# Parsing ------------------------------------------------------------------------

_P = "CAST(p_partkey AS VARCHAR)"


@query(
    f"""SELECT {_P} || '.graphql' AS path, 'GraphQLQuery' AS type, 'Q' || {_P} AS name, '' AS target FROM part
    UNION ALL SELECT {_P} || '.graphql', 'InlineFragment', 'T' || CAST(p_size AS VARCHAR), '' FROM part
    UNION ALL SELECT {_P} || '.graphql', 'GraphQLFragment', 'F' || {_P}, 'B' || CAST(p_size AS VARCHAR) FROM part
    UNION ALL SELECT {_P} || '.graphql', 'GraphQLMutation', 'M' || {_P}, '' FROM part WHERE p_size > 25"""
)
def src_graphql(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    parts = (
        F.lit("# query Hidden\nquery Q"), key, F.lit("($a: ID) { item(name: \"mutation Not\") { ...on T"), size, F.lit(" { x } } }\nfragment F"), key, F.lit(" on B"), size, F.lit(" { y }\n"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("mutation M"), key, F.lit(" { z }"))).otherwise("{ query }"),
    )
    return parsers.graphql(table(spark, sf, "part").select(F.concat(key, F.lit(".graphql")).alias("path"), F.concat(*parts).alias("text")))


@query("SELECT p_partkey AS path, 'C' || CAST(p_size AS VARCHAR) AS name, 'Base' AS base FROM part WHERE p_size % 2 = 0")
def src_php_classes(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("<?php // class X extends Y\nfinal class C"), size, F.when(F.col("p_size") % 2 == 0, " extends \\Vendor\\Base").otherwise(" implements Other"), F.lit(" { }"))
    return parsers.php_classes(table(spark, sf, "part").select(F.col("p_partkey").alias("path"), text.alias("text")))


@query("SELECT p_partkey AS path, p_type AS block FROM part UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size > 10")
def src_smarty_blocks(spark, sf):
    second = F.when(F.col("p_size") > 10, F.concat(F.lit("[{block  name = \""), "p_brand", F.lit("\"}]"))).otherwise("[{include file=\"x\"}]")
    text = F.concat(F.lit("<p>[{block name='"), "p_type", F.lit("'}]</p>"), second)
    return parsers.smarty_blocks(table(spark, sf, "part").select(F.col("p_partkey").alias("path"), text.alias("text")))


def _file_nodes(spark, sf):
    """Documents as nodes, some of them files, some without a hash."""
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "File").otherwise("Class").alias("type"), F.when(F.col("n_chars") > 500, F.md5("text")).alias("content_hash")
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'en'")
def src_indexed_files(spark, sf):
    return reindex.indexed_files(_file_nodes(spark, sf))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS content_hash FROM documents WHERE lang = 'en' AND n_chars > 500 AND doc_id IN (SELECT doc_id FROM labels)")
def flt_content_hashes(spark, sf):
    return reindex.content_hashes(_file_nodes(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id")))


# Links and layers ---------------------------------------------------------------

_LAYERS = """WITH n AS (SELECT 'C:' || c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 'Foundation' WHEN 1 THEN 'Feature' ELSE 'Project' END AS layer, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS module,
    CASE c_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS r FROM customer WHERE c_nationkey % 5 <> 0),
  e AS (SELECT 'C:' || o_custkey AS s, 'C:' || (o_orderkey % 1000 + 1) AS t FROM orders)"""


def _layered(spark, sf):
    layer = F.when(F.col("c_nationkey") % 3 == 0, "foundation").when(F.col("c_nationkey") % 3 == 1, "Feature").otherwise("PROJECT")
    path = F.when(F.col("c_nationkey") % 5 == 0, "other/x.cs").otherwise(F.concat(F.lit("src/"), layer, F.lit("/"), "c_mktsegment", F.lit("/x.cs")))
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("id"), path.alias("file_path"))
    target = F.concat(F.lit("C:"), (F.col("o_orderkey") % 1000 + 1).cast("string"))
    edges = table(spark, sf, "orders").select(F.concat(F.lit("C:"), "o_custkey").alias("source"), target.alias("target"), F.lit("CALLS").alias("relationship"))
    return nodes, edges


@query(f"{_LAYERS} SELECT id, layer, module FROM n")
def agg_layers(spark, sf):
    return linking.layered(_layered(spark, sf)[0])


@query(f"{_LAYERS} SELECT DISTINCT a.layer AS from_layer, a.module AS from_module, b.layer AS to_layer, b.module AS to_module FROM e JOIN n a ON a.id = s JOIN n b ON b.id = t WHERE b.r >= a.r AND (a.layer <> b.layer OR a.module <> b.module)")
def agg_layer_violations(spark, sf):
    return linking.helix_violations(*_layered(spark, sf))


@query(f"{_LAYERS} SELECT id AS source, 'helix::' || layer || '::' || module AS target, 'BELONGS_TO_MODULE' AS relationship, 1 AS provenance FROM n")
def grf_layer_modules(spark, sf):
    return linking.helix_modules(_layered(spark, sf)[0])[1]


@query(
    oracle(
        """, defs AS (SELECT name, id FROM nodes WHERE type = 'Part'), own AS (SELECT id FROM nodes WHERE file_path = 'src/parts/Brand#11.cs'),
        fresh AS (SELECT DISTINCT o.id AS source, d.id AS target, (SELECT count(*) FROM defs x WHERE x.name = d.name) AS n FROM own o JOIN nodes m ON m.id = o.id JOIN defs d ON d.name = m.content WHERE o.id <> d.id)
        SELECT source, target, relationship, provenance FROM edges WHERE NOT (relationship = 'REFERENCES_TYPE' AND source IN (SELECT id FROM own))
        UNION ALL SELECT source, target, 'REFERENCES_TYPE', CASE WHEN n > 1 THEN 2 ELSE 1 END FROM fresh"""
    )
)
def jon_relink_file(spark, sf):
    nodes, edges = _graph(spark, sf)
    nodes = nodes.withColumn("properties", F.create_map(F.lit("referencedTypes"), F.col("content")))
    return linking.relink_file(nodes, edges, "src/parts/Brand#11.cs", ("Part",))


@query("SELECT p_brand AS name, CASE WHEN bool_or(p_size > 25) AND bool_or(p_size <= 25) THEN 'ambiguous' WHEN bool_or(p_size > 25) THEN 'reference' ELSE 'text' END AS kind FROM part GROUP BY 1")
def agg_field_kinds(spark, sf):
    return linking.classify_fields(table(spark, sf, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") > 25).alias("is_reference")))


# Files that refer to a changed name, and the whole of a reindex -------------------


@query("SELECT DISTINCT p_brand AS file_path FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size = 7) AND p_brand IS NOT NULL")
def flt_referencing_files(spark, sf):
    part = table(spark, sf, "part")
    references = part.select(F.col("p_type").alias("type_name"), F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("file_path"))
    return reindex.referencing_files(references, part.where("p_size = 7").select(F.col("p_type").alias("name")))


def _sources(spark, sf, changed: bool):
    """Parts as classes of the file of their brand; in the second reading one file's have other names."""
    part = table(spark, sf, "part")
    name = F.when((F.col("p_brand") == "Brand#11") & (F.col("p_size") > 25), F.concat(F.lit("New "), "p_name")).otherwise(F.col("p_name")) if changed else F.col("p_name")
    return part.select(
        F.concat(F.lit("P:"), "p_partkey").alias("id"), F.lit("Class").alias("type"), name.alias("name"), F.col("p_type").alias("content"), F.col("p_brand").alias("file_path"),
        F.md5("p_type").alias("content_hash"), F.lit("s").alias("summary"), F.lit(False).alias("needs_analysis"), F.create_map(F.lit("referencedTypes"), F.lower("p_name")).alias("properties"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("int").alias("embedding_dim"), F.lit(None).cast("string").alias("embedding_model"),
    )


_REINDEXED = """WITH old AS (SELECT 'P:' || p_partkey AS id, p_name AS n, p_brand AS f, lower(p_name) AS r, p_size FROM part),
  now AS (SELECT id, CASE WHEN f = 'Brand#11' AND p_size > 25 THEN 'New ' || n ELSE n END AS n, f, r FROM old),
  names AS ((SELECT n FROM old WHERE f = 'Brand#11' EXCEPT ALL SELECT n FROM now WHERE f = 'Brand#11') UNION (SELECT n FROM now WHERE f = 'Brand#11' EXCEPT ALL SELECT n FROM old WHERE f = 'Brand#11')),
  touched AS (SELECT 'Brand#11' AS f UNION SELECT f FROM now WHERE r IN (SELECT n FROM names)),
  fresh AS (SELECT DISTINCT a.id AS source, b.id AS target, (SELECT count(*) FROM now x WHERE x.n = b.n) AS k FROM now a JOIN now b ON a.r = b.n WHERE a.id <> b.id AND a.f IN (SELECT f FROM touched))"""


@query(
    f"""{_REINDEXED} SELECT source, target, 'REFERENCES_TYPE' AS relationship, CASE WHEN k > 1 THEN 2 ELSE 1 END AS provenance FROM fresh
    UNION ALL SELECT id, f, 'DEFINED_IN', 0 FROM now"""
)
def str_reindex_edges(spark, sf):
    old, new = _sources(spark, sf, False), _sources(spark, sf, True)
    inside = new.where("file_path = 'Brand#11'")

    def defined(rows):
        return rows.select(F.col("id").alias("source"), F.col("file_path").alias("target"), F.lit("DEFINED_IN").alias("relationship"), F.lit(0).alias("provenance"), F.lit(None).cast("map<string,string>").alias("properties"))

    paths = spark.createDataFrame([("Brand#11",)], "file_path string")
    _, edges = reindex.reindex(old, defined(old), paths, inside, defined(inside))
    return edges.select("source", "target", "relationship", "provenance")


# Search and its presentations -----------------------------------------------------


@query(_bm25(["the", "only"]) + " SELECT id, round(score, 9) AS score, source || ' -> ' || CAST(id AS VARCHAR) AS line FROM (SELECT h.*, source FROM hits h JOIN documents d ON d.doc_id = h.id) ORDER BY score DESC, id LIMIT 15")
def fts_locate(spark, sf):
    docs = _docs(spark, sf).withColumn("file_path", F.lit(None).cast("string"))
    found = search.locate(docs, "the only", 15, columns=_FTS_COLUMNS, index=_index(spark, sf))
    return found.select("id", F.round("score", 9).alias("score"), "line")


_NAMED = "SELECT 'S:' || s_suppkey AS id, s_name AS name FROM supplier"
_SYMBOLS = r"""WITH n AS (
    SELECT 'P:' || p_partkey AS id, split_part(p_name, ' ', 1) AS name, CASE WHEN p_name LIKE 'hot %' THEN 'JSComponent' WHEN p_size % 2 = 0 THEN 'Class' ELSE 'Note' END AS type, 'js/' || p_brand AS file_path, p_type AS content FROM part
    UNION ALL SELECT DISTINCT 'js/' || p_brand, 'file', 'File', 'js/' || p_brand, '' FROM part),
  w AS (SELECT *, regexp_extract_all(lower(concat_ws(' ', id, name, content)), '([\p{L}\p{N}]+)', 1) AS words FROM n),
  s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w)"""


def _resolved(symbol: str) -> str:
    return f"""(WITH c AS (SELECT *, CAST(len(list_filter(words, lambda x: x = '{symbol}')) AS DOUBLE) AS t FROM w),
      h AS (SELECT c.*, greatest(ln((s.n - d + 0.5) / (d + 0.5)), 1e-6) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * len(words) / mean)) AS score FROM c, s, (SELECT count(*) FILTER (t > 0) AS d FROM c) WHERE t > 0),
      b AS (SELECT *, CASE WHEN name = '{symbol}' THEN CASE WHEN type = 'Class' THEN 0 ELSE 1 END WHEN type = 'Class' THEN 2 ELSE 3 END AS rank FROM (SELECT * FROM h ORDER BY score DESC, id LIMIT 8) ORDER BY rank, score DESC, id LIMIT 1)
      SELECT '{symbol}' AS symbol, CASE WHEN type = 'JSComponent' THEN file_path ELSE id END AS id, CASE WHEN type = 'JSComponent' THEN 'file' ELSE name END AS name, CASE WHEN type = 'JSComponent' THEN 'File' ELSE type END AS type, rank FROM b)"""


def _symbols(spark, sf):
    """Parts by the first word of their name, some of them script components of their brand's file."""
    parts = table(spark, sf, "part")
    path = F.concat(F.lit("js/"), "p_brand")
    kind = F.when(F.startswith("p_name", F.lit("hot ")), "JSComponent").when(F.col("p_size") % 2 == 0, "Class").otherwise("Note")
    own = parts.select(F.concat(F.lit("P:"), "p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), kind.alias("type"), path.alias("file_path"), F.col("p_type").alias("content"))
    return own.unionByName(parts.select(path.alias("id"), F.lit("file").alias("name"), F.lit("File").alias("type"), path.alias("file_path"), F.lit("").alias("content")).distinct())


_WANTED = ["small", "hot", "economy"]


@query(f"{_SYMBOLS} " + " UNION ALL ".join(f"SELECT * FROM {_resolved(s)}" for s in _WANTED))
def fts_resolve_definition(spark, sf):
    nodes = _symbols(spark, sf)
    index = fts.index_of(nodes, ["id", "name", "content"])
    found = [search.resolve_definition(nodes, s, index=index).select(F.lit(s).alias("symbol"), "id", "name", "type", "rank") for s in _WANTED]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _declared(spark, sf):
    """Suppliers as declarations: search for one of their names finds that name only."""
    return table(spark, sf, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("content"), F.lit("Class").alias("type"))


@query(f"SELECT name, FALSE AS exact FROM ({_NAMED}) WHERE id = 'S:4'")
def fts_verify_exists(spark, sf):
    name = table(spark, sf, "supplier").where("s_suppkey = 4").first()["s_name"]
    return search.verify_exists(_declared(spark, sf), f'"{name}"').select("name", "exact")


@query(_bm25(["the", "only"]) + ", v AS (SELECT doc_id AS id FROM documents WHERE FALSE) SELECT id, round(1 / (60.0 + row_number() OVER (ORDER BY score DESC, id)), 9) AS score FROM (SELECT * FROM hits ORDER BY score DESC, id LIMIT 20) ORDER BY score DESC LIMIT 10")
def rnk_hybrid_without_vector(spark, sf):
    found = fusion.hybrid(_docs(spark, sf), "the only", None, 10, columns=_FTS_COLUMNS, index=_index(spark, sf))
    return found.select("id", F.round("score", 9).alias("score"))


@query(
    _bm25(["the", "only"])
    + f""", a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM hits ORDER BY rank LIMIT 20),
    v AS (SELECT a.vec_id AS id, {_COS} AS c FROM {_SELF} WHERE {_COS} > 0), b AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS rank FROM v ORDER BY rank LIMIT 20)
    SELECT id, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY id ORDER BY sum(1 / (60.0 + rank)) DESC, min(l), min(rank) LIMIT 10"""
)
def rnk_hybrid(spark, sf):
    found = fusion.hybrid(_docs(spark, sf), "the only", _probe(spark, sf), 10, columns=_FTS_COLUMNS, index=_index(spark, sf), vectors=_vectors(spark, sf))
    return found.select("id", F.round("score", 9).alias("score"))


@query(r"SELECT turn, conv_id, CAST(1 AS DOUBLE) AS score FROM conversations WHERE contains(lower(text), 'the')")
def fts_rank_chunks(spark, sf):
    chunks = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    return search.rank_chunks(chunks, "the?").select("id.turn", "id.conv_id", "score")


# Enrichment -----------------------------------------------------------------------


@query(
    """SELECT e.vec_id AS id, CASE WHEN e.vec_id % 2 = 0 THEN 'm2' ELSE 'm1' END AS embedding_model, CAST(CASE WHEN e.vec_id % 2 = 0 THEN len(e.embedding) ELSE 3 END AS INTEGER) AS embedding_dim,
    CAST(CASE WHEN e.vec_id % 2 = 0 THEN CASE WHEN list_inner_product(e.embedding, e.embedding) > 0 THEN 1 ELSE 0 END ELSE 14 END AS DOUBLE) AS squared FROM embeddings e"""
)
def snk_set_embeddings(spark, sf):
    rows = table(spark, sf, "embeddings")
    old = rows.select(F.col("vec_id").alias("id"), F.array(*(F.lit(float(x)).cast("float") for x in (1, 2, 3))).alias("embedding"), F.lit(3).alias("embedding_dim"), F.lit("m1").alias("embedding_model"))
    fresh = rows.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "embedding")
    told = store.set_embeddings(old, fresh, "m2")
    return told.select("id", "embedding_model", "embedding_dim", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 3).alias("squared"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (1, 2, 3) THEN 'closed' ELSE 'open' END AS status, c_mktsegment AS kept FROM customer")
def snk_set_status(spark, sf):
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("status"), F.lit("open"), F.lit("k"), F.col("c_mktsegment")).alias("properties"))
    return store.set_status(nodes, [1, 2, 3], "closed").select("id", F.col("properties")["status"].alias("status"), F.col("properties")["k"].alias("kept"))


# Waiting work, findings and memories ----------------------------------------------


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'es' ORDER BY doc_id LIMIT 16")
def flt_pending_queue(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", F.lit(1).alias("done")).distinct()
    kind = F.when(F.col("lang") == "es", "Concept").otherwise("Class").alias("type")
    return reindex.pending(docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), kind, F.col("done").isNull().alias("needs_analysis")), 16).select("id")


@query("SELECT event_id, CAST(floor(value) AS INTEGER) AS severity FROM events WHERE event_type = 'click' AND floor(value) >= 50")
def flt_diagnostics(spark, sf):
    told = table(spark, sf, "events").select("event_id", F.col("event_type").alias("code"), F.floor("value").cast("int").alias("severity"))
    return reindex.findings(told, "click", 50).select("event_id", "severity")


@query("SELECT event_id, CAST(floor(value) AS INTEGER) AS severity FROM events ORDER BY severity DESC NULLS LAST, event_id LIMIT 25")
def flt_gravest_diagnostics(spark, sf):
    told = table(spark, sf, "events").select("event_id", F.col("event_type").alias("code"), F.floor("value").cast("int").alias("severity"))
    return reindex.findings(told, limit=25, ties=("event_id",)).select("event_id", "severity")


@query("SELECT conv_id, turn FROM conversations WHERE lower(trim(coalesce(role, ''))) NOT IN ('system', 'assistant')")
def flt_open_threads(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.lit("Task").alias("type"), F.create_map(F.lit("status"), F.col("role")).alias("properties"))
    return reindex.open_memories(rows, ("Task",), ("system", "assistant")).select("conv_id", "turn")


# Scalars --------------------------------------------------------------------------


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'public ' || p_brand || ' ' || p_name || '(' || p_type || ')' WHEN p_size % 3 = 1 THEN p_brand || ' ' || p_name ELSE 'class ' || p_name END AS line FROM part")
def scl_signature(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, "Method").when(F.col("p_size") % 3 == 1, "Property").otherwise("Class")
    given = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("modifiers"), F.lit(" public"), F.lit("returnType"), F.col("p_brand"), F.lit("parameters"), F.col("p_type"))).when(
        F.col("p_size") % 3 == 1, F.create_map(F.lit("returnType"), F.col("p_brand"))
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.signature(kind, F.col("p_name"), given).alias("line"))


@query("SELECT o_orderkey AS id, CAST(least(greatest(CASE WHEN regexp_full_match(o_orderpriority, '\\d+') THEN CAST(o_orderpriority AS BIGINT) ELSE 15 END, 1), 100) AS BIGINT) AS n, CAST(least(greatest(CAST(o_orderkey AS BIGINT), 1), 100) AS BIGINT) AS m FROM orders")
def scl_lenient_number(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), tx.lenient_number(F.col("o_orderpriority"), 15, 1, 100, whole=True).alias("n"), tx.lenient_number(F.col("o_orderkey").cast("string"), 15, 1, 100, whole=True).alias("m")
    )


@query("SELECT p_partkey AS id, p_size % 4 IN (0, 1) AS meta, p_size % 4 = 0 AS kept_out FROM part")
def scl_evaluation_meta(spark, sf):
    path = F.when(F.col("p_size") % 4 == 0, "x\\Tickets\\a.md").when(F.col("p_size") % 4 == 1, "bench/n.MD").when(F.col("p_size") % 4 == 2, "bench/n.cs").otherwise("mytickets/a.md")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.is_evaluation_meta(path).alias("meta"), tx.is_evaluation_meta(path, indexed=False).alias("kept_out"))


@query("SELECT p_partkey AS id, p_brand AS a, CAST(1 AS BIGINT) AS size FROM part")
def scl_json_map(spark, sf):
    back = tx.map_from_json(tx.map_to_json(F.create_map(F.lit("a"), F.col("p_brand"))))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), back["a"].alias("a"), F.size(back).cast("long").alias("size"))


@query("SELECT p_partkey AS id, substr(md5(p_name), 1, 8) || '-' || substr(md5(p_name), 9, 4) || '-' || substr(md5(p_name), 13, 4) || '-' || substr(md5(p_name), 17, 4) || '-' || substr(md5(p_name), 21) AS guid FROM part")
def scl_guid(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.guid(F.concat(F.lit("see {"), F.upper(F.md5("p_name")), F.lit("}."))).alias("guid"))


@query("SELECT url, CASE WHEN starts_with(url, 'https://') THEN '@/' || substr(url, 8) ELSE url END AS short FROM pages")
def scl_handle(spark, sf):
    return table(spark, sf, "pages").select("url", tx.handle(F.col("url"), "https:/").alias("short"))


@query("SELECT p_partkey AS id, '[' || p_name || ' @ ' || p_brand || '.cs:' || p_size || '-' || (p_size + 5) || ']' AS cite, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS kind, 'csharp' AS language FROM part")
def scl_citation(spark, sf):
    path = F.concat(F.lit("src/x/"), "p_brand", F.lit(".cs"))
    size = F.col("p_size").cast("int")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), tx.citation(F.col("p_name"), path, size, size + 5).alias("cite"), tx.capitalise(F.col("p_type")).alias("kind"), tx.language_of(path).alias("language")
    )


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[[:cntrl:]]', ' ', 'g')), 1, 200) AS line FROM documents")
def scl_fence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fence(F.col("text")).alias("line"))


@query(
    r"""SELECT doc_id, g1 || CASE WHEN g2 <> g1 THEN ' ' || g2 ELSE '' END AS guids FROM (SELECT doc_id, regexp_replace(m, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS g1,
    regexp_replace(md5(lang), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS g2 FROM (SELECT *, md5(text) AS m FROM documents))"""
)
def scl_guids(spark, sf):
    text = F.concat(F.lit("{"), F.upper(F.md5("text")), F.lit("} and "), tx.guid(F.md5("lang")), F.lit(", again "), F.md5("text"))
    found = table(spark, sf, "documents").select("doc_id", tx.guids(text).alias("guids"))
    return found.select("doc_id", F.array_join("guids", " ").alias("guids"))


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'See [' || source || ' @ x]' ELSE 'See [' || upper(source) || ' @ x] and [Other @ y] and [OTHER @ z]' || chr(10) || chr(10) || 'Not among the sources: Other' END AS answer FROM documents"""
)
def scl_annotate(spark, sf):
    source = F.col("source")
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("See ["), source, F.lit(" @ x]"))).otherwise(F.concat(F.lit("See ["), F.upper(source), F.lit(" @ x] and [Other @ y] and [OTHER @ z]")))
    return table(spark, sf, "documents").select("doc_id", evals.annotate(answer, F.array("source")).alias("answer"))


@query("SELECT 'docs/' || source || '/' || lang AS file_path, count(*) AS results FROM documents WHERE n_chars > 1000 AND (source LIKE 'src1_' OR lang = 'de') GROUP BY 1")
def agg_contamination(spark, sf):
    docs = table(spark, sf, "documents")
    nodes = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("docs/"), "source", F.lit("/"), "lang").alias("file_path"))
    return evals.contamination(docs.where("n_chars > 1000").select(F.col("doc_id").alias("id")), nodes, ["docs/src1?/*", "*/de"])


# Answers --------------------------------------------------------------------------


# The answers as they are made below: brands and names in small letters or not, a case in four abstained, one in four without an answer.
_ANSWERS = """WITH t AS (SELECT p_size % 4 AS k, p_brand, p_name, p_partkey FROM part),
    a AS (SELECT k = 0 AS abstained, k <> 3 AS answerable, CASE WHEN k = 0 THEN 0 ELSE 1 + CAST(k = 2 AS INTEGER) END AS cited, CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END AS valid,
      CASE WHEN k = 2 OR (k = 1 AND p_partkey % 2 = 0) THEN 1 ELSE 0 END AS got, CASE WHEN k = 0 THEN 1 ELSE 2 END AS paras, CASE WHEN k = 2 THEN 0 ELSE 1 END AS uncited,
      2 AS checks, CAST(k = 0 AS INTEGER) + CAST(k <> 2 AS INTEGER) AS passed FROM t)"""


@query(
    f"""{_ANSWERS} SELECT round(sum(valid) FILTER (answerable) / sum(cited) FILTER (answerable), 9) AS citation_validity, round(sum(got) FILTER (answerable) / count(*) FILTER (answerable), 9) AS must_cite_recall,
    round(sum(uncited) FILTER (answerable) / sum(paras) FILTER (answerable), 9) AS uncited_rate, CASE WHEN count(*) FILTER (NOT answerable) = 0 THEN 0 ELSE round(count(*) FILTER (abstained AND NOT answerable) / count(*) FILTER (NOT answerable), 9) END AS abstention_recall,
    round(count(*) FILTER (abstained AND NOT answerable) / count(*) FILTER (abstained), 9) AS abstention_precision, round(sum(passed) / sum(checks), 9) AS content_check_rate FROM a"""
)
def agg_groundedness(spark, sf):
    k, brand = F.col("p_size") % 4, F.lower("p_brand")
    cite = F.concat(F.lit("["), F.when(k == 3, F.lit("Unknown")).otherwise(brand), F.lit(" @ a.cs:1-2]"))
    answer = F.when(k == 0, F.lit("I cannot tell.")).when(k == 2, F.concat(F.lit("One "), cite, F.lit("\n\nTwo [Other @ b.cs:1]"))).otherwise(F.concat(F.lit("One "), cite, F.lit("\n\nTwo.")))
    # Part of a cited name will do: a brand without its last sign, and where the key is odd a name that is nowhere.
    must = F.when((k == 1) & (F.col("p_partkey") % 2 == 1), F.lit("nowhere")).otherwise(F.upper(F.expr("left(p_brand, length(p_brand) - 1)")))
    answers = table(spark, sf, "part").select(
        answer.alias("answer"), F.array("p_brand", "p_type").alias("valid_names"), F.array(must, F.lit("absent")).alias("must_cite"), (k == 0).alias("abstained"), (k != 3).alias("answerable"),
        F.array(F.lit("CANNOT")).alias("must_contain"), F.array(F.lit("other")).alias("must_not_contain"),
    )
    found = evals.groundedness(answers)
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


_SHARED = r"list_distinct(regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}]{{3,}})', 1))"
_BOTH_SHARED = f"CAST(len(list_intersect({_SHARED.format('a.text')}, {_SHARED.format('b.text')})) AS INTEGER)"


@query(f"SELECT CAST(a.conv_id AS VARCHAR) || ':' || a.turn AS case_id, {_BOTH_SHARED} AS shared FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE {_BOTH_SHARED} > 4")
def agg_circularity(spark, sf):
    turns = table(spark, sf, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("document"))
    cases = turns.join(after, ["conv_id", "turn"]).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), F.col("text").alias("query"), "document")
    return evals.circular_cases(cases)


# Walks with what lies along them ----------------------------------------------------


@query(
    oracle(
        """, goal AS (SELECT min(c_custkey) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)
        SELECT 0 AS step, 'R:1' AS id, CAST(NULL AS VARCHAR) AS relationship, CAST(NULL AS BOOLEAN) AS forward
        UNION ALL SELECT 1, 'N:' || c_nationkey, 'BELONGS_TO_MODULE', FALSE FROM customer, goal WHERE c_custkey = c
        UNION ALL SELECT 2, 'C:' || c, 'CONTAINS', TRUE FROM goal"""
    )
)
def grf_shortest_path(spark, sf):
    nodes, edges = _graph(spark, sf)
    home = table(spark, sf, "customer").join(table(spark, sf, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    goal = f"C:{home.agg(F.min('c_custkey')).first()[0]}"
    path = traverse.shortest_path(nodes, edges, "R:1", goal, 3)
    return spark.createDataFrame([(k, p["id"], p["relationship"], p["forward"]) for k, p in enumerate(path)], "step int, id string, relationship string, forward boolean")


@query(
    oracle(
        """, c AS (SELECT c_name AS w FROM customer WHERE c_custkey = 1)
        SELECT e.source AS id, relationship, provenance, CASE WHEN n.start_line % 2 = 0 THEN 'uses ' || w || ' here' END AS line FROM edges e JOIN nodes n ON n.id = e.source, c
        WHERE target = 'C:1' AND relationship NOT IN ('CONTAINS', 'BELONGS_TO_MODULE')"""
    )
)
def grf_find_usages(spark, sf):
    nodes, edges = _graph(spark, sf)
    name = table(spark, sf, "customer").where("c_custkey = 1").first()["c_name"]
    body = F.when(F.col("start_line") % 2 == 0, F.lit(f"first\n  uses {name} here  \nlast {name}")).otherwise("nothing")
    return traverse.find_usages(nodes.withColumn("content", body), edges, "C:1")


@query("SELECT doc_id, CAST(ceil(n_chars / 3.5) AS INTEGER) AS tokens FROM documents")
def scl_tokens_of_chars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.tokens_of_chars(F.col("n_chars")).alias("tokens"))


@query("SELECT DISTINCT 'Class' || CAST(p_size AS VARCHAR) AS type_name, 'f' || CAST(p_partkey AS VARCHAR) || '.cs::Own' AS node_id FROM part")
def src_csharp_references(spark, sf):
    """The types that parsed code names, by node: the parser's properties, read back as references."""
    code = F.concat(F.lit("class Own { // Not\n  Class"), F.col("p_size").cast("string"), F.lit(' x = null; string s = "Nor"; }'))
    files = table(spark, sf, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".cs")).alias("path"), code.alias("text"))
    nodes = parsers.nodes_of(parsers.parse_files(files, {".cs": parsers.parse_csharp}), properties=True)
    return store.type_references(nodes).select("type_name", "node_id")
