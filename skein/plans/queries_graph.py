"""Queries of walks, measures, links, search and the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import analytics, evals, fusion, linking, search, segments, store, substrings, traverse, vector_index, vectors
from skein.plans import stored
from skein.plans.queries import _graph, query
from skein.sources import driver_graph, files, parsers
from skein.sources.driver_graph import oracle, table
from skein.streaming import loops

# Walks -------------------------------------------------------------------------


@query(oracle(" SELECT source AS u, target AS v, relationship, provenance, true AS forward FROM edges UNION ALL SELECT target, source, relationship, provenance, false FROM edges"))
def grf_adjacency(spark, sf):
    """Stores the graph for walks, if this session has not yet, and returns its arcs."""
    return stored.walks(spark, sf)[1].leaving(None).drop("v_bucket")


_BOTH = ", arcs AS (SELECT source AS u, target AS v FROM edges UNION ALL SELECT target, source FROM edges)"
_USED = "relationship NOT IN ('CONTAINS', 'BELONGS_TO_MODULE')"


def _walk(start: str, step: str, depth: int) -> str:
    """A recursive expression ``walk(id, depth)``: ``step`` gives (u, v)."""
    return f", s AS ({step}), walk(id, depth) AS (SELECT {start}, 0 UNION SELECT s.v, depth + 1 FROM walk JOIN s ON s.u = walk.id WHERE depth < {depth})"


_REGION = f", walk(id, depth) AS (SELECT 'R:1', 0 UNION SELECT arcs.v, depth + 1 FROM walk JOIN arcs ON arcs.u = walk.id WHERE depth < 2), found AS (SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id)"


@query(oracle(f"{_BOTH}{_REGION} SELECT n.id, n.type, n.name, f.depth FROM found f JOIN nodes n USING (id)"))
def grf_subgraph_nodes(spark, sf):
    nodes, edges = stored.walks(spark, sf)
    return traverse.subgraph(nodes, edges, ["R:1"], 2)[0].select("id", "type", "name", "depth")


@query(oracle(f"{_BOTH}{_REGION}, k AS (SELECT id FROM found WHERE id IN (SELECT id FROM nodes)) SELECT * FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)"))
def grf_subgraph_edges(spark, sf):
    nodes, edges = stored.walks(spark, sf)
    return traverse.subgraph(nodes, edges, ["R:1"], 2)[1]


@query(
    oracle(
        _walk("'S:1'", f"SELECT target AS u, source AS v, relationship FROM edges WHERE {_USED}", 2)
        + """, f AS (SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id)
        SELECT f.id, f.depth, (SELECT min(s.relationship) FROM s JOIN f g ON g.id = s.u WHERE s.v = f.id AND g.depth = f.depth - 1) AS relation FROM f WHERE f.depth > 0"""
    )
)
def grf_impact(spark, sf):
    return traverse.impact(*stored.walks(spark, sf), ["S:1"], 2)


_BLAST_STEPS = f", s AS (SELECT target AS u, source AS v, min(provenance) AS p FROM edges WHERE {_USED} AND source <> target GROUP BY 1, 2)"
_BLAST = f"""{_BLAST_STEPS},
walk(id, depth, tier) AS (SELECT 'S:1', 0, 0 UNION SELECT s.v, depth + 1, greatest(tier, p) FROM walk JOIN s ON s.u = walk.id WHERE depth < 5)
SELECT id, CAST(min(depth) AS INTEGER) AS depth, CAST(min(tier) AS INTEGER) AS tier FROM walk WHERE id <> 'S:1' GROUP BY id"""


@query(oracle(_BLAST))
def grf_blast_radius(spark, sf):
    return traverse.blast_radius(stored.walks(spark, sf)[1], ["S:1"], 5).found


@query(
    oracle(
        f"""{_BLAST_STEPS}, walk(id, depth, tier) AS (SELECT 'S:1', 0, 0 UNION SELECT s.v, depth + 1, greatest(tier, p) FROM walk JOIN s ON s.u = walk.id WHERE depth < 2)
        SELECT DISTINCT source, target, relationship, provenance FROM edges JOIN walk ON id = target WHERE depth < 2 AND {_USED} AND source <> target"""
    )
)
def grf_blast_radius_edges(spark, sf):
    return traverse.blast_radius(stored.walks(spark, sf)[1], ["S:1"], 2).walked


@query(oracle(_walk("'P:1'", "SELECT target AS u, source AS v FROM edges WHERE relationship = 'CALLS'", 3) + " SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE id <> 'P:1' GROUP BY id"))
def grf_call_hierarchy(spark, sf):
    return traverse.call_hierarchy(*stored.walks(spark, sf), "P:1", "callers", 3)


@query(
    oracle(
        _walk("(SELECT min(id) FROM nodes WHERE type = 'Order')", "SELECT source AS u, target AS v FROM edges WHERE relationship IN ('REFERENCES_TYPE', 'IMPLEMENTS', 'EXTENDS')", 2)
        + " SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE id <> (SELECT min(id) FROM nodes WHERE type = 'Order') GROUP BY id"
    )
)
def grf_dependency_tree(spark, sf):
    nodes, edges = stored.walks(spark, sf)
    seed = nodes.where("type = 'Order'").agg(F.min("id")).first()[0]
    return traverse.dependency_tree(edges, seed, 2)


@query(
    oracle(
        f""" SELECT relationship, source AS other, e.provenance, n.name AS other_name, count(*) OVER (PARTITION BY relationship) AS group_size
        FROM edges e LEFT JOIN nodes n ON n.id = e.source WHERE target = 'C:1' AND {_USED}"""
    )
)
def grf_direct_references(spark, sf):
    nodes, edges = _graph(spark, sf)
    return traverse.direct_references(nodes, edges, "C:1").select("relationship", "other", "provenance", "other_name", "group_size")


@query(oracle(" SELECT source AS id, relationship FROM edges WHERE target = '1-URGENT' AND relationship IN ('EXTENDS', 'IMPLEMENTS')"))
def grf_implementations(spark, sf):
    return traverse.implementations_of(driver_graph.edges(spark, sf), "1-URGENT")


@query(
    oracle(
        _walk("'S:1'", f"SELECT target AS u, source AS v FROM edges WHERE {_USED}", 3)
        + ", f AS (SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id) SELECT f.id, f.depth, n.name, n.file_path FROM f JOIN nodes n USING (id) WHERE depth > 0 AND contains(lower(file_path), 'test')"
    )
)
def grf_related_tests(spark, sf):
    return traverse.related_tests(*stored.walks(spark, sf), "S:1", 3)


@query(
    oracle(
        """, s AS (SELECT target AS u, source AS v FROM edges WHERE relationship IN ('REFERENCES_TYPE', 'IMPLEMENTS', 'EXTENDS', 'CALLS')),
        walk(id, depth) AS (SELECT id, 0 FROM nodes WHERE file_path = 'src/supply/suppliers.cs' UNION SELECT s.v, depth + 1 FROM walk JOIN s ON s.u = walk.id WHERE depth < 2)
        SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id HAVING min(depth) > 0"""
    )
)
def grf_review_impact(spark, sf):
    return traverse.review_impact(*stored.walks(spark, sf), ["src/supply/suppliers.cs"], 2)


@query(oracle(f" SELECT n.file_path, count(*) AS sites, (SELECT count(*) FROM nodes WHERE name = 'FRANCE') AS collisions FROM edges e JOIN nodes n ON n.id = e.source WHERE target = 'C:1' AND {_USED} GROUP BY 1"))
def grf_rename_plan(spark, sf):
    return traverse.rename_plan(*_graph(spark, sf), "C:1", "FRANCE")


@query(oracle(" SELECT 'N:1' AS id, CAST(0 AS INTEGER) AS depth, name, start_line FROM nodes WHERE id = 'N:1' UNION ALL SELECT target, 1, n.name, n.start_line FROM edges JOIN nodes n ON n.id = target WHERE source = 'N:1' AND relationship = 'CONTAINS'"))
def grf_outline(spark, sf):
    return traverse.outline(*stored.walks(spark, sf), "N:1")


@query(
    oracle(
        """ SELECT source, target, relationship, provenance, CASE WHEN source = 'O:1' THEN target ELSE source END AS other, n.name AS other_name, n.name IS NULL AS dangling
        FROM edges e LEFT JOIN nodes n ON n.id = CASE WHEN source = 'O:1' THEN target ELSE source END WHERE 'O:1' IN (source, target)"""
    )
)
def jon_incident_edges(spark, sf):
    found = traverse.incident(*_graph(spark, sf), "O:1")
    return found.select("source", "target", "relationship", "provenance", "other", "other_name", "dangling")


@query(oracle(" SELECT * FROM edges WHERE source IN (SELECT id FROM nodes WHERE type IN ('Order', 'Customer')) AND target IN (SELECT id FROM nodes WHERE type IN ('Order', 'Customer'))"))
def jon_edges_between(spark, sf):
    nodes, edges = _graph(spark, sf)
    return traverse.edges_among(edges, nodes.where(F.col("type").isin("Order", "Customer")))


# Measures ------------------------------------------------------------------------


# Links of the whole graph, couplings only; a component's name spreads from the nodes whose name got smaller.
_LINKS = f", links AS (SELECT source AS a, target AS b FROM edges WHERE {_USED} AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))"
_COMPONENTS = f"""{_LINKS}, arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
cc(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION
  SELECT r.id, min(u.component) FROM cc u JOIN arcs ON u.id = arcs.a JOIN recurring.cc r ON r.id = arcs.b WHERE u.component < r.component GROUP BY r.id)"""


@query(oracle(f"{_COMPONENTS} SELECT id, component FROM cc"))
def grf_components(spark, sf):
    return analytics.connected_components(*_graph(spark, sf))


@query(oracle(f"{_COMPONENTS} SELECT component, count(*) AS size, array_to_string(list_slice(list_sort(list(id)), 1, 10), ',') AS first_members FROM cc GROUP BY component"))
def agg_cluster_sizes(spark, sf):
    return analytics.cluster_sizes(grf_components(spark, sf))


# Shortest paths between all pairs are too slow in SQL on whole tables; tests hold these against brute force.


@query()
def grf_betweenness(spark, sf):
    found = analytics.betweenness(*_graph(spark, sf))
    return found.select("id", F.round("betweenness", 6).alias("betweenness"), "degree")


@query()
def grf_betweenness_sampled(spark, sf):
    """Off by 0.02 of all pairs at most, but for a chance of 0.1 (``within`` says how far each)."""
    found = analytics.sampled_betweenness(*_graph(spark, sf))
    return found.select("id", F.round("betweenness", 3).alias("betweenness"), F.round("within", 3).alias("within"), "degree")


@query()
def rnk_hotspots(spark, sf):
    return analytics.hotspots(grf_betweenness(spark, sf))


@query()
def grf_communities(spark, sf):
    return analytics.modularity_communities(*_graph(spark, sf))


# Search ------------------------------------------------------------------------


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("name"), F.col("lang").alias("type"))


_FTS_COLUMNS = ["content", "name"]


def _index(spark, sf):
    """The stored index of the documents."""
    path = stored.kept(spark, sf, "postings", lambda folder: segments.write_index(_docs(spark, sf), _FTS_COLUMNS, folder))
    return stored.opened(path, lambda: segments.open_index(spark, path, 1))


_TOKENS = r"regexp_extract_all(strip_accents(lower(concat_ws(' ', text, source))), '([\p{L}\p{N}]+)', 1)"


def _bm25(terms: list[str], extra: str = "") -> str:
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS t{k}" for k, t in enumerate(terms))
    score = " + ".join(
        f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * dl / mean))" for k in range(len(terms))
    )
    return f"""WITH p AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents), c AS (SELECT id, len(w) AS dl, {tf} FROM p),
    s AS (SELECT count(*) AS n, avg(dl) AS mean, {', '.join(f'count(*) FILTER (t{k} > 0) AS d{k}' for k in range(len(terms)))} FROM c),
    hits AS (SELECT id, {score} AS score FROM c, s WHERE {' AND '.join(f't{k} > 0' for k in range(len(terms)))}){extra}"""


@query(_bm25(["the", "only"]) + " SELECT id, round(score, 9) AS score FROM hits ORDER BY score DESC, id LIMIT 20")
def fts_bm25(spark, sf):
    found = search.search(_docs(spark, sf), "the only", 20, columns=_FTS_COLUMNS, index=_index(spark, sf))
    return found.select("id", F.round("score", 9).alias("score"))


@query(_bm25(["the", "only"]) + " SELECT id, round(score, 9) AS score FROM hits")
def fts_bm25_all(spark, sf):
    return search.bm25(_docs(spark, sf), "the only", _FTS_COLUMNS).select("id", F.round("score", 9).alias("score"))


_WORDS = f"WITH d AS (SELECT doc_id AS id, {_TOKENS} AS w, regexp_extract_all(strip_accents(lower(source)), '([\\p{{L}}\\p{{N}}]+)', 1) AS s, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '([\\p{{L}}\\p{{N}}]+)', 1), ' ') || ' ' AS line FROM documents)"


@query(f"{_WORDS} SELECT 'rows' AS what, count(*) AS n FROM d UNION ALL SELECT 'words', CAST(sum(len(w)) AS BIGINT) FROM d UNION ALL SELECT 'terms', count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM d)")
def fts_index(spark, sf):
    """Builds the stored index, if this session has none yet, and counts what is in it."""
    index = _index(spark, sf)
    terms = index._read("blocks", (f"seg={s.name}" for s in index.manifest.segments)).agg(F.countDistinct("term").alias("terms"))
    told = index.lengths().agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("words")).crossJoin(terms)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("n")) for c in ("rows", "words", "terms"))))
    return told.select(pairs.alias("p")).select("p.what", "p.n")


@query(
    f"""{_WORDS} SELECT id FROM d WHERE
    ((list_contains(w, 'the') AND list_contains(w, 'only') AND NOT list_contains(w, 'and')) OR line LIKE '% die und %' OR len(list_filter(s, lambda x: starts_with(x, 'src1'))) > 0)
    AND NOT line LIKE '% of the %'"""
)
def fts_language(spark, sf):
    query = '((the only NOT and) OR "die und" OR name: src1*) NOT (die NOT die OR of + the)'
    return search.bm25(_docs(spark, sf), query, _FTS_COLUMNS, index=_index(spark, sf)).select("id")


_CHANGED = "(SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' the only' ELSE text END AS text, source FROM documents WHERE source <> 'src1' OR source IS NULL)"


@query(_bm25(["the", "only"]).replace("FROM documents)", f"FROM {_CHANGED})", 1) + " SELECT id, round(score, 9) AS score FROM hits")
def snk_refresh_index(spark, sf):
    """The stored index after a source went and a language changed: the next version, of two segments."""
    index, docs = _index(spark, sf), _docs(spark, sf)
    known = segments.versions(spark, index.path)
    if len(known) == 1:
        coming = docs.where("type = 'de' AND (name <> 'src1' OR name IS NULL)").withColumn("content", F.concat("content", F.lit(" the only")))
        segments.refresh(index, docs.where("name = 'src1'").select("id"), coming)
    latest = segments.open_index(spark, index.path)
    return search.bm25(docs, "the only", _FTS_COLUMNS, index=latest).select("id", F.round("score", 9).alias("score"))


@query("SELECT doc_id AS id, CAST(1 AS DOUBLE) AS score FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 20 OFFSET 5")
def fts_match_all(spark, sf):
    return search.search(_docs(spark, sf), "*", 20, 5, kind="de")


@query("SELECT doc_id AS id, CAST(1 AS DOUBLE) AS score FROM documents WHERE text ILIKE '%the. on%' OR source ILIKE '%the. on%'")
def fts_like(spark, sf):
    return search.like(_docs(spark, sf), "the. on", ["content", "name"])


@query("SELECT doc_id AS id, CAST(1 AS DOUBLE) AS score FROM documents WHERE text ILIKE '%only_th%' OR source ILIKE '%only_th%'")
def fts_like_indexed(spark, sf):
    path = stored.kept(spark, sf, "grams", lambda folder: substrings.write_grams(_docs(spark, sf), ["content", "name"], folder))
    return search.like(_docs(spark, sf), "only_th", ["content", "name"], grams=substrings.Grams(spark, path))


@query(oracle(" SELECT n.id, source, target, relationship FROM nodes n JOIN edges ON n.id = source OR n.id = target WHERE n.type = 'Nation'"))
def fts_attach_edges(spark, sf):
    nodes, edges = _graph(spark, sf)
    return search.attach_edges(nodes.where("type = 'Nation'"), edges)


# Vectors ------------------------------------------------------------------------


def _probe(spark, sf) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]]


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_SELF = "embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"SELECT vec_id AS id, round({_COS}, 5) AS score FROM {_SELF} WHERE {_COS} > 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vec_nearest(spark, sf):
    return vectors.nearest(_vectors(spark, sf), _probe(spark, sf), 10).select("id", F.round("score", 5).alias("score"))


@query(f"SELECT CAST(count(*) FILTER ({_COS} >= 0.2) AS BIGINT) AS strong, CAST(count(*) FILTER ({_COS} > 0 AND {_COS} < 0.2) AS BIGINT) AS weak FROM {_SELF}")
def vec_floor(spark, sf):
    scored = _vectors(spark, sf).select(vectors.cosine(F.col("embedding"), F.array(*map(F.lit, _probe(spark, sf)))).alias("s"))
    return scored.agg(F.count_if(F.col("s") >= 0.2).alias("strong"), F.count_if((F.col("s") > 0) & (F.col("s") < 0.2)).alias("weak"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE b.vec_id <> a.vec_id + 1 AND {_COS} >= 0.35")
def vec_surprising_pairs(spark, sf):
    rows = _vectors(spark, sf)
    linked = rows.select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    return vectors.surprising_pairs(rows, linked, 0.35).select("a", "b", F.round("score", 5).alias("score"))


def _vector_index(spark, sf):
    """The stored index of the embeddings."""
    path = stored.kept(spark, sf, "vectors", lambda folder: vector_index.write_vectors(_vectors(spark, sf), folder))
    return stored.opened(path, lambda: vector_index.VectorIndex(spark, path))


@query()
def vec_indexed_neighbours(spark, sf):
    """About the ten nearest of every row whose id is divisible by 20 (approximate, so no SQL; its recall is held below and in tests)."""
    queries = _vectors(spark, sf).where("id % 20 = 0")
    return _vector_index(spark, sf).search_many(queries, 10).select("query", "id", F.round("score", 5).alias("score"))


@query("SELECT least(count(*), 500) AS queries, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vec_index_recall(spark, sf):
    """Whether a search finds at least 0.9 of the exact ten best, over the first 500 such rows at most."""
    queries = _vectors(spark, sf).where("id % 20 = 0").orderBy("id").limit(500)
    return _vector_index(spark, sf).recall(queries, 10).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS length FROM embeddings")
def vec_lengths(spark, sf):
    return _vectors(spark, sf).select("id", F.round(vectors.norm(F.col("embedding")), 5).alias("length"))


@query(oracle(" , x AS (SELECT DISTINCT i, name FROM (SELECT source AS i, target AS o FROM edges UNION ALL SELECT target, source FROM edges) JOIN nodes ON nodes.id = o WHERE i <> o AND i LIKE 'N:%'), y AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY name) AS rn FROM x) SELECT i AS id, string_agg(name, ',' ORDER BY name) AS names FROM y WHERE rn <= 25 GROUP BY i"))
def vec_concept_neighbours(spark, sf):
    return linking.concept_neighbours(*_graph(spark, sf), 25, "Nation")


@query(
    """SELECT doc_id AS id, sha256(concat_ws(chr(10), lang || ' ' || source, CASE WHEN length(text) <= 1500 THEN text ELSE substr(text, 1, 900) || chr(10) || '…' || chr(10) || right(text, 600) END)) AS document FROM documents"""
)
def vec_embedding_document(spark, sf):
    doc = tx.embedding_document(F.col("lang"), F.col("source"), F.lit(""), F.lit(""), F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(doc, 256).alias("document"))


@query()
def vec_embedding_document_by_tokens(spark, sf):
    """Documents as they are embedded, within 375 tokens (a search for the cut, so no SQL; held against plain code in tests)."""
    doc = tx.embedding_document_by_tokens(F.col("lang"), F.col("source"), F.lit(""), F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(doc, 256).alias("document"))


@query(oracle(" , x AS (SELECT DISTINCT i, name FROM (SELECT source AS i, target AS o FROM edges UNION ALL SELECT target, source FROM edges) JOIN nodes ON nodes.id = o WHERE i <> o AND i LIKE 'N:%'), y AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY name) AS rn FROM x) SELECT i AS id, 'Concept ' || i || chr(10) || 'Related: ' || string_agg(name, ', ' ORDER BY name) AS document FROM y WHERE rn <= 25 GROUP BY i"))
def vec_concept_document(spark, sf):
    near = linking.concept_neighbours(*_graph(spark, sf), 25, "Nation")
    return near.select("id", tx.concept_document(F.col("id"), F.lit(None).cast("string"), F.split("names", ",")).alias("document"))


# Fusion and budgets ------------------------------------------------------------------


@query(
    _bm25(["the", "only"])
    + """, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM hits ORDER BY rank LIMIT 40),
    b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 40)
    SELECT id, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY id ORDER BY sum(1 / (60.0 + rank)) DESC, min(l), min(rank) LIMIT 20"""
)
def rnk_fusion(spark, sf):
    docs = table(spark, sf, "documents")
    first = fusion.ranked(search.search(_docs(spark, sf), "the only", 40, columns=_FTS_COLUMNS, index=_index(spark, sf)))
    second = fusion.ranked(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(40))
    return fusion.reciprocal_rank_fusion([first, second], 20).select("id", F.round("score", 9).alias("score"))


@query(
    """WITH r AS (SELECT source, doc_id, floor(n_chars / 4) AS t, row_number() OVER w AS rn, sum(floor(n_chars / 4)) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    e AS (SELECT *, max(CASE WHEN used > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS ended FROM r)
    SELECT source, doc_id, CAST(rn AS INTEGER) AS rn, CAST(used AS BIGINT) AS used FROM e WHERE (ended = 0 OR rn = 1) AND rn <= 40"""
)
def rnk_within_budget(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 4).alias("t"))
    return fusion.within_budget(docs, ["source"], ["doc_id"], "t", 4000).select("source", "doc_id", "rn", "used")


@query(oracle(", d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id), r AS (SELECT n.id, coalesce(degree, 0) AS degree, file_path FROM nodes n LEFT JOIN d USING (id)) SELECT id, degree FROM r WHERE id IN ('R:1', 'N:1') UNION ALL SELECT * FROM (SELECT id, degree FROM r WHERE id NOT IN ('R:1', 'N:1') ORDER BY degree DESC, file_path, id LIMIT 38)"))
def rnk_cap_nodes(spark, sf):
    return fusion.cap_nodes(*_graph(spark, sf), ["R:1", "N:1"], 40)


# Links ------------------------------------------------------------------------


_PARTS = ", refs AS (SELECT id AS node, content AS t FROM nodes WHERE type = 'Part'), defs AS (SELECT content AS t, id FROM nodes WHERE type = 'Part')"


@query(
    oracle(
        f"""{_PARTS}, c AS (SELECT t, count(*) AS n FROM defs GROUP BY t)
        SELECT DISTINCT node AS source, defs.id AS target, 'REFERENCES_TYPE' AS relationship, CASE WHEN n > 1 THEN 2 ELSE 1 END AS provenance FROM refs JOIN defs USING (t) JOIN c USING (t) WHERE node <> defs.id"""
    )
)
def jon_link_references(spark, sf):
    parts = driver_graph.nodes(spark, sf).where("type = 'Part'")
    return linking.link_references(parts.select(F.col("content").alias("type_name"), F.col("id").alias("node_id")), parts.withColumn("name", F.col("content")), ("Part",))


@query(
    oracle(
        f"""{_PARTS}, p AS (SELECT DISTINCT node, defs.id, t FROM refs JOIN defs USING (t) WHERE node <> defs.id)
        SELECT DISTINCT node AS source, id AS target, 'REFERENCES_TYPE' AS relationship, CASE WHEN count(*) OVER (PARTITION BY node, t) > 1 THEN 2 ELSE 1 END AS provenance FROM p"""
    )
)
def jon_link_unresolved(spark, sf):
    parts = driver_graph.nodes(spark, sf).where("type = 'Part'")
    return linking.link_unresolved(parts.select(F.col("content").alias("type_name"), F.col("id").alias("enclosing_id")), parts.withColumn("name", F.col("content")), ("Part",))


@query(oracle(" SELECT DISTINCT a.id AS source, b.id AS target, 'BINDS_TO' AS relationship, 1 AS provenance FROM nodes a JOIN nodes b ON replace(lower(trim(a.name)), 'controller', '') = replace(lower(trim(b.name)), 'controller', '') WHERE a.type = 'Part' AND b.type = 'Part' AND trim(a.name) <> '' AND a.id <> b.id"))
def jon_bind_by_name(spark, sf):
    parts = driver_graph.nodes(spark, sf).where("type = 'Part'")
    return linking.bind_by_name(parts, parts)


@query(oracle(" SELECT a.id AS source, min(b.id) AS target FROM nodes a JOIN nodes b ON a.content = b.content WHERE a.type = 'Part' AND b.type = 'Part' GROUP BY 1"))
def jon_first_match(spark, sf):
    parts = driver_graph.nodes(spark, sf).where("type = 'Part'")
    return linking.first_match(parts, parts, F.col("content"), F.col("content"))


@query(
    oracle(
        """, w AS (SELECT id, 'Sys.' || name AS full_name, name AS t FROM nodes WHERE type IN ('Part', 'Nation')), d AS (SELECT name AS t, list_sort(list(DISTINCT id)) AS targets FROM nodes WHERE type = 'Nation' GROUP BY 1)
        SELECT w.id, full_name, CASE WHEN len(targets) = 1 THEN 'resolved' WHEN len(targets) > 1 THEN 'ambiguous' WHEN starts_with(full_name, 'Sys.b') THEN 'external' ELSE 'unresolved' END AS verdict,
        coalesce(array_to_string(targets, ','), '') AS targets FROM w LEFT JOIN d ON d.t = trim(string_split_regex(string_split(w.full_name, ',')[1], '[.+]')[-1])"""
    )
)
def jon_resolve_types(spark, sf):
    nodes = driver_graph.nodes(spark, sf)
    types = nodes.where(F.col("type").isin("Part", "Nation")).select("id", F.concat(F.lit("Sys."), "name").alias("full_name"))
    found = linking.resolve_types(types, nodes, ("Sys.b",), ("Nation",))
    return found.withColumn("targets", F.array_join("targets", ","))


@query(oracle(" SELECT DISTINCT source, target FROM edges WHERE target NOT IN (SELECT id FROM nodes) AND target <> '5-LOW'"))
def jon_dangling_targets(spark, sf):
    nodes, edges = _graph(spark, sf)
    return linking.dangling_targets(edges, nodes, denied=("5-LOW",))


@query(
    "SELECT o.o_orderkey AS chunk_id, e.event_id AS node_id FROM orders o JOIN events e ON o.o_custkey = e.user_id "
    "WHERE day(e.ts) <= day(o.o_orderdate) + 2 AND day(o.o_orderdate) <= day(e.ts) + 1"
)
def jon_overlapping_lines(spark, sf):
    day, seen = F.dayofmonth("o_orderdate"), F.dayofmonth("ts")
    chunks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_path"), day.alias("start_line"), (day + 2).alias("end_line"))
    spans = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("file_path"), seen.alias("start_line"), (seen + 1).alias("end_line"))
    return linking.overlapping_lines(chunks, spans)


@query(oracle(" SELECT r_regionkey AS case_id, r_name AS expected, id FROM region JOIN nodes ON contains(lower(id), lower(r_name)) OR lower(name) = lower(r_name)"))
def jon_golden_match(spark, sf):
    golden = table(spark, sf, "region").select(F.col("r_regionkey").alias("case_id"), F.col("r_name").alias("expected"))
    return evals.golden_match(golden, driver_graph.nodes(spark, sf))


@query(f"SELECT case_id, expected, 'D:' || doc_id AS id FROM (SELECT DISTINCT split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS expected, doc_id AS case_id FROM documents WHERE doc_id % 20 = 0 AND length(split_part(text, ' ', 2)) > 0) q JOIN documents d ON contains(lower(d.text), lower(expected))")
def jon_contained_texts(spark, sf):
    """Where the first two words of every document whose id is divisible by 20 stand, in all documents."""
    docs = table(spark, sf, "documents")
    words = F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))
    needles = docs.where((F.col("doc_id") % 20 == 0) & (F.length(words[1]) > 0)).select(F.struct(F.col("doc_id").alias("case_id"), F.concat_ws(" ", *words).alias("expected")).alias("needle_id"), F.concat_ws(" ", *words).alias("needle"))
    found = substrings.contained(needles, docs.select(F.concat(F.lit("D:"), "doc_id").alias("id"), "text"))
    return found.select("needle_id.case_id", "needle_id.expected", "id")


@query(
    """WITH e AS (SELECT user_id * 100 + hour(ts) AS query, event_id AS seq, event_type AS t, value >= 50 AS m, ts < TIMESTAMP '2024-01-15' AS early FROM events),
    a AS (SELECT query, arg_min(struct_pack(t := t, m := m), seq) AS s FROM e WHERE early GROUP BY 1), b AS (SELECT query, arg_min(struct_pack(t := t, m := m), seq) AS s FROM e WHERE NOT early GROUP BY 1)
    SELECT query, a.s.t AS before, b.s.t AS after, CASE WHEN NOT a.s.m AND b.s.m THEN 'fixed' WHEN a.s.m AND NOT b.s.m THEN 'broken' ELSE 'moved' END AS verdict FROM a JOIN b USING (query) WHERE a.s.t IS DISTINCT FROM b.s.t"""
)
def jon_compare_runs(spark, sf):
    events = table(spark, sf, "events")
    runs = events.select(F.col("event_id").alias("seq"), (F.col("user_id") * 100 + F.hour("ts")).alias("query"), F.col("event_type").alias("top1"), (F.col("value") >= 50).alias("matched"), (F.col("ts") < F.lit("2024-01-15").cast("timestamp")).alias("early"))
    return evals.compare_runs(runs.where("early"), runs.where("not early"))


@query(
    """WITH i AS (SELECT o_orderkey AS f, md5(o_orderpriority) AS h FROM orders WHERE o_orderpriority <> '5-LOW'), p AS (SELECT o_orderkey AS f, md5(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END) AS h FROM orders WHERE o_orderstatus <> 'P')
    SELECT coalesce(i.f, p.f) AS file_path, CASE WHEN i.f IS NULL THEN 'new' WHEN p.f IS NULL THEN 'deleted' WHEN i.h <> p.h THEN 'changed' ELSE 'fresh' END AS state FROM i FULL JOIN p ON i.f = p.f"""
)
def jon_drift(spark, sf):
    orders = table(spark, sf, "orders")
    was = orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("file_path"), F.md5("o_orderpriority").alias("content_hash"))
    text = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))
    return files.drift(was, orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("file_path"), F.md5(text).alias("content_hash")))


# The store ------------------------------------------------------------------------


def _snapshot(spark, sf):
    """Parts as enriched nodes, and a second reading of them in which some have changed."""
    part = table(spark, sf, "part")
    old = part.where("p_brand <> 'Brand#11'").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), F.md5("p_name").alias("content_hash"), F.col("p_brand").alias("summary"),
        F.array(F.col("p_retailprice").cast("float")).alias("embedding"), F.lit(1).alias("embedding_dim"), F.lit("m1").alias("embedding_model"), F.lit(False).alias("needs_analysis"),
    )
    text = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_name"))
    new = part.where("p_size <> 7").select(
        F.col("p_partkey").alias("id"), text.alias("content"), F.md5(text).alias("content_hash"), F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("int").alias("embedding_dim"), F.lit(None).cast("string").alias("embedding_model"), F.lit(True).alias("needs_analysis"),
    )
    return old, new


@query(
    """WITH o AS (SELECT p_partkey AS id, p_name AS c, p_brand AS s FROM part WHERE p_brand <> 'Brand#11'),
    n AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_type ELSE p_name END AS c FROM part WHERE p_size <> 7)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.c, o.c) AS content, CASE WHEN n.id IS NULL OR o.c = n.c THEN o.s END AS summary,
    CASE WHEN n.id IS NULL OR o.c = n.c THEN 'm1' END AS embedding_model, NOT coalesce(n.id IS NULL OR o.c = n.c, FALSE) AS needs_analysis FROM o FULL JOIN n ON o.id = n.id"""
)
def snk_upsert_nodes(spark, sf):
    return store.upsert_nodes(*_snapshot(spark, sf)).select("id", "content", "summary", "embedding_model", "needs_analysis")


@query(
    """SELECT 'P:' || l_partkey AS source, 'S:' || l_suppkey AS target, 'REFERENCES_TYPE' AS relationship, CAST(min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS INTEGER) AS provenance,
    max_by(CAST(l_orderkey AS VARCHAR), CASE WHEN l_linestatus = 'O' THEN l_orderkey * 10 + l_linenumber ELSE -1 END) FILTER (l_linestatus = 'O') AS last_order FROM lineitem GROUP BY 1, 2"""
)
def snk_upsert_edges(spark, sf):
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("P:"), "l_partkey").alias("source"), F.concat(F.lit("S:"), "l_suppkey").alias("target"), F.lit("REFERENCES_TYPE").alias("relationship"), flag.alias("provenance"),
        F.create_map(F.lit("order"), F.col("l_orderkey").cast("string")).alias("properties"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_linestatus",
    )
    nothing = F.lit(None).cast("map<string,string>")
    old = rows.where("l_linestatus <> 'O'").drop("seq", "l_linestatus").withColumn("properties", nothing)
    merged = store.upsert_edges(old, rows.where("l_linestatus = 'O'").drop("l_linestatus"))
    return merged.select("source", "target", "relationship", "provenance", F.col("properties")["order"].alias("last_order"))


@query("SELECT DISTINCT trim(t) AS type_name, p_partkey AS node_id FROM (SELECT p_partkey, unnest(string_split(p_type || ', ' || p_brand, ',')) AS t FROM part) WHERE trim(t) <> ''")
def snk_type_references(spark, sf):
    csv = F.concat_ws(", ", "p_type", "p_brand")
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file_path"), F.create_map(F.lit("referencedTypes"), csv).alias("properties"))
    return store.type_references(nodes).select("type_name", "node_id")


def _doomed(spark, sf):
    return driver_graph.nodes(spark, sf).where("file_path like 'src/sales/b%' or type = 'Supplier'").select("file_path").distinct()


_GONE = ", gone AS (SELECT id FROM nodes WHERE file_path LIKE 'src/sales/b%' OR type = 'Supplier')"


@query(oracle(f"{_GONE} SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM gone)"))
def snk_delete_files_nodes(spark, sf):
    return store.delete_files(*_graph(spark, sf), _doomed(spark, sf))[0].select("id")


@query(oracle(f"{_GONE} SELECT source, target, relationship, provenance FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)"))
def snk_delete_files_edges(spark, sf):
    return store.delete_files(*_graph(spark, sf), _doomed(spark, sf))[1]


@query(oracle(" SELECT source, target, relationship, provenance FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE file_path LIKE 'src/orders/%')"))
def snk_clear_for_reindex(spark, sf):
    nodes, edges = _graph(spark, sf)
    return store.clear_for_reindex(nodes, edges, nodes.where("file_path like 'src/orders/%'").select("file_path"))[1]


@query(oracle(" SELECT source, target, relationship, provenance FROM edges WHERE NOT (relationship = 'CALLS' AND source IN (SELECT id FROM nodes WHERE file_path = 'src/orders/tests.cs'))"))
def snk_delete_outgoing(spark, sf):
    nodes, edges = _graph(spark, sf)
    return store.delete_outgoing(nodes, edges, nodes.where("file_path = 'src/orders/tests.cs'").select("file_path"), "CALLS")


@query("SELECT event_type AS source, event_id AS code FROM events WHERE event_type <> 'error' UNION ALL SELECT 'error', user_id FROM events WHERE event_type = 'view'")
def snk_replace_diagnostics(spark, sf):
    events = table(spark, sf, "events")
    old = events.select(F.col("event_type").alias("source"), F.col("event_id").alias("code"))
    return store.replace_diagnostics(old, events.where("event_type = 'view'").select(F.col("user_id").alias("code")), "error")


@query("SELECT vec_id AS id, label <> 1 AS stale, (label = 1) AS kept FROM embeddings")
def snk_stale_embeddings(spark, sf):
    rows = _vectors(spark, sf).select("id", "embedding", F.col("label").alias("embedding_dim"), F.lit("m").alias("embedding_model"))
    return store.mark_stale_embeddings(rows, 1).select("id", "stale", F.col("embedding").isNotNull().alias("kept"))


@query(oracle(" SELECT id FROM nodes WHERE type <> 'Part' OR id IN (SELECT target FROM edges WHERE relationship = 'CALLS' AND provenance = 0)"))
def snk_prune_orphans(spark, sf):
    nodes, edges = _graph(spark, sf)
    concepts = nodes.withColumn("type", F.when(F.col("type") == "Part", "Concept").otherwise(F.col("type")))
    calls = edges.where("relationship = 'CALLS' and provenance = 0").withColumn("relationship", F.lit("RELATES_TO"))
    return store.prune_orphan_concepts(concepts, calls).select("id")


@query(oracle(" SELECT source, 'D:1' AS target, 'AFFECTS' AS relationship, 0 AS provenance FROM (SELECT unnest(['C:1', 'S:1', 'gone']) AS source) WHERE source IN (SELECT id FROM nodes)"))
def snk_record_memory(spark, sf):
    nodes, edges = _graph(spark, sf)
    there = spark.createDataFrame([("C:1",), ("S:1",), ("gone",)], "id string")
    record = {"id": "D:1", "type": "Decision", "name": "a", "content": "b"}
    return store.record_memory(nodes, edges, record, there)[1].where("target = 'D:1'")


@query(
    """SELECT 'concept_' || lower(event_type) AS target, CAST(user_id AS VARCHAR) AS source, 'RELATES_TO' AS relationship, 1 AS provenance FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2"""
)
def snk_semantic_update(spark, sf):
    events = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    nodes = events.select(F.col("user_id").cast("string").alias("id"), F.lit("User").alias("type"), F.lit("u").alias("name"), F.lit(None).cast("string").alias("summary")).distinct()
    analysis = events.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.lit("s").alias("summary"), F.collect_set("event_type").alias("concepts"))
    edges = spark.createDataFrame([], "source string, target string, relationship string, provenance int")
    return store.add_concepts(nodes, edges, analysis)[1].select("target", "source", "relationship", "provenance")


# Scalars ------------------------------------------------------------------------

_RUNS = r"regexp_extract_all(text, '([\p{L}\p{N}]+|[^\p{L}\p{N}\s])', 1)"


@query(
    rf"""SELECT doc_id, CAST(list_sum(list_transform({_RUNS}, lambda r: CASE WHEN NOT regexp_full_match(r, '[\p{{L}}\p{{N}}]+') THEN 1
    WHEN regexp_matches(r, '\p{{Nd}}') OR length(r) > 40 THEN length(r) ELSE ceil(length(r) / 4) END)) AS BIGINT) AS tokens FROM documents"""
)
def scl_token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed FROM documents")
def scl_squeeze(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.squeeze(F.col("text")), 256).alias("squeezed"))


@query(r"SELECT p_partkey AS id, 'concept_' || regexp_replace(lower(p_name), '[^\p{L}\p{Nd}]', '', 'g') AS concept FROM part")
def scl_concept_id(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), store.concept_id(F.col("p_name")).alias("concept"))


@query("SELECT doc_id, regexp_matches(text, '\\bthe\\b') AS mentioned FROM documents")
def scl_mentions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.mentions(F.col("text"), "the").alias("mentioned"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents")
def scl_line_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.line_slice(F.col("text"), 2, 4).alias("lines"))


@query("SELECT page_id, regexp_matches(html, '(?i)you\\s+are\\s+now\\s+') OR regexp_matches(html, '(?i)\\bnew\\s+instructions\\s*:') OR regexp_matches(html, '(?i)disregard\\s+(the\\s+)?(above|previous|earlier)') OR regexp_matches(html, '(?i)ignore\\s+(all\\s+)?(previous|prior|above)\\s+(instructions|prompts|context)') OR regexp_matches(html, '(?im)^\\s*(system|assistant|developer)\\s*:') AS suspicious FROM pages")
def scl_suspicious(spark, sf):
    return table(spark, sf, "pages").select("page_id", linking.suspicious(F.col("html")).alias("suspicious"))


# Loops ------------------------------------------------------------------------


@query("SELECT o_orderkey AS file_path, CASE WHEN o_orderpriority = '5-LOW' THEN 'Deleted' WHEN o_orderstatus = 'F' THEN 'Stale' ELSE 'Fresh' END AS freshness FROM orders")
def str_freshness(spark, sf):
    orders = table(spark, sf, "orders")
    was = orders.select(F.col("o_orderkey").alias("file_path"), F.md5("o_orderpriority").alias("content_hash"))
    now = F.when(F.col("o_orderstatus") == "F", "x").otherwise(F.md5("o_orderpriority"))
    present = orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("file_path"), now.alias("content_hash"))
    return loops.freshness(was, present, was)


@query(
    oracle(
        """, d AS (SELECT DISTINCT p_brand AS f, p_type AS n FROM part WHERE p_size < 5), e AS (SELECT DISTINCT p_brand AS f, p_type AS n FROM part WHERE p_size BETWEEN 3 AND 7),
        c AS (SELECT 'Brand#11' AS f), a AS (SELECT DISTINCT n FROM d WHERE f IN (SELECT f FROM c)), b AS (SELECT DISTINCT n FROM e WHERE f IN (SELECT f FROM c)),
        x AS ((SELECT n FROM a EXCEPT SELECT n FROM b) UNION (SELECT n FROM b EXCEPT SELECT n FROM a))
        SELECT f AS file_path FROM c UNION SELECT DISTINCT p_brand FROM part WHERE p_type IN (SELECT n FROM x) AND p_brand IS NOT NULL"""
    )
)
def str_reindex_closure(spark, sf):
    part = table(spark, sf, "part")
    defs = part.select(F.col("p_brand").alias("file_path"), F.col("p_type").alias("name"), "p_size")
    changed = spark.createDataFrame([("Brand#11",)], "file_path string")
    refs = part.select(F.col("p_type").alias("type_name"), F.col("p_brand").alias("file_path"))
    return loops.reindex_closure(changed, defs.where("p_size < 5").drop("p_size"), defs.where("p_size between 3 and 7").drop("p_size"), refs)


@query()
def src_markdown_sections(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "source", F.lit("\n"), "text").alias("text"))
    return parsers.nodes_of(parsers.parse_files(docs, {".md": parsers.parse_markdown}))


