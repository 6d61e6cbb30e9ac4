"""Resolving names to definitions, and findings about what does not resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.store import first_per, type_references
from skein.schema import AMBIGUOUS, DEFINITION_TYPES, INFERRED


def _definitions(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return nodes.where(F.col("type").isin(*types)).select(F.col("name").alias("type_name"), F.col("id").alias("target"))


def _as_edges(pairs: DataFrame, relationship: str, candidates: Column) -> DataFrame:
    tier = F.when(candidates > 1, AMBIGUOUS).otherwise(INFERRED)
    return pairs.select("source", "target", F.lit(relationship).alias("relationship"), tier.alias("provenance"))


#: Rows of either side of one name that meet in one task, at least; and blocks of pairs a task that common names are dealt into.
BLOCK = 1_000
BLOCKS_A_TASK = 16


def _blocks(left: DataFrame, right: DataFrame, key: str, tasks: int, least: int) -> DataFrame:
    """Into how many blocks the rows of either side of each key go: __m of the left, __n of the right."""
    rows = left.groupBy(key).agg(F.count(F.lit(1)).alias("__m")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key)
    even = F.ceil(F.sqrt(F.sum(F.col("__m").cast("double") * F.col("__n")) / (tasks * BLOCKS_A_TASK)))
    size = rows.agg(F.greatest(F.lit(least).cast("long"), even).alias("__size"))
    return rows.crossJoin(F.broadcast(size)).select(key, *(F.ceil(F.col(c) / F.col("__size")).cast("int").alias(c) for c in ("__m", "__n")))


def _met(left: DataFrame, right: DataFrame, key: str, block: int | None = None) -> DataFrame:
    """The pairs of ``left`` (source) and ``right`` (target) with an equal key.

    A name with more than ``block`` rows on a side is dealt into blocks of about so many, and each
    block of one side meets each of the other, so a common name's pairs are made by many tasks.  Blocks grow with
    the root of all pairs, so that there are BLOCKS_A_TASK of them a task: a row's copies then do not grow with the rows.
    """
    # A number of tasks that is named stays: adaptive execution would merge them by their bytes, which are few beside the pairs.
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = _blocks(left, right, key, tasks, block or BLOCK)

    def dealt(side: DataFrame, end: str, own: str, other: str, own_blocks: str, other_blocks: str) -> DataFrame:
        there = side.join(blocks, key).withColumn(own, F.pmod(F.xxhash64(end), F.col(own_blocks).cast("long")).cast("int"))
        return there.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).drop("__m", "__n")

    place = [key, "__a", "__b"]
    wanted = dealt(left, "source", "__a", "__b", "__m", "__n").repartition(tasks, *place)
    found = dealt(right, "target", "__b", "__a", "__n", "__m").repartition(tasks, *place)
    return wanted.join(found, place).drop("__a", "__b")


def link_references(references: DataFrame, nodes: DataFrame, types: tuple[str, ...] = DEFINITION_TYPES) -> DataFrame:
    """REFERENCES_TYPE edges of ``references`` (type_name, node_id) to every definition of the name.

    Several definitions (the referring node itself counts) make the edges ambiguous; a node never refers to itself.
    """
    found = _definitions(nodes, types)
    counts = found.groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))
    # A definition has one name, so distinct references and definitions make distinct pairs: what a join makes is not shuffled again.
    wanted = references.select("type_name", F.col("node_id").alias("source")).distinct().join(counts, "type_name")
    pairs = _met(wanted, found.distinct(), "type_name").where("source <> target")
    return _as_edges(pairs, "REFERENCES_TYPE", F.col("n"))


def relink_file(nodes: DataFrame, edges: DataFrame, path: str, types: tuple[str, ...] = DEFINITION_TYPES) -> DataFrame:
    """Edges with one file's outgoing REFERENCES_TYPE edges made anew."""
    inside = nodes.where(F.col("file_path") == path)
    own = inside.select(F.col("id").alias("source"), F.lit("REFERENCES_TYPE").alias("relationship"))
    kept = edges.join(own, ["source", "relationship"], "left_anti").select(*edges.columns)
    fresh = link_references(type_references(inside), nodes, types)
    extra = {c: F.lit(None).cast(t) for c, t in edges.dtypes if c not in fresh.columns}
    return kept.unionByName(fresh.withColumns(extra) if extra else fresh)


def link_unresolved(unresolved: DataFrame, nodes: DataFrame, types: tuple[str, ...] = DEFINITION_TYPES) -> DataFrame:
    """Like ``link_references`` for (enclosing_id, type_name), but a node does not count among its own candidates."""
    wanted = unresolved.select("type_name", F.col("enclosing_id").alias("source")).distinct()
    found = _definitions(nodes, types).distinct()
    counts = found.groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))
    own = found.select("type_name", F.col("target").alias("source"), F.lit(1).alias("own"))
    wanted = wanted.join(counts, "type_name").join(own, ["type_name", "source"], "left")
    pairs = _met(wanted, found, "type_name").where("source <> target")
    return _as_edges(pairs, "REFERENCES_TYPE", F.col("n") - F.coalesce("own", F.lit(0)))


def plain_name(name: Column) -> Column:
    """Trimmed, lower case, without the word "controller"."""
    return F.replace(F.lower(F.trim(name)), F.lit("controller"), F.lit(""))


def bind_by_name(left: DataFrame, right: DataFrame, relationship: str = "BINDS_TO") -> DataFrame:
    """Edges (tier inferred) between nodes whose plain names are equal and not empty."""
    def named(side: DataFrame, end: str, names: str) -> DataFrame:
        told = side.select(F.col("id").alias(end), plain_name(F.col("name")).alias("k")).where("k <> ''")
        once = told.groupBy(end).agg(F.collect_set("k").alias("ks"))
        return once.select(end, F.when(F.size("ks") > 1, F.col("ks")).alias(names), F.explode("ks").alias("k"))

    # Ids of several names may meet at more than one; they are a pair at the least of these, so what a join makes is not shuffled again.
    pairs = _met(named(left, "source", "ks"), named(right, "target", "kt"), "k").where("source <> target")
    pairs = pairs.where(F.col("ks").isNull() | F.col("kt").isNull() | (F.col("k") == F.array_min(F.array_intersect("ks", "kt"))))
    return pairs.select("source", "target", F.lit(relationship).alias("relationship"), F.lit(INFERRED).alias("provenance"))


def first_match(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """For each row of ``left`` (id) the least id of ``right`` with an equal key."""
    a = left.select(F.col("id").alias("source"), left_key.alias("k"))
    b = first_per(right.select(F.col("id").alias("target"), right_key.alias("k")), ["k"], ["target"])
    return a.join(b, "k").select("source", "target")


def resolve_types(types: DataFrame, nodes: DataFrame, external: tuple[str, ...], kinds: tuple[str, ...] = DEFINITION_TYPES) -> DataFrame:
    """Verdict on each full type name (id, full_name): resolved, ambiguous, external or unresolved, with its targets."""
    simple = F.element_at(F.split(F.split("full_name", ",")[0], r"[.+]"), -1)
    wanted = types.select("id", "full_name", F.trim(simple).alias("type_name"))
    targets = _definitions(nodes, kinds).groupBy("type_name").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    framework = F.lit(False)
    for prefix in external:
        framework = framework | F.startswith("full_name", F.lit(prefix))
    n = F.coalesce(F.size("targets"), F.lit(0))
    verdict = F.when(n == 1, "resolved").when(n > 1, "ambiguous").when(framework, "external").otherwise("unresolved")
    return wanted.join(targets, "type_name", "left").select("id", "full_name", verdict.alias("verdict"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def dangling_targets(edges: DataFrame, nodes: DataFrame, relationships: tuple[str, ...] | None = None, denied: tuple[str, ...] = ()) -> DataFrame:
    """Distinct source, target of edges whose target no node has, but denied names."""
    used = edges if relationships is None else edges.where(F.col("relationship").isin(*relationships))
    out = used.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target").distinct()
    return out.where(~F.col("target").isin(*denied)) if denied else out


def ambiguous_names(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = DEFINITION_TYPES) -> DataFrame:
    """Names that several definitions share, at least one of which is referenced: name and how many."""
    named = nodes.where(F.col("type").isin(*types)).where("trim(name) <> ''").select("id", "name")
    used = named.join(edges.where(F.col("relationship") == "REFERENCES_TYPE").select(F.col("target").alias("id")), "id", "left_semi").select("name")
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("definitions")).where("definitions > 1").join(used, "name", "left_semi")


_LAYER = r"(?i)(?:^|[/\\])(feature|foundation|project)[/\\]([^/\\]+)"


def layered(nodes: DataFrame) -> DataFrame:
    """id, layer and module of the nodes whose path lies in a layered folder."""
    raw = nodes.select("id", F.regexp_extract("file_path", _LAYER, 1).alias("l"), F.regexp_extract("file_path", _LAYER, 2).alias("m")).where("l <> ''")
    return raw.select("id", F.initcap("l").alias("layer"), F.concat(F.upper(F.substring("m", 1, 1)), F.lower(F.expr("substring(m, 2)"))).alias("module"))


def helix_modules(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node per layer and module, and BELONGS_TO_MODULE edges to them."""
    placed = layered(nodes).withColumn("mid", F.concat_ws("::", F.lit("helix"), "layer", "module"))
    modules = placed.select(F.col("mid").alias("id"), F.lit("HelixModule").alias("type"), F.concat_ws(".", "layer", "module").alias("name")).distinct()
    edges = placed.select(F.col("id").alias("source"), F.col("mid").alias("target"), F.lit("BELONGS_TO_MODULE").alias("relationship"), F.lit(INFERRED).alias("provenance"))
    return modules, edges


def helix_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Module pairs where a dependency leads to the same layer or a higher one (Foundation, Feature, Project), once each."""
    rank = F.when(F.col("layer") == "Foundation", 0).when(F.col("layer") == "Feature", 1).otherwise(2)
    placed = layered(nodes).withColumn("rank", rank)
    a = placed.select(F.col("id").alias("source"), F.col("layer").alias("from_layer"), F.col("module").alias("from_module"), F.col("rank").alias("ra"))
    b = placed.select(F.col("id").alias("target"), F.col("layer").alias("to_layer"), F.col("module").alias("to_module"), F.col("rank").alias("rb"))
    both = edges.where(~F.col("relationship").isin("CONTAINS", "BELONGS_TO_MODULE")).join(a, "source").join(b, "target")
    other = (F.col("from_layer") != F.col("to_layer")) | (F.col("from_module") != F.col("to_module"))
    return both.where((F.col("rb") >= F.col("ra")) & other).select("from_layer", "from_module", "to_layer", "to_module").distinct()


def classify_fields(fields: DataFrame) -> DataFrame:
    """``fields`` (name, is_reference): names used both ways are ambiguous."""
    both = fields.groupBy("name").agg(F.bool_or("is_reference").alias("r"), F.bool_or(~F.col("is_reference")).alias("t"))
    return both.select("name", F.when(F.col("r") & F.col("t"), "ambiguous").when(F.col("r"), "reference").otherwise("text").alias("kind"))


# Phrases that address a model rather than a reader.
SUSPICIOUS = (
    r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|context)",
    r"(?i)disregard\s+(the\s+)?(above|previous|earlier)",
    r"(?i)you\s+are\s+now\s+",
    r"(?im)^\s*(system|assistant|developer)\s*:",
    r"(?i)\bnew\s+instructions\s*:",
)
SCANNED_TYPES = ("File", "MarkdownSection", "Class", "Interface", "Record", "Struct", "Method", "Property")


def suspicious(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in SUSPICIOUS:
        hit = hit | F.coalesce(text.rlike(pattern), F.lit(False))
    return hit


def suspicious_nodes(nodes: DataFrame, types: tuple[str, ...] | None = SCANNED_TYPES) -> DataFrame:
    used = nodes if types is None else nodes.where(F.col("type").isin(*types))
    return used.where(suspicious(F.col("content"))).select("id", "name", "file_path")


#: Lines of a stretch.
LINES = 64


def overlapping_lines(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks and node spans (file_path, start_line, end_line) of one file that share a line: chunk_id, node_id.

    Both meet by file and stretch of LINES lines, so a long file is not one task; a pair counts where its first shared line lies.
    """

    def dealt(rows: DataFrame, id: str, start: str, end: str) -> DataFrame:
        first, last = (F.floor(F.col(c) / LINES) for c in ("start_line", "end_line"))
        named = rows.where("start_line <= end_line").select("file_path", F.col("id").alias(id), F.col("start_line").alias(start), F.col("end_line").alias(end), F.explode(F.sequence(first, last)).alias("stretch"))
        return named

    both = dealt(chunks, "chunk_id", "cs", "ce").join(dealt(spans, "node_id", "ns", "ne"), ["file_path", "stretch"])
    return both.where((F.col("ns") <= F.col("ce")) & (F.col("cs") <= F.col("ne")) & (F.floor(F.greatest("cs", "ns") / LINES) == F.col("stretch"))).select("chunk_id", "node_id")


def concept_neighbours(nodes: DataFrame, edges: DataFrame, most: int = 25, concept_type: str = "Concept") -> DataFrame:
    """For each concept the first ``most`` distinct names around it, either direction: id, names."""
    concepts = nodes.where(F.col("type") == concept_type).select("id")
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other")))
    named = ends.where("id <> other").join(concepts, "id", "left_semi").join(nodes.select(F.col("id").alias("other"), "name"), "other").select("id", "name").distinct()
    w = Window.partitionBy("id").orderBy("name")
    first = named.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
