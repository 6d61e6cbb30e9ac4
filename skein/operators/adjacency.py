"""A stored graph for walks: nodes and arcs in buckets of the id they are found by.

Every edge is kept twice, as an arc that leaves its source and one that leaves
its target.  Arcs lie in folders by bucket of the id they leave, sorted by it,
with minima, maxima and Bloom filters; nodes likewise by their id.  A step of a
walk names the buckets of where it stands (an arc carries the bucket of its
other end), so only those folders are listed and read.  The arcs of one id that
has very many are dealt over several files, as ranges go by both ends.

Where a walk stands is held by the driver as long as that is few ids
(``MOST_HELD``) and needs no written table then; a wider layer is a table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.lineage import MOST_SENT, cut

#: Arcs a bucket should have, and how many buckets there are at least and at most.
ARCS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 16, 65_536
#: Ids of a layer that the driver holds, and that a filter lists one by one.
MOST_HELD, MOST_LISTED = 5_000, 10
_ABOUT = "buckets int, arcs string, nodes string"
ARC_COLUMNS = ["u", "v", "relationship", "provenance", "forward"]


def arcs(edges: DataFrame, direction: str = "both") -> DataFrame:
    """u, v and the edge's relationship, provenance and whether it is walked forward ("out", "in" or "both")."""
    rest = ["relationship", "provenance"]
    out = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), *rest, F.lit(True).alias("forward"))
    back = edges.select(F.col("target").alias("u"), F.col("source").alias("v"), *rest, F.lit(False).alias("forward"))
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


@dataclass
class Layer:
    """Where a walk stands: rows with an id and its bucket (null: not known); how many, and their buckets (None: any)."""

    rows: DataFrame
    size: int
    buckets: set[int] | None
    ids: list[str] | None = None

    def sent(self) -> DataFrame:
        return F.broadcast(self.rows) if self.size <= MOST_SENT else self.rows


def held(spark: SparkSession, table: pa.Table) -> Layer:
    """A layer of rows that the driver has."""
    buckets = set(table.column("bucket").to_pylist())
    return Layer(spark.createDataFrame(table), table.num_rows, None if None in buckets else buckets, table.column("id").to_pylist())


def settle(rows: DataFrame, few: bool = True) -> Layer:
    """``rows`` (id, bucket, maybe others) worked out: held if there are few, else written.

    ``few`` says that few are expected, so it is worth asking before writing.
    """
    if few:
        table = rows.limit(MOST_HELD + 1).toArrow()
        if table.num_rows <= MOST_HELD:
            return held(rows.sparkSession, table)
    table = cut(rows)
    size, buckets, unknown = table.agg(F.count(F.lit(1)), F.collect_set("bucket"), F.count_if(F.col("bucket").isNull())).first()
    if size <= MOST_HELD:
        return held(rows.sparkSession, table.toArrow())
    return Layer(table, size, None if unknown else set(buckets))


class EdgeTable:
    """A graph in plain tables: every step reads all edges."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges, self.nodes = edges, nodes
        self.spark = edges.sparkSession

    def bucket(self, ident: Column) -> Column:
        return F.lit(None).cast("int")

    def leaving(self, layer: Layer | None, direction: str = "both") -> DataFrame:
        found = arcs(self.edges, direction).withColumn("v_bucket", F.lit(None).cast("int"))
        return found if layer is None else found.join(layer.sent().select(F.col("id").alias("u")), "u", "left_semi")

    def edges_from(self, layer: Layer) -> DataFrame:
        return self.edges.join(layer.sent().select(F.col("id").alias("source")), "source", "left_semi").select(*self.edges.columns)

    def nodes_of(self, layer: Layer) -> DataFrame:
        return self.nodes.join(layer.sent().select("id"), "id", "left_semi").select(*self.nodes.columns)


class Adjacency:
    """A graph that ``write_adjacency`` stored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.schema(_ABOUT).parquet(f"{path}/about").first()
        self.buckets = about["buckets"]
        self.schemas = {name: StructType.fromJson(json.loads(about[name])) for name in ("arcs", "nodes")}

    def bucket(self, ident: Column) -> Column:
        return F.pmod(F.xxhash64(ident), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, key: str, layer: Layer | None) -> DataFrame:
        """The rows of ``name`` whose ``key`` is an id of the layer; only the layer's buckets are listed."""
        folder, schema = f"{self.path}/{name}", self.schemas[name]
        buckets = None if layer is None else layer.buckets
        if buckets is None or 2 * len(buckets) > self.buckets:
            rows = self.spark.read.schema(schema).parquet(folder)
        else:
            there = [b for b in sorted(buckets) if b in self._kept(name)]
            if not there:
                return self.spark.createDataFrame([], schema)
            rows = self.spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/bucket={b}" for b in there))
        if layer is None:
            return rows
        if layer.ids is not None and len(set(layer.ids)) <= MOST_LISTED:
            return rows.where(F.col(key).isin(*set(layer.ids)))
        return rows.join(layer.sent().select(F.col("id").alias(key)), key, "left_semi")

    def _kept(self, name: str) -> set[int]:
        """The buckets that have rows."""
        known = self.__dict__.setdefault("_known", {})
        if name not in known:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            listed = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
            names = (s.getPath().getName() for s in listed)
            known[name] = {int(n.partition("=")[2]) for n in names if n.startswith("bucket=")}
        return known[name]

    def leaving(self, layer: Layer | None, direction: str = "both") -> DataFrame:
        """The arcs that leave the layer (None: all arcs), with the bucket of their other end."""
        found = self._read("arcs", "u", layer)
        if direction != "both":
            found = found.where(F.col("forward") == (direction == "out"))
        return found.select(*ARC_COLUMNS, "v_bucket")

    def nodes(self) -> DataFrame:
        """All nodes."""
        return self._read("nodes", "id", None).drop("bucket")

    def edges_from(self, layer: Layer) -> DataFrame:
        """The edges, with all their columns, whose source is in the layer."""
        found = self._read("arcs", "u", layer).where("forward")
        rest = (c for c in found.columns if c not in ("u", "v", "forward", "bucket", "v_bucket"))
        return found.select(F.col("u").alias("source"), F.col("v").alias("target"), *rest)

    def nodes_of(self, layer: Layer) -> DataFrame:
        """The nodes of the layer's ids."""
        return self._read("nodes", "id", layer).drop("bucket")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ids(layers: list[Layer]) -> DataFrame:
    ids = _union([layer.rows.select("id") for layer in layers])
    return F.broadcast(ids) if sum(layer.size for layer in layers) <= MOST_SENT else ids


def write_adjacency(nodes: DataFrame, edges: DataFrame, path: str, arcs_a_bucket: int = ARCS_A_BUCKET) -> None:
    """Store ``nodes`` (id and others) and ``edges`` (source, target, relationship, provenance and others) under ``path``.

    Arcs under path/arcs, nodes under path/nodes, each by bucket; the number of buckets under path/about.
    An edge's further columns are kept with the arc that leaves its source, null with the other.
    """
    spark = nodes.sparkSession
    total = 2 * edges.count()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-total // arcs_a_bucket)))
    files = max(buckets, -(-total // arcs_a_bucket))
    rest = [c for c in edges.columns if c not in ("source", "target", "relationship", "provenance")]
    kinds = dict(edges.dtypes)

    def side(u: str, v: str, forward: bool) -> DataFrame:
        return edges.select(
            F.col(u).alias("u"), F.col(v).alias("v"), "relationship", "provenance", F.lit(forward).alias("forward"),
            *((F.col(f"`{c}`") if forward else F.lit(None).cast(kinds[c])).alias(c) for c in rest),
        )

    def number(ident: str) -> Column:
        return F.pmod(F.xxhash64(F.col(ident)), F.lit(buckets)).cast("int")

    schemas = {}

    def store(rows: DataFrame, order: list[str], name: str) -> None:
        schemas[name] = rows.schema.json()
        dealt = rows.repartitionByRange(files, "bucket", *order).sortWithinPartitions("bucket", *order)
        dealt.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{order[0]}", "true").parquet(f"{path}/{name}")

    both = side("source", "target", True).unionByName(side("target", "source", False))
    store(both.where("u is not null").withColumns({"v_bucket": number("v"), "bucket": number("u")}), ["u", "v"], "arcs")
    store(nodes.where("id is not null").withColumn("bucket", number("id")), ["id"], "nodes")
    spark.createDataFrame([(buckets, schemas["arcs"], schemas["nodes"])], _ABOUT).write.parquet(f"{path}/about")


@dataclass(frozen=True)
class Steps:
    """The steps a walk may take: arcs in one direction, of the given condition (on relationship, provenance)."""

    graph: EdgeTable | Adjacency
    direction: str = "both"
    condition: Column | None = None

    def leaving(self, layer: Layer | None) -> DataFrame:
        found = self.graph.leaving(layer, self.direction)
        return found if self.condition is None else found.where(self.condition)

    def stand(self, ids: list[str]) -> Layer:
        """A layer of the given ids."""
        rows = self.graph.spark.createDataFrame(pa.table({"id": pa.array(list(dict.fromkeys(ids)), pa.string())}))
        return self.stand_on(rows)

    def stand_on(self, ids: DataFrame) -> Layer:
        rows = ids.select("id").distinct() if not ids.isLocal() else ids.select("id")
        return settle(rows.withColumn("bucket", self.graph.bucket(F.col("id"))))


def walkable(edges: DataFrame | EdgeTable | Adjacency, nodes: DataFrame | None = None) -> EdgeTable | Adjacency:
    return EdgeTable(edges, nodes) if isinstance(edges, DataFrame) else edges


def without(rows: DataFrame, layers: list[Layer]) -> DataFrame:
    """``rows`` whose id lies in none of the layers."""
    ids = _ids(layers)
    return rows.join(ids, "id", "left_anti")


def walk(start: Layer, steps: Steps, hops: int) -> list[Layer]:
    """The layers at 0, 1, ... ``hops`` steps, each id in the first layer that reaches it; ends with the last that is not empty."""
    layers = [start]
    for _ in range(hops):
        if not layers[-1].size:
            break
        reached = steps.leaving(layers[-1]).groupBy(F.col("v").alias("id")).agg(F.first("v_bucket").alias("bucket")).where("id is not null")
        layers.append(settle(without(reached, layers), few=layers[-1].ids is not None))
    return layers if layers[-1].size or len(layers) == 1 else layers[:-1]


def depths(layers: list[Layer]) -> DataFrame:
    """id and depth of every layer's ids."""
    return _union([layer.rows.select("id", F.lit(k).alias("depth")) for k, layer in enumerate(layers)])


def nodes_within(graph: EdgeTable | Adjacency, layers: list[Layer]) -> DataFrame:
    """The nodes of the layers, with their depth."""
    return _union([graph.nodes_of(layer).withColumn("depth", F.lit(k)) for k, layer in enumerate(layers)])


def edges_within(graph: EdgeTable | Adjacency, layers: list[Layer], known: DataFrame) -> DataFrame:
    """The edges among ``known`` (id: some of the layers' ids)."""
    found = _union([graph.edges_from(layer) for layer in layers])
    ids = F.broadcast(known.select("id")) if sum(layer.size for layer in layers) <= MOST_SENT else known.select("id")
    both = found.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return both.select(*found.columns)
