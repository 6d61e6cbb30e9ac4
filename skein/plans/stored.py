"""Tables that are derived from a folder once and kept for the session, as an indexer would keep them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.lineage import shared_folder
from skein.operators.adjacency import Adjacency, write_adjacency
from skein.sources import driver_graph

_KEPT: dict[tuple[str, str, str, str], str] = {}
_OPENED: dict[str, object] = {}


def opened[T](path: str, how: Callable[[], T]) -> T:
    """What ``how`` opens at a kept folder, opened once."""
    if path not in _OPENED:
        _OPENED[path] = how()
    return _OPENED[path]  # type: ignore[return-value]


def state_of(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and modification times of a folder's tables; those of a table's files are listed and added up by tasks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = []
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        told: tuple = (status.getPath().toString(), status.getLen(), status.getModificationTime())
        if status.isDirectory():
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(told[0])
            mark = F.xxhash64("path", "length", "modificationTime")
            told += tuple(files.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum("length")).first())
        listed.append(told)
    return hashlib.sha256(repr(sorted(listed)).encode()).hexdigest()


def kept(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The folder that ``write`` filled for this session and for the input as it is now; written on first use, after a change, or where it is gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name, state_of(spark, sf_dir))
    if key in _KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(_KEPT[key])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return _KEPT[key]
    folder = f"{shared_folder(spark)}/kept-{name}-{uuid.uuid4().hex}"
    write(folder)
    _KEPT[key] = folder
    return folder


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the edges as a stored table."""
    path = kept(spark, sf_dir, "edges", lambda folder: driver_graph.edges(spark, sf_dir).write.parquet(folder))
    return driver_graph.nodes(spark, sf_dir), spark.read.parquet(path)


def walks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Adjacency]:
    """Nodes, and the graph stored for walks."""
    path = kept(spark, sf_dir, "adjacency", lambda folder: write_adjacency(*graph(spark, sf_dir), folder))
    found = opened(path, lambda: Adjacency(spark, path))
    return found.nodes(), found
