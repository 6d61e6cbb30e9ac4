"""Cutting the lineage of iterative plans through tables written in the shared checkpoint folder.

A table read back has the size of its files; a checkpoint would carry on the
planner's estimate, which a loop of joins multiplies until planning itself is
what takes long.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of an id and little else that may be sent to every executor (some 24 bytes each).
MOST_SENT = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables, which all executors see.

    It is the one the cluster names in spark.checkpoint.dir.  Only a local
    session, whose executors are this machine, may leave that unset and gets a
    temporary one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-"))
    return sc.getCheckpointDir()


#: Whether the shuffle files of a query go when it ends; else they stay until the driver happens to collect what refers to them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back from there, without its lineage and its shuffle files.

    ``spent`` are earlier results of this function that nothing reads from now on; they are removed.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(folder)
    back.written_in = folder
    release(*spent)
    return back


def release(*spent: DataFrame) -> None:
    """Remove what ``cut`` wrote for these tables; nothing may read them any more."""
    for df in spent:
        folder = getattr(df, "written_in", None)
        if folder:
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of a shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
