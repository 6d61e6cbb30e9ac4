"""Source files as rows: scan, guards, text, fingerprint, chunks and change lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the index format.
MOST_BYTES = 5 * 1024 * 1024
SNIFFED_BYTES = 8000
STORED_CHARS = 100_000
CUT_MARK = "\n\n… [truncated]"

#: Carriage return with line feed, then the other single line ends.
_LINE_ENDS = "\r\n|[\r\u0085\u2028\u2029\f]"


def glob_to_regex(glob: str) -> str:
    """A glob (``**`` crosses folders, ``*`` and ``?`` do not) as a regex for a whole relative path."""
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            c = glob[at]
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), at + 1
    return f"^{out}$"


def scan(spark: SparkSession, root: str, extensions: list[str], excludes: list[str] = ()) -> DataFrame:
    """path (relative), length and content of the files under ``root`` with one of the extensions; large ones are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root)
    base = root.rstrip("/") + "/"
    relative = F.substring_index("path", base, -1)
    kept = files.where(F.col("length") <= MOST_BYTES).withColumn("path", relative)
    kept = kept.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions]))
    for glob in excludes:
        kept = kept.where(~F.col("path").rlike(glob_to_regex(glob)))
    return kept.select("path", "length", "content")


def is_binary(content: Column) -> Column:
    """Whether one of the first bytes is zero."""
    return (F.instr(F.decode(F.substring(content, 1, SNIFFED_BYTES), "ISO-8859-1"), "\u0000") > 0)


def normalise_lines(text: Column) -> Column:
    return F.regexp_replace(text, _LINE_ENDS, "\n")


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def stored_content(text: Column) -> Column:
    return F.when(F.length(text) > STORED_CHARS, F.concat(F.substring(text, 1, STORED_CHARS), F.lit(CUT_MARK))).otherwise(text)


def file_nodes(files: DataFrame) -> DataFrame:
    """A File node per readable text file (path, content bytes)."""
    text = normalise_lines(F.decode("content", "UTF-8"))
    return files.where(~is_binary(F.col("content"))).select(
        F.col("path").alias("id"), F.lit("File").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"),
        stored_content(text).alias("content"), F.col("path").alias("file_path"), fingerprint(text).alias("content_hash"),
    )


_PUSH = T.StructType(
    [T.StructField("commits", T.ArrayType(T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in ("added", "modified", "removed")])))]
)


def pushed_files(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Distinct files that the commits of push payloads add, modify or remove."""
    commits = payloads.select(F.explode(F.from_json(column, _PUSH)["commits"]).alias("c"))
    empty = F.array().cast("array<string>")
    named = F.concat(*(F.coalesce(F.col(f"c.{k}"), empty) for k in ("added", "modified", "removed")))
    return commits.select(F.explode(named).alias("file")).where("file is not null").distinct()


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, query and expected (one row each) of golden query sets."""
    rows = spark.read.schema("id string, query string, expected array<string>").option("multiLine", "true").json(path)
    return rows.select(F.col("id").alias("case_id"), "query", F.explode("expected").alias("expected"))


def drift(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """file_path and state (changed, new, deleted, fresh) from two tables of file_path and content_hash."""
    a = indexed.select("file_path", F.col("content_hash").alias("was"))
    b = present.select("file_path", F.col("content_hash").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("fresh")
    return a.join(b, "file_path", "full_outer").select("file_path", state.alias("state"))
