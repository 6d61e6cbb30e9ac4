"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells.  A key's 64-bit hash names its cell; the
first virtual node at or after the cell names its home shard.  A shard takes
keys up to its capacity; the keys that overflow continue clockwise to the next
virtual node whose shard has room.  Capacities add up to the weight of all
keys (slack 0: row counts differ by one at most) or exceed it by ``slack``.

Only the weights per cell, at most CELLS rows whatever the input, come to the
driver; there the overflow is settled and the outcome, a list of (cell, rank
interval, shard, first slot), goes back as a table of as bounded a size.  Each
row then needs its rank within its cell, from one shuffle of ids without texts.

Defined results: ids order the keys, a row without an id is dealt by its text and
ranks first; rows that repeat an id are ranked by their text's crc and length,
and lie on neighbouring slots; a null text has size 1 and crc 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 16
VNODES = 64


def ring(shards: int, vnodes: int = VNODES, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order, at most one per cell."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.sha256(f"shard-{shard}-{v}".encode()).digest()[:8]) >> (64 - cell_bits)
            at.setdefault(cell, shard)
    return sorted(at.items())


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """What each shard holds at most; with slack 0 exactly the total."""
    if slack > 0:
        return [-(-int(total * (1 + slack)) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def settle(counts: dict[int, int], nodes: list[tuple[int, int]], caps: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, past rank, shard) for every cell's keys.

    Keys at home come first, in ring order; what is left then walks clockwise.
    """
    cells = [c for c, _ in nodes]
    room, out, over = list(caps), [], []
    for cell in sorted(counts):
        n = counts[cell]
        home = bisect.bisect_left(cells, cell) % len(nodes)
        shard = nodes[home][1]
        take = min(n, room[shard])
        if take:
            out.append((cell, 0, take, shard))
            room[shard] -= take
        if take < n:
            over.append((home, cell, take, n))
    for home, cell, rank, n in over:
        step = home
        while rank < n:
            step = (step + 1) % len(nodes)
            shard = nodes[step][1]
            if take := min(n - rank, room[shard]):
                out.append((cell, rank, rank + take, shard))
                room[shard] -= take
                rank += take
    return sorted(out)


def shard_rows(
    docs: DataFrame,
    shards: int = 8,
    vnodes: int = VNODES,
    slack: float = 0.0,
    cell_bits: int = CELL_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    # A row without an id has its text for a key.
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    cell = F.shiftrightunsigned(key, 64 - cell_bits).alias("cell")
    ids = docs.select(cell).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["cell"]: r["n"] for r in ids.collect()}  # at most 2 ** cell_bits rows
    if not counts:
        placed = []
    else:
        placed = settle(counts, ring(shards, vnodes, cell_bits), capacities(sum(counts.values()), shards, slack))
    slot, segments = [0] * shards, []
    for c, lo, hi, shard in placed:
        segments.append((c, lo, hi, shard, slot[shard]))
        slot[shard] += hi - lo
    where = spark.createDataFrame(segments, "cell long, lo long, hi long, shard int, first long")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        cell,
    )
    order = Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    inside = (ranked["cell"] == where["cell"]) & (ranked["rank"] >= where["lo"]) & (ranked["rank"] < where["hi"])
    return ranked.join(where, inside).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", **options) -> None:
    """The rows of ``docs`` under path/shard=k, in slot order within each file.

    Needs unique ids: a row finds its shard by its id.  A column of the input
    that is named shard is written as shard_1 (or the next name that is free).
    """
    taken = set(docs.columns)

    def free(name: str) -> str:
        while name in taken:
            stem, _, number = name.rpartition("_")
            name = f"{stem}_{int(number) + 1}" if stem and number.isdigit() else f"{name}_1"
        taken.add(name)
        return name

    placed = shard_rows(docs, shards, id_col=id_col, **options)
    if "shard" in taken:
        docs = docs.withColumnRenamed("shard", free("shard"))
    name, slot = free("placed_id"), free("slot")
    placed = placed.select(F.col("doc_id").alias(name), "shard", F.col("slot").alias(slot))
    rows = docs.join(placed, docs[id_col].eqNullSafe(placed[name])).drop(name)
    rows.repartition("shard", F.floor(F.col(slot) / 100_000)).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(path)
