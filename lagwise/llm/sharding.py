"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every row has a ring position, a hash of its id and text. Each shard owns `VIRTUAL` points; a row belongs to the next
point clockwise. A shard takes its own rows up to its capacity in ring order; the overflow continues clockwise to the
next shard with room. Capacities differ by at most one row and add up to all rows, so the law is `rows`: counts are at
most one apart. Only the overflow moves away from its own shard.

The ring is cut into `CELLS` cells. The driver sees one count per cell (a fixed number), decides how many rows of each
cell go where, and sends back the pieces. Rows are numbered inside their cell, so no task holds a whole shard.

Defined cases: a null text has size 1 (no bytes, plus one) and the checksum of the empty text; a null id hashes as
such. Repeated rows share a cell and are placed one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import documents, free_name

CELLS = 1 << 16
VIRTUAL = 128


def ring(shards: int, virtual: int = VIRTUAL, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Points in ring order: the cell at which each ends and its shard."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") % cells, s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in points]), np.array([s for _, s in points])


def place(counts: dict[int, int], shards: int, virtual: int = VIRTUAL, cells: int = CELLS) -> dict[int, list[tuple[int, int, int]]]:
    """Per cell its pieces (first row, shard, first slot); rows of a cell count from 0."""
    ends, owners = ring(shards, virtual, cells)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    onward = list(range(1, len(ends) + 1))  # per point, a later one that may have room; a full point is skipped for good
    onward[-1] = 0

    def next_open(at: int) -> int:
        passed = []
        while not room[owners[at]]:
            passed.append(at)
            at = onward[at]
        for p in passed:
            onward[p] = at
        return at

    pieces: dict[int, list[tuple[int, int, int]]] = {}
    overflow: list[tuple[int, int, int, int]] = []

    def give(cell: int, first: int, shard: int, n: int) -> None:
        pieces.setdefault(cell, []).append((first, int(shard), used[shard]))
        room[shard] -= n
        used[shard] += n

    for cell in sorted(counts):
        at = int(np.searchsorted(ends, cell)) % len(ends)
        own = min(counts[cell], room[owners[at]])
        if own:
            give(cell, 0, owners[at], own)
        if own < counts[cell]:
            overflow.append((cell, at, own, counts[cell] - own))
    for cell, at, first, left in overflow:
        while left:
            at = next_open(at)
            n = min(left, room[owners[at]])
            give(cell, first, owners[at], n)
            first, left = first + n, left - n
    return pieces


def shard(docs: DataFrame, into: str, shards: int = 16, virtual: int = VIRTUAL, cells: int = CELLS, carry: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `carry`, by default all) with a column `into` of (shard, slot)."""
    spark = docs.sparkSession
    position = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    cell = F.pmod(position, F.lit(cells)).cast("int")
    counts = {r["cell"]: r["count"] for r in docs.groupBy(cell.alias("cell")).count().collect()}  # at most `cells` rows
    pieces = place(counts, shards, virtual, cells)
    plan = spark.createDataFrame(
        [(c, [(f, s, slot) for f, s, slot in p]) for c, p in pieces.items()],
        "at int, pieces array<struct<first: long, shard: int, slot: long>>",
    )
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), cell.alias("cell"), position.alias("position"), F.col("doc_id").alias("id"))
    order = Window.partitionBy("cell").orderBy("position", "id")
    numbered = held.withColumn("n", F.row_number().over(order) - 1)
    joined = numbered.join(F.broadcast(plan), F.col("cell") == F.col("at"))  # one row per cell, a fixed bound
    mine = F.element_at(F.filter("pieces", lambda p: p["first"] <= F.col("n")), -1)
    joined = joined.withColumn("mine", mine)
    return joined.select("row.*", F.struct(F.col("mine.shard").alias("shard"), (F.col("mine.slot") + F.col("n") - F.col("mine.first")).alias("slot")).alias(into))


def write(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Shard files under `path`, one folder per shard, with the columns of `docs` and the slot."""
    name = free_name(docs, "placed")
    rows = shard(docs, name, shards)
    folder, slot = free_name(docs, "shard"), free_name(docs, "slot")
    rows.withColumns({folder: F.col(f"{name}.shard"), slot: F.col(f"{name}.slot")}).drop(name).write.partitionBy(folder).parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = shard(docs, "s", carry=["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "s.shard", "s.slot", F.lit(None).cast("int").alias("grown_shard"))
