"""Records of large CSV files whose quoted fields may hold line breaks, read by many tasks.

Spark reads such a file as lines, in blocks. Whether a block begins inside quotes is known once all blocks before it are, so one
pass finds for each block where it ends if it begins outside, and where if it begins inside; the driver, with one row per
block, chains them. A second pass joins lines to records; those that cross blocks are put together at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = rb'"[^"]*+(?:""[^"]*+)*+'
_FIELD = rb'(?:' + _QUOTED + rb'"[^,]*+|[^",][^,]*+|)'
_OPENS = re.compile(rb'(?:' + _FIELD + rb',)*+' + _QUOTED)
_REST = re.compile(rb'[^"]*+(?:""[^"]*+)*+')


LAST = 2**63 - 1
BATCH = 10_000


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends within quotes; a quote counts where a field begins, or within quotes."""
    if b'"' not in line:
        return inside
    if inside:
        end = _REST.match(line).end()
        if end == len(line):
            return True
        comma = line.find(b",", end)
        if comma < 0:
            return False
        line = line[comma + 1:]
    return _OPENS.fullmatch(line) is not None


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    for batch in batches:
        yield from zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist())


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, for a begin outside and inside quotes: whether it ends inside, and whether a record ends in it; and the file's line end."""
    found: dict[tuple[str, int], list[bool]] = {}
    for block, line in _lines(batches):
        if block not in found:
            found[block] = [False, True, False, False, block[1] == 0 and line.endswith(b"\r")]
        state = found[block]
        for i in (0, 1):
            state[i] = ends_inside(line, state[i])
            state[2 + i] |= not state[i]
    for block, state in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*block, *state)], ["path", "block", *_ENDS])


_ENDS = ["outside", "inside", "outside_ends", "inside_ends", "two_signs"]


def _begins(ends: list) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """Of each block: whether it begins inside quotes, the block where its first record began, whether lines end in two signs."""
    found = {}
    path, inside, owner, two_signs = None, False, 0, False
    for r in sorted(ends, key=lambda r: (r["path"], r["block"])):
        if r["path"] != path:
            path, inside, owner, two_signs = r["path"], False, r["block"], r["two_signs"]
        found[path, r["block"]] = inside, owner, two_signs
        if not inside or r["inside_ends"]:
            owner = r["block"]
        inside = r["inside"] if inside else r["outside"]
    return found


def large_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows (path, block, row, record): all records but each file's header, and empty ones, as text without the line end.

    `block` and `row` order the records of a file. A line break within quotes is one sign, as Spark's own reader gives it.
    """
    raw = spark.read.text(list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    # One row per block comes to the driver.
    ends = raw.mapInArrow(_ends, ", ".join(["path string, block long", *(f"{c} boolean" for c in _ENDS)])).collect()
    begins = spark.sparkContext.broadcast(_begins(ends))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A whole record has piece -1; of one that crosses blocks each part has its own block as piece, and the block it began in."""
        out: list[tuple] = []
        held: list[bytes] = []
        now, row, inside, owner, crosses, two_signs = None, 0, False, 0, False, False

        def taken() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["path", "block", "row", "piece", "record"])
            out.clear()
            return batch

        def rest() -> None:
            """What is open at the end of a block."""
            if held:
                out.append((now[0], owner if crosses else now[1], LAST, now[1], b"\n".join(held)))
                held.clear()

        for block, line in _lines(batches):
            if block != now:
                rest()
                now, row = block, 0
                inside, owner, two_signs = begins.value[block]
                crosses = inside
            inside = ends_inside(line, inside)
            held.append(line[:-1] if two_signs and line.endswith(b"\r") else line)
            if not inside:
                if crosses:
                    rest()
                    crosses = False
                else:
                    out.append((now[0], now[1], row, -1, b"\n".join(held)))
                    held.clear()
                    row += 1
            if len(out) >= BATCH:
                yield taken()
        rest()
        if out:
            yield taken()

    pieces = raw.mapInArrow(join, "path string, block long, row long, piece long, record binary")
    # At most one record per block crosses its end, the last one that begins there.
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", F.col("record").cast("string").alias("record")))), lambda p: p["record"])
    crossed = pieces.filter("piece >= 0").groupBy("path", "block", "row").agg(F.array_join(parts, "\n").alias("record"))
    whole = pieces.filter("piece < 0").select("path", "block", "row", F.col("record").cast("string").alias("record"))
    return whole.unionByName(crossed).filter("NOT (block = 0 AND row = 0) AND record <> ''")
