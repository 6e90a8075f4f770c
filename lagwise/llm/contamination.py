"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, one scan of the texts.

Texts and items are normalised alike: A-Z in lower case, words of letters, digits and all characters beyond ASCII. A
window is `window` consecutive words of an item; a shorter item is one window. In a task every word that some item has
is one character of a code, every other word the same unused one; the automaton is built over the coded windows and
reads each coded document once. Ends of matches are word places; normalising keeps byte offsets, so runs of hit
words map straight to the bytes of the original text.

Windows are formed in Spark. They reach the tasks by broadcast, in blocks of about `BLOCK_BYTES`; the bytes are counted
first, and a word of more than 64 bytes stands as its digest, so a window has a bound as well. Up to that size there is one
automaton, and no shuffle at all. Beyond it the texts are scanned once per block, and the hits, which only hit documents
have, are put together by id and text digest.

Defined cases: a null or empty text has no words and no hits, and an item without words no windows. An item without an id
makes words hit but is not among the items; items that share an id are one. Repeated documents have a row each. Very long
texts are read whole. Without documents the result is empty; without items nothing is hit. Only id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lagwise.llm.common import bounded_batches, documents, held, normalised, utf8

WINDOW = 10
BLOCK_BYTES = 4_000_000
# The first code that no word has, and the range of code points that are no characters by themselves.
UNKNOWN, SURROGATES, SURROGATE_COUNT = "\0", 0xD800, 0x800
RUNS = "array<struct<first:int,last:int,start:int,end:int>>"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct rows (item, key): the windows of every item, as words joined by one blank."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                words = held(normalised(text.as_py()).split())
                keys = [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []
                for at in range(0, len(keys), 1000):
                    part = keys[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(part), pa.string()), pa.array(part, pa.binary())], ["item", "key"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(cut, "item string, key binary").distinct()


class Scanner:
    """The automaton of some windows."""

    def __init__(self, windows: list[tuple[str | None, bytes]]):
        import ahocorasick

        self.code: dict[bytes, str] = {}
        self.items: list[list[str]] = []
        places: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton()
        for item, key in windows:
            at = places.get(key)
            if at is None:
                at = places[key] = len(self.items)
                self.items.append([])
                words = key.split(b" ")
                self.automaton.add_word("".join(self.code.setdefault(w, self._sign(len(self.code))) for w in words), (len(words), at))
            if item is not None:
                self.items[at].append(item)
        if places:
            self.automaton.make_automaton()

    @staticmethod
    def _sign(n: int) -> str:
        n += 1
        return chr(n if n < SURROGATES else n + SURROGATE_COUNT)

    def scan(self, text: str | None) -> tuple[int, list[dict], list[str]]:
        """Words of the text, runs of hit words with their bytes, and items found."""
        normal = normalised(text)
        words = normal.split()
        if not self.code or not words:
            return len(words), [], []
        get = self.code.get
        coded = "".join([get(w, UNKNOWN) for w in held(words)])
        found = list(self.automaton.iter(coded))
        if not found:
            return len(words), [], []
        last = np.array([end for end, _ in found])
        first = last + 1 - np.array([n for _, (n, _) in found])
        depth = np.cumsum(np.bincount(first, minlength=len(words) + 1) - np.bincount(last + 1, minlength=len(words) + 1))
        edges = np.diff(np.concatenate([[0], (depth > 0).astype(np.int8)]))
        spans = [m.span() for m in re.finditer(rb"[^ ]+", normal)]
        runs = [
            {"first": a, "last": b - 1, "start": spans[a][0], "end": spans[b - 1][1]}
            for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())
        ]
        return len(words), runs, sorted({item for at in {at for _, (_, at) in found} for item in self.items[at]})


def joined(runs: list[dict]) -> list[dict]:
    """Runs of several scans as one list without overlaps."""
    out: list[dict] = []
    for run in sorted(runs, key=lambda r: (r["first"], -r["last"])):
        if out and run["first"] <= out[-1]["last"] + 1:
            if run["last"] > out[-1]["last"]:
                out[-1] |= {"last": run["last"], "end": run["end"]}
        else:
            out.append(dict(run))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, runs, items): runs of hit words, by word places and by bytes of the original UTF-8 text
    (last word within, end byte beyond), and the ids of items found, sorted as strings."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, mark binary, n_words long, runs {RUNS}, items array<string>, counted long"
    names = ["doc_id", "mark", "n_words", "runs", "items", "counted"]
    run_type = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")]))
    types = [to_arrow_type(kind), pa.binary(), pa.int64(), run_type, pa.list_(pa.string()), pa.int64()]
    windows = item_windows(benchmark, window)
    weight = F.length("key") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16
    total = windows.agg(F.sum(weight)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))

    def scan(block: int) -> DataFrame:
        part = windows.filter(F.pmod(F.xxhash64("item", "key"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r["item"], bytes(r["key"])) for r in part.collect()])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(sent.value)
            for batch in batches:
                columns: list[list] = [[] for _ in names]
                for key, text in zip(batch.column(0), batch.column(1)):
                    n, runs, items = scanner.scan(text.as_py())
                    if block == 0 or runs:
                        mark = hashlib.sha256(utf8(text.as_py())).digest()[:16] if blocks > 1 else None
                        for column, value in zip(columns, (key.as_py(), mark, n, runs, items, int(block == 0))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        return rows.mapInArrow(read, schema)

    if blocks == 1:
        return scan(0).select("doc_id", "n_words", "runs", "items")
    found = scan(0)
    for block in range(1, blocks):
        found = found.unionByName(scan(block))
    # Copies of a document have equal runs, so sets stay as small as the number of blocks.
    merged = found.groupBy("doc_id", "mark").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_set("runs")).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sum("counted").alias("counted"),
    )

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("runs")
            yield batch.set_column(at, "runs", pa.array([joined(r) for r in batch.column(at).to_pylist()], run_type))

    whole = merged.mapInArrow(put_together, schema)
    return whole.select("doc_id", "n_words", "runs", "items", F.explode(F.sequence(F.lit(1), "counted"))).drop("col")


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH item_words AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS body
  FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), places AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS body
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), matches AS (
  SELECT r, p.k, i, item FROM places p JOIN windows v ON p.k = v.k AND p.body = v.body
), hits AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM matches) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT r, item FROM matches WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits ON docs.r = hits.r LEFT JOIN items ON docs.r = items.r
"""
