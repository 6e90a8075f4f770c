"""Ranked lexical search: for every item the documents of highest inner product of term weights and term impacts.

The items are a stated query set, taken in blocks of about `BLOCK_BYTES` of text, each against all documents. Of a block's
terms, one scan forms the documents' sparse vectors (term, occurrences), packed in runs of `RUN_DOCS` documents and
stored once; sums over them give the number of documents, their length and the terms' document frequencies. A second
pass turns occurrences into integer impacts and orders the vectors of a run by length (norm), in buckets:

* Cauchy-Schwarz: a bucket whose longest vector times the length of the query stays below the query's threshold is left out, and so are
  all after it. The threshold is the score that the task's best `k` documents so far reach.
* Coordinate bounds: the query's heaviest coordinates are added up. The others can add at most the sum of their weights
  times the largest impacts of the run, and at most the product of what is left of the lengths of query and document.
  Documents below the threshold by the smaller of the two are left out.
* Survivors are scored anew, exactly, in 64-bit integers; bounds are in doubles and have a margin.

A task returns at most `k` documents per query, which are ranked within parts of the documents first and then as a whole. Vectors are
never shuffled; memory is one run of vectors and the block's terms.

Defined cases: a null text, or one without terms, is no document. Every row of the items is an item, repeated or without an
id or not; one without known terms has no result. Repeated documents are ranked each; a null doc_id counts as the smallest. Very long texts are read
whole. Without documents or without items the result is empty. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lagwise.llm.chunks import pack, unpack
from lagwise.llm.common import bounded_batches, documents, held, normalised
from lagwise.session import cut_lineage

BLOCK_BYTES = 2_000_000
RUN_DOCS = 4_096
RUN_TERMS = 4_000_000
BUCKET_DOCS = 256
# Coordinates are added up until the others can add at most this share of the threshold.
REST = 0.25
MARGIN = 1 + 1e-9
PARTS = 64


def runs_of(batches: Iterator[pa.RecordBatch], code: dict[bytes, int]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents that have terms: ids, lengths, known terms per document, terms and their occurrences."""
    get, width = code.get, len(code)
    ids: list = []
    sizes: list[int] = []
    counts, terms, times, total = [], [], [], 0
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        at = 0
        while at < len(keys):
            found, begin, taken = [], len(sizes), 0
            # Up to a full run, or some MB of words, at a time.
            while at < len(keys) and len(sizes) < RUN_DOCS and taken < RUN_TERMS:
                words = held(normalised(texts[at].as_py()).split())
                if words:
                    ids.append(keys[at].as_py())
                    sizes.append(len(words))
                    taken += len(words)
                    found.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
                at += 1
            if found:
                flat = np.concatenate(found)
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                known = flat >= 0
                cells, often = np.unique(owner[known] * width + flat[known], return_counts=True)
                counts.append(np.bincount(cells // width if width else cells, minlength=len(sizes) - begin))
                terms.append((cells % width if width else cells).astype(np.int32))
                times.append(often.astype(np.int32))
                total += len(cells)
            if len(sizes) >= RUN_DOCS or total >= RUN_TERMS:
                yield ids, np.array(sizes, np.int64), np.concatenate(counts), np.concatenate(terms), np.concatenate(times)
                ids, sizes, counts, terms, times, total = [], [], [], [], [], 0
    if sizes:
        yield ids, np.array(sizes, np.int64), np.concatenate(counts), np.concatenate(terms), np.concatenate(times)


def vectors(docs: DataFrame, code: dict[bytes, int]) -> DataFrame:
    """Stored rows: packed runs with their number of documents and terms; one row a task with document frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(code)
    schema = "run binary, n_docs long, n_terms long, df array<long>"
    names, types = ["run", "n_docs", "n_terms", "df"], [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value), np.int64)
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)
        for ids, sizes, counts, terms, times in runs_of(batches, sent.value):
            df += np.bincount(terms, minlength=len(df))
            yield row(pack(ids, sizes, counts, terms, times), len(ids), int(sizes.sum()), None)
        yield row(None, 0, 0, df)

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(read, schema))


class Run:
    """The impact vectors of a run of documents, in order of falling length."""

    def __init__(self, blob: bytes, n_all: int, length_all: int, width: int):
        self.ids, sizes, counts, terms, times = unpack(blob)
        mean = 50 + (50 * sizes * n_all) // length_all
        t = times.astype(np.int64)
        impact = (1_000_000_000 * t) // (1000 * t + 20 * np.repeat(mean, counts))
        owner = np.repeat(np.arange(len(sizes)), counts)
        square = np.bincount(owner, impact.astype(float) ** 2, minlength=len(sizes))
        order = np.argsort(-square, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.square = square[order]
        self.norm = np.sqrt(self.square)
        self.longest = self.norm[::BUCKET_DOCS]
        by_id = sorted(range(len(order)), key=lambda i: (self.ids[order[i]] is not None, self.ids[order[i]]))
        self.id_rank = np.empty(len(order), np.int64)
        self.id_rank[by_id] = np.arange(len(order))
        self.order = order
        # By document for scoring, by term for the bounds; both with documents in order of length.
        rows = np.argsort(place[owner], kind="stable")
        self.terms, self.impact = terms[rows], impact[rows]
        self.begin = np.concatenate([[0], np.cumsum(counts[order])])
        columns = np.lexsort((place[owner], terms))
        self.column_docs, self.column_impact = place[owner][columns], impact[columns].astype(float)
        self.edges = np.searchsorted(terms[columns], np.arange(width + 1))
        self.most = np.zeros(width)
        np.maximum.at(self.most, terms, impact)

    def survivors(self, terms: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
        """Documents that may score `least`: by the norms of buckets, then by coordinates. Terms come by falling weight."""
        squares = np.append(np.cumsum((weights * weights)[::-1])[::-1], 0.0)
        live = min(len(self.norm), BUCKET_DOCS * int(np.searchsorted(-self.longest, -least / (math.sqrt(squares[0]) * MARGIN), side="right")))
        if not live:
            return np.empty(0, np.int64)
        # What the coordinates from each place on can add at most; the leading ones are those before it gets small.
        tail = np.append(np.cumsum((weights * self.most[terms])[::-1])[::-1], 0.0)
        cut = int(np.argmax(tail <= REST * least))
        score, square = np.zeros(live), np.zeros(live)
        for term, weight in zip(terms[:cut].tolist(), weights[:cut].tolist()):
            a, b = self.edges[term], self.edges[term + 1]
            b = a + np.searchsorted(self.column_docs[a:b], live)
            at, impact = self.column_docs[a:b], self.column_impact[a:b]
            score[at] += weight * impact
            square[at] += impact * impact
        left = np.sqrt(np.maximum(self.square[:live] * MARGIN - square, 0))
        bound = score + np.minimum(math.sqrt(squares[cut]) * left, tail[cut])
        return np.flatnonzero(bound * MARGIN >= least)

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; `weights` has the query's weight of every term."""
        sizes = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.begin[rows] - (ends - sizes), sizes)
        sums = np.concatenate([[0], np.cumsum(weights[self.terms[at]] * self.impact[at])])
        return sums[ends] - sums[ends - sizes]


def best(runs: Iterator[Run], queries: list[np.ndarray], weights: np.ndarray, k: int) -> list[list[tuple[int, object]]]:
    """Per query the k best (score, id) over all runs."""
    found: list[list[tuple[int, object]]] = [[] for _ in queries]
    plans = [t[np.argsort(-weights[t], kind="stable")] for t in (q[weights[q] > 0] for q in queries)]
    dense = np.zeros(len(weights), np.int64)
    for run in runs:
        for q, terms in enumerate(plans):
            if not len(terms):
                continue
            least = found[q][-1][0] if len(found[q]) == k else 1
            rows = run.survivors(terms, weights[terms].astype(float), least)
            if not len(rows):
                continue
            dense[terms] = weights[terms]
            scores = run.scores(rows, dense)
            dense[terms] = 0
            good = np.flatnonzero(scores >= least)
            top = good[np.lexsort((run.id_rank[rows[good]], -scores[good]))[:k]]
            new = [(int(scores[i]), run.ids[run.order[rows[i]]]) for i in top]
            if new:
                found[q] = sorted(found[q] + new, key=lambda x: (-x[0], x[1] is not None, x[1]))[:k]
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): of every item the k documents of highest score above 0; ties by doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = cut_lineage(items.select("item_id", "text", F.monotonically_increasing_id().alias("q")))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    id_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    out: DataFrame | None = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "text").orderBy("q").collect()
        code: dict[bytes, int] = {}
        queries = [np.array(sorted({code.setdefault(w, len(code)) for w in held(normalised(r["text"]).split())}), np.int64) for r in part]
        stored = vectors(docs, code)
        n_all, length_all = stored.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        # One row per term of the block.
        df = dict(stored.select(F.posexplode("df")).groupBy("pos").agg(F.sum("col")).collect())
        weights = np.array([math.floor(1000 * math.log((2 * (n_all or 0) + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(code))], np.int64)
        sent = spark.sparkContext.broadcast((queries, [r["q"] for r in part], weights, n_all, length_all))
        kind = to_arrow_type(id_type)

        def rank(batches: Iterator[pa.RecordBatch], sent=sent, kind=kind) -> Iterator[pa.RecordBatch]:
            queries, names, weights, n_all, length_all = sent.value
            runs = (Run(blob.as_py(), n_all, length_all, len(weights)) for batch in batches for blob in batch.column(0))
            for name, top in zip(names, best(runs, queries, weights, k)):
                if top:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(top)), pa.array([s for s, _ in top], pa.int64()), pa.array([i for _, i in top], kind)],
                        ["q", "score", "doc_id"],
                    )

        got = stored.filter("run IS NOT NULL").select("run").mapInArrow(rank, f"q long, score long, doc_id {id_type.simpleString()}")
        out = got if out is None else out.unionByName(got)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    parts = Window.partitionBy("q", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    few = out.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= k).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", F.col("item_id").cast(item_type).alias("item_id")), "q").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), sized AS (
  SELECT r, doc_id, w, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0
), whole AS (
  SELECT count(*)::BIGINT AS n_all, sum(n)::BIGINT AS length_all FROM sized
), asked AS (
  SELECT row_number() OVER () AS q, item_id, text FROM benchmark
), terms AS (
  SELECT DISTINCT q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM asked
), occurrences AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM terms) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*)::BIGINT AS df FROM occurrences GROUP BY term), whole
), impacts AS (
  SELECT r, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // length_all)) AS impact
  FROM occurrences JOIN sized USING (r), whole
), scores AS (
  SELECT q, r, sum(weight * impact)::BIGINT AS score FROM terms JOIN weights USING (term) JOIN impacts USING (term) GROUP BY q, r
), ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank
  FROM scores JOIN sized USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN asked USING (q) WHERE rank <= 50
"""
