"""Substring dedup by level-wise doubling.

A window is a run of `length` words. The levels are its length halved (rounded up) until at most `SHORTEST` words are left,
50, 25, 13, 7, and are worked through from the shortest. At the first level a window is represented by the block of the lowest hash in it:
equal windows choose the same one, so none is missed, while about one position in twenty is sent. Blocks that repeat in another
document, and only those, are extended to the next length, forwards or, where the window has no room, backwards; at the last
level the block is the window. A level that nothing reaches sends nothing. A word is removed by the last level alone.

Each level is one exchange. A chunk of documents sends every distinct candidate once, as a 64-bit hash with a 32-bit
check, both of the two halves' hashes, and the lowest and highest doc_id that has it in the chunk; candidates
are split into buckets by hash, one for every `BUCKET_BYTES` of text at least, so a bucket does not grow with the corpus. The lowest id
over all chunks goes back to chunks where a higher one has the candidate. A passage that a third of all documents share is thus one value
per chunk. Chunks are cut and tokenised once, as numbers of words and the distinct words; all levels read the one shuffle that deals them.

A word is removed when a window over it also starts in a document with a smaller doc_id. Defined cases: a null text has
no words; a null id counts as larger than every other, and rows without id do not remove each other's words; nor do rows with the
same id. An empty table gives an empty result. Very long texts are read whole; a chunk holds at least one. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.chunks import chunks, pack, unpack
from lagwise.llm.common import bounded_batches, documents, words

LENGTH = 50
SHORTEST = 7
BUCKETS_PER_PARTITION = 2
BUCKET_BYTES = 8_000_000
NO_ID = np.iinfo(np.int64).max
R = 0x9FB21C651E98DF25
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _windows(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every run of `length` values, modulo 2^64."""
    n = len(values)
    if n < length:
        return np.empty(0, np.uint64)
    if not _POWERS or len(_POWERS[0]) < n + 1:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 20), x, np.uint64)])) for x in (R, pow(R, -1, 1 << 64))]
    up, down = _POWERS
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down[:n])])
    return _mix((total[length:] - total[:-length]) * up[: n - length + 1])


def _lowest(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the lowest of each `span` neighbours, the first of equals."""
    low, place, width = values, np.arange(len(values)), 1

    def join(low, place, shift):
        right, at = low[shift:], place[shift:]
        left, own = low[: len(right)], place[: len(right)]
        take = right < left
        return np.where(take, right, left), np.where(take, at, own)

    while 2 * width <= span:
        low, place = join(low, place, width)
        width *= 2
    return join(low, place, span - width)[1] if span > width else place


def levels(length: int) -> list[int]:
    """Block lengths from the shortest to `length`; each is at most twice the one before."""
    sizes = [length]
    while sizes[-1] > SHORTEST:
        sizes.append((sizes[-1] + 1) // 2)
    return sizes[::-1]


def tokenised(ids: list, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, bytes]:
    """Ids, words per document, the number of every word (its four bytes apart, which packs better), and the distinct words."""
    tokens = [words(t) for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    seen: dict[bytes, int] = {}
    order = np.fromiter((seen.setdefault(w, len(seen)) for d in tokens for w in d), "<i4", int(sizes.sum()))
    return [None if i is None or i != i else int(i) for i in ids], sizes, np.ascontiguousarray(order.view(np.uint8).reshape(-1, 4).T), b" ".join(seen)


class Chunk:
    """Words and word hashes of a chunk's documents, its windows, and the block that stands for a window at each level."""

    def __init__(self, ids: list, sizes: np.ndarray, numbers: np.ndarray, distinct: bytes, length: int):
        self.ids, self.sizes, self.first = ids, sizes, np.cumsum(sizes) - sizes
        self.order, self.distinct = np.ascontiguousarray(numbers.T).view("<i4").ravel(), distinct.split()
        table = np.fromiter(map(xxhash.xxh64_intdigest, self.distinct), np.uint64, len(self.distinct))
        self.flow = table[self.order] if len(table) else np.empty(0, np.uint64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.id_of = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.length, self.known = length, {}
        self.levels = levels(length)
        n = len(self.flow) - length + 1
        if n < 1:
            self.inside = self.anchor = np.empty(0, np.int64)
            return
        # Starts of windows that lie inside one document.
        self.inside = np.flatnonzero(self.owner[:n] == self.owner[length - 1 :])
        shortest = self.levels[0]
        key, _ = self.marks(shortest, np.arange(len(self.flow) - shortest + 1))
        self.anchor = _lowest(key, length - shortest + 1)[self.inside]

    def marks(self, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and check of the blocks of `size` words that start at these places."""
        half = (size + 1) // 2
        if half not in self.known:
            self.known[half] = _windows(self.flow, half)
        left, right = self.known[half][at], self.known[half][at + size - half]
        key = _mix(left * np.uint64(R) + right)
        return key, (_mix(right * np.uint64(0xC2B2AE3D27D4EB4F) + (left ^ (left >> np.uint64(17)))) >> np.uint64(32)).astype(np.uint32)

    def blocks(self, size: int) -> np.ndarray:
        """Where the block of this level starts, per window: at the anchor, or so that it ends with the anchor."""
        if size == self.length:
            return self.inside
        room = self.length - self.levels[-2]
        return np.where(self.anchor - self.inside <= room, self.anchor, self.anchor + self.levels[0] - size)

    def candidates(self, size: int, before: int | None = None, repeated: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, check and id of this level's blocks; of windows whose block of the level before is among the repeated keys."""
        at = self.blocks(size)
        if before is not None and len(at):
            at = at[np.isin(self.marks(before, self.blocks(before))[0], repeated)]
        at = np.unique(at)
        return *self.marks(size, at), self.id_of[self.owner[at]]

    def texts(self, spans: list[list[tuple[int, int]]]) -> list[str]:
        """The words of every document outside its runs, joined by one space."""
        out = []
        for a, n, runs in zip(self.first.tolist(), self.sizes.tolist(), spans):
            left = [self.distinct[k] for k in self.order[a : a + n].tolist()]
            for first, last in reversed(runs):
                del left[first:last]
            out.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        return out

    def spans(self, starts: np.ndarray) -> list[list[tuple[int, int]]]:
        """Per document the merged runs [first, last) of words covered by windows at these starts."""
        edge = np.zeros(len(self.owner) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.length, -1)
        covered = np.cumsum(edge)[:-1] > 0
        out: list[list[tuple[int, int]]] = []
        for a, n in zip(self.first, self.sizes):
            flags = np.flatnonzero(np.diff(np.concatenate([[0], covered[a : a + n].astype(np.int8), [0]])))
            out.append(list(zip(flags[::2].tolist(), flags[1::2].tolist())))
        return out


def _candidates(key: np.ndarray, check: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, check), each with its lowest and highest id, in order of the key."""
    order = np.lexsort((check, key))
    key, check, ids = key[order], check[order], ids[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])) if len(key) else np.empty(0, np.int64)
    if not len(new):
        return key, check, ids, ids
    return key[new], check[new], np.minimum.reduceat(ids, new), np.maximum.reduceat(ids, new)


SENT = "chunk string, bucket int, data binary"


def _sent(name: str, key: np.ndarray, check: np.ndarray, ids: np.ndarray, buckets: int) -> pd.DataFrame:
    key, check, low, high = _candidates(key, check, ids)
    # Buckets are ranges of the hash, so each is a slice of the sorted keys.
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.empty(0, np.int64)
    edges = [*first.tolist(), len(key)]
    data = [pack(key[a:b], check[a:b], low[a:b], (high - low)[a:b]) for a, b in zip(edges, edges[1:])]
    return pd.DataFrame({"chunk": name, "bucket": bucket[first], "data": data}, columns=["chunk", "bucket", "data"])


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: per chunk the candidates that a smaller id has too, with the lowest id of all."""
    got = [unpack(d) for d in rows["data"]]
    key, check, low, high = (np.concatenate([g[k] for g in got]) for k in range(4))
    high = low + high
    source = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    order = np.lexsort((check, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])])
    least = np.empty(len(key), np.int64)
    most = np.empty(len(key), np.int64)
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least[order] = np.minimum.reduceat(low[order], at)[group]
    most[order] = np.maximum.reduceat(high[order], at)[group]
    keep = np.flatnonzero(least < most)  # in two documents at least
    parts = np.split(keep, np.searchsorted(source[keep], np.arange(1, len(got))))
    return pd.DataFrame(
        [(c, pack(key[p], check[p], least[p])) for c, p in zip(rows["chunk"], parts) if len(p)], columns=["chunk", "data"],
    )


def _found(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = [unpack(d) for d in rows["data"]]
    kinds = (np.uint64, np.uint32, np.int64)
    return tuple(np.concatenate([g[k] for g in got]) if got else np.empty(0, kinds[k]) for k in range(3))


def _exchange(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInPandas(_compare, "chunk string, data binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (doc_id, n_words, spans, kept): the runs of words to remove, and the other words joined by one space."""
    if length < 1:
        raise ValueError("length must be positive")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), volume // BUCKET_BYTES)
    sizes = levels(length)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, ids, texts in chunks(batches):
            yield pd.DataFrame({"chunk": [name], "data": [pack(*tokenised(ids, texts))]})

    held = rows.mapInPandas(cut, "chunk string, data binary").groupBy("chunk")

    def first_level(held: pd.DataFrame) -> pd.DataFrame:
        return _sent(held["chunk"].iloc[0], *Chunk(*unpack(held["data"].iloc[0]), length).candidates(sizes[0]), buckets)

    def next_level(before: int, size: int):
        def extend(held: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(found):
                return pd.DataFrame(columns=["chunk", "bucket", "data"])
            got = Chunk(*unpack(held["data"].iloc[0]), length).candidates(size, before, np.unique(_found(found)[0]))
            return _sent(held["chunk"].iloc[0], *got, buckets)

        return extend

    def remove(held: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(*unpack(held["data"].iloc[0]), length)
        starts = np.empty(0, np.int64)
        if len(found):
            known, marks, least = _found(found)
            order = np.lexsort((marks, known))
            known, marks, least = known[order], marks[order], least[order]
            at = chunk.inside
            key, check = chunk.marks(length, at)
            ids = chunk.id_of[chunk.owner[at]]
            left = np.searchsorted(known, key)
            hit = np.zeros(len(key), bool)
            for k in range(int(np.unique(known, return_counts=True)[1].max())):  # checks per key, one as a rule
                place = np.minimum(left + k, len(known) - 1)
                hit |= (known[place] == key) & (marks[place] == check) & (least[place] < ids)
            starts = at[hit]
        spans = chunk.spans(starts)
        runs = [[{"first": a, "last": b} for a, b in s] for s in spans]
        return pd.DataFrame({"doc_id": pd.array(chunk.ids, "Int64"), "n_words": chunk.sizes, "spans": runs, "kept": chunk.texts(spans)})

    found = _exchange(held.applyInPandas(first_level, SENT))
    for before, size in zip(sizes, sizes[1:]):
        found = _exchange(held.cogroup(found.groupBy("chunk")).applyInPandas(next_level(before, size), SENT))
    return held.cogroup(found.groupBy("chunk")).applyInPandas(
        remove, "doc_id long, n_words long, spans array<struct<first: long, last: long>>, kept string",
    )


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    rows = repeated_spans(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
