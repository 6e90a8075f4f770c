"""Chunks: runs of documents of some MB of text, the unit in which texts and their parts are shuffled.

A chunk is named by its partition and its place there. Its data is one compressed value, so a shuffle moves few rows.
`signed_chunks` adds a digest of ids and texts to the name: of an input that two scans order differently, the parts of
a chunk then never meet parts of another one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext

if TYPE_CHECKING:
    import pandas as pd

CHUNK_CHARS = 4_000_000
SIGNED_CHARS = 2_000_000
CHUNK_ROWS = 50_000


def pack(*values) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(values, protocol=5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(blob)))


def chunks(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, list, list[str]]]:
    """Chunks of a partition: name, ids, texts."""
    part, serial, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
            ids.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= CHUNK_CHARS or len(texts) >= CHUNK_ROWS:
                yield f"{part}.{serial}", ids, texts
                serial, ids, texts, size = serial + 1, [], [], 0
    if texts:
        yield f"{part}.{serial}", ids, texts


def signed_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list, list[str]]]:
    """Chunks of a partition of Arrow batches (id, text): name with digest, ids, texts."""
    part, serial, ids, texts, size, mark = TaskContext.get().partitionId(), 0, [], [], 0, xxhash.xxh64()
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            ids.append(key.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            mark.update(repr(ids[-1]).encode())
            mark.update(texts[-1].encode("utf-8", "surrogatepass"))
            if size >= SIGNED_CHARS or len(texts) >= CHUNK_ROWS:
                yield f"{part}.{serial}.{mark.hexdigest()}", ids, texts
                serial, ids, texts, size, mark = serial + 1, [], [], 0, xxhash.xxh64()
    if texts:
        yield f"{part}.{serial}.{mark.hexdigest()}", ids, texts
