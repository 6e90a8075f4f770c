"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# A side is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 16 MB, so that long texts do not pile up in a Python task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, with underscores added until the input has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def held_out(modulus: int, remainder: int) -> Column:
    """True for rows kept from learning: crc32 of the id as text. A row without id is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(True))


def attach(rows: DataFrame, side: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join a stored side with unique keys: by broadcast when counted small, else by shuffle and AQE's skew join."""
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(side) if small else side, on, how)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and \\x09-\\x0D; splitting bytes knows exactly these separators."""
    return utf8(text).split()


# Lower case for A-Z, a blank for all of ASCII that is neither letter nor digit; as many bytes as before.
_NORMAL = bytes(i if i >= 0x80 or chr(i).isalnum() else 32 for i in range(256)).lower()
LONG_WORD = 64


def normalised(text: str | None) -> bytes:
    """UTF-8 in which `split` finds the words of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return utf8(text).translate(_NORMAL)


def held(words: list[bytes]) -> list[bytes]:
    """Words, those over `LONG_WORD` bytes as a sign that no normalised word has and their digest."""
    if max(map(len, words), default=0) <= LONG_WORD:
        return words
    return [w if len(w) <= LONG_WORD else b"#" + hashlib.sha256(w).digest()[:24].replace(b" ", b"#") for w in words]


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


_TABLES: dict[str, np.ndarray] = {}


def class_table(test: str) -> np.ndarray:
    """One flag per code point, e.g. class_table("isalpha"); built once per worker."""
    if test not in _TABLES:
        _TABLES[test] = np.fromiter((getattr(chr(i), test)() for i in range(0x110000)), bool, 0x110000)
    return _TABLES[test]


def parts(texts: Iterable[str | None], size: int) -> Iterable[list[str | None]]:
    """Lists of at most `size` texts."""
    chunk: list[str | None] = []
    for text in texts:
        chunk.append(text)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk
