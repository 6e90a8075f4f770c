"""Language identification with string kernels.

A text is the set of its letter n-grams of lengths 1 to 4 (a blended spectrum; presence, not counts), hashed
into 2^15 buckets. The kernel of two texts is the size of the common set over the root of the product of sizes.
Landmarks give the Nystroem map, and one ridge regression per language is solved on it. Scoring a batch is one
product of its presence matrix with the landmark matrix and one with the weights.

Learning uses a hash-chosen sample of at most `SAMPLE_PER_LANG` rows per language and `SAMPLE_ROWS` in all (a
documented bound; a linear number of landmarks comes from it). Whole texts are used in learning and scoring.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text when nothing can be
learned. Ties go to the first language by code point. Repeated rows give repeated results. Very long texts are read
whole. An empty table gives an empty result. Only id and text are read, in learning lang as well, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lagwise.llm.common import bounded_batches, class_table, code_points, documents, held_out, parts

LENGTHS = (1, 2, 3, 4)
BITS = 15
LANDMARKS = 128
RIDGE = 1e-4
SAMPLE_PER_LANG = 400
SAMPLE_ROWS = 4000
UNKNOWN = "und"
BATCH = 128


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of all n-grams of the lower-cased text; runs of other characters count as one space."""
    codes = code_points((text or "").lower())
    letter = class_table("isalpha")[codes]
    if not letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(letter, codes, 32).astype(np.uint32)
    codes = codes[np.concatenate(([True], letter[1:] | letter[:-1]))]
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    found, rolling = [], np.zeros(len(codes), np.uint32)
    for n in LENGTHS:
        if len(codes) < n:
            break
        rolling = rolling[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] * np.uint32(2 * n + 1)
        mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(found)


def presence(texts: list[str | None]) -> np.ndarray:
    """One row per text with a one for every bucket it has."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, text in zip(out, texts):
        row[buckets(text)] = 1
    return out


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Common n-grams over the root of the product of set sizes; zero for an empty set."""
    sizes = np.sqrt(np.maximum(rows.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))[None, :]
    return (rows @ landmarks.T) / sizes


def fit(docs: DataFrame, learn, per_lang: int = SAMPLE_PER_LANG, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """Model from rows where `learn` holds and lang is not null; None when there are none.

    The driver gets one count per language and the sample's packed n-gram sets (4 KB a row), never texts.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    names, want = sorted(counts), max(2, min(per_lang, sample_rows // len(counts)))

    @pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(row.astype(bool)).tobytes() for chunk in parts(texts, BATCH) for row in presence(chunk)], dtype=object)

    # An expected share 1.3 times the wish, then the first in hash order; rows of equal hash are copies.
    scale = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 1.3 * want / n) * 1_000_000)))])
    rank_of_hash = F.pmod("h", F.lit(1_000_000))
    sample = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).withColumn("rank", rank_of_hash)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "h"))
    sample = sample.filter(F.col("rank") < scale[F.col("lang")]).withColumn("place", place).filter(F.col("place") <= want)
    got = sample.select("lang", "rank", packed("text").alias("grams")).collect()
    by_lang: dict[str, list[bytes]] = {k: [] for k in names}
    for r in sorted(got, key=lambda r: (r["rank"], r["grams"])):
        if len(by_lang[r["lang"]]) < want:
            by_lang[r["lang"]].append(bytes(r["grams"]))
    grams = [(k, g) for k in names for g in by_lang[k]]
    if not grams:
        return None
    x = np.array([np.unpackbits(np.frombuffer(g, np.uint8)) for _, g in grams], np.float32)
    y = np.array([[1.0 if k == n else -1.0 for n in names] for k, _ in grams])
    share = max(1, LANDMARKS // len(names))
    first = [i for k in names for i in [j for j, (l, _) in enumerate(grams) if l == k][:share]]
    marks = x[first]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(x, marks) @ root
    # Languages weigh the same, however many rows each has.
    weight = np.array([1 / max(1, len(by_lang[k])) for k, _ in grams])
    weight /= weight.sum()
    mean, base = weight @ phi, weight @ y
    centred = phi - mean
    solved = np.linalg.solve(centred.T @ (weight[:, None] * centred) + RIDGE * np.eye(phi.shape[1]), centred.T @ (weight[:, None] * (y - base)))
    return {"names": names, "marks": np.packbits(marks.astype(bool), axis=1), "weights": root @ solved, "bias": base - mean @ solved}


def classify(docs: DataFrame, model: dict | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score): the language of every text and a score from 0 to 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # landmarks x 4 KB, bounded

    @pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        if known:
            marks = np.unpackbits(known["marks"], axis=1).astype(np.float32)
            names = np.array(known["names"], dtype=object)
        for batch in batches:
            out_names, out_scores = [], []
            for chunk in parts(batch, BATCH):
                rows = presence(chunk) if known else np.zeros((len(chunk), 1), np.float32)
                if not known:
                    out_names += [UNKNOWN] * len(chunk)
                    out_scores += [0.0] * len(chunk)
                    continue
                values = kernel(rows, marks) @ known["weights"] + known["bias"]
                best = values.argmax(1)
                has = rows.any(1)
                out_names += list(np.where(has, names[best], UNKNOWN))
                out_scores += list(np.where(has, np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1), 0.0))
            yield pd.DataFrame({"lang_pred": out_names, "score": out_scores})

    return docs.select("doc_id", score("text").alias("r")).select("doc_id", "r.lang_pred", "r.score")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir)
    model = fit(docs, ~held_out(5, 0))
    return classify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
