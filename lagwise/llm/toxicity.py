"""Toxicity with noisy-channel deobfuscation.

Words written with look-alike signs, with signs or blanks between letters, or with drawn-out letters are read as
lattices: every character offers letters with a cost. A Viterbi search finds the reading that is likeliest under a
character trigram model, which is counted over the words of all documents. The restored words, and their beginnings of four
to six letters, are then scored by their log-odds between toxic and other labelled documents, and the two
strongest words of a document give its score, scaled to a probability.

The lexicon is fitted on a hash-ordered sample of at most `SAMPLE` labelled rows of either label (a documented
bound; the ids are broadcast) and keeps at most `LEXICON` terms whose association is beyond chance. The character
counts cover all documents.

Defined cases: null and empty texts have no words and get the score of such. Several labels of one id count as the
lowest; null labels do not count. Without rows of both labels every score is 0. Repeated rows get the same score. Very long texts
are read whole. An empty table gives an empty result. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lagwise.llm.common import bounded_batches, code_points, class_table, documents, held_out, labels
from lagwise.llm.quality import one_label
from lagwise.session import cut_lineage

# What a sign may stand for (fixed values).
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": string.ascii_lowercase,
}
BETWEEN = ".-_*~'"
SYMBOLS = 28  # word edge, a to z, any other letter
COST = {"sign": -1.0, "any": -4.0, "drop": -1.5, "keep": -6.0, "repeat": -0.5}
PREFIXES = (4, 5, 6)
SAMPLE = 10_000
LEXICON = 5_000
MARGIN = 4.0  # a likelihood ratio of 2 log(terms) + MARGIN is reached by chance by one term in twenty corpora
LEAST_LIFT = 1.5  # log-odds
TRIM = string.punctuation + "…“”„«»¡¿"
CACHED = 300_000
MANY_STATES = 60  # below, no time is spent on leaving readings out
BINS = 200
MOST_SCORE = 20.0
SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*]+[^\W_@$!|]|[ .\-_*]+[@$!|]){2,}(?!\S)|(?<!\S)[@$!|](?:[ .\-_*]+[^\W_@$!|]){2,}(?!\S)")
ODD = re.compile(r"[0-9@$!|+(€£*._~\-]|([^\W\d_])\1\1")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def trigram_counts(texts: pd.Series) -> np.ndarray:
    """Counts of symbol triples of the letters of some texts; words are runs of letters between edges."""
    codes = code_points("\n".join(t or "" for t in texts).lower() + "\n")
    letter = class_table("isalpha")[codes]
    ids = np.where(letter, np.where((codes >= 97) & (codes <= 122), codes - 96, 27), 0).astype(np.int64)
    # One edge symbol after a word serves as the two before the next.
    ids = ids[np.concatenate(([True], (ids[1:] > 0) | (ids[:-1] > 0)))]
    before = np.concatenate(([0], ids[:-1]))
    two = np.concatenate(([0], before[:-1]))
    two = np.where(before == 0, 0, two)
    return np.bincount((two * SYMBOLS + before) * SYMBOLS + ids, minlength=SYMBOLS**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probability of a symbol after two others, from all documents; at most 28^3 counts reach the driver."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            total += trigram_counts(batch["text"])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"triple": at, "n": total[at]})

    got = docs.select("text").mapInPandas(count, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in got:
        counts[r["triple"]] = r["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0) + 0.5, three.sum((0, 1)) + 1.0
    low = two / two.sum(1, keepdims=True) * 0.9 + 0.1 * one / one.sum()
    return np.log((three + 5 * low[None]) / (three.sum(2, keepdims=True) + 5))


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest reading of an obfuscated lower-case token under the model."""
    # A state is the last two symbols and whether the last letter was drawn out; it keeps the best reading.
    states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
    most = -float(model.min())
    for c in token:
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
        for letter in LOOKS.get(c, ""):
            options.append((letter, COST["any"] if c == "*" else COST["sign"]))
        # Signs may stand for nothing; digits that look like a letter may not.
        drop = COST["drop"] if not c.isalnum() else COST["keep"] if not options else None
        new: dict[tuple[int, int, str], tuple[float, str]] = {}

        def offer(key, value, text):
            if key not in new or value > new[key][0]:
                new[key] = (value, text)

        for (a, b, last), (value, text) in states.items():
            for letter, cost in options:
                s = symbol(letter)
                offer((b, s, letter), value + cost + model[a, b, s], text + letter)
                if last == letter:  # a drawn-out letter adds nothing
                    offer((a, b, last), value + cost + COST["repeat"], text)
            if drop is not None:
                offer((a, b, last), value + drop, text)
        # Keep what can still win: readings of the same rest have the same contexts after three letters at most.
        if len(new) > MANY_STATES:
            least = max(value for value, _ in new.values()) - 3 * most
            new = {key: found for key, found in new.items() if found[0] >= least}
        states = new
    if not states:
        return token
    return max((value + model[a, b, 0], text) for (a, b, _), (value, text) in states.items())[1]


def readings(text: str | None, model: np.ndarray, known: dict[str, tuple[str, ...]]) -> set[str]:
    """The distinct words of a text, plain and restored. `known` remembers odd tokens."""
    low = (text or "").lower()
    out: set[str] = set()

    def read(token: str) -> None:
        got = known.get(token)
        if got is None:
            restored = restore(token, model)
            got = known[token] = (restored,) if restored else ()
        out.update(got)

    for token in set(low.split()):
        if token.isalpha():
            out.add(token)
            if ODD.search(token):
                read(token)
            continue
        core = token.strip(TRIM)
        if core:
            out.add(core)
            whole = token.rstrip(TRIM)
            odd = whole if whole[:1] in "@$" and len(whole) > 2 else core
            if ODD.search(odd) and any(c.isalpha() for c in odd) and not odd.isalpha() or ODD.search(core) and core.isalpha():
                read(odd)
                # Trailing signs may be letters too, as in a word that ends with look-alikes.
                if token[-1:] in "$@!|1" and token != odd and len(token) - len(odd) <= 2:
                    read(token.lstrip(TRIM.replace("@", "").replace("$", "")))
    for found in SPACED.finditer(low):
        read(re.sub(r"[ .\-_*]+", "", found.group()))
    return out


def terms(word: str) -> list[str]:
    """A word and its beginnings, which are marked as such."""
    return [word, *[word[:k] + "~" for k in PREFIXES if len(word) > k]]


def lexicon(docs: DataFrame, marks: DataFrame, model: np.ndarray, learn) -> dict:
    """Weights of the terms associated with label 1, and the scale of the document score."""
    spark = docs.sparkSession
    known = marks.filter(learn)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {"weights": {}, "scale": None}
    # At most SAMPLE ids of either label, so the broadcast is bounded.
    sample = known.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).unionByName(
        known.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    sent = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, tuple[str, ...]] = {}
        seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
        rows_of = [0, 0]

        def flush():
            for label, counts in enumerate(seen):
                if counts or rows_of[label]:
                    yield pd.DataFrame({"label": label, "term": [*counts, ""], "n": [*counts.values(), rows_of[label]]})
                    counts.clear()
                    rows_of[label] = 0

        for batch in batches:
            for label, text in zip(batch["label"], batch["text"]):
                own = {t for w in readings(text, sent.value, memory) for t in terms(w)}
                counts = seen[label]
                rows_of[label] += 1
                for t in own:
                    counts[t] = counts.get(t, 0) + 1
            if len(memory) > CACHED:
                memory.clear()
            if len(seen[0]) + len(seen[1]) > CACHED:
                yield from flush()
        yield from flush()

    parts = rows.mapInPandas(count, "label int, term string, n long")
    one = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    counts = cut_lineage(parts.groupBy("term").agg(one(1).alias("n1"), one(0).alias("n0")).filter("n1 > 0"))
    total = counts.filter("term = ''").first()
    if total is None or not total["n0"]:
        return {"weights": {}, "scale": None}
    # Terms of one or two documents are beside the point of chance: they are too many to be tested one by one.
    evidence = 2 * np.log(max(2, counts.filter("n1 > 2").count())) + MARGIN
    t1, t0 = float(total["n1"]), float(total["n0"])
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    both = (n1 + n0) / (t1 + t0)
    part = lambda n, rate: F.when(n > 0, n * F.log(n / rate)).otherwise(0.0)
    ratio = 2 * (part(n1, t1 * both) + part(n0, t0 * both) + part(t1 - n1, t1 * (1 - both)) + part(t0 - n0, t0 * (1 - both)))
    weight = F.log((n1 + 0.5) / (t1 + 1)) - F.log((n0 + 0.5) / (t0 + 1))
    strong = counts.filter("term <> ''").select("term", weight.alias("w"), ratio.alias("r"))
    strong = strong.filter((F.col("w") >= LEAST_LIFT) & (F.col("r") >= float(evidence))).orderBy(F.desc("r"), "term").limit(LEXICON)
    weights = {r["term"]: r["w"] for r in strong.collect()}
    found = {"weights": weights, "scale": None}
    scored = rows.select("label", _raw(spark, model, found)("text").alias("s"))
    got = scored.select("label", F.least(F.floor(F.col("s.raw") / MOST_SCORE * BINS), F.lit(BINS - 1)).alias("bin")).groupBy("label", "bin").count().collect()
    z = np.array([(r["bin"] + (0.5 if r["bin"] else 0)) * MOST_SCORE / BINS for r in got])
    y = np.array([float(r["label"]) for r in got])
    # Sampled rows weigh what they stand for.
    share = {1: sizes[1] / t1, 0: sizes[0] / t0}
    weight_of = np.array([r["count"] * share[r["label"]] for r in got])
    found["scale"] = logistic(z, y, weight_of)
    return found


def logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic regression, lightly ridged."""
    design, beta, ridge = np.column_stack([z, np.ones(len(z))]), np.array([0.1, 0.0]), np.diag([0.2, 0.2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve(design.T @ ((weight * p * (1 - p))[:, None] * design) + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def _raw(spark, model: np.ndarray, found: dict):
    """Column function: raw score and the words behind it."""
    sent = spark.sparkContext.broadcast((model, found["weights"]))

    @pandas_udf("raw double, words array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chars, weights = sent.value
        memory: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            raw, best = [], []
            for text in batch:
                hits = []
                for word in readings(text, chars, memory) if weights else ():
                    w = max((weights.get(t, 0.0) for t in terms(word)), default=0.0)
                    if w > 0:
                        hits.append((w, word))
                hits = sorted(hits, reverse=True)[:2]
                raw.append(sum(w for w, _ in hits))
                best.append([word for _, word in hits])
            if len(memory) > CACHED:
                memory.clear()
            yield pd.DataFrame({"raw": raw, "words": best})

    return run


def score(docs: DataFrame, model: np.ndarray, found: dict) -> DataFrame:
    """Rows (doc_id, score, words): probability of label 1, and the restored words that made it."""
    bounded_batches(docs.sparkSession)
    slope, offset = found["scale"] or (0.0, -40.0)
    raw = docs.select("doc_id", _raw(docs.sparkSession, model, found)("text").alias("s"))
    value = 1 / (1 + F.exp(-(F.least(F.col("s.raw"), F.lit(MOST_SCORE)) * slope + offset)))
    return raw.select("doc_id", (value if found["scale"] else F.lit(0.0)).alias("score"), "s.words")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_model(docs)
    found = lexicon(docs, one_label(labels(spark, sf_dir), "toxic"), model, ~held_out(3, 1))
    return score(docs, model, found).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "words",
    )
