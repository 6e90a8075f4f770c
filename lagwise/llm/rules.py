"""Quality rules by weak supervision.

Rules look at a text and vote good, bad or abstain. The votes of all documents are counted per vote pattern (at
most 3^9 patterns, however many rows), and expectation-maximisation on the counts estimates each rule's accuracy,
from how often it votes on good and on bad documents. A document is kept when its posterior probability of being good reaches `KEEP` and
the base rule does not reject it.

A rule is never taken to be wrong more often than right, which keeps the roles of the classes. A document against
which no rule votes is kept whatever its posterior, and counts as good by half at least while the accuracies are estimated;
the posterior returned is the model's own. `one_word` abstains on texts below 30 words.

Defined cases: a null text is an empty one; it fails the base rule. Ties at `KEEP` are kept. An empty table gives an
empty result. Repeated rows get the same verdict.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lagwise.llm.common import bounded_batches, class_table, code_points, documents, free_name, words
from lagwise.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
KEEP = 0.5
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Name, vote, and the measure's bound: a rule votes when the measure lies beyond it (above for "over"), else it abstains.
#: That a defect is absent is no vote for a document; only the last two rules speak for one.
RULES = [
    ("repeats", BAD, "repeat_share", "over", 0.20),
    ("symbols", BAD, "symbol_share", "over", 0.10),
    ("same_lines", BAD, "same_line_share", "over", 0.30),
    ("capitals", BAD, "upper_share", "over", 0.50),
    ("bangs", BAD, "bang_share", "over", 0.30),
    ("one_word", BAD, "top_word_share", "over", 0.30),
    ("few_letters", BAD, "letter_share", "under", 0.60),
    ("plain_words", GOOD, "plain_share", "over", 0.80),
    ("enough_words", GOOD, "n_words", "over", 29),
]
CLASS_PRIOR = (8.0, 2.0)  # pseudo-counts of good and bad documents
VOTE_PRIOR = {BAD: ((1.0, 40.0), (1.0, 3.0)), GOOD: ((4.0, 1.0), (1.0, 1.0))}  # of voting and abstaining on good, on bad
ROUNDS = 200
PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?]?")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURED = StructType([*[StructField(c, LongType()) for c in COUNTS], StructField("pattern", IntegerType())])


def repeated_words(tokens: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Hashes only show which texts have none; the rest is exact."""
    n = len(tokens) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.uint64, len(tokens))
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, exact, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, window), axis=0, return_inverse=True, return_counts=True)
    edge = np.zeros(len(tokens) + 1, np.int64)
    starts = np.flatnonzero(counts[exact.ravel()] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The base counts and the vote pattern, a number in base 3: per rule 0 bad, 1 abstain, 2 good."""
    text = text or ""
    tokens, codes = words(text), code_points(text)
    n = len(tokens)
    blank = int(((codes == 32) | ((codes >= 9) & (codes <= 13))).sum())
    word_chars, n_symbols = len(codes) - blank, sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.encode("utf-8", "surrogatepass").split(b"\n") if line.split()]
    n_dup_lines, n_repeat = len(lines) - len(set(lines)), repeated_words(tokens)
    letters = int(class_table("isalpha")[codes].sum())
    counts: dict[bytes, int] = {}
    for w in tokens:
        counts[w] = counts.get(w, 0) + 1
    value = {
        "n_words": n, "symbol_share": n_symbols / max(1, n), "same_line_share": n_dup_lines / max(1, len(lines)),
        "repeat_share": n_repeat / max(1, n), "upper_share": int(class_table("isupper")[codes].sum()) / max(1, letters),
        "bang_share": text.count("!") / max(1, n), "top_word_share": max(counts.values(), default=0) / max(1, n) if n >= 30 else 0,
        "letter_share": letters / max(1, word_chars),
        "plain_share": sum(c for w, c in counts.items() if PLAIN.fullmatch(w.decode("utf-8", "surrogatepass"))) / max(1, n),
    }
    pattern = 0
    for _, vote, measure_, side, bound in RULES:
        beyond = value[measure_] > bound if side == "over" else value[measure_] < bound
        pattern = pattern * 3 + (vote if beyond else ABSTAIN)
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, pattern


@pandas_udf(MEASURED)
def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=[*COUNTS, "pattern"])


def votes(patterns: np.ndarray) -> np.ndarray:
    """One row per pattern: 0 bad, 1 abstain, 2 good per rule."""
    return np.stack([patterns // 3 ** (len(RULES) - 1 - k) % 3 for k in range(len(RULES))], 1)


def estimate(patterns: np.ndarray, counts: np.ndarray) -> dict:
    """Expectation-maximisation over pattern counts: class prior and how often each rule votes on good and on bad documents.

    A rule's accuracy is the share of its votes that fall on documents of the class it names; it is never taken to be below chance.
    """
    voted = (votes(patterns) != ABSTAIN).astype(float)
    says_bad = np.array([vote == BAD for _, vote, *_ in RULES])
    on, off = (np.array([VOTE_PRIOR[vote][k] for _, vote, *_ in RULES]) for k in (0, 1))
    # Bounds of bad votes are far from ordinary text, so one such vote is the first guess of a bad document.
    p = np.array([0.98, 0.1, 0.02])[np.minimum(voted[:, says_bad].sum(1), 2).astype(int)]
    for _ in range(ROUNDS):
        w1, w0 = counts * p, counts * (1 - p)
        prior = (w1.sum() + CLASS_PRIOR[0]) / (counts.sum() + sum(CLASS_PRIOR))
        good = (w1 @ voted + on[:, 0]) / (w1.sum() + on.sum(1))
        bad = (w0 @ voted + off[:, 0]) / (w0.sum() + off.sum(1))
        chance = prior * good + (1 - prior) * bad
        wrong = np.where(says_bad, bad < good, good < bad)
        model = {"prior": prior, "good": np.where(wrong, chance, good), "bad": np.where(wrong, chance, bad)}
        new = trusted(patterns, posterior(patterns, model))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    given = np.where(says_bad, (1 - prior) * model["bad"], prior * model["good"])
    model["accuracy"] = given / (prior * model["good"] + (1 - prior) * model["bad"])
    return model


def posterior(patterns: np.ndarray, model: dict) -> np.ndarray:
    """Probability that a document with this pattern is good."""
    v = votes(patterns)
    vote, none = np.log(model["good"] / model["bad"]), np.log((1 - model["good"]) / (1 - model["bad"]))
    odds = np.log(model["prior"] / (1 - model["prior"])) + np.where(v != ABSTAIN, vote, none).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def trusted(patterns: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The posteriors, at least `KEEP` where no rule votes bad."""
    return np.where((votes(patterns) == BAD).any(1), p, np.maximum(KEEP, p))


def pattern_posteriors(measured: DataFrame, pattern: Column) -> tuple[dict[int, float], list[int]]:
    """Posterior per vote pattern that occurs, and the patterns that are kept; counts over all rows, at most 3^9 of them reach the driver."""
    got = measured.groupBy(pattern.alias("pattern")).count().collect()
    if not got:
        return {}, []
    patterns, counts = np.array([r["pattern"] for r in got]), np.array([float(r["count"]) for r in got])
    p = posterior(patterns, estimate(patterns, counts))
    return dict(zip(patterns.tolist(), p.tolist())), patterns[trusted(patterns, p) >= KEEP].tolist()


def base_failed(row: str) -> Column:
    n = F.col(f"{row}.n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{row}.n_repeat_words") > MOST_REPEATED * n)


def _posterior_of(spark, pattern: Column, table: dict[int, float]) -> Column:
    sent = spark.sparkContext.broadcast(table)

    @pandas_udf("double")
    def look_up(p: pd.Series) -> pd.Series:
        return p.map(sent.value).astype(float)

    return look_up(pattern)


def verdicts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, base counts, base_failed, posterior, kept). The counts are stored, so texts are read once."""
    bounded_batches(docs.sparkSession)
    rows = cut_lineage(docs.select("doc_id", _measure("text").alias("m")))
    table, good = pattern_posteriors(rows, F.col("m.pattern"))
    own, failed = _posterior_of(docs.sparkSession, F.col("m.pattern"), table), base_failed("m")
    return rows.select("doc_id", "m.*", failed.alias("base_failed"), own.alias("posterior"), (~failed & F.col("m.pattern").isin(good)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns. Texts are measured once to count and once to filter."""
    bounded_batches(docs.sparkSession)
    name = free_name(docs, "measured")
    _, good = pattern_posteriors(docs.select(_measure("text").alias("m")), F.col("m.pattern"))
    rows = docs.withColumn(name, _measure("text"))
    # At most 3^9 patterns, looked up without a second Python worker beside the one that measures.
    return rows.filter(~base_failed(name) & F.col(f"{name}.pattern").isin(good)).drop(name)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior",
    )
