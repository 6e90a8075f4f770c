"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a vector of transformed statistics (`STATISTICS`). Per class the mean and covariance are sums
over all labelled learning rows, formed per partition. A covariance is shrunk towards the diagonal of the pooled
one and kept as its Cholesky factor; the score is the logistic of the difference of the two log-densities plus
the log prior odds, scaled on the learning rows so that scores are probabilities.

Defined cases: a null text is an empty one, which has a vector like any other. Several labels of one id count as
the lowest; null labels do not count. Without learning rows of both classes every score is the share of label 1
(0.5 without labels). Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from lagwise.llm.common import bounded_batches, class_table, code_points, documents, held_out, labels, words
from lagwise.session import cut_lineage

STATISTICS = [
    "log_words", "word_length", "upper", "letters", "digits", "symbols", "bangs", "other_marks", "variety", "stutter",
    "same_lines", "top_word", "short_words", "line_ends", "same_triples",
]
SYMBOLS = "#*$%&|<>"
SHRINK = 0.15
FLOOR = 1e-4
BINS = 400
SPAN = 40.0


def statistics(text: str | None) -> np.ndarray:
    """The vector of one whole text; shares are taken to their square root, counts to logarithms."""
    text = text or ""
    tokens, codes = words(text), code_points(text)
    n, lines = len(tokens), [line for line in text.split("\n") if line.strip()]
    solid = max(1, int((~class_table("isspace")[codes]).sum()))
    letters = int(class_table("isalpha")[codes].sum())
    upper = int(class_table("isupper")[codes].sum())
    digits = int(class_table("isdigit")[codes].sum())
    symbols = sum(text.count(c) for c in SYMBOLS)
    bangs = text.count("!")
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, n)
    counts = np.bincount(ids, minlength=1)
    triples = (ids[:-2] * 1_000_003 + ids[1:-1]) * 1_000_003 + ids[2:] if n > 2 else ids[:0]
    share = lambda x, of: np.sqrt(max(0, x) / max(1, of))
    return np.array([
        np.log1p(n),
        np.log1p(solid / max(1, n)),
        share(upper, letters),
        share(letters, solid),
        share(digits, solid),
        share(symbols, max(1, n)),
        share(bangs, max(1, n)),
        share(solid - letters - digits - symbols - bangs, solid),
        np.log1p(len(seen)) / np.log1p(max(1, n)),
        share(int((ids[1:] == ids[:-1]).sum()), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(int(counts.max()), n),
        share(sum(len(w) == 1 for w in tokens), n),
        share(sum(line.rstrip()[-1] in ".!?" for line in lines), len(lines)),
        share(len(triples) - len(np.unique(triples)), len(triples)),
    ])


@pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


def features(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x): the statistics of every whole text, stored so that they are computed once."""
    bounded_batches(docs.sparkSession)
    return cut_lineage(docs.select("doc_id", _statistics("text").alias("x")))


def one_label(marks: DataFrame, name: str) -> DataFrame:
    """Rows (doc_id, label) with unique ids."""
    known = marks.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return known.groupBy("doc_id").agg(F.min(name).cast("int").alias("label"))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for label, rows in batch.groupby("label"):
            x = np.column_stack([np.ones(len(rows)), np.stack(rows["x"].to_numpy())])
            sums[int(label)] = sums.get(int(label), 0) + x.T @ x
    for label, m in sums.items():
        yield pd.DataFrame({"label": label, "pos": np.arange(m.size), "value": m.ravel()})


def fit(x: DataFrame, marks: DataFrame, learn) -> dict:
    """Class means, Cholesky factors and scale from all labelled rows where `learn` holds."""
    rows = x.filter(learn).join(marks, "doc_id").filter(F.col("label").isin(0, 1)).select("label", "x")
    sums = rows.mapInPandas(_moments, "label int, pos int, value double").groupBy("label", "pos").agg(F.sum("value").alias("value"))
    found: dict[int, dict[int, float]] = {}
    for r in sums.collect():  # two classes x (d + 1)^2 numbers
        found.setdefault(r["label"], {})[r["pos"]] = r["value"]
    moments = {}
    for label, cells in found.items():
        side = int(np.sqrt(len(cells)))
        moments[label] = np.array([cells[i] for i in range(side * side)]).reshape(side, side)
    total = sum(m[0, 0] for m in moments.values())
    if len(moments) < 2:
        return {"prior": float(moments[1][0, 0] / total) if 1 in moments else 0.5 if not moments else 0.0, "classes": None}
    classes, pooled, covs = {}, 0, {}
    for label, m in moments.items():
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        covs[label] = (n, mean, m[1:, 1:] / n - np.outer(mean, mean))
        pooled = pooled + covs[label][2] * n / total
    for label, (n, mean, cov) in covs.items():
        shrunk = (1 - SHRINK) * cov + SHRINK * np.diag(np.diag(pooled)) + FLOOR * np.eye(len(mean))
        factor = np.linalg.cholesky(shrunk)
        classes[label] = (np.log(n / total), mean, factor, 2 * np.log(np.diag(factor)).sum())
    model = {"prior": float(moments[1][0, 0] / total), "classes": classes, "scale": (1.0, 0.0)}
    model["scale"] = _scale(rows, model)
    return model


def log_odds(x: np.ndarray, classes: dict) -> np.ndarray:
    """Difference of the classes' log-densities with priors, one number per row."""
    side = []
    for label in (1, 0):
        prior, mean, factor, log_det = classes[label]
        z = np.linalg.solve(factor, (x - mean).T)
        side.append(prior - 0.5 * (log_det + (z * z).sum(0)))
    return side[0] - side[1]


def _scale(rows: DataFrame, model: dict) -> tuple[float, float]:
    """Slope and offset that make the log-odds probabilities on all learning rows, from a histogram per class."""
    sent = rows.sparkSession.sparkContext.broadcast(model["classes"])

    @pandas_udf("int")
    def bin_of(x: pd.Series) -> pd.Series:
        squeezed = np.arcsinh(log_odds(np.stack(x.to_numpy()), sent.value)) if len(x) else np.empty(0)
        return pd.Series(np.clip((squeezed / 10 + 0.5) * BINS, 0, BINS - 1).astype(np.int32))

    got = rows.select("label", bin_of("x").alias("bin")).groupBy("label", "bin").count().collect()  # at most 2 x BINS rows
    z = np.array([((r["bin"] + 0.5) / BINS - 0.5) * 10 for r in got])
    y = np.array([float(r["label"]) for r in got])
    weight = np.array([float(r["count"]) for r in got])
    design = np.column_stack([z, np.ones(len(z))])
    beta, ridge = np.array([0.5, 0.0]), np.diag([0.5, 0.5])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -SPAN, SPAN)))
        step = np.linalg.solve(design.T @ ((weight * p * (1 - p))[:, None] * design) + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def score(x: DataFrame, model: dict) -> DataFrame:
    """Rows (doc_id, score)."""
    sent = x.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def probability(xs: pd.Series) -> pd.Series:
        known = sent.value
        if not known["classes"] or not len(xs):
            return pd.Series(np.full(len(xs), known["prior"]))
        slope, offset = known["scale"]
        z = np.arcsinh(log_odds(np.stack(xs.to_numpy()), known["classes"]))
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * z + offset, -SPAN, SPAN))))

    return x.select("doc_id", probability("x").alias("score"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    x = features(documents(spark, sf_dir))
    model = fit(x, one_label(labels(spark, sf_dir), "quality"), ~held_out(4, 2))
    return score(x, model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
