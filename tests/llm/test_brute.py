"""Classifiers, ring and counts against direct versions; restoration of planted spellings."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.llm import language, quality, rules, sharding, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_equals_kernel_ridge_on_landmarks(spark, docs):
    """The direct solution: coefficients on landmarks, penalised by the kernel among them."""
    rows = [(r["lang"], r["text"]) for r in docs.filter("lang IS NOT NULL").collect()]
    model = language.fit(docs, F.lit(True))
    marks = np.unpackbits(model["marks"], axis=1).astype(float)
    x = language.presence([t for _, t in rows]).astype(float)
    assert len(rows) <= language.SAMPLE_ROWS and all(sum(k == n for k, _ in rows) <= language.SAMPLE_PER_LANG for n in model["names"])
    y = np.array([[1.0 if k == n else -1.0 for n in model["names"]] for k, _ in rows])
    weight = np.array([1 / sum(k == l for k, _ in rows) for l, _ in rows])
    weight /= weight.sum()
    between, among = language.kernel(x, marks), language.kernel(marks, marks)
    centred = between - weight @ between
    alpha = np.linalg.lstsq(centred.T @ (weight[:, None] * centred) + language.RIDGE * among, centred.T @ (weight[:, None] * (y - weight @ y)), rcond=1e-12)[0]
    direct = (between - weight @ between) @ alpha + weight @ y
    got = between @ model["weights"] + model["bias"]
    assert np.abs(got - direct).max() < 1e-3
    found = {r["doc_id"]: r for r in language.classify(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for key, text in list(texts.items())[:50]:
        one = language.presence([text])
        if one.any():
            value = (language.kernel(one, marks) @ model["weights"] + model["bias"])[0]
            assert found[key]["lang_pred"] == model["names"][int(value.argmax())]
            assert found[key]["score"] == pytest.approx(np.clip((value.max() + 1) / 2, 0, 1), abs=1e-5)


def test_language_sample_is_the_same_in_any_order(spark, docs):
    twice = docs.unionByName(docs)
    a, b = (language.fit(d, F.lit(True), per_lang=9) for d in (twice.repartition(7), twice.repartition(3)))
    assert np.array_equal(a["marks"], b["marks"]) and np.allclose(a["weights"], b["weights"])


def test_quality_equals_direct_densities(spark):
    folder = "/root/testdata/sf0.01"
    table = quality.features(spark.read.parquet(f"{folder}/documents.parquet"))
    marks = quality.one_label(spark.read.parquet(f"{folder}/labels.parquet"), "quality")
    model = quality.fit(table, marks, F.col("doc_id") % 2 == 0)
    rows = {r["doc_id"]: np.array(r["x"]) for r in table.collect()}
    label = {r["doc_id"]: r["label"] for r in marks.collect()}
    of = {k: np.stack([rows[i] for i in sorted(rows) if i % 2 == 0 and label.get(i) == k]) for k in (0, 1)}
    total = len(of[0]) + len(of[1])
    cov = {k: np.cov(x.T, bias=True) for k, x in of.items()}
    pooled = sum(cov[k] * len(of[k]) / total for k in of)

    def density(k, x):
        s = (1 - quality.SHRINK) * cov[k] + quality.SHRINK * np.diag(np.diag(pooled)) + quality.FLOOR * np.eye(len(x))
        d = x - of[k].mean(axis=0)
        return np.log(len(of[k]) / total) - 0.5 * (np.linalg.slogdet(s)[1] + d @ np.linalg.inv(s) @ d)

    slope, offset = model["scale"]
    got = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}
    for i in sorted(rows)[::17]:
        z = np.arcsinh(density(1, rows[i]) - density(0, rows[i]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(slope * z + offset, -quality.SPAN, quality.SPAN))), abs=1e-6)


def walk(counts, shards):
    """Rows one by one: home first, in ring order; then those that found it full go on clockwise."""
    ends, owners = sharding.ring(shards)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, waiting = [0] * shards, {}, []

    def take(row, shard):
        out[row] = (shard, used[shard])
        room[shard] -= 1
        used[shard] += 1

    for cell in sorted(counts):
        at = int(np.searchsorted(ends, cell)) % len(ends)
        for n in range(counts[cell]):
            if room[owners[at]]:
                take((cell, n), int(owners[at]))
            else:
                waiting.append(((cell, n), at))
    for row, at in waiting:
        while not room[owners[at]]:
            at = (at + 1) % len(ends)
        take(row, int(owners[at]))
    return out


@pytest.mark.parametrize("shards, seed", [(1, 0), (3, 1), (16, 2), (17, 3)])
def test_ring_equals_a_walk_row_by_row(shards, seed):
    rng = random.Random(seed)
    counts = {c: rng.choice([1, 1, 2, 40]) for c in rng.sample(range(sharding.CELLS), 700)} | {77: 5000}
    got = {}
    for cell, pieces in sharding.place(counts, shards).items():
        for (first, shard, slot), after in itertools.zip_longest(pieces, pieces[1:]):
            for n in range(first, after[0] if after else counts[cell]):
                got[cell, n] = (shard, slot + n - first)
    assert got == walk(counts, shards)


def test_one_more_shard_moves_little():
    """At least 1/17 has to move; bounded loads and whole cells move some more (8.8 % measured on 10^6 rows)."""
    rng = np.random.default_rng(0)
    cells, n = np.unique(rng.integers(0, sharding.CELLS, 200_000), return_counts=True)
    counts = dict(zip(cells.tolist(), n.tolist()))

    def owner(shards):
        out = {}
        for cell, pieces in sharding.place(counts, shards).items():
            for (first, shard, _), after in itertools.zip_longest(pieces, pieces[1:]):
                for k in range(first, after[0] if after else counts[cell]):
                    out[cell, k] = shard
        return out

    before, after = owner(16), owner(17)
    moved = np.mean([before[row] != after[row] for row in before])
    assert 1 / 17 - 0.005 < moved < 0.11


def test_base_counts_by_definition(spark, docs, prose):
    rng = random.Random(9)
    texts = [r["text"] for r in docs.limit(60).collect()] + ["a b\na b\n\n \na b", "#*$ %&|<>", "　x\x85y \x0bz", "é\nÉ\né"]
    texts += ["\n".join(" ".join(rng.choice(prose[:4]) for _ in range(rng.randint(0, 6))) for _ in range(12)) for _ in range(20)]
    for text in texts:
        tokens = re.findall("[^\x20\x09-\x0d]+", text)
        grams = [tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4)]
        lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
        repeated = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 400 else None
        got = rules.measure(text)
        want = (len(tokens), sum(map(len, tokens)), len(re.findall("[#*$%&|<>]", text)), sum(line in lines[:i] for i, line in enumerate(lines)))
        assert got[:4] == want and (repeated is None or got[4] == len(repeated))


@pytest.fixture(scope="module")
def characters(docs):
    return toxicity.language_model(docs)


def every_reading(token, model):
    """All readings of a token with their scores, without any pruning."""
    found = {}

    def go(at, a, b, last, value, text):
        if at == len(token):
            found[text] = max(found.get(text, -np.inf), value + model[a, b, 0])
            return
        c = token[at]
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(x, toxicity.COST["any"] if c == "*" else toxicity.COST["sign"]) for x in toxicity.LOOKS.get(c, "")]
        for x, cost in options:
            s = toxicity.symbol(x)
            go(at + 1, b, s, x, value + cost + model[a, b, s], text + x)
            if last == x:
                go(at + 1, a, b, last, value + cost + toxicity.COST["repeat"], text)
        if not c.isalnum():
            go(at + 1, a, b, last, value + toxicity.COST["drop"], text)
        elif not options:
            go(at + 1, a, b, last, value + toxicity.COST["keep"], text)

    go(0, 0, 0, "", 0.0, "")
    return found


def test_restoring_equals_an_unpruned_search(characters, monkeypatch):
    monkeypatch.setattr(toxicity, "MANY_STATES", 0)  # the bound is used at every character
    rng = random.Random(4)
    for _ in range(150):
        token = "".join(rng.choice("abeiost013@$!|-*" if rng.random() < 0.9 else "éñ72") for _ in range(rng.randint(1, 7)))
        if token.count("*") > 2:
            continue
        found = every_reading(token, characters)
        assert found[toxicity.restore(token, characters)] == pytest.approx(max(found.values()), abs=1e-9)


def test_planted_spellings_are_restored(spark, characters):
    """One sign, a drawn-out letter or signs between the letters of frequent words: 88 of 100 are read as written.

    The rest are invented words whose reading with another letter, or one less, is likelier under the model."""
    folder = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.language_model(folder)
    words = folder.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\b[a-z]{5,9}\\b"), F.lit(0))).alias("w"))
    frequent = [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(300).collect()]
    rng, right, total = random.Random(8), 0, 0
    for word in frequent:
        places = [i for i, c in enumerate(word) if c in "eaios"]
        if places and not toxicity.ODD.search(word):
            at = rng.choice(places)
            sign = {"e": "3", "a": "@", "i": "!", "o": "0", "s": "$"}[word[at]]
            for seen in (word[:at] + sign + word[at + 1 :], "-".join(word), word[:at] + word[at] * 4 + word[at + 1 :]):
                right += toxicity.restore(seen, model) == word
                total += 1
    assert total > 500 and right / total > 0.85


def test_few_toxic_rows_still_give_scores(spark):
    rows = [(i, "you complete idiot " + "x" * i if i < 2 else f"a calm sentence number {i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 2)) for i in range(40)], "doc_id long, label int")
    model = toxicity.language_model(frame)
    found = toxicity.lexicon(frame, marks, model, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model, found).collect()}
    assert min(got[0], got[1]) > max(got[i] for i in range(2, 40)) > 0
