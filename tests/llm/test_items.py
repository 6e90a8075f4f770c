"""Decontamination and ranked search against brute force."""

import math
import random
import re

import pytest

from lagwise.llm import contamination, ranking
from lagwise.llm.catalog import ORACLES, QUERIES

import oracle

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = "[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def planted(prose):
    """Items of all lengths, documents with whole and partial passages, copies, nulls and long words."""
    rng = random.Random(12)
    long = "\u00e9" * 60
    items = [(i, " ".join(rng.choice(prose[:90]) for _ in range(rng.choice([1, 2, 9, 10, 11, 40])))) for i in range(40)]
    items += [(100, f"{long} one {long}x two"), (101, items[0][1].upper()), (102, None), (103, "?!"), (None, items[5][1]), (104, long), (105, "a" * 64), (5, "same id twice"), (3, items[3][1])]
    docs = []
    for i in range(150):
        parts = [rng.choice(prose) for _ in range(rng.randint(0, 60))]
        for _, text in rng.sample(items[:42], 2):
            cut = text.split()[rng.randint(0, 3) :] if rng.random() < 0.5 else text.split()
            at = rng.randint(0, len(parts))
            parts[at:at] = cut
        docs.append((i, rng.choice([" ", ", ", "\n--"]).join(parts).title()))
    docs += [(7, docs[7][1])] * 3 + [(900, None), (None, docs[7][1]), (901, ""), (902, " ".join(w for _, t in docs[:60] for w in t.split())), (903, long + " a " + "a" * 64)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 5_000])
def test_hits_equal_brute_force(spark, planted, block_bytes):
    docs, items = planted
    windows = {}
    for item, text in items:
        words = re.findall(WORD, low(text))
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).add(None if item is None else str(item))
    want = []
    for key, text in docs:
        words, hit, names = re.findall(WORD, low(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(words[i : i + n])] - {None}
        want.append((str(key), len(words), sorted(hit), sorted(names)))
    got = []
    for r in contamination.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes).collect():
        places = [p for run in r["runs"] for p in range(run["first"], run["last"] + 1)]
        got.append((str(r["doc_id"]), r["n_words"], places, r["items"]))
        # Runs point at the same words of the original text.
        text = next(t for k, t in docs if k == r["doc_id"])
        raw, words = (text or "").encode(), re.findall(WORD, low(text))
        for run in r["runs"]:
            assert re.findall(WORD, low(raw[run["start"] : run["end"]].decode())) == words[run["first"] : run["last"] + 1]
    assert sorted(got) == sorted(want)


def brute_ranking(docs, items, k):
    def terms(text):
        return re.findall("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+", low(text))

    bags = [(key, terms(text)) for key, text in docs]
    bags = [(key, b) for key, b in bags if b]
    n_all, length = len(bags), sum(len(b) for _, b in bags)
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        df = {t: sum(t in b for _, b in bags) for t in asked}
        w = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) for t in asked}
        for key, b in bags:
            m = 50 + 50 * len(b) * n_all // length
            s = sum(w[t] * (10**9 * b.count(t) // (1000 * b.count(t) + 20 * m)) for t in asked if t in b)
            if s > 0:
                scores.append((-s, key is not None, key))
        scores.sort()
        out += [(str(item), i + 1, str(key), -s) for i, (s, _, key) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, block_bytes, run_docs, bucket", [(50, 2_000_000, 4096, 256), (3, 600, 13, 4), (1, 2_000_000, 50, 1)])
def test_ranking_equals_brute_force(spark, planted, monkeypatch, k, block_bytes, run_docs, bucket):
    docs, items = planted
    docs = docs + [(2000 + i, docs[20][1]) for i in range(70)]  # more ties than places
    monkeypatch.setattr(ranking, "RUN_DOCS", run_docs)
    monkeypatch.setattr(ranking, "BUCKET_DOCS", bucket)
    monkeypatch.setattr(ranking, "PARTS", 3)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    got = ranking.search(frame, spark.createDataFrame(items, ITEMS), k, block_bytes).collect()
    assert sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in got) == brute_ranking(docs, items, k)


def test_bounds_leave_documents_out(planted):
    """Buckets and coordinates do prune, and never what belongs in the result."""
    import numpy as np

    from lagwise.llm.chunks import pack

    rng = np.random.default_rng(0)
    sizes = rng.integers(5, 400, 2000)
    counts = np.minimum(sizes, rng.integers(1, 30, 2000))
    terms = np.concatenate([np.sort(rng.choice(500, c, replace=False)) for c in counts]).astype(np.int32)
    times = rng.integers(1, 4, len(terms)).astype(np.int32)
    run = ranking.Run(pack(list(range(2000)), sizes, counts, terms, times), 2000, int(sizes.sum()), 500)
    weights = rng.integers(1, 8000, 500)
    chosen = np.sort(rng.choice(500, 12, replace=False))
    dense = np.zeros(500, np.int64)
    dense[chosen] = weights[chosen]
    scores = run.scores(np.arange(2000), dense)
    least = int(np.sort(scores)[-50])
    order = chosen[np.argsort(-weights[chosen])]
    left = run.survivors(order, weights[order].astype(float), least)
    assert set(np.flatnonzero(scores >= least)) <= set(left.tolist()) and len(left) < 400
    norm = math.sqrt((weights[order].astype(float) ** 2).sum())
    assert len(run.survivors(order, weights[order].astype(float), int(norm * run.norm[0] * 2))) == 0


def test_queries_on_odd_rows(spark, odd_rows, as_table):
    items = spark.createDataFrame([(1, "no id here"), (1, None), (None, "no id here"), (2, "")], ITEMS)
    folder = as_table(documents=odd_rows, benchmark=items)
    ranked = QUERIES["op13_lexical_search"](spark, folder).collect()
    assert {(r["item_id"], r["rank"], r["doc_id"]) for r in ranked if r["rank"] == 1} == {(1, 1, None), (None, 1, None)}
    for name in ("op12_decontamination", "op13_lexical_search", "op11_spelling_variants"):
        assert oracle.difference(QUERIES[name](spark, folder), tables(folder), ORACLES[name]) is None


def tables(folder):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con
