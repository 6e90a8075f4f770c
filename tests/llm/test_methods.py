"""The operators against brute force, exact round trips, SQL twins and held-out accuracy."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import oracle
from lagwise.llm import bpe, exact, mixing, rules, sharding, simhash, substring, toxicity
from lagwise.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert oracle.difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_language_held_out(spark, duck):
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect()}
    truth = duck.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    held = [(got[i]["lang_pred"], lang) for i, lang in truth if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97


@pytest.mark.parametrize("name, label, least", [("op2_quality_classifier", "quality", 0.95), ("op6_toxicity", "toxic", 0.85)])
def test_scores_held_out(spark, duck, name, label, least):
    got = {r["doc_id"]: r for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    truth = duck.sql(f"SELECT doc_id, {label} FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    side = lambda k: np.array([got[i]["score"] for i, y in truth if y == k and got[i]["held_out"]])
    one, none = side(1)[:, None], side(0)[None, :]
    assert (one > none).mean() + 0.5 * (one == none).mean() > least


def encoder():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cutting_equals_the_library():
    _, library = encoder()
    rng = random.Random(1)
    signs = "abc the'sTHE  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0   　​﻿é日本0129½²!#$ñ\U0001F600́'"
    rows = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["", "'", "'s", "a'll", "x've'd'", "  "]
    words, _, flow, counts = bpe.sequence(rows, 8)
    ends = np.cumsum(counts)
    for text, a, b in zip(rows, ends - counts, ends):
        assert [i for k in flow[a:b] for i in library.encode_ordinary(words[k].decode())] == library.encode_ordinary(text)


def test_encoding_and_round_trip(spark, texts):
    ranks, library = encoder()
    got = QUERIES["op4_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    back = bpe.decode(bpe.encode(frame, ranks, public_tokenizers.PATTERN, buckets=3), ranks).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back} == texts


def brute_spans(docs, length):
    first = {}
    tokens = {i: t.encode().split() for i, t in docs}
    for i in sorted(tokens):
        for k in range(len(tokens[i]) - length + 1):
            first.setdefault(tuple(tokens[i][k : k + length]), i)
    out = {}
    for i, w in tokens.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = True
        out[i] = b" ".join(x for x, g in zip(w, gone) if not g).decode()
    return out


def test_substring_equals_brute_force(spark, texts, prose):
    rng = random.Random(2)
    docs = list(texts.items())
    passage = prose[100:170]
    for i in range(60):  # shared passages at any offset, runs of one word, copies
        words = [rng.choice(prose) for _ in range(rng.randint(0, 150))]
        at = rng.randint(0, len(words))
        cut = rng.randint(0, 30)
        docs.append((10_000 + i, " ".join(words[:at] + passage[cut : cut + rng.choice([48, 49, 50, 51, 70])] + words[at:])))
        docs.append((20_000 + i, " ".join([rng.choice(["x", "y"])] * rng.randint(40, 120))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert substring.levels(50) == [7, 13, 25, 50] and substring.levels(5) == [5]
    for length in (50, 10, 31, 4):
        got = {r["doc_id"]: r["kept"] for r in substring.repeated_spans(frame, length).collect()}
        assert got == brute_spans(docs, length)


def test_ball_hashing_finds_all_links(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in list(prints):
        for bits in (1, 2, 3, 4, 5):
            q = p
            for b in rng.sample(range(64), bits):
                q ^= 1 << b
            prints.append(q)
    prints = np.unique(np.array(prints, np.uint64))
    frame = spark.createDataFrame([(int(np.int64(p.view(np.int64))), i) for i, p in enumerate(prints)], "f long, doc_id long")
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    want = {int(p.view(np.int64)): find(i) for i, p in enumerate(prints)}
    assert {r["f"]: r["component_id"] for r in simhash.groups(frame).collect()} == want
    for key_bits in (1, 20, 32):
        pairs = {(r["a"], r["b"]) for r in simhash.links(frame.select("f"), key_bits).collect()}
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
    old, simhash.EXPANDED = simhash.EXPANDED, 500
    try:  # keys too large for one pass are done in slices
        assert {r["f"]: r["component_id"] for r in simhash.groups(frame).collect()} == want
    finally:
        simhash.EXPANDED = old


def test_fingerprint_by_definition(texts):
    for text in [*list(texts.values())[:20], "", " \n", "One", "one two", "A b C", "É É É É"]:
        words = [w.lower() for w in text.encode().split()]
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_repeated_words_by_definition(prose):
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.choice("abc") if rng.random() < 0.7 else rng.choice(prose) for _ in range(rng.randint(0, 60))]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        assert rules.repeated_words([w.encode() for w in words]) == len(covered)


def test_rules_verdicts(spark, duck):
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    truth = duck.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    assert np.mean([got[i]["kept"] for i, y in truth if y == 1 and not got[i]["base_failed"]]) > 0.99
    assert np.mean([got[i]["kept"] for i, y in truth if y == 0]) < 0.1
    assert all(r["kept"] for r in got.values() if not r["base_failed"] and r["posterior"] >= 0.5)


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.85
    fire_good, fire_bad = np.full(9, 0.01), np.full(9, 0.4)
    fire_good[7:], fire_bad[7:] = 0.95, 0.3
    fired = rng.random((20_000, 9)) < np.where(good[:, None], fire_good, fire_bad)
    vote = np.where(fired, np.array([0] * 7 + [2] * 2), 1)
    patterns, counts = np.unique(vote @ 3 ** np.arange(8, -1, -1), return_counts=True)
    model = rules.estimate(patterns, counts.astype(float))
    assert abs(model["prior"] - good.mean()) < 0.02 and np.abs(model["bad"] - fire_bad).max() < 0.05


def test_documents_without_votes_are_kept():
    silent, bad = sum(3**k for k in range(9)), sum(3**k for k in range(8))
    model = rules.estimate(np.array([silent + 4, silent, bad]), np.array([9000.0, 10.0, 500.0]))
    own = rules.posterior(np.array([silent, bad]), model)
    assert (own < rules.KEEP).all()
    assert (rules.trusted(np.array([silent, bad]), own) >= rules.KEEP).tolist() == [True, False]


def test_heavy_hitters_are_found(spark, prose):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 7 == 0 else prose[i % 600] + str(i % 50)) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    named = exact.frequent(frame.select(exact.digest_of().alias("d")), 8)
    assert {hashlib.sha256(t.encode()).hexdigest() for t in ("hot", "warm")} <= set(named) and len(named) <= 8
    for capacity in (2, 256):
        got = {r["doc_id"]: r["g"] for r in exact.groups(frame, "g", capacity).collect()}
        best = {}
        for i, t in rows:
            best.setdefault(t, []).append(i)
        assert all((got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(best[t]), len(best[t]), i == max(best[t])) for i, t in rows)


def test_targets_and_emission(spark, prose):
    rows = [(i, " ".join(prose[: 5 + i % 40]), f"s{(i * i) % 5}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r["source"]: r for r in mixing.source_targets(frame).collect()}
    total = sum(r["source_size"] for r in targets.values())
    assert abs(sum(r["target"] for r in targets.values()) - 1.5 * total) < 1e-6 * total
    taken = {}
    for r in mixing.mix(frame).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    assert all(abs(taken.get(s, 0) - r["target"]) < 0.06 * r["target"] + 1 for s, r in targets.items())
    plan = [(r["doc_id"], r["m"]["copies"]) for r in mixing.repetitions(frame, "m").collect()]
    assert sorted(plan) == sorted((r["doc_id"], r["m"]["copies"]) for r in mixing.repetitions(frame.repartition(9), "m").collect())


def test_ring_is_balanced_and_moves_little(spark, texts):
    frame = spark.createDataFrame(list(texts.items()) + [(0, "same")] * 300, "doc_id long, text string")
    rows = [r["s"] for r in sharding.shard(frame, "s", shards=7).collect()]
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Rows leave their own shard only when it is full.
    rng = random.Random(6)
    counts = {c: rng.randint(1, 9) for c in rng.sample(range(sharding.CELLS), 3000)}
    ends, owners = sharding.ring(7)
    natural = [0] * 7
    for c, n in counts.items():
        natural[owners[np.searchsorted(ends, c) % len(ends)]] += n
    room = sum(counts.values()) / 7
    stayed = sum(n for c, p in sharding.place(counts, 7).items() for (a, s, _), b in zip(p, [*[x[0] for x in p[1:]], counts[c]])
                 for n in [b - a] if s == owners[np.searchsorted(ends, c) % len(ends)])
    assert stayed >= sum(min(n, int(room)) for n in natural)


@pytest.fixture(scope="module")
def characters(spark):
    return toxicity.language_model(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("seen, meant", [("1d10t", "idiot"), ("m0r0n", "moron"), ("idiiiiot", "idiot"), ("i-d-i-o-t", "idiot"), ("l0ser", "loser"), ("p@thet1c", "pathetic"), ("tr4sh", "trash")])
def test_readings_restore_words(characters, seen, meant):
    known = {}
    assert meant in toxicity.readings(f"the {seen} of", characters, known)


def test_spaced_letters_are_joined(characters):
    assert "idiot" in toxicity.readings("the i d i o t of", characters, {})
    assert "the" in toxicity.readings("The, of", characters, {})
