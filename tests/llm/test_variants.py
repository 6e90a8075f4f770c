"""Spelling variants against brute force."""

import random
import zlib

import pytest

from lagwise.llm import variants
from lagwise.llm.catalog import QUERIES


def one_edit(word):
    """All strings one edit from a word, over the letters used here."""
    letters = "abcdeéß"
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters if c != word[i])


@pytest.fixture(scope="module")
def lexicon():
    rng = random.Random(11)
    words = {"".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 9))) for _ in range(150)}
    for w in list(words):
        words |= set(rng.sample(sorted(set(one_edit(w))), 4))
    words |= {"".join(rng.sample("aaaabbbb", 8)) for _ in range(60)}  # many words with equal counts
    return {w: rng.choice([5, 6, 30, 30, 200, 5000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("limits", [{}, {"groups": 3}, {"groups": 2, "node_words": 7, "node_visits": 20}, {"node_words": 1}, {"groups": 1}])
def test_pairs_and_forms_equal_brute_force(spark, lexicon, limits):
    frame = spark.createDataFrame(list(lexicon.items()), "word string, n long").repartition(3)
    got = {r["word"]: r for r in variants.variants(frame, **limits).collect()}
    assert set(got) == set(lexicon)
    form = {}
    for w, n in lexicon.items():
        near = {o for o in one_edit(w) if o in lexicon and o != w}
        best = min(near, key=lambda o: (-lexicon[o], o), default=None)
        form[w] = best if best and lexicon[best] >= 5 * n else None
        assert (got[w]["n_near"], got[w]["form"], got[w]["form_n"]) == (len(near), form[w], lexicon.get(form[w]))
    for w in lexicon:
        end = w
        while form[end]:
            end = form[end]
        assert got[w]["root"] == end


def test_pairs_come_once(spark, lexicon):
    frame = spark.createDataFrame(list(lexicon.items()), "word string, n long")
    pairs = [frozenset((r["a"], r["b"])) for r in variants.near_pairs(frame, node_words=20).collect()]
    assert len(pairs) == len(set(pairs)) and all(len(p) == 2 for p in pairs)


def test_long_chains_of_forms(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(27)]
    got = variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r["root"] for r in got} == {"w27"} and len(got) == 27


def test_counts_by_definition(spark, odd_rows):
    import re

    want = {}
    for r in odd_rows.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        for run in re.findall("[a-z\u00c0-\u00ff]+", low):
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] = want.get(run, 0) + 1
    assert {r["word"]: r["n"] for r in variants.word_counts(odd_rows, every=7).collect()} == want


def test_query_on_odd_rows(spark, odd_rows, as_table):
    got = QUERIES["op11_spelling_variants"](spark, as_table(documents=odd_rows)).collect()
    assert got and all(r["n"] >= 5 and len(r["word"]) >= 6 for r in got) and len({r["word"] for r in got}) == len(got)
