"""Every operator on odd rows and on empty tables."""

import pytest

import corpus_pipeline
from lagwise.llm import bpe, exact, language, mixing, quality, rules, sharding, simhash, substring, toxicity
from lagwise.llm.catalog import QUERIES as OPERATORS
from lagwise.llm.common import held_out
from pyspark.sql import functions as F

QUERIES = {**OPERATORS, "pipeline": corpus_pipeline.run}
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty, as_table, name):
    items = spark.createDataFrame([(1, "no one")], ITEMS)
    for benchmark in (items, items.limit(0)):
        folder = as_table(documents=empty, labels=spark.createDataFrame([], LABELS), benchmark=benchmark)
        assert QUERIES[name](spark, folder).collect() == []
        if not name.startswith(("op12", "op13")):
            break


PER_DOCUMENT = sorted(set(QUERIES) - {"pipeline", "op11_spelling_variants", "op13_lexical_search"})


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_result_per_row(spark, odd_rows, as_table, name):
    marks = spark.createDataFrame([(4, 1, 0), (4, 0, None), (6, 0, 1), (None, 1, 1), (7, None, None)], LABELS)
    items = spark.createDataFrame([(1, "id here"), (1, None), (None, "no id"), (2, "")], ITEMS)
    got = QUERIES[name](spark, as_table(documents=odd_rows, labels=marks, benchmark=items)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd_rows.collect())


def test_pipeline_on_odd_rows(spark, odd_rows, as_table):
    got = QUERIES["pipeline"](spark, as_table(documents=odd_rows)).collect()
    assert {r["doc_id"] for r in got} <= {4, 5, 6, 7}


def test_filters_keep_columns(spark, odd_rows):
    for rows in (exact.dedup(odd_rows), simhash.dedup(odd_rows), mixing.mix(odd_rows), rules.keep_good(odd_rows)):
        assert rows.columns == odd_rows.columns
        rows.collect()


def test_dedup_of_ties(spark, odd_rows):
    for capacity in (1, 256):  # with one counter nearly all groups take the ordinary way
        kept = exact.dedup(odd_rows, capacity).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
        assert len({r["t"] for r in kept}) == len(kept) == odd_rows.select(F.coalesce("text", F.lit(""))).distinct().count()
        assert 5 in {r["doc_id"] for r in kept} and 2 in {r["doc_id"] for r in kept}
    near = [r["doc_id"] for r in simhash.dedup(odd_rows).collect()]
    assert near.count(4) == 1 and 5 not in near and near.count(1) == 1


def test_unknown_language_and_scores(spark, odd_rows):
    got = {r["doc_id"]: r for r in language.classify(odd_rows, language.fit(odd_rows, F.lit(True))).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert {r["lang_pred"] for r in language.classify(odd_rows, None).collect()} == {"und"}


def test_held_out_is_never_learned(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"))
    import zlib

    got = {r[0]: r[1] for r in rows.select("doc_id", held_out(5, 0)).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))


def test_long_text_is_read_whole(prose):
    long = " ".join(prose * 60)
    assert rules.measure(long)[0] == 36_000 and rules.measure(long)[4] == 36_000
    assert simhash.fingerprint(long) != simhash.fingerprint(long[:200])
    assert len(bpe.sequence([long], 4)[2]) == 36_000
    assert len(substring.Chunk(*substring.tokenised([1], [long]), 50).inside) == 36_000 - 49
    assert sharding.place({5: 7}, 3)[5][0][0] == 0
    assert toxicity.readings(None, None, {}) == set() and quality.statistics(None).shape == (15,)
