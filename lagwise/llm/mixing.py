"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights, and a source's repetition rate is its target over
its size. Each document is emitted floor(rate) times, plus once more when a hash of the seed, its id and its text
falls below the fractional part. No random state is used, so reruns and retries agree.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a source of size 0 has target
0 and its documents are not taken. Repeated rows share one coin. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import WORD_PATTERN, attach, documents, free_name
from lagwise.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"


def source_targets(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows (source, source_size, target): one per source, stored.

    Sources in code point order take the weights in turn. Raising all targets in proportion to the weights, a
    source stops at `most` times its size. In the order of limit over weight the stopped ones are a prefix, so one
    running sum finds the common level. The windows see one row per source, never documents.
    """
    sizes = docs.groupBy("source").agg(F.sum(word_count()).alias("source_size"))
    whole, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", turn)
        .withColumn("limit", most * F.col("source_size"))
        .withColumn("step", F.row_number().over(by_limit))
        .withColumn("stopped", F.sum("limit").over(by_limit) - F.col("limit"))
        .withColumn("rest", F.sum("weight").over(whole) - F.sum("weight").over(by_limit) + F.col("weight"))
        .withColumn("level", (share * F.sum("source_size").over(whole) - F.col("stopped")) / F.col("rest"))
        .withColumn("open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("step"))).over(whole))
        .withColumn("level", F.max(F.when(F.col("step") == F.col("open"), F.col("level"))).over(whole))
    )
    reached = F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double"))
    return cut_lineage(ranked.select("source", "source_size", F.least(F.col("limit").cast("double"), reached).alias("target")))


def word_count():
    return F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def repetitions(docs: DataFrame, into: str, seed: str = SEED, **rules) -> DataFrame:
    """`docs` with a column `into` of (size, source_size, target, copies)."""
    targets = source_targets(docs, **rules).select(
        F.col("source").alias("_source"), F.struct("source_size", "target").alias("_of"),
    )
    rate = F.when(F.col("_of.source_size") > 0, F.col("_of.target") / F.col("_of.source_size")).otherwise(0.0)
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    coin = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    copies = (F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")).cast("long")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", "text", "doc_id")
    joined = attach(held, targets, F.col("source").eqNullSafe(F.col("_source")))
    out = F.struct(word_count().alias("size"), F.col("_of.source_size"), F.col("_of.target"), copies.alias("copies"))
    return joined.select("_row.*", out.alias(into))


def mix(docs: DataFrame, **rules) -> DataFrame:
    """The mixed documents: every row as often as its source's rate says, with the columns of `docs`."""
    name = free_name(docs, "mix")
    rows = repetitions(docs, name, **rules)
    each = free_name(docs, "copy")
    return rows.withColumn(each, F.explode(F.array_repeat(F.lit(True), F.col(f"{name}.copies").cast("int")))).drop(name, each)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    rows = repetitions(documents(spark, sf_dir).select("doc_id", "text", "source"), "m")
    return rows.select("doc_id", "m.size", "m.source_size", "m.target", (F.col("m.size") * F.col("m.copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s
), r AS (
  SELECT *, row_number() OVER o AS step, CAST(sum(cap) OVER o - cap AS BIGINT) AS stopped,
         CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS BIGINT) AS rest, CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS UNBOUNDED PRECEDING)
), v AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * total - stopped) / rest AS level FROM r
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (
           SELECT arg_min(level, step) FROM v WHERE level * weight <= cap)) AS target FROM v
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5(concat_ws('|', 'mix', CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, '')))), 1, 8) AS BIGINT)
           / CAST(4294967296 AS DOUBLE) AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
