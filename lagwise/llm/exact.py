"""Exact dedup with a heavy-hitter split.

Misra-Gries counters per partition, merged, name every digest that more than one row in `CAPACITY` has. Their
exact sizes and winners are aggregated and broadcast (at most `CAPACITY` rows), so their copies are decided where
they lie and never shuffled by digest. All other digests are shuffled; none of them holds more than a
`CAPACITY`-th of the rows. Groups are decided on (digest, id) alone, and the verdict is joined to the rows: no text lies in a window,
and `dedup` deals rows by digest and id, so even a large group is spread over all tasks.

Of equal texts the row with the largest doc_id stays; null ids come last. Defined cases: a null text equals an
empty one. Of rows that share the winning id, one stays. An empty table gives an empty result. Other columns are
carried and do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import documents

CAPACITY = 256


def digest_of(text: str = "text") -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def frequent(digests: DataFrame, capacity: int = CAPACITY) -> list[str]:
    """At most `capacity` digests, among them all that more than one row in `capacity` has."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[str, int] = {}
        for batch in batches:
            for digest, n in batch["d"].value_counts(sort=False).items():
                counters[digest] = counters.get(digest, 0) + int(n)
            if len(counters) > capacity:  # lower all by the largest counter that must go
                cut = sorted(counters.values(), reverse=True)[capacity]
                counters = {d: n - cut for d, n in counters.items() if n > cut}
        if counters:
            yield pd.DataFrame({"d": list(counters), "n": list(counters.values())})

    parts = digests.mapInPandas(count, "d string, n long").groupBy("d").agg(F.sum("n").alias("n"))
    return [r["d"] for r in parts.orderBy(F.desc("n"), "d").limit(capacity).collect()]


def first_of_ties(rows: DataFrame, digest: str, mark: str) -> DataFrame:
    """Marks one row per digest in two steps, so that no window grows beyond one map partition's rows."""
    part, local = f"{mark}_p", f"{mark}_n"
    within = Window.partitionBy(digest, part).orderBy(F.lit(0))
    among = Window.partitionBy(digest, local).orderBy(part)
    rows = rows.withColumn(part, F.spark_partition_id()).withColumn(local, F.least(F.row_number().over(within), F.lit(2)))
    first = rows.filter(F.col(local) == 1).withColumn(mark, F.row_number().over(among) == 1)
    return first.unionByName(rows.filter(F.col(local) > 1).withColumn(mark, F.lit(False))).drop(part, local)


def winners(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """Rows (w, keep_id, group_size, ties) per digest: of the heavy digests, and of all others.

    `ties` counts the rows that share the winning id.
    """
    digests = docs.select(digest_of().alias("d"), F.col("doc_id").alias("id"))
    heavy = digests.sparkSession.createDataFrame([(d,) for d in frequent(digests.select("d"), capacity)], "w string")
    # Exact sizes of the few named digests: one row per digest and task is shuffled. Then how often the winner's id occurs.
    named = digests.join(F.broadcast(heavy), F.col("d") == F.col("w")).groupBy("w").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    named = named.filter("group_size > 1")
    tops = digests.join(F.broadcast(named), (F.col("d") == F.col("w")) & F.col("id").eqNullSafe(F.col("keep_id")))
    large = tops.groupBy("w").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count("*").alias("ties"))
    # The others are dealt by digest once, which serves both aggregations.
    others = digests.join(F.broadcast(named.select("w")), F.col("d") == F.col("w"), "left_anti").repartition("d")
    small = others.groupBy("d", "id").count().groupBy(F.col("d").alias("w")).agg(
        F.max("id").alias("keep_id"), F.sum("count").alias("group_size"), F.coalesce(F.max_by("count", "id"), F.sum("count")).alias("ties"))
    return large, small


def _held(docs: DataFrame, large: DataFrame, carry: list[str]) -> DataFrame:
    """Rows (row, id, d) of `docs`, with the verdict on heavy digests, of others null."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("doc_id").alias("id"), digest_of().alias("d"))
    return held.join(F.broadcast(large), F.col("d") == F.col("w"), "left").drop("w")


def groups(docs: DataFrame, into: str, capacity: int = CAPACITY, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of `docs` (None: all) and `into` of (digest, keep_id, group_size, kept); one row for every row of the input."""
    large, small = winners(docs, capacity)
    split = _held(docs, large, docs.columns if carry is None else carry)
    light = split.filter("ties is null").select("row", "id", "d").join(small, F.col("d") == F.col("w")).drop("w")
    rows = split.filter("ties is not null").unionByName(light)
    best = F.col("id").eqNullSafe(F.col("keep_id"))
    out = lambda kept: F.struct(F.col("d").alias("digest"), "keep_id", "group_size", kept.alias("kept")).alias(into)
    tied = best & (F.col("ties") > 1)
    first = first_of_ties(rows.filter(tied), "d", "first")
    return rows.filter(~tied).select("row", out(best)).unionByName(first.select("row", out(F.col("first")))).select("row.*", into)


def dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of each group of equal texts, with the columns of `docs`.

    Losers of heavy digests go where they lie. Other rows are matched with the winners by digest and id.
    """
    large, small = winners(docs, capacity)
    split = _held(docs, large, docs.columns)
    best = F.col("id").eqNullSafe(F.col("keep_id"))
    light = split.filter("ties is null").select("row", "id", "d").join(small, (F.col("d") == F.col("w")) & best).drop("w")
    rows = split.filter(F.col("ties").isNotNull() & best).unionByName(light)
    tied = first_of_ties(rows.filter("ties > 1"), "d", "first").filter("first")
    return rows.filter("ties = 1").select("row.*").unionByName(tied.select("row.*"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    rows = groups(documents(spark, sf_dir), "g", carry=["doc_id"])
    return rows.select("doc_id", "g.keep_id", "g.group_size", "g.kept", F.col("g.digest").alias("text_sha256"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
