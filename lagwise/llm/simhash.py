"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most 3 bits apart have a common variant within half that distance: 1 bit from one and at most 2
from the other. Fingerprints of even and of odd parity share the work: an even one emits its variants within 1 bit, an
odd one also those at 2 bits. Distances 1 and 3 join an even and an odd fingerprint, distance 2 meets in the middle at 1
bit from each. Of three differing bits two lie in the same half of the word, so variants at 2 bits flip a pair inside
one half only: 65 variants of an even and 1,057 of an odd fingerprint.

The shuffle key is a prefix of the variant. Variants with the same prefix travel as one row and are expanded where they
land; about a twelfth of the variants is shuffled. The members of one variant that are 1 bit from it are within the radius of all its other members,
so one of them is linked to each, which is linear and loses no connection. Every link is verified by its bit distance. Distinct
fingerprints are linked, never documents, so a group of copies is one row; components are found by
star contraction on the links, with checkpoints in the shared folder.

Defined cases: null and empty texts and those without a word have fingerprint zero and are linked like any other; fewer words than
a shingle form one shingle; ties and repeated rows share a component. `dedup` keeps one row per component,
that of the smallest doc_id. A component whose rows all lack an id has component_id null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lagwise.llm.common import bounded_batches, documents, utf8
from lagwise.llm.exact import first_of_ties
from lagwise.session import cut_lineage

SHINGLE = 3
RADIUS = 3
SEED = 42
ROWS_PER_KEY = 64
EXPANDED = 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the hashes of all word shingles; only A-Z are lower-cased."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(plain, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(plain[a:b], SEED) for a, b in zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in pieces; every shingle counts
        votes += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints_of(shingle: int):
    @pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return run


def masks(parity: int) -> np.ndarray:
    """Bits that a fingerprint of this parity flips: none, each, and for odd ones each pair inside a half."""
    bit = [1 << i for i in range(64)]
    pairs = [a | b for half in (bit[:32], bit[32:]) for a, b in combinations(half, 2)] if parity else []
    return np.array([0, *bit, *pairs], np.uint64)


def _parity(x: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x) & 1).astype(np.uint8)


def links(prints: DataFrame, key_bits: int) -> DataFrame:
    """Rows (a, b) of linked distinct fingerprints; enough of them to connect all that are within the radius.

    `prints` has distinct fingerprints in column `f`.
    """
    shift = np.uint64(64 - key_bits)

    def by_prefix(parity: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        all_ = masks(parity)
        prefixes = all_ >> shift
        return np.unique(prefixes), {int(p): all_[prefixes == p] for p in np.unique(prefixes)}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [by_prefix(0)[0], by_prefix(1)[0]]
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            odd = _parity(f)
            for parity in (0, 1):
                for part in np.array_split(f[odd == parity], max(1, (odd == parity).sum() * len(flips[parity]) // 500_000)):
                    rows, flip = np.repeat(part, len(flips[parity])), np.tile(flips[parity], len(part))
                    key = (rows >> shift) ^ flip
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, rows, flip)], ["key", "f", "flip"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = [by_prefix(0)[1], by_prefix(1)[1]]
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links among the variants of whole keys. Oversized keys are done in slices of the variants' low bits."""
            f, flip, odd = rows[1], rows[2], _parity(rows[1])
            weight = np.array([len(tails[o][int(x)]) for o, x in zip(odd.tolist(), flip.tolist())]) if len(f) < 1000 else None
            size = int(weight.sum()) if weight is not None else len(f) * 40
            slices = 1
            while size // slices > EXPANDED:
                slices *= 2
            kinds, kind = np.unique(flip * np.uint64(2) + odd, return_inverse=True)
            for s in range(slices):
                variants, owners, near = [], [], []
                for k, code in enumerate(kinds.tolist()):
                    part, tail = f[kind == k], tails[code & 1][code >> 1]
                    v = (part[:, None] ^ tail[None, :]).ravel()
                    mine = (v & np.uint64(slices - 1)) == s if slices > 1 else slice(None)
                    variants.append(v[mine])
                    owners.append(np.repeat(part, len(tail))[mine])
                    near.append(np.tile(np.bitwise_count(tail) < 2, len(part))[mine])
                v, own, close = np.concatenate(variants), np.concatenate(owners), np.concatenate(near)
                order = np.argsort(v, kind="stable")
                v, own, close = v[order], own[order], close[order]
                new = np.concatenate([[True], v[1:] != v[:-1]])
                group = np.cumsum(new) - 1
                # The hub of a variant: its smallest member at 1 bit; a variant with none of these makes no link.
                hub = np.full(group[-1] + 1, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(hub, group[close], own[close])
                has = np.zeros(group[-1] + 1, bool)
                has[group[close]] = True
                centre = hub[group]
                take = has[group] & (own != centre) & (np.bitwise_count(own ^ centre) <= RADIUS)
                if take.any():
                    pair = np.unique(np.stack([np.minimum(own, centre)[take], np.maximum(own, centre)[take]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64))], ["a", "b"])

        # Rows come sorted by key: only whole keys are worked on, several small ones at once.
        count, wanted = 0, EXPANDED // 12
        for batch in batches:
            rows = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns])
            held.append(rows)
            count += rows.shape[1]
            if count < wanted:
                continue
            rows = np.concatenate(held, 1)
            whole = int(np.searchsorted(rows[0].view(np.int64), rows[0].view(np.int64)[-1]))
            if whole:
                yield from flush(rows[:, :whole])
            held = [rows[:, whole:]]
            count = held[0].shape[1]
            wanted = max(EXPANDED // 12, 2 * count)
        if count:
            yield from flush(np.concatenate(held, 1))

    spread = prints.mapInArrow(emit, "key long, f long, flip long").repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (f, root): for every linked fingerprint the smallest of its component.

    Alternating large-star and small-star steps: every vertex hooks its larger neighbours, then its smaller ones, to its
    smallest neighbour. The number of steps is logarithmic; each is a shuffle of the links, stored by a checkpoint.
    """
    edges = cut_lineage(edges)
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m").filter("x <> m").distinct()
        low = large.groupBy("x").agg(F.min("m").alias("least"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct(F.col("x").alias("b"), F.col("least").alias("a")), F.struct(F.col("m").alias("b"), F.col("least").alias("a")))).alias("e"))
        edges = cut_lineage(small.select("e.a", "e.b").filter("a <> b").distinct())
        # At the end every edge is a star (root, member), which a step leaves as it is.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last:
            return edges.select(F.col("b").alias("f"), F.col("a").alias("root"))
        last = state


def prints_of(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, f, t): fingerprint and a hash of the text, which tells rows of one id apart; stored."""
    bounded_batches(docs.sparkSession)
    return cut_lineage(docs.select("doc_id", fingerprints_of(shingle)("text").alias("f"), F.xxhash64("text").alias("t")))


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (f, root, component_id) per distinct fingerprint, stored: the smallest fingerprint and doc_id of its component."""
    if radius != RADIUS:
        raise ValueError("the variants are those of a radius of 3 bits")
    distinct = cut_lineage(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    key_bits = int(np.clip(np.ceil(np.log2(max(1, distinct.count() / ROWS_PER_KEY))), 8, 32))
    roots = components(links(distinct.select("f"), key_bits))
    named = distinct.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut_lineage(named.join(ids, "root").select("f", "root", "component_id"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of every component, with the columns of `docs`: that of the smallest id (null last), then text hash.

    Winners are aggregated from ids and fingerprints; texts are only matched with the winners' (id, text hash).
    """
    prints = prints_of(docs, shingle)
    known = prints.join(groups(prints, radius).select("f", "root"), "f").groupBy("root", "doc_id", "t").count()
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t")
    best = known.groupBy("root").agg(F.min(F.struct(first.alias("first"), "count")).alias("b"))
    winners = cut_lineage(best.select(F.struct(F.col("b.first.doc_id").alias("id"), F.col("b.first.t").alias("t")).alias("won"), F.col("b.count").alias("n")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"))
    on = F.col("id").eqNullSafe(F.col("won.id")) & (F.col("t") == F.col("won.t"))
    kept = rows.join(winners, on)
    single = kept.filter(F.col("n") == 1).select("row.*")
    tied = first_of_ties(kept.filter(F.col("n") > 1).withColumn("d", F.xxhash64("id", "t")), "d", "chosen")
    return single.unionByName(tied.filter("chosen").select("row.*"))


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    prints = prints_of(documents(spark, sf_dir))
    joined = prints.join(groups(prints), "f")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
