"""Spelling variants: a trie over letter-group counts, searched with one surplus and one deficit.

Words are the lower-cased letter runs of all texts, counted in the JVM with map-side sums. The letters are dealt to
`GROUPS` groups of about equal use; a word's vector has its number of letters of every group. Words stand in a trie
arranged by one count after another. An inserted letter adds one to one count, a replaced one adds one to a count and takes one from
another or changes none; so all words near a word lie in leaves that a depth-first search reaches by spending one
surplus and, for words of equal length, one deficit. Of two words of equal length the search starts from the one whose
first differing count is the lower, so a pair is found once. Words of the leaves are verified letter by letter; a leaf
of many words is first looked up by the halves of its words, one of which a single edit leaves alone.

The upper levels of the trie are the shuffle key. Their number is the smallest at which no node holds over
`NODE_WORDS` words. A node still above that at the last level is cut into salted parts, as are its visitors, and every part
meets every part. A word visits the nodes that its budget reaches, 1 + k + k (k - 1) / 2 at k levels, and only those that
hold words. A group of a task has at most about `NODE_WORDS` words and `NODE_VISITS` visitors.

Forms point to words at least `ratio` times as frequent, so chains are short (at most 28 steps for 64-bit counts); roots
come from doubling the steps, in at most five joins.

Defined cases: a null text has no words; a null id stands as empty text in the hash. Repeated rows count each. Very long
texts are read whole. An empty table, or one without words frequent enough, gives an empty result. Ties of counts go to
the smaller word in code-point order. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import documents
from lagwise.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]+"
GROUPS = 10
NODE_WORDS = 4_000
NODE_VISITS = 60_000
MANY = 8


def word_counts(docs: DataFrame, every: int = 199) -> DataFrame:
    """Rows (word, n): runs of letters in lower case. A run whose hash with the doc_id `every` divides loses a letter."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of each group. Letters are dealt in order of use, back and forth, so that groups are used alike.

    One row per letter comes to the driver: at most as many as the alphabet has.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").count()
    ranked = [r["letter"] for r in sorted(letters.collect(), key=lambda r: (-r["count"], r["letter"]))]
    turns = [*range(groups), *reversed(range(groups))]
    dealt = [""] * groups
    for i, letter in enumerate(ranked):
        dealt[turns[i % len(turns)]] += letter
    return dealt


def vector(letters: list[str]) -> Column:
    """Number of letters of each group in `word`."""
    signs = F.length("word")
    return F.array(*(signs - F.length(F.translate("word", group, "")) if group else F.lit(0) for group in letters))


def levels_for(vectors: DataFrame, groups: int, most: int) -> int:
    """Smallest number of levels at which no node has over `most` words, or all."""
    leaves = vectors.groupBy("v").agg(F.count("*").alias("n"))
    nodes = leaves.select(F.explode(F.sequence(F.lit(1), F.lit(groups))).alias("level"), "v", "n")
    sizes = nodes.groupBy("level", F.expr("slice(v, 1, level)").alias("node")).agg(F.sum("n").alias("n"))
    largest = {r["level"]: r["n"] for r in sizes.groupBy("level").agg(F.max("n").alias("n")).collect()}
    return next((k for k in sorted(largest) if largest[k] <= most), groups)


def node_of(counts: list[Column]) -> Column:
    return F.concat_ws(",", *counts)


def visits(level: int) -> Column:
    """Nodes of the upper levels that a word's budget reaches, with what is spent: 0 nothing, 1 the surplus, 2 both."""
    v = [F.col("v")[i] for i in range(level)]
    out = [F.struct(node_of(v).alias("node"), F.lit(0).alias("spent"))]
    for i in range(level):
        more = [*v[:i], v[i] + 1, *v[i + 1 :]]
        out.append(F.struct(node_of(more).alias("node"), F.lit(1).alias("spent")))
        for j in range(i + 1, level):
            less = [*more[:j], more[j] - 1, *more[j + 1 :]]
            out.append(F.struct(node_of(less).alias("node"), F.lit(2).alias("spent")))
    return F.array(*out)


def near(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced (equal lengths) or inserted."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


class Leaf:
    """Words of one vector, hence of one length; many words are looked up by their halves."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words, self.half = words, len(words[0][0]) // 2
        self.heads: dict[str, list] = {}
        self.tails: dict[str, list] = {}
        if len(words) > MANY:
            for entry in words:
                self.heads.setdefault(entry[0][: self.half], []).append(entry)
                self.tails.setdefault(entry[0][self.half :], []).append(entry)

    def candidates(self, word: str, spent: int) -> Iterator[tuple[str, int]]:
        if not self.heads:
            yield from self.words
            return
        head, tail = word[: self.half], word[self.half - (spent == 1) :]
        yield from self.heads.get(head, ())
        # What agrees in the head too has been looked at.
        yield from (e for e in self.tails.get(tail, ()) if e[0][: self.half] != head)


def build(words: list[tuple[list[int], str, int]]) -> dict | Leaf:
    """The trie below a node: count to subtree, level by level; leaves at the end."""
    root: dict = {}
    for counts, word, n in words:
        at = root
        for count in counts[:-1]:
            at = at.setdefault(count, {})
        at.setdefault(counts[-1] if counts else None, []).append((word, n))

    def close(at: dict, left: int) -> dict:
        return {k: Leaf(x) if left <= 1 else close(x, left - 1) for k, x in at.items()}

    return close(root, len(words[0][0]))


def search(trie: dict, counts: tuple[int, ...], spent: int, level: int = 0) -> Iterator[tuple[Leaf, int]]:
    """Leaves within the budget, depth first."""
    if level >= len(counts):
        if not counts:  # the node itself is the leaf
            yield trie[None], spent
        return
    last = level + 1 == len(counts)
    for count, now in ((counts[level], spent), (counts[level] + 1, 1) if spent == 0 else (counts[level] - 1, 2)):
        below = trie.get(count) if now == spent or spent < 2 else None
        if below is not None:
            if last:
                yield below, now
            else:
                yield from search(below, counts, now, level + 1)


def pairs_in_node(held: pa.Table, visitors: pa.Table) -> pa.Table:
    """Pairs (a, n_a, b, n_b) of visitors a and words b that lie in this node."""
    out: list[tuple[str, int, str, int]] = []
    if held.num_rows and visitors.num_rows:
        trie = build(list(zip(held["rest"].to_pylist(), held["word"].to_pylist(), held["n"].to_pylist())))
        alike: dict[tuple, list[tuple[str, int]]] = {}
        for rest, spent, word, n in zip(*(visitors[c].to_pylist() for c in ("ahead", "spent", "a", "n_a"))):
            alike.setdefault((tuple(rest), spent), []).append((word, n))
        for (rest, spent), callers in alike.items():
            for leaf, total in search(trie, rest, spent):
                for a, n in callers:
                    out += [(a, n, b, m) for b, m in leaf.candidates(a, total) if near(a, b) and (total or a < b)]
    columns = list(zip(*out)) or [[]] * 4
    kinds = [pa.string(), pa.int64()] * 2
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "n_a", "b", "n_b"])


def near_pairs(words: DataFrame, groups: int = GROUPS, node_words: int = NODE_WORDS, node_visits: int = NODE_VISITS) -> DataFrame:
    """Rows (a, n_a, b, n_b): every pair of words (word, n; words distinct) one edit apart, once."""
    letters = letter_groups(words, groups)
    vectors = words.select("word", "n", vector(letters).alias("v"))
    level = levels_for(vectors, groups, node_words)
    rest = F.expr(f"slice(v, {level + 1}, {groups})").alias("rest")
    held = vectors.select(node_of([F.col("v")[i] for i in range(level)]).alias("node"), rest, "word", "n")
    going = vectors.select(rest, "word", "n", F.explode(visits(level)).alias("to")).select("to.node", "to.spent", "rest", "word", "n")
    sizes = held.groupBy("node").agg(F.count("*").alias("held")).join(going.groupBy("node").agg(F.count("*").alias("come")), "node")
    cuts = sizes.select("node", F.ceil(F.col("held") / node_words).cast("int").alias("own"), F.ceil(F.col("come") / node_visits).cast("int").alias("other"))
    cuts = cut_lineage(cuts)
    salt = lambda parts: F.pmod(F.xxhash64("word"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    held = held.join(cuts, "node").select("node", "rest", "word", "n", salt("own").alias("x"), every("other").alias("y"))
    going = going.join(cuts, "node").select(
        F.col("node").alias("to"), "spent", F.col("rest").alias("ahead"), F.col("word").alias("a"), F.col("n").alias("n_a"),
        every("own").alias("to_x"), salt("other").alias("to_y"),
    )
    return held.groupBy("node", "x", "y").cogroup(going.groupBy("to", "to_x", "to_y")).applyInArrow(pairs_in_node, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root): the end of each chain of (word, form). Steps double with every join."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        joined = cut_lineage(steps.join(ahead, "root", "left").select("word", F.coalesce("farther", "root").alias("root"), F.col("farther").isNotNull().alias("moved")))
        if joined.filter("moved").isEmpty():
            return joined.select("word", "root")
        steps = joined.select("word", "root")


def variants(words: DataFrame, ratio: int = 5, **limits: int) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    words = cut_lineage(words.select("word", "n"))
    pairs = cut_lineage(near_pairs(words, **limits))
    both = reduce(DataFrame.unionByName, (pairs.select(F.col(x).alias("word"), F.col(f"n_{y}").alias("m"), F.col(y).alias("other")) for x, y in ("ab", "ba")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    with_best = words.join(best, "word", "left")
    follows = -F.col("best.m") >= ratio * F.col("n")
    found = cut_lineage(with_best.select(
        "word", F.when(follows, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(follows, -F.col("best.m")).alias("form_n"),
    ))
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    counted = word_counts(documents(spark, sf_dir)).filter((F.length("word") >= 6) & (F.col("n") >= 5))
    return variants(counted)


# The crc32 of '<doc_id>:<run>' is worked out byte by byte; two words of one length are near if deleting the same place
# makes them equal, and a word is near a longer one if a deletion makes it.
OP11_SQL = r"""
WITH RECURSIVE turns(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM turns WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS bytes FROM turns WHERE k = 8
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), per_document AS (
  SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split(id || ':' || run, ''),
    lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195::BIGINT, unicode(s)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1]))) AS h
  FROM per_document, crc_table
), counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
    sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1
), words AS (
  SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5
), deleted AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part
  FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM deleted a JOIN deleted b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT d.word, w.word, w.n FROM deleted d JOIN words w ON d.part = w.word
  UNION
  SELECT w.word, d.word, d.n FROM deleted d JOIN words w ON d.part = w.word
), best AS (
  SELECT word, count(*) AS n_near, min((-m, other)) AS top FROM pairs GROUP BY word
), found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -top[1] >= 5 * w.n THEN top[2] END AS form, CASE WHEN -top[1] >= 5 * w.n THEN -top[1] END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chains(word, ending) AS (
  SELECT word, word FROM words
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN found f ON f.word = c.ending WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.ending AS root FROM chains c JOIN found f ON f.word = c.ending WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM found f JOIN roots r ON r.word = f.word
"""
