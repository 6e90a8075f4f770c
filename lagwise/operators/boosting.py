"""Boosted regression trees for many expanding training sets at once.

A model is refitted before every test window. All fits (one per model and window) grow level by level together: one job
per level forms, for every fit, histograms of the residuals by (node, feature, bin), adds them up over the blocks of rows, and
picks the best cut of each node. The driver keeps the cuts only: at most one row per fit and node.

Rows are binned once and packed in blocks of about `BLOCK_ROWS`, in order of their window, so that the training rows of a fit are
a prefix of each block. A block meets the fits in groups; what a group knows of a block (the predictions so far) is
stored after each tree, so a lost executor costs one tree at most, and the former state is then removed.
Work is rows times fits, memory of a task one block with one group of fits. When all rows are one block there is nothing
to add up between levels, and a job grows `ROUNDS` trees before it stores its state; the trees are the same. There a level adds up
the smaller child of each node only, its sibling is what the node leaves (exact for whole targets: the state has single precision).
Features are joined to columns, as digits of a number: a pass over the rows for each column adds up all its features, and sums over
the small table give the histogram of each.

A cut maximises the gain in squared error with an L2 penalty of `PENALTY` on leaf values, as usual for boosted trees; fits start
from the mean of their training rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.expressions import complete
from lagwise.session import cut_lineage, remove, scratch

BINS = 32
BLOCK_ROWS = 100_000
ROUNDS = 20
GROUP_FITS = 64
SIDE_BINS = (8, 2)
PENALTY = 1.0
LEAST_GAIN = 1e-9


def bin_edges(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each column, from one pass; a column has less of them when it has few values."""
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    found = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in columns)).first()
    return [np.unique(np.array(found[c] or [], float)) for c in columns]


def pack_blocks(rows: DataFrame, columns: Sequence[str], models: Sequence[Sequence[int]], edges: list[np.ndarray], target: str,
                keys: Sequence[str]) -> DataFrame:
    """Rows (block, data): per partition the bins, targets, windows, keys, and which models a row is complete for."""
    plain = rows.select("split_index", F.col(target).cast("double").alias("_y"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)), *keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        window = whole["split_index"].to_numpy()
        order = np.argsort(window, kind="stable")
        raw = np.stack([whole[f"_x{i}"].to_numpy(zero_copy_only=False) for i in range(len(columns))], axis=1)[order]
        bins = np.stack([np.searchsorted(e, raw[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
        known = ~np.isnan(raw)
        fit_for = np.stack([known[:, list(m)].all(axis=1) for m in models], axis=1)
        data = (bins, whole["_y"].to_numpy()[order], window[order].astype(np.int32), fit_for, whole.select(list(keys)).take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(data, 5)], pa.binary())], ["data"])

    return plain.mapInArrow(pack, "data binary")


def cuts_of(histogram: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best cut per node of sums and counts [2, node, feature, bin]: rows (feature or -1, bin, left and right value)."""
    left = np.cumsum(histogram, axis=3)[..., :-1]
    whole = histogram.sum(axis=3, keepdims=True)
    right = whole - left

    def share(side: np.ndarray) -> np.ndarray:
        found = side[1] + penalty
        np.divide(side[0], found, out=found)
        return np.multiply(side[0], found, out=found)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = share(left)
        gain += share(right)
        gain -= share(whole)
        np.copyto(gain, -np.inf, where=np.minimum(left[1], right[1]) < 1)
    nodes, features, cuts = gain.shape
    best = gain.reshape(nodes, -1).argmax(axis=1)
    at = (np.arange(nodes), best // cuts, best % cuts)
    split = gain[at] > LEAST_GAIN
    both = [np.where(split, side[0][at] / (side[1][at] + penalty), 0.0) for side in (left, right)]
    return np.stack([np.where(split, at[1], -1), np.where(split, at[2], 0), *both], axis=1)


class Trees:
    """One growing tree per fit, nodes numbered as in a heap: children of i are 2i+1 and 2i+2."""

    def __init__(self, fits: int, depth: int):
        self.feature = np.full((fits, 2**depth - 1), -1, np.int32)
        self.cut = np.zeros((fits, 2**depth - 1), np.int32)
        self.value = np.zeros((fits, 2 ** (depth + 1) - 1))

    def grow(self, fit: int, level: int, cuts: np.ndarray) -> None:
        first = 2**level - 1
        at = np.arange(first, 2 * first + 1)
        self.feature[fit, at], self.cut[fit, at] = cuts[:, 0], cuts[:, 1]
        split = cuts[:, 0] >= 0
        self.value[fit, 2 * at[split] + 1], self.value[fit, 2 * at[split] + 2] = cuts[split, 2], cuts[split, 3]

    def descend(self, fit: int, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The nodes one level below `node`; a row stays where its node has no cut."""
        inner = np.minimum(node, self.feature.shape[1] - 1)
        feature = np.where(node == inner, self.feature[fit, inner], -1)
        right = bins.ravel().take(feature * bins.shape[1] + np.arange(len(node)), mode="wrap") > self.cut[fit, inner]
        return np.where(feature >= 0, 2 * node + 1 + right, node)

    def divide(self, fit: int, level: int, bins: np.ndarray, members: list[np.ndarray]) -> Iterator[np.ndarray]:
        """The rows of each node below `level` from those of its nodes; a node without a cut has no children."""
        for node, rows in enumerate(members, 2**level - 1):
            if self.feature[fit, node] < 0:
                yield from (rows[:0], rows[:0])
            else:
                right = bins[self.feature[fit, node]].take(rows) > self.cut[fit, node]
                yield from (rows.take(np.flatnonzero(~right)), rows.take(np.flatnonzero(right)))

    def nodes(self, fit: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node each row has come to."""
        node = np.zeros(bins.shape[1], np.int64)
        for _ in range(depth):
            node = self.descend(fit, bins, node)
        return node


class Joined:
    """Columns that hold several features each: a main one and beside it one of at most 16 bins, or one of at most 8 and one of at most 2.

    `columns` [column, row] has the cell of each row; `held` has the features and their columns, per kind of place.
    """

    def __init__(self, bins: np.ndarray, width: int = BINS):
        large, small = SIDE_BINS
        side = large * small
        self.features, self.shape = len(bins), (width, side)
        sizes = bins.max(axis=1, initial=0).astype(int) + 1
        free: dict[str, list[int]] = {"side": [], "large": [], "small": []}
        self.held: dict[str, list[tuple[int, int]]] = {"main": [], "side": [], "large": [], "small": []}
        columns: list[np.ndarray] = []
        for f in np.argsort(-sizes, kind="stable").tolist():
            kind = next((k for k, most in (("small", small), ("large", large), ("side", side)) if free[k] and sizes[f] <= most), "main")
            if kind == "main":
                columns.append(bins[f].astype(np.int64) * side)
                free["side"].append(len(columns) - 1)
                at = len(columns) - 1
            else:
                at = free[kind].pop(0)
                if kind == "side" and sizes[f] <= large:
                    kind = "large"
                    free["small"].append(at)
                columns[at] += bins[f].astype(np.int64) * (small if kind == "large" else 1)
            self.held[kind].append((f, at))
        self.cells = width * side
        self.columns = np.array(columns, np.min_scalar_type(self.cells)).reshape(len(columns), bins.shape[1])

    def spread(self, table: np.ndarray, found: np.ndarray) -> None:
        """The histograms [kind, node, feature, bin] from a table [kind, node, column, cell]."""
        table = table.reshape(*table.shape[:3], *self.shape)
        side = np.einsum("kncms->kncs", table)
        halves = side.reshape(*side.shape[:3], *SIDE_BINS)
        sums = {"main": lambda: np.einsum("kncms->kncm", table), "side": lambda: side,
                "large": lambda: np.einsum("knclt->kncl", halves), "small": lambda: np.einsum("knclt->knct", halves)}
        for kind, held in self.held.items():
            if held:
                features, columns = map(list, zip(*held))
                part = sums[kind]()
                found[:, :, features, : part.shape[3]] = part[:, :, columns]


class View:
    """The rows of a block that are complete for a model, in order of their window: bins [feature, row], targets, windows, places."""

    def __init__(self, data: tuple, m: int, places: np.ndarray, width: int):
        bins, target, window, fit_for, _ = data
        self.rows = np.flatnonzero(fit_for[:, m])
        self.bins = np.ascontiguousarray(bins[self.rows][:, places].T)
        self.target, self.window = target[self.rows], window[self.rows]
        self.width = max(width, SIDE_BINS[0] * SIDE_BINS[1])

    @cached_property
    def joined(self) -> Joined:
        return Joined(self.bins, self.width)

    def trained(self, split: int) -> int:
        """How many rows stand before a window."""
        return int(np.searchsorted(self.window, split))

    def reached(self, split: int) -> int:
        """How many rows stand before a window or in it."""
        return int(np.searchsorted(self.window, split, side="right"))


def views_of(data: tuple, fits: list[tuple[int, int, int]], models: Sequence[np.ndarray], width: int = BINS) -> dict[int, View]:
    return {m: View(data, m, models[m], width) for m in {m for _, m, _ in fits}}


def histogram(joined: Joined, own: np.ndarray, rest: np.ndarray, nodes: int, rows: np.ndarray | None = None,
              counts: np.ndarray | None = None) -> np.ndarray:
    """Sums and counts [2, node, feature, bin] of residuals, over the first rows or those at `rows`; node `nodes` is left out.

    One joined column after the other, so that what is added up at a time stays in the processor's cache. `counts` are those already known.
    """
    weights = (rest, None) if counts is None else (rest,)
    first = own * joined.cells if nodes > 1 else None
    table = np.empty((len(weights), nodes, len(joined.columns), joined.cells))
    for c, column in enumerate(joined.columns):
        cells = column[: len(own)] if rows is None else column.take(rows)
        if first is not None:
            cells = cells + first
        for kind, w in enumerate(weights):
            table[kind, :, c] = np.bincount(cells, w, minlength=(nodes + 1) * joined.cells).reshape(-1, joined.cells)[:nodes]
    found = np.zeros((2, nodes, joined.features, joined.shape[0]))
    joined.spread(table, found[: len(weights)])
    if counts is not None:
        found[1] = counts
    return found


def places_of(node: np.ndarray, level: int) -> np.ndarray:
    """The place of each row's node in its level; rows at rest above it come after the last one."""
    nodes = 2**level
    own = node - (nodes - 1)
    return np.where(own < 0, nodes, own)


def child_histograms(above: np.ndarray, joined: Joined, members: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
    """The histogram of a level from the one above it: only the smaller child of a node is added up, the other is what it leaves.

    `members` has the rows of each node of the level, none for the children of a node without a cut.
    """
    sizes = np.array([len(rows) for rows in members]).reshape(-1, 2)
    parents = len(sizes)
    less = (sizes[:, 1] < sizes[:, 0]).astype(int)
    rows = np.concatenate([members[2 * p + least] for p, least in enumerate(less)])
    own = np.repeat(np.arange(parents), sizes[np.arange(parents), less])
    part = histogram(joined, own, rest.take(rows), parents, rows)
    other = above - part
    other[0][other[1] == 0] = 0.0
    other[:, sizes.sum(axis=1) == 0] = 0.0  # a node without a cut has no children
    found = np.empty((2, parents, 2, *above.shape[2:]))
    found[:, np.arange(parents), less] = part
    found[:, np.arange(parents), 1 - less] = other
    return found.reshape(2, 2 * parents, *above.shape[2:])


def histograms(data: tuple, state: np.ndarray, fits: list[tuple[int, int, int]], models: Sequence[np.ndarray], trees: Trees,
               level: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per fit the histogram of its training rows in a block."""
    views = views_of(data, fits, models, width)
    for i, (fit, m, split) in enumerate(fits):
        view = views[m]
        end = view.trained(split)
        rest = view.target[:end] - state[view.rows[:end], i]
        node = trees.nodes(fit, view.bins[:, :end], level)
        yield fit, histogram(view.joined, places_of(node, level), rest, 2**level)


def advance(data: tuple, state: np.ndarray, fits: list[tuple[int, int, int]], models: Sequence[np.ndarray], trees: Trees,
            depth: int, rate: float) -> np.ndarray:
    """Predictions after one more tree, for the training and the test rows of each fit."""
    state, views = state.copy(), views_of(data, fits, models)
    for i, (fit, m, split) in enumerate(fits):
        view = views[m]
        end = view.reached(split)
        state[view.rows[:end], i] += rate * trees.value[fit, trees.nodes(fit, view.bins[:, :end], depth)]
    return state


def grow_alone(data: tuple, state: np.ndarray, fits: list[tuple[int, int, int]], models: Sequence[np.ndarray], rounds: int,
               depth: int, width: int, rate: float) -> np.ndarray:
    """Predictions after some more trees, when the block has all rows: no fit waits for another one, and each row goes down a tree once."""
    state, views = state.copy(), views_of(data, fits, models, width)
    for i, (_, m, split) in enumerate(fits):
        view = views[m]
        train, end = view.trained(split), view.reached(split)
        target, tested = view.target[:train], np.ascontiguousarray(view.bins[:, train:end])
        held = state[view.rows[:end], i]
        known, more = None, np.empty(end)
        every, root = np.arange(train), np.zeros(train, np.int64)
        for _ in range(rounds):
            tree, rest, members = Trees(1, depth), target - held[:train], [every]
            found = known = histogram(view.joined, root, rest, 1, counts=None if known is None else known[1])
            for level in range(depth):
                if level:
                    found = child_histograms(found, view.joined, members, rest)
                tree.grow(0, level, cuts_of(found))
                for node, rows in enumerate(members, 2**level - 1):
                    if tree.feature[0, node] < 0:
                        more[rows] = rate * tree.value[0, node]
                members = list(tree.divide(0, level, view.bins, members))
            for node, rows in enumerate(members, 2**depth - 1):
                more[rows] = rate * tree.value[0, node]
            more[train:] = rate * tree.value[0, tree.nodes(0, tested, depth)]
            held += more
        state[view.rows[:end], i] = held
    return state


def dealt(fits: list[tuple[int, int, int]], work: Sequence[int], n_groups: int) -> list[list[tuple[int, int, int]]]:
    """Groups of about equal numbers of fits and equal work: from the largest down, to and fro over the groups."""
    groups: list[list] = [[] for _ in range(n_groups)]
    for i, at in enumerate(sorted(range(len(fits)), key=lambda k: -work[k])):
        turn, g = divmod(i, n_groups)
        groups[g if turn % 2 == 0 else n_groups - 1 - g].append(fits[at])
    return groups


def fit_splits(bucketed: DataFrame, splits: Sequence[int], models: dict[str, Sequence[str]], target: str, settings: dict,
               to_rows: Callable[..., DataFrame], min_train: int, min_test: int,
               keys: Sequence[str] = ("date", "region_id", "need_type"), block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """Predictions of every model for every window of `splits`, each fitted to the rows of earlier windows.

    `bucketed` has the window of each row as `split_index`. `to_rows(frame, model, prediction, split, n_train)` shapes the result.
    None when no fit has enough rows.
    """
    spark = bucketed.sparkSession
    names = list(models)
    columns = list(dict.fromkeys(c for m in names for c in models[m]))
    places = [np.array([columns.index(c) for c in models[m]]) for m in names]
    last = max(splits, default=-1)
    rows = cut_lineage(bucketed.filter(F.col(target).isNotNull() & (F.col("split_index") <= last)).select("split_index", target, *columns, *keys))
    # One row per window of the calendar.
    whole = [complete(models[m]) for m in names]
    sums = [a for c in whole for a in (F.count_if(c), F.sum(F.when(c, F.col(target).cast("double"))))]
    found = sorted(tuple(r) for r in rows.groupBy("split_index").agg(*sums).collect())
    counts = {r[0]: r[1:] for r in found}
    fits: list[tuple[int, int, int]] = []
    starts, trained = [], []
    for s in sorted(splits):
        for m in range(len(names)):
            n = sum(r[1 + 2 * m] for r in found if r[0] < s)
            if n >= min_train and counts.get(s, [0] * (2 * len(names)))[2 * m] >= min_test:
                fits.append((len(fits), m, s))
                trained.append(int(n))
                starts.append(sum(r[2 + 2 * m] or 0.0 for r in found if r[0] < s) / n)
    if not fits:
        return None

    depth, width = settings["maxDepth"], settings.get("maxBins", BINS)
    n_blocks = max(1, -(-sum(r[1] for r in rows.groupBy("split_index").count().collect()) // block_rows))
    blocks = pack_blocks(rows.repartition(n_blocks), columns, places, bin_edges(rows, columns, width), target, keys)
    n_groups = min(len(fits), max(-(-len(fits) // GROUP_FITS), -(-spark.sparkContext.defaultParallelism // n_blocks)))
    groups = dealt(fits, [trained[fit] * len(places[m]) for fit, m, _ in fits], n_groups)
    fixed = spark.sparkContext.broadcast((groups, places, np.array(starts)))
    folder = scratch(spark, "boosting")

    def stored_row(g: int, blob: bytes, state: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([g], pa.int32()), pa.array([blob], pa.binary()), pa.array([state.tobytes()], pa.binary())], ["g", "data", "state"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, _, starts = fixed.value
        for batch in batches:
            for g, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = len(pickle.loads(blob.as_py())[1])
                state = np.repeat(starts[[f for f, _, _ in groups[g]]].astype(np.float32)[None], n, axis=0)
                yield stored_row(g, blob.as_py(), state)

    def opened(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for g, blob, state in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = pickle.loads(blob.as_py())
                group = fixed.value[0][g]
                yield g, group, data, np.frombuffer(state.as_py(), np.float32).reshape(len(data[1]), len(group)), blob.as_py()

    schema = "g int, data binary, state binary"
    spread = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("g"), "data").repartition(n_blocks * n_groups)
    at = f"{folder}/0"
    spread.mapInArrow(begin, schema).write.parquet(at)

    def grow_local(rounds: int) -> Callable:
        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, group, data, state, blob in opened(batches):
                yield stored_row(g, blob, grow_alone(data, state, group, fixed.value[1], rounds, depth, width, settings["stepSize"]))

        return grow

    def grow_shared(stored: DataFrame) -> Callable:
        """One tree of every fit, level by level over all blocks; returns what adds it to the state."""
        trees = Trees(len(fits), depth)
        for level in range(depth):
            now = spark.sparkContext.broadcast((trees, level))

            def measure(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
                trees, level = now.value
                for _, group, data, state, _ in opened(batches):
                    for fit, h in histograms(data, state, group, fixed.value[1], trees, level, width):
                        yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([pickle.dumps(h, 5)], pa.binary())], ["fit", "found"])

            def add_up(table: pa.Table) -> pa.Table:
                cuts = cuts_of(sum(pickle.loads(x.as_py()) for x in table["found"]))
                return pa.table({"fit": table["fit"][:1], "found": pa.array([pickle.dumps(cuts, 5)], pa.binary())})

            measured = stored.mapInArrow(measure, "fit int, found binary").groupBy("fit").applyInArrow(add_up, "fit int, found binary")
            for r in measured.collect():
                trees.grow(r["fit"], level, pickle.loads(r["found"]))
            now.destroy()
        grown = spark.sparkContext.broadcast(trees)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, group, data, state, blob in opened(batches):
                yield stored_row(g, blob, advance(data, state, group, fixed.value[1], grown.value, depth, settings["stepSize"]))

        return step

    done = 0
    while done < settings["maxIter"]:
        stored = spark.read.schema(schema).parquet(at)
        rounds = min(ROUNDS, settings["maxIter"] - done) if n_blocks == 1 else 1
        done += rounds
        after = f"{folder}/{done}"
        stored.mapInArrow(grow_local(rounds) if n_blocks == 1 else grow_shared(stored), schema).write.parquet(after)
        remove(spark, at)
        at = after

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group, data, state, _ in opened(batches):
            _, target_values, window, fit_for, named = data
            for i, (fit, m, split) in enumerate(group):
                chosen = np.flatnonzero((window == split) & fit_for[:, m])
                part = named.take(pa.array(chosen))
                for name, values, kind in (("fit", np.full(len(chosen), fit), pa.int32()), ("_split", np.full(len(chosen), split), pa.int32()), (target, target_values[chosen], pa.float64()), ("prediction", state[chosen, i].astype(float), pa.float64())):
                    part = part.append_column(name, pa.array(values, kind))
                yield from part.combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in keys}
    scored = spark.read.schema(schema).parquet(at).mapInArrow(
        score, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "fit int, _split int", f"`{target}` double, prediction double"]))
    scored = cut_lineage(scored)
    remove(spark, folder)
    model_of = F.array(*(F.lit(names[m]) for _, m, _ in fits))
    n_of = F.array(*map(F.lit, trained))
    return to_rows(scored, model_of[F.col("fit")], F.col("prediction"), F.col("_split"), n_of[F.col("fit")])
