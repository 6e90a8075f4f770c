"""Trees for all expanding splits against one naive fit per split."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise.operators import boosting

SETTINGS = {"maxIter": 7, "maxDepth": 3, "stepSize": 0.3}
MODELS = {"wide": ["a", "b", "c"], "slim": ["c", "a"]}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 700
    pdf = pd.DataFrame({"split_index": np.sort(rng.integers(-1, 6, n)), "id": np.arange(n), "a": rng.normal(size=n).round(2),
                        "b": rng.integers(0, 3, n).astype(float), "c": rng.normal(size=n)})
    pdf["target"] = 3 * (pdf.a > 0.2) * pdf.b + np.sin(3 * pdf.c) + rng.normal(scale=0.1, size=n)
    pdf.loc[rng.choice(n, 40, replace=False), "b"] = np.nan
    return pdf


def naive_tree(bins, rest, depth):
    """A function of the bins: value 0 at a root without a cut, else shrunken means of the sides."""
    def leaf(part):
        return rest[part].sum() / (len(part) + boosting.PENALTY)

    def gain(parts):
        return sum(rest[p].sum() ** 2 / (len(p) + boosting.PENALTY) for p in parts)

    def grow(part, level, value):
        best = None
        if level < depth:
            for f in range(bins.shape[1]):
                for cut in range(boosting.BINS - 1):
                    low, high = part[bins[part, f] <= cut], part[bins[part, f] > cut]
                    if len(low) and len(high):
                        more = gain([low, high]) - gain([part])
                        if more > boosting.LEAST_GAIN and (best is None or more > best[0] + 1e-9):
                            best = (more, f, cut, low, high)
        if best is None:
            return lambda x: value
        _, f, cut, low, high = best
        sides = grow(low, level + 1, leaf(low)), grow(high, level + 1, leaf(high))
        return lambda x: sides[int(x[f] > cut)](x)

    return grow(np.arange(len(rest)), 0, 0.0)


def naive(pdf, edges):
    columns = ["a", "b", "c"]
    binned = np.stack([np.searchsorted(edges[c], pdf[c], side="left") for c in columns], axis=1)
    out = {}
    for model, used in MODELS.items():
        whole = pdf[used].notna().all(axis=1).to_numpy()
        bins = binned[:, [columns.index(c) for c in used]]
        for split in range(6):
            train = np.flatnonzero(whole & (pdf.split_index < split))
            test = np.flatnonzero(whole & (pdf.split_index == split))
            y = pdf.target.to_numpy()
            state = np.full(len(pdf), y[train].mean())
            for _ in range(SETTINGS["maxIter"]):
                tree = naive_tree(bins[train], (y - state)[train], SETTINGS["maxDepth"])
                state += SETTINGS["stepSize"] * np.array([tree(x) for x in bins])
            out |= {(model, split, int(pdf.id[i])): (state[i], len(train)) for i in test}
    return out


def shaped(rows, model, prediction, split, n):
    return rows.select(model.alias("model"), split.alias("split"), "id", "target", prediction.alias("p"), n.alias("n"))


@pytest.mark.parametrize("block_rows, rounds", [(100_000, 20), (100_000, 3), (200, 20)])
def test_all_splits_equal_single_fits(spark, rows, monkeypatch, block_rows, rounds):
    monkeypatch.setattr(boosting, "ROUNDS", rounds)
    monkeypatch.setattr(boosting, "GROUP_FITS", 5)
    schema = "split_index int, id long, a double, b double, c double, target double"
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), schema).repartition(4)
    edges = dict(zip("abc", boosting.bin_edges(df, ["a", "b", "c"])))
    got = boosting.fit_splits(df, range(6), MODELS, "target", SETTINGS, shaped, 10, 3, keys=["id"], block_rows=block_rows).collect()
    want = naive(rows, edges)
    assert {(r["model"], r["split"], r["id"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        p, n = want[r["model"], r["split"], r["id"]]
        assert r["p"] == pytest.approx(p, abs=1e-4) and r["n"] == n
        assert r["target"] == rows.target[r["id"]]


def test_too_few_rows_give_no_fit(spark, rows):
    df = spark.createDataFrame([(0, 1, 1.0, 1.0)], "split_index int, id long, a double, target double")
    assert boosting.fit_splits(df, [0], {"m": ["a"]}, "target", SETTINGS, shaped, 1, 1, keys=["id"]) is None


def test_scratch_is_removed(spark, rows, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(boosting, "scratch", lambda s, name: str(tmp_path / name))
    df = spark.createDataFrame([(w, i, float(i % 7), float(i % 7)) for i in range(60) for w in (-1, 0)], "split_index int, id long, a double, target double")
    out = boosting.fit_splits(df, [0], {"m": ["a"]}, "target", SETTINGS | {"maxIter": 40}, shaped, 1, 1, keys=["id"])
    assert out.filter(F.abs(F.col("p") - F.col("target")) > 0.2).count() == 0
    assert os.listdir(tmp_path) == []


def block(n=900, seed=3):
    """A block of four features for two models; targets are whole numbers, some rows lack a feature of the first model."""
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, boosting.BINS, (n, 4)).astype(np.uint8)
    bins[:, 3] = rng.integers(0, 2, n) * 9
    known = np.stack([rng.random(n) < 0.9, np.ones(n, bool)], axis=1)
    target = np.rint(bins[:, 0] + 4 * (bins[:, 1] > 12) + 9 * (bins[:, 3] > 0) + rng.normal(size=n))
    data = (bins, target, np.sort(rng.integers(-1, 3, n)).astype(np.int32), known, None)
    return data, [(0, 0, 1), (1, 1, 2), (2, 1, 0)], [np.array([0, 1, 2, 3]), np.array([3, 0])]


def test_trees_grown_alone_equal_trees_grown_by_level(monkeypatch):
    data, fits, models = block()
    begin = np.tile(np.float32([8.5, 9.25, 7.75]), (len(data[1]), 1))
    added, plain = [], boosting.histogram
    monkeypatch.setattr(boosting, "histogram", lambda bins, own, *a, **k: added.append(len(own)) or plain(bins, own, *a, **k))
    got = boosting.grow_alone(data, begin, fits, models, 4, 5, boosting.BINS, 0.3)
    alone = sum(added)
    added.clear()
    want = begin
    for _ in range(4):
        trees = boosting.Trees(len(fits), 5)
        for level in range(5):
            for fit, found in boosting.histograms(data, want, fits, models, trees, level, boosting.BINS):
                trees.grow(fit, level, boosting.cuts_of(found))
        want = boosting.advance(data, want, fits, models, trees, 5, 0.3)
    assert np.array_equal(got, want) and not np.array_equal(got, begin)
    # Below the root only smaller children are added up: at most the rows once and half of them four times.
    assert alone <= sum(added) * 3 / 5


def test_groups_have_equal_work():
    fits = [(i, 0, i) for i in range(50)]
    groups = boosting.dealt(fits, range(1, 51), 8)
    assert sorted(f for g in groups for f in g) == fits
    sums = [sum(i + 1 for i, _, _ in g) for g in groups]
    assert max(sums) - min(sums) <= 50 and {len(g) for g in groups} <= {6, 7}


def test_joined_features_have_their_own_histograms():
    rng = np.random.default_rng(5)
    sizes = [32, 2, 7, 1, 16, 9, 2, 30, 8, 3, 2, 2, 17]
    bins = np.stack([rng.integers(0, s, 4000) for s in sizes]).astype(np.uint8)
    joined = boosting.Joined(bins)
    assert len(joined.columns) <= len(sizes) / 2
    own, rest = rng.integers(0, 5, 4000), rng.integers(-9, 9, 4000).astype(float)
    rows = np.flatnonzero(rng.random(4000) < 0.3)
    for found, at in ((boosting.histogram(joined, own, rest, 4), np.arange(4000)), (boosting.histogram(joined, own[rows], rest[rows], 4, rows), rows)):
        want = np.zeros((2, 5, len(sizes), boosting.BINS))
        for f in range(len(sizes)):
            np.add.at(want[0, :, f], (own[at], bins[f, at]), rest[at])
            np.add.at(want[1, :, f], (own[at], bins[f, at]), 1)
        assert np.array_equal(found, want[:, :4])


@pytest.mark.parametrize("bins", [8, 200])
def test_joined_features_of_few_and_many_bins(bins):
    rng = np.random.default_rng(6)
    data = (rng.integers(0, bins, (500, 3)).astype(np.uint8), rng.integers(0, 9, 500).astype(float), np.sort(rng.integers(-1, 2, 500)).astype(np.int32),
            np.ones((500, 1), bool), None)
    fits, models, begin = [(0, 0, 1)], [np.arange(3)], np.zeros((500, 1), np.float32)
    got = boosting.grow_alone(data, begin, fits, models, 2, 3, bins, 0.5)
    want = begin
    for _ in range(2):
        trees = boosting.Trees(1, 3)
        for level in range(3):
            for fit, found in boosting.histograms(data, want, fits, models, trees, level, bins):
                plain = np.zeros_like(found)
                view = boosting.View(data, 0, models[0], bins)
                end = view.trained(1)
                own = boosting.places_of(trees.nodes(0, view.bins[:, :end], level), level)
                inside = own < 2**level
                for f in range(3):
                    np.add.at(plain[0, :, f], (own[inside], view.bins[f, :end][inside]), (view.target - want[:, 0])[:end][inside])
                    np.add.at(plain[1, :, f], (own[inside], view.bins[f, :end][inside]), 1)
                assert np.array_equal(plain, found)
                trees.grow(fit, level, boosting.cuts_of(found))
        want = boosting.advance(data, want, fits, models, trees, 3, 0.5)
    assert np.array_equal(got, want) and not np.array_equal(got, begin)
