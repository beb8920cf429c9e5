"""Histogram boosting against plain exact-greedy trees, and exact quantiles."""

import math
import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from churnframe.operators import boosting as B
from churnframe.operators import quantiles as Q


def plain_tree(x, residual, curve, depth):
    """Exact-greedy tree: nested (feature, threshold, left, right) or leaf."""
    value = residual.sum() / curve.sum()
    best = None
    if depth and len(residual) > 1:
        base = residual.sum() ** 2 / len(residual)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for edge in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= edge
                gain = residual[left].sum() ** 2 / left.sum() + residual[~left].sum() ** 2 / (~left).sum() - base
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, edge, left)
    if best is None:
        return value
    _, f, edge, left = best
    parts = [plain_tree(x[m], residual[m], curve[m], depth - 1) for m in (left, ~left)]
    return (f, edge, *parts)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_boost(x, y, logistic, n_trees, depth, rate):
    p = y.mean()
    start = math.log(p / (1 - p)) if logistic else p
    raw = np.full(len(y), start)
    for _ in range(n_trees):
        prob = 1 / (1 + np.exp(-raw))
        residual, curve = (y - prob, prob * (1 - prob)) if logistic else (y - raw, np.ones(len(y)))
        tree = plain_tree(x, residual, curve, depth)
        raw = raw + rate * np.array([plain_value(tree, r) for r in x])
    return 1 / (1 + np.exp(-raw)) if logistic else raw


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 12, 500), rng.integers(0, 5, 500), rng.integers(-20, 20, 500) / 4])
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] / 4 - 1.5 + (x[:, 2] > 1))))).astype(float)
    z = x[:, 0] * 2 - x[:, 1] + rng.normal(0, 0.5, 500)
    rows = [(i, *map(float, r), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, z))]
    return x, y, z, spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z double").repartition(4)


@pytest.mark.parametrize("label, logistic", [("y", True), ("z", False)])
def test_boosting_matches_plain_trees(data, monkeypatch, label, logistic):
    monkeypatch.setattr(B, "iteration_partitions", lambda spark, n: 3)
    monkeypatch.setattr(B, "CHECKPOINT", 4)
    x, y, z, df = data
    model = B.fit_trees(df, ["a", "b", "c"], label, ["a", "b", "c"], 500, logistic, n_trees=11, depth=3, rate=0.3)
    assert len(model.trees) == 11
    want = plain_boost(x, y if logistic else z, logistic, 11, 3, 0.3)
    got = {r.id: r.s for r in model.score(df, ["a", "b", "c"], "s").select("id", "s").collect()}
    assert [got[i] for i in range(500)] == pytest.approx(want.tolist(), abs=1e-9)


def test_guesses_save_passes_and_change_nothing(data, monkeypatch):
    *_, df = data
    passes, real = [], B._histograms

    def counted(*args):
        passes.append(args[3])
        return real(*args)

    class Forgetful(dict):
        def get(self, key, default=None):
            return default

    monkeypatch.setattr(B, "_histograms", counted)
    args = (["a", "b", "c"], "y", ["a", "b", "c"], 500, True)
    guessed = B.fit_trees(df, *args, n_trees=30, depth=3, rate=0.1)
    n, grow = len(passes), B.grow
    monkeypatch.setattr(B, "grow", lambda blocks, parts, edges, depth, logistic, last: grow(blocks, parts, edges, depth, logistic, Forgetful()))
    monkeypatch.setattr(B, "DIRECT", 0)
    plain = B.fit_trees(df, *args, n_trees=30, depth=3, rate=0.1)
    assert len(passes) - n == 90 and n < 85
    for a, b in zip(guessed.trees, plain.trees):
        assert [(x.feature, x.threshold, x.left, x.right, x.rows) for x in a] == [(x.feature, x.threshold, x.left, x.right, x.rows) for x in b]
        assert [x.value for x in a] == pytest.approx([x.value for x in b], rel=1e-9)


def test_what_reaches_the_driver_does_not_grow_with_partitions(data, monkeypatch):
    *_, df = data
    sent, models = [], []
    real = RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: sent.append(real(rdd)) or sent[-1])
    # 2: sums of sums, over several rounds
    for parts, fan in ((1, 256), (3, 256), (12, 256), (12, 2)):
        monkeypatch.setattr(B, "iteration_partitions", lambda spark, n: parts)
        monkeypatch.setattr(B, "FAN", fan)
        sent.clear()
        models.append(B.fit_trees(df.repartition(12), ["a", "b", "c"], "y", ["a", "b", "c"], 500, True, n_trees=4, depth=3, rate=0.3))
        assert sent and all(len(rows) == 3 for rows in sent)  # one row per feature
        assert max(len(pickle.dumps(rows)) for rows in sent) < 8000
    for m in models[1:]:
        for a, b in zip(models[0].trees, m.trees, strict=True):
            assert [(x.feature, x.threshold, x.rows) for x in a] == [(x.feature, x.threshold, x.rows) for x in b]
            assert [x.value for x in a] == pytest.approx([x.value for x in b], rel=1e-9)


def test_save_load_importance_and_constant_label(data, spark, scratch):
    *_, df = data
    model = B.fit_trees(df, ["a", "b", "c"], "z", ["a", "b", "c"], 500, False, n_trees=5, depth=3, rate=0.1)
    shares = model.importances()
    assert shares.sum() == pytest.approx(1) and shares.argmax() == 0
    model.save(spark, f"{scratch}/t")
    assert B.BoostedTrees.load(spark, f"{scratch}/t") == model
    flat = B.fit_trees(df.withColumn("y", F.lit(1.0)), ["a"], "y", ["a"], 500, True, n_trees=2, depth=3, rate=0.1)
    assert [len(t) for t in flat.trees] == [1, 1] and flat.importances().sum() == 0
    assert flat.score(df, ["a"], "s").agg(F.min("s")).collect()[0][0] > 0.999


def test_many_values_are_cut_at_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    values = rng.lognormal(size=3000)
    df = spark.createDataFrame([(float(v), float(i % 7)) for i, v in enumerate(values)], "a double, b double").repartition(5)
    a, b = B.bin_edges(df, ["a", "b"], 3000, max_bins=16)
    ordered = np.sort(values)
    assert a.tolist() == [ordered[3000 * k // 16] for k in range(1, 16)]
    assert b.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]


def test_substituted_scores_are_scores_of_substituted_rows(data):
    from churnframe.operators.models import substituted_scores

    *_, df = data
    cols = ["a", "b", "c"]
    model = B.fit_trees(df, cols, "y", cols, 500, True, n_trees=12, depth=3, rate=0.2)
    means = {"a": 5.3, "b": 2.0, "c": -0.1}
    found, base, names = substituted_scores(model, df, cols, means)
    found = found.select("id", F.col(base).alias("base"), *[F.col(n).alias(c) for c, n in zip(cols, names)])
    found = {r.id: r for r in found.collect()}
    plain = {r.id: r.s for r in model.score(df, cols, "s").collect()}
    assert all(found[i].base == pytest.approx(plain[i], abs=1e-12) for i in plain)
    for c in cols:
        held = model.score(df.withColumn(c, F.lit(means[c])), cols, "s").collect()
        assert all(found[r.id][c] == pytest.approx(r.s, abs=1e-12) for r in held)


def test_order_statistics_of_odd_numbers(spark):
    values = [0.0, -0.0, 1e-310, -1e-310, math.inf, -math.inf, 1.5, 1.5, -2.25, 1e300, -1e300, None, None]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "a double, b double").repartition(3)
    ordered = sorted(v for v in values if v is not None)
    got = Q.order_statistics(df, {"a": range(len(ordered)), "b": [0, 12]})
    assert [got["a"][i] for i in range(len(ordered))] == ordered
    assert got["b"] == {0: 0.0, 12: 12.0}
    with_nan = spark.createDataFrame([(float("nan"),), (3.0,)], "a double")
    found = Q.order_statistics(with_nan, {"a": [0, 1]})["a"]
    assert found[0] == 3.0 and math.isnan(found[1])
    with pytest.raises(ValueError):
        Q.order_statistics(df, {"a": [99]})


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=777), rng.integers(0, 4, 777)
    df = spark.createDataFrame([(float(a), int(b), None) for a, b in zip(x, y)], "x double, y int, z double").repartition(6)
    qs = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = Q.quantiles(df, ["x", "y", "z"], qs)
    assert got["x"] == pytest.approx(np.quantile(x, qs).tolist(), abs=1e-15)
    assert got["y"] == pytest.approx(np.quantile(y, qs).tolist())
    assert got["z"] == [None] * 5
    assert Q.medians(df, ["x"])["x"] == pytest.approx(np.median(x), abs=1e-15)
    assert Q.quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}
