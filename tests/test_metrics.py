"""Metrics against brute force on small frames (ties, censoring, zeros)."""

import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from churnframe.operators import metrics as M


def _auc_brute(y, s):
    pos = [a for a, t in zip(s, y) if t == 1]
    neg = [a for a, t in zip(s, y) if t == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(y, s):
    thresholds = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in thresholds:
        tp = sum(1 for a, b in zip(s, y) if a >= t and b == 1)
        fp = sum(1 for a, b in zip(s, y) if a >= t and b == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def _frame(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 1)) for i in range(n)]  # heavy ties
    return rows, spark.createDataFrame(rows, "id long, y long, s double")


def test_roc_auc_and_ap_with_ties(spark):
    rows, df = _frame(spark)
    y = [r[1] for r in rows]
    s = [r[2] for r in rows]
    auc = M.roc_auc(df, "y", "s", parts=5).collect()[0][0]
    assert auc == pytest.approx(_auc_brute(y, s), abs=1e-12)
    ap = M.average_precision(df, "y", "s", parts=5).collect()[0][0]
    assert ap == pytest.approx(_ap_brute(y, s), abs=1e-9)


def _cindex_brute(t, e, r):
    num = den = 0.0
    for i, j in itertools.permutations(range(len(t)), 2):
        if e[i] == 1 and (t[j] > t[i] or (t[j] == t[i] and e[j] == 0)):
            den += 1
            num += 1.0 if r[i] > r[j] else 0.5 if r[i] == r[j] else 0.0
    return num / den if den else None


@pytest.mark.parametrize("seed", [1, 2])
def test_concordance_matches_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 12), rnd.randint(0, 1), float(rnd.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame(rows, "t long, e long, r double")
    got = M.concordance_index(df, "t", "e", "r", parts=5).collect()[0][0]
    want = _cindex_brute(*zip(*rows))
    assert got == pytest.approx(want, abs=1e-12)


def test_concordance_of_fractional_durations(spark):
    rows = [(0.2, 1, 3.0), (0.5, 1, 2.0), (0.8, 1, 1.0)]
    df = spark.createDataFrame(rows, "t double, e long, r double")
    assert M.concordance_index(df, "t", "e", "r").collect()[0][0] == 1.0
    rnd = random.Random(8)
    rows = [(round(rnd.random() * 3, 1), rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(250)]
    df = spark.createDataFrame(rows, "t double, e long, r double")
    assert M.concordance_index(df, "t", "e", "r", parts=6).collect()[0][0] == pytest.approx(_cindex_brute(*zip(*rows)), abs=1e-12)


def test_concordance_of_one_risk(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.5), (2, 1, 0.5)], "t long, e long, r double")
    assert M.concordance_index(df, "t", "e", "r").collect()[0][0] == 0.5


def test_constant_target_and_large_mean(spark):
    df = spark.createDataFrame([(5.0, 4.0), (5.0, 5.0)], "y double, p double")
    assert M.regression_metrics(df, "y", "p").collect()[0]["r2"] == 0.0
    assert M.regression_metrics(df, "y", "y").collect()[0]["r2"] == 1.0
    far = spark.createDataFrame([(1e9 + i, 1e9 + i + 0.5) for i in range(4)], "y double, p double")
    assert M.regression_metrics(far, "y", "p").collect()[0]["r2"] == pytest.approx(1 - 1.0 / 5.0, abs=1e-6)


def test_unknown_labels_are_counted(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (None, 0)], "t long, p long")
    rep = {r["label"]: r["support"] for r in M.classification_report(df, "t", "p").collect()}
    assert rep["unknown"] == 2 and rep["weighted avg"] == 2


def test_roc_auc_beyond_long_products(spark):
    n = 4_000_000_000
    counts = spark.createDataFrame([(0.1, 0, n), (0.9, n, 0)], "s double, pos long, neg long")
    cum = counts.select(M._times(F.col("pos"), F.lit(2) * F.lit(n)).alias("x")).agg(F.sum("x")).collect()[0][0]
    assert int(cum) == 2 * n * n


def test_concordance_all_censored(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.1)], "t long, e long, r double")
    assert M.concordance_index(df, "t", "e", "r").collect()[0][0] is None


def test_roc_auc_by_null_group(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.1), ("a", 0, 0.9)], "g string, y long, s double")
    got = {r["g"]: r["roc_auc"] for r in M.roc_auc_by(df, "g", "y", "s").collect()}
    assert got == {None: 1.0, "a": 0.0}


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "t long, p long")
    rep = {r["label"]: r for r in M.classification_report(df, "t", "p").collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0 and rep["1"]["f1_score"] == 0.0
    assert rep["0"]["recall"] == 1.0
    assert rep["accuracy"]["f1_score"] == pytest.approx(2 / 3)
    assert rep["weighted avg"]["support"] == 3


def test_spearman_with_ties(spark):
    rnd = random.Random(5)
    a = [rnd.randint(0, 5) for _ in range(200)]
    b = [x + rnd.randint(0, 3) for x in a]
    df = spark.createDataFrame(list(zip(range(200), a, b)), "id long, a long, b long")
    got = M.spearman(df, "a", "b", parts=5).collect()[0][0]

    def avg_rank(v):
        order = sorted(range(len(v)), key=lambda i: v[i])
        ranks = [0.0] * len(v)
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and v[order[j + 1]] == v[order[i]]:
                j += 1
            for k in range(i, j + 1):
                ranks[order[k]] = (i + j) / 2 + 1
            i = j + 1
        return ranks

    want = np.corrcoef(avg_rank(a), avg_rank(b))[0, 1]
    assert got == pytest.approx(want, abs=1e-8)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").collect()[0]
    assert r["mae"] == pytest.approx(0.5)
    assert r["rmse"] == pytest.approx(np.sqrt((0.25 + 0 + 1) / 3), abs=1e-6)
    assert r["r2"] == pytest.approx(1 - 1.25 / 2.0, abs=1e-6)


def test_roc_auc_by_group_multi_bucket(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 1), round(rnd.random(), 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, y long, s double")
    got = {r["g"]: r["roc_auc"] for r in M.roc_auc_by(df, "g", "y", "s", parts=5).collect()}
    for g in "abc":
        sub = [r for r in rows if r[1] == g]
        assert got[g] == pytest.approx(_auc_brute([r[2] for r in sub], [r[3] for r in sub]), abs=1e-12)


@pytest.mark.parametrize("u, d", [(5.0, 5), (7.25, 3), (5000.5, 5000), (123456.75, 100000), (1e9, 200000), (1e6, 1)])
def test_falling_sums_match_direct_sums(u, d):
    from churnframe.operators.survival import _falling_sums

    x = u - np.arange(d)
    want = (np.log(x).sum(), (1 / x).sum(), (1 / x**2).sum())
    assert _falling_sums(u, d) == pytest.approx(want, rel=1e-11)
