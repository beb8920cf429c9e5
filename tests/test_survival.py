"""Cox sums over ordered ranges against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnframe.operators import survival as SV


def plain(rows, beta):
    """Efron log-likelihood, gradient, Hessian and Breslow hazard by loops."""
    p = len(beta)
    ll, grad, hess, hazard, steps = 0.0, np.zeros(p), np.zeros((p, p)), 0.0, []
    x = {i: np.array(r[2:], float) for i, r in enumerate(rows)}
    w = {i: math.exp(float(x[i] @ beta)) for i in x}
    for t in sorted({r[0] for r in rows if r[1]}):
        risk = [i for i, r in enumerate(rows) if r[0] >= t]
        dead = [i for i, r in enumerate(rows) if r[0] == t and r[1]]

        def moments(ids):
            return (
                sum(w[i] for i in ids),
                sum((w[i] * x[i] for i in ids), np.zeros(p)),
                sum((w[i] * np.outer(x[i], x[i]) for i in ids), np.zeros((p, p))),
            )

        (r0, r1, r2), (d0, d1, d2) = moments(risk), moments(dead)
        for i in dead:
            ll += float(x[i] @ beta)
            grad += x[i]
        for k in range(len(dead)):
            s0, s1, s2 = (a - k / len(dead) * b for a, b in ((r0, d0), (r1, d1), (r2, d2)))
            ll -= math.log(s0)
            grad -= s1 / s0
            hess -= s2 / s0 - np.outer(s1, s1) / s0**2
        hazard += len(dead) / r0
        steps.append((float(t), hazard))
    return ll, grad, hess, steps


@pytest.mark.parametrize("kind", ["days", "months", "one duration", "hot duration", "no events"])
def test_step_and_baseline_match_plain_loops(spark, monkeypatch, kind):
    rng = random.Random(kind)
    duration = {
        "days": lambda: rng.uniform(0, 50),
        "months": lambda: rng.randrange(12),
        "one duration": lambda: 5,
        "hot duration": lambda: 4 if rng.random() < 0.6 else rng.randrange(9),
        "no events": lambda: rng.randrange(5),
    }[kind]
    rows = [(float(duration()), 0 if kind == "no events" else rng.randrange(2), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "t double, e int, a double, b double").repartition(3)
    monkeypatch.setattr(SV, "iteration_partitions", lambda spark, n: 7)
    monkeypatch.setattr(SV, "CHUNK", 11)
    beta = np.array([0.3, -0.5])
    ordered = SV.Ordered(df, "t", "e", [F.col("a"), F.col("b")])
    assert ordered.rows.rdd.getNumPartitions() == 7
    terms, _ = ordered.step(beta)
    ll, grad, hess, steps = plain(rows, beta)
    assert terms.ll == pytest.approx(ll, rel=1e-10)
    assert terms.gradient == pytest.approx(grad, rel=1e-9, abs=1e-9)
    assert terms.hessian == pytest.approx(hess, rel=1e-9, abs=1e-9)
    got = sorted((r.t, r.hazard) for r in ordered.baseline(beta).collect())
    assert [t for t, _ in got] == [t for t, _ in steps]
    assert [h for _, h in got] == pytest.approx([h for _, h in steps], rel=1e-10)


def test_fit_recovers_planted_coefficients_over_distinct_durations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2))
    t = rng.exponential(1 / np.exp(x @ np.array([0.7, -0.4])))
    seen = rng.exponential(2.0, 4000)
    rows = [(float(min(a, b)), int(a <= b), float(u), float(v)) for a, b, (u, v) in zip(t, seen, x)]
    df = spark.createDataFrame(rows, "t double, e int, a double, b double")
    model = SV.fit_cox(df, "t", "e", ["a", "b"])
    assert len({r[0] for r in rows}) == 4000 and model.iterations < 20
    assert model.coef == pytest.approx([0.7, -0.4], abs=0.08)
    assert not [c for c in vars(SV) if c == "MAX_DURATIONS"]


def test_medians_are_the_first_time_at_the_level(spark):
    steps = [(1.0, 0.1), (2.0, 0.1), (3.0, 0.5), (7.0, 0.7), (9.0, 2.0)]
    baseline = spark.createDataFrame(steps, SV.BASELINE)
    model = SV.CoxModel(["x"], np.array([1.0]), np.zeros(1), np.ones(1), baseline, 0.0, 0)
    log2 = math.log(2.0)
    xs = [-2.0, -1.0, 0.0, 0.5, 2.0, math.log(log2 / 0.5), math.log(log2 / 0.1), None]
    got = SV.median_survival(model, spark.createDataFrame(list(enumerate(xs)), "k int, x double"), "k")
    got = {r.k: r.median_survival for r in got.collect()}
    for k, x in enumerate(xs[:5]):
        level = log2 / math.exp(x)
        assert got[k] == next((t for t, h in steps if h >= level), None)
    assert len(got) == len(xs)
