"""Cox proportional hazards (Efron ties) by Newton steps over ordered ranges.

The rows are sorted once, by falling duration, into ranges that stay cached.
A Newton step is two passes over them.  The first gives each range's sums of
w, w x and w x x' (w = exp(x beta)); added up in order, they tell every range
the risk-set sums of all longer durations.  In the second, a range runs down
its rows with these sums and adds up the terms of its event times.  Rows of
one duration may lie in several ranges (ranges are cut by a row number as
well, so a duration that a third of all rows share is spread): each range
sends the sums of its first and last duration apart, and the driver puts these
together.  So a range sends and gets a few vectors of moments; no number of
durations, events or ties makes anything on the driver grow, only ranges do.

Covariates are standardised first (population mean / std), as the usual
fitters do; coefficients are reported on the original scale.  The baseline
hazard is a table with a row per event time; a median is looked up in it by one
range sort of the baseline with the profiles.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.operators.metrics import concordance_index
from churnframe.operators.ordering import next_value, prefix_sums
from churnframe.session import cut_lineage, iteration_partitions, ship_code

CHUNK = 2048  # rows whose moments are held at once
BASELINE = "t double, hazard double"


@dataclass
class CoxModel:
    features: list[str]
    beta: np.ndarray  # on the standardised scale
    mean: np.ndarray
    std: np.ndarray
    baseline: DataFrame  # event time, cumulative baseline hazard of centred covariates
    log_likelihood: float
    iterations: int

    @property
    def coef(self) -> np.ndarray:
        return self.beta / self.std

    def linear_predictor(self) -> F.Column:
        """(x - mean) . coef, i.e. the log partial hazard."""
        expr = F.lit(0.0)
        for f, m, s, b in zip(self.features, self.mean, self.std, self.beta):
            if s > 0:
                expr = expr + (F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(b))
        return expr

    def save(self, spark, path: str) -> None:
        meta = {
            "features": self.features,
            "beta": self.beta.tolist(),
            "mean": self.mean.tolist(),
            "std": self.std.tolist(),
            "log_likelihood": self.log_likelihood,
            "iterations": self.iterations,
        }
        self.baseline.write.mode("overwrite").parquet(f"{path}/baseline")
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> "CoxModel":
        m = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
        baseline = spark.read.schema(BASELINE).parquet(f"{path}/baseline")
        arrays = (np.array(m[k]) for k in ("beta", "mean", "std"))
        return cls(m["features"], *arrays, baseline, m["log_likelihood"], m["iterations"])

    def hazard_ratios(self, spark) -> DataFrame:
        rows = [(f, float(c), float(np.exp(c))) for f, c in zip(self.features, self.coef)]
        df = spark.createDataFrame(rows, "feature string, coef double, hazard_ratio double")
        return df.orderBy(F.abs(F.col("hazard_ratio") - 1.0).desc(), "feature")


# ---------------------------------------------------------------- moments and terms


@dataclass
class Groups:
    """Sums over the rows of each of some durations, in falling order:
    ``at_risk`` and ``events`` hold w * (1, x, x x'), of all rows and of event
    rows; ``n`` events, ``x`` and ``lp`` their covariates and predictors."""

    t: np.ndarray
    at_risk: np.ndarray
    events: np.ndarray
    n: np.ndarray
    x: np.ndarray
    lp: np.ndarray

    @classmethod
    def of(cls, t: np.ndarray, e: np.ndarray, x: np.ndarray, beta: np.ndarray) -> "Groups":
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        lp = x @ beta
        w = np.exp(lp)
        moments = np.concatenate([np.ones((len(t), 1)), x, (x[:, :, None] * x[:, None, :]).reshape(len(t), -1)], axis=1)
        moments *= w[:, None]

        def add(v):
            return np.add.reduceat(v, first, axis=0)

        return cls(t[first], add(moments), add(moments * e[:, None]), add(e), add(x * e[:, None]), add(lp * e))

    def part(self, which) -> "Groups":
        return Groups(*(v[which] for v in vars(self).values()))

    def merged(self, other: "Groups") -> "Groups":
        """Followed by ``other``; the last and its first duration may be equal."""
        if not len(self.t):
            return other
        if len(other.t) and self.t[-1] == other.t[0]:
            last = [a[-1:] if k == "t" else a[-1:] + b[:1] for (k, a), b in zip(vars(self).items(), vars(other).values())]
            parts = zip(vars(self).values(), last, vars(other).values())
            return Groups(*(np.concatenate([a[:-1], m, b[1:]]) for a, m, b in parts))
        return Groups(*(np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values())))

    def packed(self) -> bytes:
        return b"".join(np.column_stack([v.reshape(len(self.t), -1) for v in vars(self).values()]).astype("<f8"))

    @classmethod
    def unpacked(cls, raw: bytes, p: int) -> "Groups":
        q = 1 + p + p * p
        v = np.frombuffer(raw, "<f8").reshape(-1, 3 + 2 * q + p)
        cuts = np.cumsum([0, 1, q, q, 1, p, 1])
        t, at_risk, events, n, x, lp = (v[:, a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        return cls(t[:, 0], at_risk, events, n[:, 0], x, lp[:, 0])


_DIRECT = 1000  # terms summed one by one; larger arguments by Euler-Maclaurin


def _falling_sums(u: float, d: int) -> tuple[float, float, float]:
    """Sums of log x, 1 / x and 1 / x^2 over x = u, u - 1, .., u - d + 1, in
    time independent of d: terms up to _DIRECT above the smallest are added,
    the others (x > _DIRECT) integrated with end corrections, whose error is
    far below rounding."""
    low = u - d + 1
    direct = min(d, _DIRECT)
    x = low + np.arange(direct)
    logs, inverse, squares = np.log(x).sum(), (1 / x).sum(), (1 / x**2).sum()
    if d > direct:
        a, b = low + direct, u
        logs += b * np.log(b) - a * np.log(a) - (b - a) + (np.log(a) + np.log(b)) / 2 + (1 / b - 1 / a) / 12
        inverse += np.log(b / a) + (1 / a + 1 / b) / 2 - (1 / b**2 - 1 / a**2) / 12
        squares += 1 / a - 1 / b + (1 / a**2 + 1 / b**2) / 2 - (1 / b**3 - 1 / a**3) / 6
    return float(logs), float(inverse), float(squares)


@dataclass
class Terms:
    """Efron log-likelihood, gradient and Hessian, summed over event times."""

    ll: float
    gradient: np.ndarray
    hessian: np.ndarray

    @classmethod
    def none(cls, p: int) -> "Terms":
        return cls(0.0, np.zeros(p), np.zeros((p, p)))

    def add(self, g: Groups, before: np.ndarray) -> np.ndarray:
        """Adds the terms of ``g``, given the sums of all longer durations;
        returns the risk-set sum of each duration."""
        p = len(self.gradient)
        risk = before + np.cumsum(g.at_risk, axis=0)
        used = np.flatnonzero(g.n > 0.5)
        if len(used):
            r, events, d = risk[used], g.events[used], np.round(g.n[used])
            # Efron's terms are R - l D / d for l = 0 .. d - 1: with delta = D0 / d
            # and u = R0 / delta - l they are sums of log u, 1 / u and 1 / u^2
            delta = events[:, 0] / d
            u = r[:, 0] / delta
            logs, inverse, squares = np.log(u), 1 / u, 1 / u**2
            for i in np.flatnonzero(d > 1):
                logs[i], inverse[i], squares[i] = _falling_sums(u[i], int(d[i]))
            a1 = events[:, 1 : 1 + p] / d[:, None]
            c1 = r[:, 1 : 1 + p] - u[:, None] * a1
            r2, d2 = (m[:, 1 + p :].reshape(-1, p, p) for m in (r, events))
            self.ll += float((g.lp[used] - logs - d * np.log(delta)).sum())
            self.gradient = self.gradient + (g.x[used] - (d[:, None] * a1 + inverse[:, None] * c1) / delta[:, None]).sum(0)
            second = (d2 + inverse[:, None, None] * (r2 - (u / d)[:, None, None] * d2)) / delta[:, None, None]
            cross = a1[:, :, None] * c1[:, None, :]
            outer = d[:, None, None] * a1[:, :, None] * a1[:, None, :] + inverse[:, None, None] * (cross + cross.transpose(0, 2, 1))
            outer += squares[:, None, None] * c1[:, :, None] * c1[:, None, :]
            self.hessian = self.hessian - (second - outer / (delta**2)[:, None, None]).sum(0)
        return risk[:, 0]


def _chunks(batches: Iterator[pa.RecordBatch], p: int, beta: np.ndarray) -> Iterator[Groups]:
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            columns = [c.to_numpy(zero_copy_only=False) for c in whole.slice(at, CHUNK).columns]
            x = np.column_stack(columns[2:]) if p else np.zeros((len(columns[0]), 0))
            yield Groups.of(columns[0], columns[1], x, beta)


class Ordered:
    """Training rows in cached ranges of falling duration.  Rows without a
    duration or an event mark take no part."""

    def __init__(self, rows: DataFrame, duration: str, event: str, covariates: Sequence[F.Column]):
        ship_code(rows.sparkSession)
        self.p = len(covariates)
        data = rows.select(
            F.col(duration).cast("double").alias("t"),
            F.col(event).cast("double").alias("e"),
            *[c.cast("double").alias(f"x{i}") for i, c in enumerate(covariates)],
        ).where("t IS NOT NULL AND e IS NOT NULL")
        data = cut_lineage(data.withColumn("_row", F.monotonically_increasing_id()))
        order = [F.col("t").desc(), F.col("_row")]
        parts = iteration_partitions(rows.sparkSession, data.count())
        self.rows = data.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row").persist()

    def release(self) -> None:
        self.rows.unpersist()

    def _ranges(self, beta: np.ndarray) -> list[tuple[int, np.ndarray, Groups, bool]]:
        """(range, sums of all its rows, its first and last durations, whether
        these are one), in order."""
        p = self.p

        def run(batches):
            total, first, held = 0.0, None, None
            for g in _chunks(batches, p, beta):
                total = total + g.at_risk.sum(0)
                held = g if held is None else held.merged(g)
                if len(held.t) > 1:
                    first = held.part(slice(0, 1)) if first is None else first
                    held = held.part(slice(-1, None))
            if held is not None:
                one = first is None
                ends = held if one else first.merged(held)
                columns = [[TaskContext.get().partitionId()], [total.astype("<f8").tobytes()], [ends.packed()], [one]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "total", "ends", "one"])

        found = self.rows.mapInArrow(run, "part bigint, total binary, ends binary, one boolean").collect()
        return [
            (r.part, np.frombuffer(r.total, "<f8"), Groups.unpacked(bytes(r.ends), p), r.one)
            for r in sorted(found, key=lambda r: r.part)
        ]

    def step(self, beta: np.ndarray, baseline: bool = False) -> tuple[Terms, DataFrame | None]:
        """One Newton step's sums at ``beta`` and, if asked for, the baseline
        hazard's increments (t, hazard) at event times."""
        p, spark = self.p, self.rows.sparkSession
        terms, before = Terms.none(p), {}
        risk, shared = np.zeros(1 + p + p * p), None  # longer durations; the one that ranges share
        edges: list[tuple[float, float]] = []

        def close(group: Groups | None, longer: np.ndarray) -> None:
            if group is not None:
                r0 = terms.add(group, longer)
                edges.extend((float(t), float(n / r)) for t, n, r in zip(group.t, group.n, r0) if n > 0)

        longer = risk  # the sums before the shared duration
        for part, total, ends, one in self._ranges(beta):
            head = ends.part(slice(0, 1))
            if shared is not None and shared.t[0] == head.t[0]:
                shared = shared.merged(head)
            else:
                close(shared, longer)
                shared, longer = head, risk
            if not one:  # the first duration ends in this range, the last goes on
                close(shared, longer)
                before[part] = risk
                shared, longer = ends.part(slice(1, 2)), risk + total - ends.at_risk[1]
            risk = risk + total
        close(shared, longer)

        def run(batches):
            longer = before.get(TaskContext.get().partitionId())
            if longer is None:  # a single duration: the driver has it
                return
            own, held, first = Terms.none(p), None, True
            for g in _chunks(batches, p, beta):
                held = g if held is None else held.merged(g)
                done, held = held.part(slice(0, -1)), held.part(slice(-1, None))
                if first and len(done.t):  # the range's first duration
                    longer = longer + done.at_risk[0]
                    done, first = done.part(slice(1, None)), False
                if len(done.t):
                    r0 = own.add(done, longer)
                    longer = longer + done.at_risk.sum(0)
                    if baseline:
                        at = done.n > 0
                        yield pa.RecordBatch.from_arrays([pa.array(done.t[at]), pa.array((done.n / r0)[at])], names=["t", "hazard"])
            if not baseline:
                packed = np.concatenate([[own.ll], own.gradient, own.hessian.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([packed.astype("<f8").tobytes()], pa.binary())], names=["terms"])

        if baseline:
            inner = self.rows.mapInArrow(run, BASELINE)
            return terms, inner.unionByName(spark.createDataFrame(edges, BASELINE))
        for r in self.rows.mapInArrow(run, "terms binary").collect():
            v = np.frombuffer(r.terms, "<f8")
            terms.ll += float(v[0])
            terms.gradient = terms.gradient + v[1 : 1 + p]
            terms.hessian = terms.hessian + v[1 + p :].reshape(p, p)
        return terms, None

    def baseline(self, beta: np.ndarray) -> DataFrame:
        """Breslow's cumulative hazard at event times, as a written table:
        events over the risk-set sum, added up in order of time."""
        steps = self.step(beta, baseline=True)[1]
        running = prefix_sums(steps, [("t", True)], ["hazard"])
        return cut_lineage(running.select("t", F.col("hazard_cum").alias("hazard")))


# ---------------------------------------------------------------- fit


def partial_likelihood(
    rows: DataFrame, duration: str, event: str, beta: dict[str, float]
) -> tuple[float, dict[str, float]]:
    """Efron log-likelihood and its gradient at given coefficients (on the
    features' own scale): one Newton step's sums."""
    ordered = Ordered(rows, duration, event, [F.col(f) for f in beta])
    try:
        terms, _ = ordered.step(np.array(list(beta.values())))
    finally:
        ordered.release()
    return terms.ll, dict(zip(beta, map(float, terms.gradient)))


def fit_cox(
    train: DataFrame,
    duration: str,
    event: str,
    features: Sequence[str],
    max_iter: int = 50,
    tol: float = 1e-12,
) -> CoxModel:
    features = list(features)
    stats = train.agg(
        *[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)],
    ).collect()[0]
    mean = np.array([float(stats[f"m{i}"]) for i in range(len(features))])
    std = np.array([float(stats[f"s{i}"] or 0.0) for i in range(len(features))])
    live = [i for i in range(len(features)) if std[i] > 0]
    scaled = [(F.col(features[i]).cast("double") - F.lit(float(mean[i]))) / F.lit(float(std[i])) for i in live]
    ordered = Ordered(train, duration, event, scaled)
    beta = previous = np.zeros(len(live))
    old = None
    try:
        for it in range(1, max_iter + 1):
            terms, _ = ordered.step(beta)
            if old is not None and terms.ll < old - 1e-9 * abs(old):
                # overshoot (beyond rounding noise): halve the step and retry
                beta = (beta + previous) / 2.0
                continue
            step = np.linalg.solve(-terms.hessian, terms.gradient) if live else np.zeros(0)
            previous, beta = beta, beta + step
            small = np.max(np.abs(step), initial=0.0) < 1e-7
            flat = old is not None and abs(terms.ll - old) <= tol * max(1.0, abs(old))
            old = terms.ll
            if small or flat:
                break
        ll = ordered.step(beta)[0].ll
        baseline = ordered.baseline(beta)
    finally:
        ordered.release()
    full = np.zeros(len(features))
    full[live] = beta
    return CoxModel(features, full, mean, np.where(std > 0, std, 1.0), baseline, ll, it)


def fixed_model(rows: DataFrame, duration: str, event: str, beta: dict[str, float]) -> CoxModel:
    """The model of given coefficients (covariates not centred): only the
    baseline is computed; nothing is fitted."""
    names, values = list(beta), np.array(list(beta.values()))
    ordered = Ordered(rows, duration, event, [F.col(f) for f in names])
    try:
        ll, baseline = ordered.step(values)[0].ll, ordered.baseline(values)
    finally:
        ordered.release()
    return CoxModel(names, values, np.zeros(len(names)), np.ones(len(names)), baseline, ll, 0)


def concordance(model: CoxModel, test: DataFrame, duration: str, event: str) -> DataFrame:
    """Test concordance of the partial hazard."""
    scored = test.select(F.col(duration), F.col(event), model.linear_predictor().alias("_risk"))
    return concordance_index(scored, duration, event, "_risk")


def median_survival(model: CoxModel, profiles: DataFrame, key: str) -> DataFrame:
    """For each profile row: first time with S(t) = exp(-H0(t) e^{lp}) <= 0.5,
    i.e. H0(t) >= ln 2 / e^{lp}; NULL when the curve never gets there.  The
    baseline never falls, so that is the next event time when profiles and
    baseline are ordered by hazard."""
    level = F.lit(float(np.log(2.0))) * F.exp(-model.linear_predictor())
    asked = profiles.select(level.alias("h"), F.col(key).alias("_key"), F.lit(True).alias("asks"))
    steps = model.baseline.select(F.col("hazard").alias("h"), F.col("t"), F.lit(False).alias("asks"))
    rows = asked.unionByName(steps, allowMissingColumns=True)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    # of equal hazards a profile comes before the times, an earlier time before later ones
    found = next_value(rows, [("h", True), ("asks", False), ("t", True), ("_row", True)], "t", "median_survival")
    return found.where("asks").select(F.col("_key").alias(key), "median_survival")
