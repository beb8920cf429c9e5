"""Evaluation metrics as distributed aggregations.

Ranking metrics first collapse rows to distinct scores (a partial
aggregation, so heavy ties cost nothing), then take running sums in score
order with ``ordering.prefix_sums``; no step collects rows to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnframe.operators.ordering import global_rank, prefix_sums
from churnframe.session import cut_lineage


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("bigint")
    return df.groupBy(F.col(score).alias("s")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")
    )


def _times(a: Column, b: Column) -> Column:
    """Product of two counts without overflow."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def _auc(num2: Column) -> Column:
    p, n = F.col("P"), F.col("N")
    return F.when((p > 0) & (n > 0), num2.cast("double") / (F.lit(2.0) * p * n))


def roc_auc(df: DataFrame, label: str, score: str, **kw) -> DataFrame:
    """Rank form with average ranks for ties:
    AUC = sum over scores of pos_s * (neg_below_s + neg_s / 2) / (P * N).
    Numerator and denominator are exact integers, so the result is too."""
    counts = _score_counts(df, label, score)
    cum = prefix_sums(counts, [("s", True)], ["neg"], **kw)
    twice = _times(F.col("pos"), F.lit(2) * (F.col("neg_cum") - F.col("neg")) + F.col("neg"))
    agg = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(twice).alias("num2"))
    return agg.select(_auc(F.col("num2")).alias("roc_auc"))


def roc_auc_by(df: DataFrame, group: str, label: str, score: str, **kw) -> DataFrame:
    """ROC-AUC per group (tenant): rows, positive rate and AUC for each
    group value, NULL being one.  Running sums are taken over (group, score),
    so a group holding most rows is still cut over many ranges; the negatives
    of the groups before one are the least running sum in it."""
    y = F.col(label).cast("bigint")
    counts = df.groupBy(F.col(group).alias("g"), F.col(score).alias("s")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")
    )
    cum = prefix_sums(counts, [("g", True), ("s", True)], ["neg"], **kw)
    below = F.col("neg_cum") - F.col("neg")
    twice = _times(F.col("pos"), F.lit(2) * below + F.col("neg"))
    agg = cum.groupBy("g").agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(twice).alias("num2"), F.min(below).alias("before")
    )
    return agg.select(
        F.col("g").alias(group),
        (F.col("P") + F.col("N")).cast("bigint").alias("n"),
        (F.col("P") / (F.col("P") + F.col("N"))).alias("positive_rate"),
        _auc(F.col("num2") - _times(F.lit(2) * F.col("P"), F.col("before"))).alias("roc_auc"),
    )


def average_precision(df: DataFrame, label: str, score: str, **kw) -> DataFrame:
    """Sum over distinct thresholds (descending) of (R_k - R_{k-1}) * P_k,
    no interpolation."""
    counts = _score_counts(df, label, score)
    cum = prefix_sums(counts, [("s", False)], ["pos", "neg"], **kw)
    prec = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    agg = cum.agg(F.sum("pos").alias("P"), F.sum(F.col("pos") * prec).alias("w"))
    return agg.select(F.when(F.col("P") > 0, F.round(F.col("w") / F.col("P"), 12)).alias("average_precision"))


def classification_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Per class precision / recall / F1 / support, accuracy, macro and
    weighted averages; 0 on zero division.  One 2x2 count, then arithmetic.
    Rows whose label or prediction is neither 0 nor 1 are in no class; if
    there are any, a row ``unknown`` has their number as support."""
    t, p = F.col(y_true), F.col(y_pred)
    c = df.agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count(F.lit(1)).alias("all"),
    )

    def div(a, b):
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    def f1(pr, rc):
        return F.when(pr + rc > 0, F.lit(2.0) * pr * rc / (pr + rc)).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = div(tp, tp + fp), div(tp, tp + fn)
    p0, r0 = div(tn, tn + fn), div(tn, tn + fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    f1_1, f1_0 = f1(p1, r1), f1(p0, r0)

    def row(name, pr, rc, f, sup):
        return F.struct(
            F.lit(name).alias("label"),
            F.round(pr, 12).alias("precision"),
            F.round(rc, 12).alias("recall"),
            F.round(f, 12).alias("f1_score"),
            sup.cast("bigint").alias("support"),
        )

    rows = [
        row("0", p0, r0, f1_0, s0),
        row("1", p1, r1, f1_1, s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", div(p0 * s0 + p1 * s1, n), div(r0 * s0 + r1 * s1, n), div(f1_0 * s0 + f1_1 * s1, n), n),
        row("accuracy", div(tp + tn, n), div(tp + tn, n), div(tp + tn, n), n),
        row("unknown", F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("all") - n),
    ]
    return c.select(F.inline(F.array(*rows))).filter("label <> 'unknown' OR support > 0")


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """RMSE, MAE, R^2 in one pass.  A constant target has R^2 1 if predicted
    exactly, else 0."""
    e = F.col(y) - F.col(pred)
    a = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("sse"),
        F.sum(F.abs(e)).alias("sae"),
        F.var_pop(F.col(y)).alias("var"),
    )
    sst = F.col("n") * F.col("var")
    r2 = F.when(sst > 0, F.lit(1.0) - F.try_divide(F.col("sse"), sst)).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return a.select(
        F.round(F.sqrt(F.try_divide(F.col("sse"), F.col("n"))), 6).alias("rmse"),
        F.round(F.try_divide(F.col("sae"), F.col("n")), 6).alias("mae"),
        F.when(F.col("n") > 0, F.round(r2, 6)).alias("r2"),
    )


def average_ranks(counts: DataFrame, value: str, out: str, **kw) -> DataFrame:
    """``counts`` (any columns and ``_n`` rows each) with the average rank of
    ``value``: ties share the mean of their positions."""
    per = counts.groupBy(F.col(value).alias("_v")).agg(F.sum("_n").alias("_c"))
    cum = prefix_sums(per, [("_v", True)], ["_c"], **kw).select(
        "_v", ((F.col("_c_cum") - F.col("_c")) + (F.col("_c") + 1) / F.lit(2.0)).alias(out)
    )
    return counts.join(cum, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def spearman(df: DataFrame, a: str, b: str, ranks: bool = False, **kw) -> DataFrame:
    """Spearman correlation: Pearson correlation of average ranks.  Rows are
    reduced to counts per pair of values first, so a value that many rows hold
    is one row per partner value.  With ``ranks=True`` the columns already are
    tie-free ranks 1..n, so the ranking passes are skipped."""
    if ranks:
        return df.agg(F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 9).alias("spearman"))
    pairs = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    pairs = average_ranks(average_ranks(cut_lineage(pairs), "_a", "_ra", **kw), "_b", "_rb", **kw)
    # both ranks have the mean (n + 1) / 2
    total = pairs.agg(F.sum("_n")).collect()[0][0] or 0
    x, y = (F.col(c) - F.lit((total + 1) / 2.0) for c in ("_ra", "_rb"))
    sums = pairs.agg(F.sum(F.col("_n") * x * y).alias("xy"), F.sum(F.col("_n") * x * x).alias("xx"), F.sum(F.col("_n") * y * y).alias("yy"))
    spread = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    return sums.select(F.round(F.when(spread > 0, F.col("xy") / spread), 9).alias("spearman"))


def leakage_screen(df: DataFrame, label: str, features: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Correlation of each numeric feature with the label; flag |r| >= 0.9.
    One aggregation for all features, then the wide row is melted."""
    a = df.agg(*[F.corr(F.col(f).cast("double"), F.col(label).cast("double")).alias(f) for f in features])
    rows = [F.struct(F.lit(f).alias("feature"), F.round(F.col(f), 9).alias("correlation")) for f in features]
    return a.select(F.inline(F.array(*rows))).withColumn(
        "leaky", F.coalesce(F.abs(F.col("correlation")) >= F.lit(threshold), F.lit(False))
    )


# ---------------------------------------------------------------- concordance


def concordance_index(df: DataFrame, duration: str, event: str, risk: str, parts: int | None = None) -> DataFrame:
    """Harrell's concordance of a risk score against (duration, event).

    A pair (i, j) is comparable when i has the event and j lasted longer, or
    equally long but censored; it is concordant when risk_i > risk_j, and a
    tie in risk counts one half.  Durations are any numbers.

    Exact without a pair join, driver table or Python.  Rows collapse to
    (risk, duration, event) counts and risks get dense numbers R.  R_j < R_i
    holds for exactly one bit k: both agree above it, i has a 1 there and j a
    0.  So for each bit, within a group of equal upper bits, the rows with a 0
    are counted in falling order of duration up to each event row with a 1.
    All bits (and, as two more levels, equal risks and all pairs) are answered
    by ONE distributed prefix sum over log2(risks) + 2 copies of the counts.
    """
    e = F.col(event).cast("int")
    counts = df.groupBy(
        F.col(risk).cast("double").alias("r"), F.col(duration).cast("double").alias("t"), e.alias("e")
    ).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    numbers = cut_lineage(global_rank(counts.select(F.col("r").alias("v")).distinct(), ["v"], "no", parts))
    bits = max(1, int(numbers.count()).bit_length())
    rows = counts.join(numbers, F.col("r").eqNullSafe(F.col("v"))).select("no", "t", "e", "n")

    def entry(level: int, prefix: Column, counted: Column, asks: Column) -> Column:
        """A row's part in a level: how often it is counted, how often it asks.
        Of equal durations, the censored are counted before events ask."""
        order = F.when(asks > 0, F.lit(1)).when(F.col("e") == 0, F.lit(0)).otherwise(F.lit(2))
        return F.struct(
            F.lit(level).alias("level"),
            prefix.cast("bigint").alias("prefix"),
            F.col("t"),
            order.alias("o"),
            counted.cast("bigint").alias("counted"),
            asks.cast("bigint").alias("asks"),
        )

    zero, n = F.lit(0), F.col("n")
    entries = []
    for k in range(bits):
        low = F.shiftright("no", k).bitwiseAND(F.lit(1).cast("bigint")) == 0
        upper = F.shiftright("no", k + 1)
        entries.append(entry(k, upper, F.when(low, n).otherwise(zero), F.when(~low & (F.col("e") == 1), n).otherwise(zero)))
    asks = F.when(F.col("e") == 1, n).otherwise(zero)
    for level, prefix in ((bits, F.col("no")), (bits + 1, F.lit(0))):
        entries += [entry(level, prefix, n, zero), entry(level, prefix, zero, asks)]
    spread = rows.select(F.explode(F.array(*entries)).alias("x")).select("x.*").filter("counted > 0 OR asks > 0")
    spread = spread.groupBy("level", "prefix", "t", "o").agg(F.sum("counted").alias("counted"), F.sum("asks").alias("asks"))
    cum = prefix_sums(spread, [("level", True), ("prefix", True), ("t", False), ("o", True)], ["counted"], parts=parts)
    groups = cum.groupBy("level", "prefix").agg(
        F.sum(_times(F.col("asks"), F.col("counted_cum"))).alias("pairs"),
        F.sum("asks").alias("asks"),
        F.min(F.col("counted_cum") - F.col("counted")).alias("before"),
    )
    pairs = F.col("pairs") - _times(F.col("asks"), F.col("before"))
    weight = F.when(F.col("level") < bits, F.lit(2)).when(F.col("level") == bits, F.lit(1)).otherwise(F.lit(0))
    total = groups.agg(
        F.sum(pairs * weight).alias("num2"), F.sum(F.when(F.col("level") == bits + 1, pairs)).alias("den")
    )
    return total.select(
        F.when(F.col("den") > 0, F.col("num2").cast("double") / (F.lit(2.0) * F.col("den").cast("double"))).alias("c_index")
    )
