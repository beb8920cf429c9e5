"""Backtest / proof of lift: churned revenue caught by each targeting
strategy within the top fraction of the test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.functions.columns import binarize, hash_order_key
from churnframe.operators.ordering import Key, after, kth_keys
from churnframe.operators.prioritize import AT_RISK, PROBABILITY, strategy_keys
from churnframe.session import cut_lineage
from churnframe.spec import TenantSpec


def backtest_size(top_pct: float, n: int) -> int:
    """Backtest list size: round(pct * n), half-even."""
    return int(round(top_pct * n))


def campaign_size(top_pct: float, n: int) -> int:
    """Campaign list size: at least 1, truncating."""
    return max(1, int(n * top_pct))


def member(keys: Sequence[Key], bound: tuple | bool):
    if bound is True:
        return F.lit(True)
    if bound is False:
        return F.lit(False)
    return ~after(list(keys), bound)


def backtest(
    test_scored: DataFrame,
    spec: TenantSpec,
    top_pcts: Sequence[float] = (0.2,),
    seed: int = 42,
    **kw,
) -> DataFrame:
    """Long table: top_pct, strategy, top_n, total_churned_revenue,
    caught_revenue, caught_pct.

    ``test_scored`` holds the test rows with ``churn_probability``.  All
    strategies and thresholds are answered by ONE aggregation pass over the
    scored rows: each top-n list is the key of its n-th row, found by one
    range sort of the key columns; nothing is scored twice.  Strategy
    ``random`` takes n ids by md5('<seed>:<id>') order.
    """
    idc, rev = spec.id_column, spec.revenue_column
    base = test_scored.select(
        F.col(idc),
        F.col(PROBABILITY),
        F.col(rev),
        (F.col(PROBABILITY) * F.col(rev)).alias(AT_RISK),
        binarize(F.col(spec.target_column), spec.positive_value).alias("_y"),
        hash_order_key(seed, F.col(idc)).alias("_h"),
    )
    base = cut_lineage(base)
    n = base.count()
    sizes = {p: backtest_size(p, n) for p in top_pcts}
    strategies: dict[str, list[Key]] = {
        "revenue_weighted": strategy_keys("revenue_weighted", idc),
        "probability_only": strategy_keys("probability_only", idc),
        "random": [("_h", True), (idc, True)],
    }
    flags = {}
    for name, keys in strategies.items():
        bounds = kth_keys(base, keys, sorted(set(sizes.values())), **kw)
        for p, k in sizes.items():
            flags[(p, name)] = member(keys, bounds[k])
    churned = F.col("_y") == 1
    aggs = [F.sum(F.when(churned, F.col(rev)).otherwise(F.lit(0.0))).alias("total")]
    for i, ((p, name), flag) in enumerate(flags.items()):
        aggs.append(F.sum(F.when(churned & flag, F.col(rev)).otherwise(F.lit(0.0))).alias(f"c{i}"))
    row = base.agg(*aggs)
    total = F.col("total")
    entries = []
    for i, (p, name) in enumerate(flags):
        caught = F.col(f"c{i}")
        entries.append(
            F.struct(
                F.lit(float(p)).alias("top_pct"),
                F.lit(name).alias("strategy"),
                F.lit(sizes[p]).cast("bigint").alias("top_n"),
                F.round(total, 4).alias("total_churned_revenue"),
                F.round(caught, 4).alias("caught_revenue"),
                F.round(F.when(total > 0, F.lit(100.0) * caught / total).otherwise(F.lit(0.0)), 6).alias("caught_pct"),
            )
        )
    return row.select(F.inline(F.array(*entries)))
