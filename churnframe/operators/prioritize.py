"""Priority ranking by revenue at risk (or by probability alone)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.operators.ordering import global_rank, top
from churnframe.spec import TenantSpec

# Strategy names and output columns.
STRATEGIES = ("revenue_weighted", "probability_only")
PROBABILITY = "churn_probability"
AT_RISK = "expected_revenue_at_risk"


def strategy_keys(strategy: str, id_column: str) -> list[tuple[str, bool]]:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    score = AT_RISK if strategy == "revenue_weighted" else PROBABILITY
    # ties broken by id, so the ranking is reproducible
    return [(score, False), (id_column, True)]


def with_risk(scored: DataFrame, spec: TenantSpec) -> DataFrame:
    return scored.select(
        spec.id_column,
        PROBABILITY,
        spec.revenue_column,
        (F.col(PROBABILITY) * F.col(spec.revenue_column)).alias(AT_RISK),
    )


def priority_ranking(scored: DataFrame, spec: TenantSpec, strategy: str = "revenue_weighted", **kw) -> DataFrame:
    """Columns id, churn_probability, revenue, expected_revenue_at_risk, rank
    (1..n, distributed; see ``ordering.global_rank``)."""
    keys = strategy_keys(strategy, spec.id_column)
    return global_rank(with_risk(scored, spec), keys, "rank", **kw)


def head(scored: DataFrame, spec: TenantSpec, limit: int, strategy: str = "revenue_weighted") -> DataFrame:
    """First ``limit`` rows of the ranking, without ranking the others."""
    if limit < 0:
        raise ValueError("limit must be >= 0")
    return top(with_risk(scored, spec), strategy_keys(strategy, spec.id_column), limit)
