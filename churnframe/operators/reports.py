"""Business reports and data-quality expectations as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.functions.columns import binarize

# The analyses offered per tenant, the kind of run record that each of them
# needs, and the reason code if the tenant has none.
NOT_TRAINED = "no_model"
NOT_VALIDATED = "revenue_not_backtested"
CAPABILITIES = {
    "metrics": ("classifier", NOT_TRAINED),
    "importance": ("classifier", NOT_TRAINED),
    "priority": ("backtest", NOT_VALIDATED),
    "backtest": ("backtest", NOT_VALIDATED),
    "survival": ("survival", NOT_TRAINED),
    "segments": ("segments", NOT_TRAINED),
    "anomalies": ("anomalies", NOT_TRAINED),
    "clv": ("clv", NOT_TRAINED),
}


def capability_matrix(tenants: DataFrame, runs: DataFrame) -> DataFrame:
    """(tenant_id, capability, available, reason) for every tenant.  ``runs``
    holds the run records (tenant_id, kind, ...) of all tenants; a tenant may
    have none."""
    kinds = runs.groupBy("tenant_id").agg(F.collect_set("kind").alias("kinds"))  # at most one entry per kind
    rows = []
    for capability, (kind, without) in CAPABILITIES.items():
        available = F.coalesce(F.array_contains("kinds", kind), F.lit(False))
        rows.append(
            F.struct(F.lit(capability).alias("capability"), available.alias("available"), F.when(~available, F.lit(without)).alias("reason"))
        )
    known = tenants.select("tenant_id").distinct().join(kinds, "tenant_id", "left")
    return known.select("tenant_id", F.inline(F.array(*rows)))


def outcome_by_group(df: DataFrame, group: str, target: str, positive) -> DataFrame:
    """Churn rate per group, with the label looked up only here."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(100.0) * F.avg(binarize(F.col(target), positive))).alias("churn_rate_pct"),
    )


def expectations(clean_df: DataFrame, id_column: str, target: str, labels: Sequence[str], duration: str, total: str, revenue: str) -> DataFrame:
    """One aggregation of violation counts (all should be 0)."""
    dur, tot = F.col(duration), F.col(total)
    agg = clean_df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col(target).isin(*labels) | F.col(target).isNull()).alias("bad_label"),
        F.count_if(dur < 0).alias("negative_duration"),
        (F.count(F.lit(1)) - F.countDistinct(F.col(id_column))).alias("duplicate_ids"),
        F.count_if(tot.isNull()).alias("missing_total"),
        F.count_if((dur == 0) & (tot != F.col(revenue))).alias("zero_duration_total_mismatch"),
    )
    return agg.select(*[F.col(c).cast("bigint").alias(c) for c in agg.columns])


def ranking_expectations(ranking: DataFrame, revenue: str) -> DataFrame:
    """Probabilities in [0, 1], revenue and risk >= 0, ranks exactly 1..n."""
    agg = ranking.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((F.col("churn_probability") < 0) | (F.col("churn_probability") > 1)).alias("bad_probability"),
        F.count_if(F.col(revenue) < 0).alias("negative_revenue"),
        F.count_if(F.col("expected_revenue_at_risk") < 0).alias("negative_risk"),
        F.min("rank").alias("min_rank"),
        F.max("rank").alias("max_rank"),
        F.countDistinct("rank").alias("distinct_ranks"),
    )
    return agg.select(*[F.col(c).cast("bigint").alias(c) for c in agg.columns])
