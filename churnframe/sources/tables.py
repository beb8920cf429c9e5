"""Readers for the given parquet tables and the derived customer snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnframe.functions.columns import closed_form_score, hash_unit

SNAPSHOT_CUTOFF = "2001-01-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_snapshot(
    spark: SparkSession,
    sf_dir: str,
    label: str = "planted",
    cutoff: str = SNAPSHOT_CUTOFF,
    with_future_spend: bool = False,
) -> DataFrame:
    """One row per customer with an order before ``cutoff``.

    Features come from orders before the cutoff, the natural label from
    orders after it (``churn = 'Yes'`` if none).  ``label='planted'`` replaces
    the label by a hash draw against the closed-form score, which gives the
    lift tests a signal to find.  ``with_future_spend`` adds the lifetime-value
    target: with natural labels the revenue after the cutoff, from the same
    aggregation; planted, average order x (1 + orders / 10), times a hash draw
    between a half and one and a half - the given tables' future orders do not
    depend on the past.

    Plan: one scan of ``orders`` (date, customer, price only), one partial
    aggregation by customer (map-side combine, so a customer with a huge
    share of orders costs one row per map task), one shuffle join with
    ``customer``; nation and region are broadcast by Spark, which knows their
    size in bytes.
    """
    cut = F.lit(cutoff).cast("timestamp_ntz")
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    before = F.col("o_orderdate") < cut
    hist = (
        orders.groupBy("o_custkey")
        .agg(
            F.count_if(before).alias("n_orders"),
            F.min(F.when(before, F.col("o_orderdate"))).alias("first_ts"),
            F.max(F.when(before, F.col("o_orderdate"))).alias("last_ts"),
            F.sum(F.when(before, F.col("o_totalprice").cast("decimal(18,2)"))).alias("spend"),
            F.max((~before).cast("int")).alias("has_future"),
            F.sum(F.when(~before, F.col("o_totalprice").cast("decimal(18,2)"))).alias("future"),
        )
        .filter(F.col("n_orders") > 0)
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    cut_date = F.lit(cutoff[:10]).cast("date")
    tenure_days = F.datediff(cut_date, F.col("first_ts").cast("date"))
    snap = (
        customer.join(hist, hist.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("r_name").alias("tenant_id"),
            F.col("c_mktsegment").alias("contract"),
            F.col("n_name").alias("nation"),
            F.col("n_orders").cast("bigint").alias("n_orders"),
            tenure_days.cast("bigint").alias("tenure_days"),
            F.floor(tenure_days / F.lit(30)).cast("bigint").alias("tenure_months"),
            F.datediff(cut_date, F.col("last_ts").cast("date")).cast("bigint").alias("recency_days"),
            (F.col("spend").cast("double") / F.col("n_orders")).alias("avg_order"),
            # Billed total as the source systems deliver it: text, blank for
            # customers in their first month (the zero-tenure quirk).
            F.when(F.floor(tenure_days / F.lit(30)) == 0, F.lit(" "))
            .otherwise(F.col("spend").cast("string"))
            .alias("total_spend"),
            F.when(F.col("has_future") == 1, F.lit("No")).otherwise(F.lit("Yes")).alias("natural_churn"),
            # revenue after the cutoff: the lifetime-value target
            F.coalesce(F.col("future").cast("double"), F.lit(0.0)).alias("future_spend"),
        )
    )
    if not with_future_spend:
        snap = snap.drop("future_spend")
    if label == "natural":
        return snap.withColumnRenamed("natural_churn", "churn")
    if label != "planted":
        raise ValueError(f"label must be 'planted' or 'natural', got {label!r}")
    u = hash_unit("churn:", F.col("customer_id"))
    planted = F.when(u < closed_form_score(F.col("recency_days")), F.lit("Yes")).otherwise(F.lit("No"))
    if with_future_spend:
        draw = hash_unit("value:", F.col("customer_id")) + F.lit(0.5)
        snap = snap.withColumn("future_spend", F.col("avg_order") * (1 + F.col("n_orders") / 10) * draw)
    return snap.withColumn("churn", planted).drop("natural_churn")

