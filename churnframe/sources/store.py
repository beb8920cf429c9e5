"""Tenant-partitioned tables: customers, predictions, split manifests, runs.

Writes use dynamic partition overwrite, so re-running a load replaces the
tenant's (and version's) partition instead of appending duplicates.
Every read goes through ``tenant_scope``: a filter on the partition column,
which the parquet scan prunes to that tenant's folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.session import path_exists
from churnframe.spec import TenantSpec

CUSTOMERS_SCHEMA = "tenant_id string, customer_id string, raw_features string, created_at timestamp"
PREDICTIONS_SCHEMA = (
    "tenant_id string, customer_id string, model_version string, churn_probability double, predicted_at timestamp"
)


def pack_customers(
    raw: DataFrame,
    spec: TenantSpec,
    created_at: dt.datetime,
    tenant_id: str | None = None,
    tenant_column: str | None = None,
) -> DataFrame:
    """Every raw row as (tenant, id text, JSON of the whole row, load time).
    Null fields stay in the JSON as null.  The tenant is the name
    ``tenant_id`` or the value of ``tenant_column``: exactly one is given."""
    if (tenant_id is None) == (tenant_column is None):
        raise ValueError("give tenant_id or tenant_column")
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns]), {"ignoreNullFields": "false"})
    tenant = F.lit(tenant_id) if tenant_column is None else F.col(f"`{tenant_column}`").cast("string")
    return raw.select(
        tenant.alias("tenant_id"),
        F.col(f"`{spec.id_column}`").cast("string").alias("customer_id"),
        body.alias("raw_features"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )


def score_population(
    df: DataFrame,
    scorer,
    spec: TenantSpec,
    tenant_id: str,
    model_version: str,
    predicted_at: dt.datetime,
) -> DataFrame:
    """Score the whole cleaned population (train and test) into prediction
    rows."""
    return scorer.transform(df).select(
        F.lit(tenant_id).alias("tenant_id"),
        F.col(spec.id_column).cast("string").alias("customer_id"),
        F.lit(model_version).alias("model_version"),
        F.col("churn_probability").cast("double").alias("churn_probability"),
        F.lit(predicted_at).cast("timestamp").alias("predicted_at"),
    )


def write_partitioned(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite only the partitions present in ``df``.  Rows are dealt by the
    partition columns first, in slices of Spark's advisory size, so a tenant
    gets few large files and a hot tenant several writers."""
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a whole table (CSV with a header row, no index column)."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def read_table_as(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """Read a table back with its known schema (no inference)."""
    r = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    return r.load(path)


def read_tenants(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All tenants' rows.  The partition column is read as text, never by
    inference, which would take the tenants '1', '001' and '1.0' for one.
    Without a ``schema``, files with differing fields, nested ones too, are
    read as one table, fields that a file lacks being NULL."""
    if schema is None:
        inferred = spark.read.option("mergeSchema", "true").parquet(path).schema
        fields = [T.StructField("tenant_id", T.StringType()) if f.name == "tenant_id" else f for f in inferred.fields]
        return spark.read.schema(T.StructType(fields)).parquet(path)
    return spark.read.schema(schema).parquet(path)


def tenant_scope(spark: SparkSession, path: str, tenant_id: str, schema: str | None = None) -> DataFrame:
    """The caller's tenant only (partition pruning on tenant_id)."""
    return read_tenants(spark, path, schema).filter(F.col("tenant_id") == F.lit(tenant_id))


def write_manifest(manifest: DataFrame, path: str, tenant_id: str) -> None:
    write_partitioned(manifest.withColumn("tenant_id", F.lit(tenant_id)), path, ["tenant_id"])


def read_manifest(spark: SparkSession, path: str, tenant_id: str) -> DataFrame:
    return tenant_scope(spark, path, tenant_id).drop("tenant_id")


def record_run(run: DataFrame, path: str, run_id: str, when: dt.datetime) -> None:
    """Append one run record (parquet, one folder per tenant).  Records may
    differ in their fields."""
    (
        run.withColumn("run_id", F.lit(run_id))
        .withColumn("timestamp", F.lit(when.isoformat()))
        .coalesce(1)
        .write.mode("append")
        .partitionBy("tenant_id")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str, tenant_id: str) -> DataFrame:
    """The tenant's run records; a single 'not available' row when none."""
    if path_exists(spark, path):
        runs = tenant_scope(spark, path, tenant_id)
        if not runs.isEmpty():
            return runs
    return spark.createDataFrame([(tenant_id, False, "no_model")], "tenant_id string, available boolean, reason string")
