"""Scoring new customer records as they arrive.

Cleaning, encoding, alignment and scoring are row-local (no state), so the
batch operators apply unchanged to a streaming DataFrame: ``readStream``
over a folder of parquet files -> clean -> model.transform -> parquet sink
partitioned like the predictions table.  The checkpoint goes under the
session's shared checkpoint folder, so a restarted query resumes where it
stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from churnframe.operators.clean import clean
from churnframe.session import checkpoint_dir
from churnframe.spec import TenantSpec


def scored_stream(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    scorer,
    spec: TenantSpec,
    tenant_id: str,
    model_version: str,
) -> DataFrame:
    """A streaming DataFrame of prediction rows for files landing in
    ``source_dir`` (schema given up front, as streaming sources require)."""
    raw = spark.readStream.schema(schema).parquet(source_dir)
    return scorer.transform(clean(raw, spec)).select(
        F.lit(tenant_id).alias("tenant_id"),
        F.col(spec.id_column).cast("string").alias("customer_id"),
        F.lit(model_version).alias("model_version"),
        F.col("churn_probability").cast("double").alias("churn_probability"),
        F.current_timestamp().alias("predicted_at"),
    )


def start_scoring(
    stream: DataFrame,
    sink_dir: str,
    query_name: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append predictions to ``sink_dir`` partitioned by tenant and version."""
    spark = stream.sparkSession
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    writer = (
        stream.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", f"{base.rstrip('/')}/streams/{query_name}")
        .partitionBy("tenant_id", "model_version")
        .outputMode("append")
        .queryName(query_name)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_once(stream: DataFrame, sink_dir: str, query_name: str) -> None:
    """Process everything present now, then stop (for batch-style runs)."""
    q = start_scoring(stream, sink_dir, query_name, available_now=True)
    q.awaitTermination()


__all__ = ["scored_stream", "start_scoring", "run_once"]
