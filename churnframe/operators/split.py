"""Label-stratified, row-order-independent train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnframe.functions.columns import hash_order_key
from churnframe.operators.ordering import rank_within
from churnframe.session import cut_lineage
from churnframe.spec import TenantSpec


def test_rows(n: Column, test_size: float) -> Column:
    """How many of a label's ``n`` rows are test rows: the share, rounded half
    to even; a label of two or more rows is always in both splits, and a
    single row always trains."""
    share = F.bround(n * F.lit(float(test_size)), 0).cast("bigint")
    # a share that would take every row falls back to half of them
    share = F.when(share >= n, F.greatest(F.lit(1), F.floor(n / 2))).otherwise(share)
    return F.when(n > 1, F.greatest(F.lit(1), share)).otherwise(F.lit(0)).cast("bigint")


def stratified_split(df: DataFrame, spec: TenantSpec, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Manifest ``(id, label, split)``.

    Within each label (as text) ids are ordered by md5('<seed>:<id>'), then
    id; the first ``test_rows`` go to test.  Only the set of records
    matters, never their physical order.  The per-label ordinal is a
    distributed rank, so a label holding most rows is still sorted by many
    tasks.
    """
    idc, tgt = spec.id_column, spec.target_column
    base = df.select(
        F.col(idc).alias("id"),
        F.coalesce(F.col(tgt).cast("string"), F.lit("nan")).alias("label"),
    ).withColumn("_h", hash_order_key(seed, F.col("id")))
    ranked = rank_within(base, "label", ["_h", "id"], "_rn")
    # one row per label joins back; Spark broadcasts it or splits a hot label
    cut = base.groupBy("label").agg(test_rows(F.count(F.lit(1)), test_size).alias("_cut"))
    return ranked.join(cut_lineage(cut), "label").select(
        "id",
        "label",
        F.when(F.col("_rn") <= F.col("_cut"), F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )


def split_rows(df: DataFrame, manifest: DataFrame, spec: TenantSpec, which: str) -> DataFrame:
    """Rows of one split: a join on id with the manifest, never row positions."""
    ids = manifest.filter(F.col("split") == which).select(F.col("id").alias(spec.id_column))
    return df.join(ids, spec.id_column, "left_semi")
