"""Cleaning: numeric coercion and the two imputation branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.functions.columns import coerce_numeric
from churnframe.spec import TenantSpec


def clean(df: DataFrame, spec: TenantSpec) -> DataFrame:
    """Revenue (and the billed total, when present) to double; unparseable
    becomes NULL.

    If both the duration and the billed-total column exist: a missing total
    at duration 0 takes the revenue value, any other missing total becomes
    0.0, and missing revenue is left as is.  Otherwise missing revenue
    becomes 0.0.  One projection, no shuffle.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    rev = spec.revenue_column
    out = df.withColumn(rev, coerce_numeric(F.col(rev), types[rev]))
    total, dur = spec.total_column, spec.duration_column
    if total and dur and total in types and dur in types:
        t = coerce_numeric(F.col(total), types[total])
        imputed = F.when((F.col(dur) == 0) & t.isNull(), F.col(rev)).otherwise(t)
        return out.withColumn(total, F.coalesce(imputed, F.lit(0.0)))
    return out.withColumn(rev, F.coalesce(F.col(rev), F.lit(0.0)))
