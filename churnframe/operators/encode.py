"""Ordinal encoding of categorical columns, fitted on the training rows.

The encoder is a table ``(column, value, code)``: codes 0.. follow the
sorted distinct non-null values of each column.  A NULL or unseen value
encodes to -1 (MLlib's ``StringIndexer`` would give it the next index
instead).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.operators.ordering import rank_within

def categorical_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(types[c], (T.StringType, T.BooleanType))]


def fit_encoders(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value) pairs, melted, deduplicated map-side, then
    numbered within each column."""
    if not columns:
        return train.sparkSession.createDataFrame([], "column string, value string, code bigint")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    distinct = (
        train.select(pairs.alias("p"))
        .select("p.column", "p.value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )
    ranked = rank_within(distinct, "column", ["value"], "code")
    return ranked.withColumn("code", (F.col("code") - 1).cast("bigint"))


def encode(df: DataFrame, encoders: DataFrame, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Replace each of ``columns`` that ``df`` has by its code (double); NULL,
    unseen values and columns that had no value at fitting give -1.0.  With a
    ``prefix`` the codes go to new columns and the originals stay.  One left
    join per column: Spark broadcasts a column's table if its size allows and
    else splits a hot value's rows."""
    out = df
    for c in columns:
        if c not in df.columns:
            continue
        enc = encoders.filter(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").cast("double").alias("_code")
        )
        out = (
            out.join(enc, F.col(f"`{c}`").cast("string") == F.col("_value"), "left")
            .withColumn(prefix + c, F.coalesce(F.col("_code"), F.lit(-1.0)))
            .drop("_value", "_code")
        )
    return out


def align_features(df: DataFrame, feature_names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Force the trained feature order: absent features become constant 0,
    extra columns are dropped (``keep`` columns pass through first)."""
    present = set(df.columns)
    cols = [F.col(c) for c in keep]
    cols += [F.col(f) if f in present else F.lit(0).cast("double").alias(f) for f in feature_names]
    return df.select(*cols)
