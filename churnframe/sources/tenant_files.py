"""Loading one tenant's customer table: read, null tokens, validation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.functions.columns import PANDAS_NA_TOKENS, coerce_numeric, nan_to_null
from churnframe.session import cut_lineage
from churnframe.spec import TenantSpec


def normalize_missing(df: DataFrame, tokens: bool = True) -> DataFrame:
    """Every missing marker to NULL once, at load: NaN in floating columns
    and, for ``tokens`` (text from a CSV file), pandas' NA tokens."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and tokens:
            cols.append(F.when(~c.isin(*PANDAS_NA_TOKENS), c).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def retype(df: DataFrame) -> DataFrame:
    """Text columns typed by their values once missing markers are NULL, as
    pandas does: whole numbers (double if any is missing), numbers, True /
    False (if none is missing), else text.  One aggregation finds all types."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    aggs = []
    for i, n in enumerate(names):
        c = F.trim(F.col(f"`{n}`"))
        number = coerce_numeric(c, T.StringType())
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.isNull()).alias(f"missing{i}"),
            F.count(number).alias(f"number{i}"),
            F.count_if(c.rlike(r"^[+-]?\d{1,18}$")).alias(f"whole{i}"),
            F.count_if(c.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"truth{i}"),
        ]
    found = df.agg(*aggs).first()
    columns = {}
    for i, n in enumerate(names):
        c = F.trim(F.col(f"`{n}`"))
        count, missing = found[f"n{i}"], found[f"missing{i}"]
        if count and found[f"whole{i}"] == count and not missing:
            columns[n] = c.cast("bigint")
        elif count and found[f"number{i}"] == count:
            columns[n] = coerce_numeric(c, T.StringType())
        elif count and found[f"truth{i}"] == count and not missing:
            columns[n] = c.cast("boolean")
    return df.withColumns(columns) if columns else df


def read_tenant(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, or parquet.  A CSV file is read as text, its missing
    markers become NULL, and then columns take the types of ``schema`` (one
    scan) or those that their values allow (one more scan).  A missing path
    surfaces Spark's PATH_NOT_FOUND error unchanged."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt != "csv":
        return normalize_missing(spark.read.format(fmt).load(path), tokens=False)
    text = normalize_missing(spark.read.option("header", True).csv(path))
    if schema is None:
        return retype(text)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    typed = []
    for f in schema.fields:
        typed.append(typed_text(F.trim(F.col(f"`{f.name}`")), f.dataType).alias(f.name))
    return text.select(*typed)


def typed_text(c: Column, kind: T.DataType) -> Column:
    """Text as ``kind``; what is no such value is NULL.  Whole numbers and
    decimals are read from the digits (a double would change ids of 16 digits
    and more); only forms like ``1e3`` go through a double."""
    if not isinstance(kind, T.NumericType):
        return c.cast(kind)
    number = coerce_numeric(c, T.StringType())
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number.cast(kind)
    if isinstance(kind, T.DecimalType):
        return F.coalesce(c.try_cast(kind), number.try_cast(kind))
    return F.coalesce(c.try_cast(kind), c.try_cast("decimal(38,9)").try_cast(kind), number.try_cast(kind))


def require_columns(df: DataFrame, spec: TenantSpec) -> None:
    """The columns of the roles that every tenant has, in the spec's order."""
    roles = (("id", spec.id_column), ("label", spec.target_column), ("revenue", spec.revenue_column))
    absent = [f"{role} column '{name}'" for role, name in roles if name not in df.columns]
    if absent:
        raise ValueError(f"tenant {spec.tenant_id}: no {', no '.join(absent)}")


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Ids held by more than one row (two NULL ids count as a duplicate, one
    does not).  A partial aggregation: a hot id costs one row per map task."""
    return (
        df.groupBy(F.col(id_column).alias("id"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") > 1)
    )


def require_unique_key(df: DataFrame, id_column: str) -> None:
    if duplicate_ids(df, id_column).limit(1).count() > 0:
        raise ValueError(f"an id occurs in several rows of column '{id_column}'")


def load_tenant(
    spark: SparkSession,
    spec: TenantSpec,
    path: str | None = None,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    return validate(read_tenant(spark, path or spec.path, fmt, schema), spec)


def validate(df: DataFrame, spec: TenantSpec) -> DataFrame:
    """The checked table; see ``validate_with``."""
    return validate_with(df, spec, {})[0]


def validate_with(df: DataFrame, spec: TenantSpec, violations: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """The table, read once and written, and how many of its rows show each
    violation (and ``n_rows``): counted while it is written.  Only the id
    column of the written table is read again, for the key check."""
    require_columns(df, spec)
    seen = Observation()
    counts = [F.count_if(F.coalesce(v, F.lit(False))).alias(name) for name, v in violations.items()]
    table = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts))
    require_unique_key(table, spec.id_column)
    return table, {name: int(n) for name, n in seen.get.items()}
