"""Column expressions shared by the operators.  All are built-in Spark SQL
functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A number as pandas' ``to_numeric`` accepts it: optional sign, digits with an
# optional fraction (or a bare fraction), optional exponent, or an infinity
# word; blanks around are trimmed first.  Spark alone would also accept
# '1d' / '1f' suffixes.  'nan' is not matched: missing either way.
NUMERIC_PATTERN = r"(?i)^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"

# Tokens pandas' CSV reader treats as missing by default.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


def nan_to_null(c: Column) -> Column:
    """NaN sorts above every number and poisons averages: make it NULL."""
    return F.when(~F.isnan(c), c)


def coerce_numeric(c: Column, dtype: T.DataType) -> Column:
    """Unparseable to NULL, as ``pd.to_numeric(errors='coerce')``."""
    if isinstance(dtype, T.StringType):
        trimmed = F.trim(c)
        parsed = F.when(trimmed.rlike(NUMERIC_PATTERN), trimmed.try_cast("double"))
        return nan_to_null(parsed)
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    return nan_to_null(c.cast("double"))


def binarize(c: Column, positive: Any) -> Column:
    """``target == positive`` as 0/1; a missing label is 0."""
    return c.eqNullSafe(F.lit(positive)).cast("int")


def yes_no_strict(c: Column, name: str = "value") -> Column:
    """'Yes' -> 1, 'No' -> 0, anything else fails the job."""
    return (
        F.when(c == "Yes", F.lit(1))
        .when(c == "No", F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit(f"{name}: cannot recode "), F.coalesce(c, F.lit("NULL")))).cast("int"))
        .cast("bigint")
    )


def yes_no_lenient(c: Column) -> Column:
    """'Yes' -> 1, 'No' -> 0, anything else NULL."""
    return F.when(c == "Yes", F.lit(1)).when(c == "No", F.lit(0)).cast("bigint")


def hash_unit(salt: str, key: Column) -> Column:
    """Deterministic uniform number in [0, 1) from md5(salt || key).  The
    same expression exists in DuckDB, so samples and splits can be checked
    against SQL."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_order_key(seed: int, key: Column) -> Column:
    """Order key for seeded shuffles: md5 of '<seed>:<id>'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def closed_form_score(recency: Column) -> Column:
    """Closed-form churn score used where an exact SQL oracle is needed:
    recency / (recency + 180)."""
    r = recency.cast("double")
    return r / (r + F.lit(180.0))
