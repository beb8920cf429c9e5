"""Per-customer explanations by marginal effect, for every test customer.

For customer c and feature f: effect = p(c) - p(c with f set to the encoded
training mean).  A scorer gives the substituted scores as columns of the same
row, so nothing is copied or regrouped: the effects are an array, sorted in
the row, and the top three |effect| (ties in feature order) are its head.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.operators.prioritize import PROBABILITY

Substituted = Callable[[DataFrame, dict[str, float]], tuple[DataFrame, str, list[str]]]


def feature_means(train_inputs: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Means of the encoded training features (one row)."""
    return train_inputs.agg(*[F.avg(c).alias(c) for c in inputs])


def explain_scores(
    inputs: DataFrame,
    id_column: str,
    feature_names: Sequence[str],
    means: dict[str, float],
    substituted: Substituted,
    top: int = 3,
) -> DataFrame:
    """``inputs``: id plus model inputs; ``substituted(inputs, means)`` adds
    the score and one score per feature, in the features' order, and names
    them.  Output: customer id, churn_probability, rank, feature,
    contribution, direction (``up`` if > 0, else ``down``)."""
    scored, base, columns = substituted(inputs, means)
    effects = []
    for k, (c, name) in enumerate(zip(columns, feature_names)):
        effect = F.col(base) - F.col(c)
        effects.append(F.struct((-F.abs(effect)).alias("order"), F.lit(k).alias("k"), effect.alias("effect"), F.lit(name).alias("name")))
    best = F.slice(F.array_sort(F.array(*effects)), 1, top)
    rows = scored.select(id_column, F.col(base).alias(PROBABILITY), F.posexplode(best).alias("place", "e"))
    return rows.select(
        id_column,
        PROBABILITY,
        (F.col("place") + 1).cast("bigint").alias("rank"),
        F.col("e.name").alias("feature"),
        F.col("e.effect").alias("contribution"),
        F.when(F.col("e.effect") > 0, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
    )


def lookup_status(ids: DataFrame, manifest: DataFrame, id_column: str) -> DataFrame:
    """Batch id lookup: ``ok`` for test-split ids, ``not_in_test`` for other
    known ids, ``not_found`` otherwise."""
    m = manifest.select(F.col("id").alias(id_column), "split")
    return ids.select(id_column).join(m, id_column, "left").select(
        id_column,
        F.when(F.col("split").isNull(), F.lit("not_found"))
        .when(F.col("split") == "test", F.lit("ok"))
        .otherwise(F.lit("not_in_test"))
        .alias("status"),
    )
