"""Scorers: anything with ``transform(df) -> df + churn_probability``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.functions.columns import closed_form_score
from churnframe.operators.prioritize import PROBABILITY


class ClosedFormScorer:
    """recency / (recency + 180): a fixed score that SQL can reproduce bit
    for bit, used where an operator is checked against an exact oracle."""

    def __init__(self, recency_column: str = "recency_days"):
        self.recency_column = recency_column

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PROBABILITY, closed_form_score(F.col(self.recency_column)))

    def substituted(self, df: DataFrame, means: dict[str, float]) -> tuple[DataFrame, str, list[str]]:
        """``df`` with its score and, for each entry of ``means``, the score
        with that column at its mean; and the names of these columns."""
        names = [f"_p{k}" for k in range(len(means))]
        held = [
            closed_form_score(F.lit(float(m)) if c == self.recency_column else F.col(self.recency_column)).alias(n)
            for (c, m), n in zip(means.items(), names)
        ]
        return df.select("*", closed_form_score(F.col(self.recency_column)).alias(PROBABILITY), *held), PROBABILITY, names


def classify_at(threshold: float = 0.5):
    """``probability >= threshold`` as 0/1."""
    return (F.col(PROBABILITY) >= F.lit(threshold)).cast("bigint")
