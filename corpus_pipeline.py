"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the
columns of ``documents``; the last returns packed bins.  ``run`` writes each
stage's result as Parquet in the shared checkpoint folder, reads it back for
the next one and then deletes what came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnframe.llm import decontaminate, packing, secret_scan, simhash, toxicity
from churnframe.llm.common import discard, materialise, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("secret_scan", secret_scan.stage),
    ("best_fit_packing", packing.stage),
]

#: Trained models and packing have no SQL form; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return docs
