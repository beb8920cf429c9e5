"""Feedback loop: pick a campaign from the ranking, fold the observed
outcomes back in as new training rows, retrain under a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.functions.columns import binarize, hash_order_key
from churnframe.operators.backtest import campaign_size
from churnframe.operators.metrics import average_precision, roc_auc
from churnframe.operators.models import fit_churn
from churnframe.operators.ordering import top
from churnframe.operators.prioritize import PROBABILITY
from churnframe.operators.split import split_rows
from churnframe.session import cut_lineage
from churnframe.spec import TenantSpec

# Fixed value: how feedback rows are tagged.
FEEDBACK_TAG = "synthetic_feedback_not_real"


def select_campaign(
    ranking: DataFrame,
    id_column: str,
    n_customers: int = 100,
    retention_rate: float = 0.3,
    top_pct: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """From the top ``max(1, int(n * top_pct))`` of a ranking, take
    ``min(n_customers, size)`` ids by hash order, and mark the first
    ``int(taken * retention_rate)`` of those (another hash order) as
    retained.  Returns (id, retained)."""
    n = ranking.count()
    size = campaign_size(top_pct, n)
    take = min(n_customers, size)
    retained = int(take * retention_rate)
    def hashed(what: str):
        return hash_order_key(seed, F.concat(F.lit(what + ":"), F.col(id_column).cast("string")))

    # two top-k of at most n_customers rows, not two full rankings
    listed = ranking.filter(F.col("rank") <= size).select(id_column, hashed("sample").alias("_h"))
    picked = top(listed, ["_h", id_column], take, "_pick").withColumn("_h", hashed("retain"))
    return top(picked, ["_h", id_column], take, "_pick").select(id_column, (F.col("_pick") <= retained).alias("retained"))


def relabel(df: DataFrame, outcomes: DataFrame, spec: TenantSpec, new_label_column: str = "new_label") -> DataFrame:
    """Overwrite the label on the ids present in ``outcomes``; the source
    table is untouched (a left join and coalesce).  An id reported twice
    counts once (the largest label wins, so the result is deterministic);
    ids unknown to ``df`` are ignored."""
    o = outcomes.groupBy(F.col(spec.id_column)).agg(F.max(F.col(new_label_column)).alias("_new"))
    return (
        df.join(o, spec.id_column, "left")
        .withColumn(spec.target_column, F.coalesce(F.col("_new"), F.col(spec.target_column)))
        .drop("_new")
    )


def feedback_batch(df: DataFrame, campaign: DataFrame, spec: TenantSpec, retained_value="No") -> DataFrame:
    """Rows of the campaign's customers; retained ones get the negative
    label; tagged with ``data_source``."""
    outcomes = campaign.filter("retained").select(spec.id_column, F.lit(retained_value).alias("new_label"))
    rows = df.join(campaign.select(spec.id_column), spec.id_column, "left_semi")
    return relabel(rows, outcomes, spec).withColumn("data_source", F.lit(FEEDBACK_TAG))


def append_feedback(train: DataFrame, batch: DataFrame) -> DataFrame:
    """Train rows plus the batch: columns matched by name, missing ones NULL,
    duplicates kept."""
    return train.unionByName(batch, allowMissingColumns=True)


def retrain_with_feedback(
    df: DataFrame,
    manifest: DataFrame,
    batch: DataFrame,
    spec: TenantSpec,
    features: list[str],
    params: dict | None = None,
    evaluate_on_feedback_ids: bool = False,
    retention_rate: float | None = None,
):
    """New model on train + batch (encoders refit on the union, the previous
    version's feature order).  Evaluated on the original test split, by
    default without the feedback ids, which would otherwise be scored after
    being trained on.  Returns (model, one-row record)."""
    train = split_rows(df, manifest, spec, "train")
    clean_batch = batch.drop("data_source")
    # the batch comes from the previous version's scores and ranking: cut
    # that lineage before the iterative fit
    combined = cut_lineage(append_feedback(train, clean_batch))
    model = fit_churn(combined, spec, features=features, params=params)
    test = split_rows(df, manifest, spec, "test")
    if not evaluate_on_feedback_ids:
        test = test.join(batch.select(spec.id_column), spec.id_column, "left_anti")
    scored = model.transform(test).withColumn("_y", binarize(F.col(spec.target_column), spec.positive_value))
    y = binarize(F.col(spec.target_column), spec.positive_value)
    counts = [
        train.agg(F.count(F.lit(1)).alias("n_train_original"), F.avg(y).alias("churn_rate_train_original")),
        clean_batch.agg(
            F.count(F.lit(1)).alias("n_feedback"),
            F.avg(y).alias("churn_rate_feedback"),
            # share of batch rows labelled negative (the inferred rate) ...
            F.avg((F.col(spec.target_column) != F.lit(spec.positive_value)).cast("int")).alias("negative_share_feedback"),
        ),
        combined.agg(F.count(F.lit(1)).alias("n_train_combined"), F.avg(y).alias("churn_rate_train_combined")),
        scored.agg(F.count(F.lit(1)).alias("n_test"), F.avg("_y").alias("churn_rate_test")),
        roc_auc(scored, "_y", PROBABILITY),
        average_precision(scored, "_y", PROBABILITY),
    ]
    # one-row parts stacked, then folded into a single row
    rec = counts[0]
    for c in counts[1:]:
        rec = rec.unionByName(c, allowMissingColumns=True)
    record = rec.agg(*[F.max(c).alias(c) for c in rec.columns])
    # the rate the campaign applied (when known) and the inferred share of
    # negative labels in the batch are reported apart
    applied = F.lit(retention_rate).cast("double") if retention_rate is not None else F.col("negative_share_feedback")
    record = record.withColumn("retention_rate_applied", applied).withColumn(
        "evaluated_on_feedback_ids", F.lit(bool(evaluate_on_feedback_ids))
    )
    return model, record


# How a version that saw simulated outcomes names itself.
DATA_SOURCE = "training rows and a synthetic feedback batch"
DISCLOSURE = (
    "Trained on the training split and on outcomes simulated for a sample of the ranked test customers. "
    "It shows how feedback flows back; its figures are no evidence of a better model."
)


def disclosed(record: DataFrame, run_id: str, source: str) -> DataFrame:
    """The record of ``retrain_with_feedback`` with its version and what its
    data are."""
    batch = F.struct(
        F.col("n_feedback").alias("n_customers_sampled"), F.col("retention_rate_applied"), F.lit(source).alias("source")
    )
    return record.select(
        F.lit(run_id).alias("run_id"),
        F.lit(DATA_SOURCE).alias("data_source"),
        F.lit(DISCLOSURE).alias("synthetic_data_disclosure"),
        batch.alias("feedback_batch_info"),
        *[F.col(c) for c in record.columns if c != "retention_rate_applied"],
    )
