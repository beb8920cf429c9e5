"""Registered queries with an exact DuckDB oracle (part 2)."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnframe.functions.columns import binarize, hash_order_key, yes_no_lenient, yes_no_strict
from churnframe.operators import lloyd
from churnframe.operators import metrics as M
from churnframe.operators.anomaly import Forest, anomaly_report, flag
from churnframe.operators.backtest import backtest, backtest_size, campaign_size, member
from churnframe.operators.boosting import BoostedTrees, Node, fit_trees
from churnframe.operators.clean import clean
from churnframe.operators.encode import align_features, encode, fit_encoders
from churnframe.operators.explain import explain_scores, feature_means, lookup_status
from churnframe.operators.feedback import append_feedback, feedback_batch, relabel, select_campaign
from churnframe.operators.models import substituted_scores
from churnframe.operators.ordering import kth_keys, prefix_sums
from churnframe.operators.prioritize import head, priority_ranking
from churnframe.operators.quantiles import medians, quantiles
from churnframe.operators.reports import expectations, outcome_by_group, ranking_expectations
from churnframe.operators.scoring import ClosedFormScorer, classify_at
from churnframe.operators.segment import Segmentation, profile_clusters, scale, scale_stats
from churnframe.operators.silhouette import point_silhouettes
from churnframe.operators.survival import BASELINE, CoxModel, partial_likelihood
from churnframe.plans import oracle as O
from churnframe.plans.catalog import cleaned, manifest, query, snapshot, split_of, test_scored, with_split
from churnframe.sources.conform import conform_schema, enrich_base_wins
from churnframe.sources.store import (
    CUSTOMERS_SCHEMA,
    pack_customers,
    read_runs,
    read_table_as,
    record_run,
    score_population,
    tenant_scope,
    write_partitioned,
    write_table,
)
from churnframe.sources.tables import read_table
from churnframe.sources.tenant_files import duplicate_ids, load_tenant, normalize_missing
from churnframe.session import new_path
from churnframe.spec import SNAPSHOT, TenantSpec

S = SNAPSHOT
ID = S.id_column
CATS = ["contract", "nation"]
LOAD_TS = dt.datetime(2001, 1, 1)


def _train(spark, sf):
    return split_of(spark, sf, "train")


def _ranking(spark, sf, strategy):
    return priority_ranking(test_scored(spark, sf), S, strategy)


def _one_row(*parts: DataFrame) -> DataFrame:
    """Stack one-row aggregates and fold them into one row (no cross join)."""
    rec = parts[0]
    for p in parts[1:]:
        rec = rec.unionByName(p, allowMissingColumns=True)
    return rec.agg(*[F.max(c).alias(c) for c in rec.columns])


TRAIN = O.CLEAN + "," + O.split_cte() + """,
train AS (SELECT c.* FROM clean c JOIN manifest m ON m.id = c.customer_id AND m.split = 'train'),
test AS (SELECT c.* FROM clean c JOIN manifest m ON m.id = c.customer_id AND m.split = 'test')"""

ENC = """,
enc AS (
  SELECT 'contract' AS col, value, row_number() OVER (ORDER BY value) - 1 AS code
  FROM (SELECT DISTINCT contract AS value FROM train WHERE contract IS NOT NULL)
  UNION ALL
  SELECT 'nation', value, row_number() OVER (ORDER BY value) - 1
  FROM (SELECT DISTINCT nation AS value FROM train WHERE nation IS NOT NULL))"""


def enc_expr(table: str, c: str) -> str:
    return (
        f"COALESCE((SELECT CAST(e.code AS DOUBLE) FROM enc e WHERE e.col = '{c}' AND e.value = {table}.{c}), -1.0)"
    )


RANKS = O.TEST_SCORED + """,
ranked AS (
  SELECT customer_id, churn_probability, avg_order, expected_revenue_at_risk, churn,
         row_number() OVER (ORDER BY expected_revenue_at_risk DESC, customer_id) AS r_rw,
         row_number() OVER (ORDER BY churn_probability DESC, customer_id) AS r_po
  FROM test_scored)"""


# ---------------------------------------------------------------- sources


@query(
    "duplicate_ids",
    "SELECT o_custkey AS id, CAST(COUNT(*) AS BIGINT) AS n_rows FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1",
)
def q_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_ids(read_table(spark, sf, "orders"), "o_custkey").withColumn("n_rows", F.col("n_rows").cast("bigint"))


CONFORM_RENAME = {
    "customer_id": "customerID",
    "contract": "Contract",
    "tenure_months": "tenure",
    "avg_order": "MonthlyCharges",
    "total_spend": "TotalCharges",
    "churn": "Churn",
}


@query(
    "conform_schema",
    O.with_(
        O.SNAP,
        """SELECT customer_id AS customerID, contract AS Contract, tenure_months AS tenure,
       avg_order AS MonthlyCharges, total_spend AS TotalCharges, churn AS Churn,
       CAST(CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS BIGINT) AS ChurnValue
FROM snap""",
    ),
)
def q_conform_schema(spark: SparkSession, sf: str) -> DataFrame:
    raw = snapshot(spark, sf).withColumn("ChurnValue", F.col("churn"))
    slim, _full = conform_schema(
        raw,
        CONFORM_RENAME,
        ["customerID", "Contract", "tenure", "MonthlyCharges", "TotalCharges", "Churn", "ChurnValue"],
        strict_yes_no=["ChurnValue"],
        drop_from_full=["ChurnValue"],
    )
    return slim


@query(
    "enrich_base_wins",
    O.with_(
        O.CLEAN,
        """SELECT c.*, cu.c_acctbal AS balance, cu.c_name AS account_name
FROM clean c LEFT JOIN customer cu ON cu.c_custkey = c.customer_id""",
    ),
)
def q_enrich_base_wins(spark: SparkSession, sf: str) -> DataFrame:
    ext = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias(ID),
        F.col("c_acctbal").alias("balance"),
        F.col("c_name").alias("account_name"),
        F.lower("c_mktsegment").alias("contract"),  # overlapping: base wins
    )
    return enrich_base_wins(cleaned(spark, sf), ext, ID, ["balance", "account_name"])


BALANCE_SPEC = TenantSpec("accounts", "c_custkey", "c_mktsegment", "BUILDING", "balance")


@query(
    "fill_revenue",
    """SELECT c_custkey,
       COALESCE(TRY_CAST(CASE WHEN c_acctbal < 0 THEN NULL
                              ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) END AS DOUBLE), 0.0) AS balance
FROM customer""",
)
def q_fill_revenue(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_table(spark, sf, "customer").select(
        "c_custkey",
        "c_mktsegment",
        F.when(F.col("c_acctbal") < 0, F.lit(""))
        .otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
        .alias("balance"),
    )
    return clean(normalize_missing(raw), BALANCE_SPEC).select("c_custkey", "balance")


@query(
    "binarize_label",
    O.with_(
        O.SNAP,
        """SELECT customer_id,
       CAST(CASE WHEN churn IS NOT DISTINCT FROM 'Yes' THEN 1 ELSE 0 END AS BIGINT) AS churn_flag,
       CAST(CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS BIGINT) AS churn_lenient,
       CAST(CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS BIGINT) AS churn_strict
FROM snap""",
    ),
)
def q_binarize_label(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot(spark, sf).select(
        ID,
        binarize(F.col("churn"), "Yes").cast("bigint").alias("churn_flag"),
        yes_no_lenient(F.col("churn")).alias("churn_lenient"),
        yes_no_strict(F.col("churn"), "churn").alias("churn_strict"),
    )


@query(
    "fit_encoders",
    O.with_(TRAIN + ENC, 'SELECT col AS "column", value, CAST(code AS BIGINT) AS code FROM enc'),
)
def q_fit_encoders(spark: SparkSession, sf: str) -> DataFrame:
    return fit_encoders(_train(spark, sf), CATS)


@query(
    "encode_features",
    O.with_(
        TRAIN + ENC,
        f"SELECT customer_id, {enc_expr('test', 'contract')} AS contract, {enc_expr('test', 'nation')} AS nation FROM test",
    ),
)
def q_encode_features(spark: SparkSession, sf: str) -> DataFrame:
    enc = fit_encoders(split_of(spark, sf, "train"), CATS)
    return encode(split_of(spark, sf, "test"), enc, CATS).select(ID, *CATS)


ALIGNED = ["contract", "nation", "n_orders", "recency_days", "avg_order", "loyalty_tier"]


@query(
    "align_features",
    O.with_(
        TRAIN + ENC,
        f"""SELECT customer_id, {enc_expr('clean', 'contract')} AS contract, {enc_expr('clean', 'nation')} AS nation,
       n_orders, recency_days, avg_order, CAST(0 AS DOUBLE) AS loyalty_tier
FROM clean""",
    ),
)
def q_align_features(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaned(spark, sf)
    enc = fit_encoders(split_of(spark, sf, "train"), CATS)
    return align_features(encode(df, enc, CATS), ALIGNED, keep=[ID])


# ---------------------------------------------------------------- split / sampling


@query(
    "split_balance",
    O.with_(
        O.CLEAN + "," + O.split_cte(),
        """SELECT split, CAST(COUNT(*) AS BIGINT) AS n,
       AVG(CASE WHEN label = 'Yes' THEN 1 ELSE 0 END) AS churn_rate
FROM manifest GROUP BY split""",
    ),
)
def q_split_balance(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(binarize(F.col("label"), "Yes")).alias("churn_rate")
    )


@query(
    "split_overlap",
    O.with_(
        O.CLEAN + "," + O.split_cte(),
        """SELECT CAST(SUM(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(SUM(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test,
       CAST((SELECT COUNT(*) FROM (SELECT id FROM manifest WHERE split = 'train'
                                   INTERSECT SELECT id FROM manifest WHERE split = 'test')) AS BIGINT) AS n_overlap
FROM manifest""",
    ),
)
def q_split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf)
    sizes = m.agg(
        F.count_if(F.col("split") == "train").cast("bigint").alias("n_train"),
        F.count_if(F.col("split") == "test").cast("bigint").alias("n_test"),
    )
    overlap = (
        m.filter("split = 'train'").select("id").intersect(m.filter("split = 'test'").select("id"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_overlap"))
    )
    return _one_row(sizes, overlap)


@query(
    "random_baseline",
    O.with_(
        O.TEST_SCORED,
        """SELECT customer_id FROM (
  SELECT customer_id, row_number() OVER (ORDER BY md5('42:' || CAST(customer_id AS VARCHAR)), customer_id) AS r,
         COUNT(*) OVER () AS n
  FROM test_scored) WHERE r <= round_even(CAST(0.2 AS DOUBLE) * n, 0)""",
    ),
)
def q_random_baseline(spark: SparkSession, sf: str) -> DataFrame:
    t = test_scored(spark, sf).select(ID).withColumn("_h", hash_order_key(42, F.col(ID)))
    keys = [("_h", True), (ID, True)]
    k = backtest_size(0.2, t.count())
    return t.filter(member(keys, kth_keys(t, keys, [k])[k])).select(ID)


CAMPAIGN = RANKS + """,
sized AS (SELECT CAST(floor(COUNT(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_top FROM ranked),
sz AS (SELECT greatest(1, n_top) AS n_top, least(100, greatest(1, n_top)) AS take,
              CAST(floor(least(100, greatest(1, n_top)) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS n_ret FROM sized),
picked AS (
  SELECT customer_id, row_number() OVER (ORDER BY md5('42:sample:' || CAST(customer_id AS VARCHAR)), customer_id) AS p
  FROM ranked, sz WHERE r_rw <= sz.n_top),
taken AS (SELECT customer_id FROM picked, sz WHERE p <= sz.take),
campaign AS (
  SELECT customer_id,
         row_number() OVER (ORDER BY md5('42:retain:' || CAST(customer_id AS VARCHAR)), customer_id) <= (SELECT n_ret FROM sz)
           AS retained
  FROM taken)"""


@query("select_campaign", O.with_(CAMPAIGN, "SELECT customer_id, retained FROM campaign"))
def q_select_campaign(spark: SparkSession, sf: str) -> DataFrame:
    return select_campaign(_ranking(spark, sf, "revenue_weighted"), ID, 100, 0.3, 0.2, 42)


@query(
    "relabel",
    O.with_(
        CAMPAIGN,
        """SELECT c.customer_id, CASE WHEN k.retained THEN 'No' ELSE c.churn END AS churn
FROM clean c LEFT JOIN campaign k ON k.customer_id = c.customer_id""",
    ),
)
def q_relabel(spark: SparkSession, sf: str) -> DataFrame:
    camp = select_campaign(_ranking(spark, sf, "revenue_weighted"), ID, 100, 0.3, 0.2, 42)
    outcomes = camp.filter("retained").select(ID, F.lit("No").alias("new_label"))
    return relabel(cleaned(spark, sf), outcomes, S).select(ID, "churn")


@query(
    "append_feedback",
    O.with_(
        CAMPAIGN,
        """SELECT c.customer_id, c.churn, CAST(NULL AS VARCHAR) AS data_source
FROM clean c JOIN manifest m ON m.id = c.customer_id AND m.split = 'train'
UNION ALL
SELECT c.customer_id, CASE WHEN k.retained THEN 'No' ELSE c.churn END, 'synthetic_feedback_not_real'
FROM clean c JOIN campaign k ON k.customer_id = c.customer_id""",
    ),
)
def q_append_feedback(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaned(spark, sf)
    camp = select_campaign(_ranking(spark, sf, "revenue_weighted"), ID, 100, 0.3, 0.2, 42)
    batch = feedback_batch(df, camp, S)
    return append_feedback(split_of(spark, sf, "train"), batch).select(ID, "churn", "data_source")


# ---------------------------------------------------------------- ranking / lift


def _ranking_sql(rank_col: str) -> str:
    return O.with_(
        RANKS,
        f"""SELECT customer_id, churn_probability, avg_order, expected_revenue_at_risk,
       CAST({rank_col} AS BIGINT) AS rank FROM ranked""",
    )


@query("priority_revenue_weighted", _ranking_sql("r_rw"))
def q_priority_rw(spark: SparkSession, sf: str) -> DataFrame:
    return _ranking(spark, sf, "revenue_weighted")


@query("priority_probability_only", _ranking_sql("r_po"))
def q_priority_po(spark: SparkSession, sf: str) -> DataFrame:
    return _ranking(spark, sf, "probability_only")


@query(
    "priority_head",
    O.with_(
        RANKS,
        """SELECT customer_id, churn_probability, avg_order, expected_revenue_at_risk, CAST(r_rw AS BIGINT) AS rank
FROM ranked WHERE r_rw <= 50""",
    ),
)
def q_priority_head(spark: SparkSession, sf: str) -> DataFrame:
    return head(test_scored(spark, sf), S, 50)


@query(
    "top_fraction",
    O.with_(
        O.TEST_SCORED,
        """SELECT top_pct, CAST(round_even(top_pct * n, 0) AS BIGINT) AS backtest_n,
       CAST(greatest(1, floor(n * top_pct)) AS BIGINT) AS campaign_n
FROM (SELECT COUNT(*) AS n FROM test_scored) CROSS JOIN
     (SELECT CAST(x AS DOUBLE) AS top_pct FROM (VALUES (0.1), (0.2), (0.3)) t(x))""",
    ),
)
def q_top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    n = test_scored(spark, sf).count()
    rows = [(p, backtest_size(p, n), campaign_size(p, n)) for p in (0.1, 0.2, 0.3)]
    return spark.createDataFrame(rows, "top_pct double, backtest_n bigint, campaign_n bigint")


@query(
    "new_entrants",
    O.with_(RANKS, "SELECT customer_id FROM ranked WHERE r_rw <= 20 AND r_po > 20"),
)
def q_new_entrants(spark: SparkSession, sf: str) -> DataFrame:
    rw = head(test_scored(spark, sf), S, 20).select(ID)
    po = head(test_scored(spark, sf), S, 20, "probability_only").select(ID)
    return rw.join(po, ID, "left_anti")


@query(
    "rank_correlation",
    O.with_(RANKS, "SELECT round(corr(r_rw, r_po), 9) AS spearman FROM ranked"),
)
def q_rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    rw = _ranking(spark, sf, "revenue_weighted").select(ID, F.col("rank").alias("r_rw"))
    po = _ranking(spark, sf, "probability_only").select(ID, F.col("rank").alias("r_po"))
    return M.spearman(rw.join(po, ID), "r_rw", "r_po", ranks=True)


@query(
    "backtest",
    O.with_(
        O.TEST_SCORED
        + """,
n AS (SELECT COUNT(*) AS n FROM test_scored),
ranks AS (
  SELECT customer_id, avg_order, churn,
    row_number() OVER (ORDER BY expected_revenue_at_risk DESC, customer_id) AS r_rw,
    row_number() OVER (ORDER BY churn_probability DESC, customer_id) AS r_po,
    row_number() OVER (ORDER BY md5('42:' || CAST(customer_id AS VARCHAR)), customer_id) AS r_rd
  FROM test_scored),
long AS (
  SELECT avg_order, churn, 'revenue_weighted' AS strategy, r_rw AS r FROM ranks
  UNION ALL SELECT avg_order, churn, 'probability_only', r_po FROM ranks
  UNION ALL SELECT avg_order, churn, 'random', r_rd FROM ranks),
tot AS (SELECT SUM(CASE WHEN churn = 'Yes' THEN avg_order ELSE 0.0 END) AS total FROM test_scored),
caught AS (
  SELECT l.strategy, CAST(round_even(CAST(0.2 AS DOUBLE) * n.n, 0) AS BIGINT) AS top_n,
         SUM(CASE WHEN l.churn = 'Yes' AND l.r <= round_even(CAST(0.2 AS DOUBLE) * n.n, 0) THEN l.avg_order ELSE 0.0 END) AS c
  FROM long l CROSS JOIN n GROUP BY l.strategy, n.n)""",
        """SELECT CAST(0.2 AS DOUBLE) AS top_pct, strategy, top_n, round(tot.total, 4) AS total_churned_revenue,
       round(c, 4) AS caught_revenue,
       round(CASE WHEN tot.total > 0 THEN 100.0 * c / tot.total ELSE 0.0 END, 6) AS caught_pct
FROM caught CROSS JOIN tot""",
    ),
)
def q_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return backtest(test_scored(spark, sf), S, (0.2,), seed=42)


# ---------------------------------------------------------------- metrics

SCORED_Y = O.TEST_SCORED + """,
sy AS (SELECT churn_probability AS s, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS y FROM test_scored),
sc AS (SELECT s, SUM(y) AS pos, SUM(1 - y) AS neg FROM sy GROUP BY s)"""


@query(
    "roc_auc",
    O.with_(
        SCORED_Y
        + """,
cum AS (SELECT s, pos, neg, SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM sc)""",
        """SELECT CAST(SUM(pos * (2 * (neg_cum - neg) + neg)) AS DOUBLE) / (2.0 * SUM(pos) * SUM(neg)) AS roc_auc FROM cum""",
    ),
)
def q_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    t = test_scored(spark, sf).withColumn("_y", binarize(F.col("churn"), "Yes"))
    return M.roc_auc(t, "_y", "churn_probability")


@query(
    "average_precision",
    O.with_(
        SCORED_Y
        + """,
cum AS (SELECT s, pos,
          SUM(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pc,
          SUM(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nc FROM sc)""",
        "SELECT round(SUM(pos * (CAST(pc AS DOUBLE) / (pc + nc))) / SUM(pos), 12) AS average_precision FROM cum",
    ),
)
def q_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    t = test_scored(spark, sf).withColumn("_y", binarize(F.col("churn"), "Yes"))
    return M.average_precision(t, "_y", "churn_probability")


@query(
    "classification_report",
    O.with_(
        O.TEST_SCORED
        + """,
p AS (SELECT CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS t,
             CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END AS p FROM test_scored),
c AS (SELECT SUM(CASE WHEN t=1 AND p=1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN t=0 AND p=1 THEN 1 ELSE 0 END) AS fp,
             SUM(CASE WHEN t=1 AND p=0 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN t=0 AND p=0 THEN 1 ELSE 0 END) AS tn FROM p),
m AS (SELECT *,
  CASE WHEN tp+fp > 0 THEN CAST(tp AS DOUBLE)/(tp+fp) ELSE 0.0 END AS p1,
  CASE WHEN tp+fn > 0 THEN CAST(tp AS DOUBLE)/(tp+fn) ELSE 0.0 END AS r1,
  CASE WHEN tn+fn > 0 THEN CAST(tn AS DOUBLE)/(tn+fn) ELSE 0.0 END AS p0,
  CASE WHEN tn+fp > 0 THEN CAST(tn AS DOUBLE)/(tn+fp) ELSE 0.0 END AS r0,
  tp+fn AS s1, tn+fp AS s0, tp+fn+tn+fp AS n FROM c),
f AS (SELECT *, CASE WHEN p1+r1 > 0 THEN 2.0*p1*r1/(p1+r1) ELSE 0.0 END AS f1,
                CASE WHEN p0+r0 > 0 THEN 2.0*p0*r0/(p0+r0) ELSE 0.0 END AS f0,
                CASE WHEN n > 0 THEN CAST(tp+tn AS DOUBLE)/n ELSE 0.0 END AS acc FROM m)""",
        """SELECT '0' AS label, round(p0, 12) AS precision, round(r0, 12) AS recall, round(f0, 12) AS f1_score, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', round(p1, 12), round(r1, 12), round(f1, 12), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0+p1)/2, 12), round((r0+r1)/2, 12), round((f0+f1)/2, 12), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg',
  round(CASE WHEN n > 0 THEN (p0*s0 + p1*s1)/n ELSE 0.0 END, 12), round(CASE WHEN n > 0 THEN (r0*s0 + r1*s1)/n ELSE 0.0 END, 12),
  round(CASE WHEN n > 0 THEN (f0*s0 + f1*s1)/n ELSE 0.0 END, 12), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', round(acc, 12), round(acc, 12), round(acc, 12), CAST(n AS BIGINT) FROM f""",
    ),
)
def q_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    t = test_scored(spark, sf).select(yes_no_lenient(F.col("churn")).alias("_t"), classify_at(0.5).alias("_p"))
    return M.classification_report(t, "_t", "_p")


@query(
    "regression_metrics",
    O.with_(
        O.CLEAN,
        """SELECT round(sqrt(SUM(e*e) / COUNT(*)), 6) AS rmse, round(SUM(abs(e)) / COUNT(*), 6) AS mae,
       round(1.0 - SUM(e*e) / (SUM(y*y) - SUM(y)*SUM(y)/COUNT(*)), 6) AS r2
FROM (SELECT total_spend AS y, total_spend - avg_order * (tenure_months + 1) AS e FROM clean)""",
    ),
)
def q_regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaned(spark, sf).withColumn("_pred", F.col("avg_order") * (F.col("tenure_months") + 1))
    return M.regression_metrics(df, "total_spend", "_pred")


@query(
    "concordance_index",
    O.with_(
        O.CLEAN
        + f""",
s AS (SELECT tenure_months AS t, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS e, {O.SCORE} AS r FROM clean),
pairs AS (
  SELECT SUM(CASE WHEN b.r < a.r THEN 2 WHEN b.r = a.r THEN 1 ELSE 0 END) AS num2, COUNT(*) AS den
  FROM s a JOIN s b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))""",
        "SELECT CAST(num2 AS DOUBLE) / (2.0 * den) AS c_index FROM pairs",
    ),
)
def q_concordance_index(spark: SparkSession, sf: str) -> DataFrame:
    df = ClosedFormScorer().transform(cleaned(spark, sf)).withColumn("_e", binarize(F.col("churn"), "Yes"))
    return M.concordance_index(df, "tenure_months", "_e", "churn_probability")


@query(
    "risk_set_counts",
    O.with_(
        O.CLEAN,
        """SELECT t AS tenure_months, CAST(n AS BIGINT) AS n_rows, CAST(d AS BIGINT) AS events,
       CAST(SUM(n) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS at_risk
FROM (SELECT tenure_months AS t, COUNT(*) AS n, SUM(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END) AS d
      FROM clean GROUP BY tenure_months)""",
    ),
)
def q_risk_set_counts(spark: SparkSession, sf: str) -> DataFrame:
    per = cleaned(spark, sf).groupBy("tenure_months").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum(binarize(F.col("churn"), "Yes")).cast("bigint").alias("events"),
    )
    return prefix_sums(per, [("tenure_months", False)], ["n_rows"]).withColumnRenamed("n_rows_cum", "at_risk")


LEAK_FEATURES = ["n_orders", "tenure_days", "recency_days", "avg_order", "total_spend"]


@query(
    "leakage_screen",
    O.with_(
        O.CLEAN
        + """,
y AS (SELECT *, CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END AS yy FROM clean),
r AS ("""
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, yy), 9) AS correlation FROM y" for c in LEAK_FEATURES)
        + ")",
        "SELECT feature, correlation, COALESCE(abs(correlation) >= 0.9, false) AS leaky FROM r",
    ),
)
def q_leakage_screen(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaned(spark, sf).withColumn("_y", binarize(F.col("churn"), "Yes"))
    return M.leakage_screen(df, "_y", LEAK_FEATURES)


# ---------------------------------------------------------------- segments / explain

NUMERIC = ["n_orders", "tenure_days", "recency_days", "avg_order"]


@query(
    "scale_features",
    O.with_(
        O.CLEAN,
        "SELECT customer_id, "
        + ", ".join(
            f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END, 9) AS {c}"
            for c in NUMERIC
        )
        + " FROM clean",
    ),
)
def q_scale_features(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaned(spark, sf)
    z = scale(df, scale_stats(df, NUMERIC), keep=[ID])
    return z.select(ID, *[F.round(F.col(c), 9).alias(c) for c in NUMERIC])


CLUSTER_RULE = "least(4, CAST(floor(tenure_months / 12.0) AS BIGINT))"
# Label texts of the rule-based tenure clusters (cluster 4 has
# none on purpose, to exercise the default).
RULE_LABELS = [(0, "under one year"), (1, "one to two years"), (2, "two to three years"), (3, "three to four years")]


@query(
    "cluster_profile",
    O.with_(
        O.CLEAN
        + f""",
a AS (SELECT *, {CLUSTER_RULE} AS cluster FROM clean),
modes AS (SELECT cluster, contract FROM (
  SELECT cluster, contract, row_number() OVER (PARTITION BY cluster ORDER BY COUNT(*) DESC, contract) AS rn
  FROM a GROUP BY cluster, contract) WHERE rn = 1),
lab AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{v}')" for k, v in RULE_LABELS)}) t(cluster, label)),
prof AS (SELECT cluster, COUNT(*) AS size, AVG(CAST(tenure_months AS DOUBLE)) AS mean_tenure,
                AVG(avg_order) AS mean_avg_order, 100.0 * AVG(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END) AS churn_rate_pct
         FROM a GROUP BY cluster)""",
        """SELECT p.cluster, CAST(p.size AS BIGINT) AS size, round(100.0 * p.size / SUM(p.size) OVER (), 9) AS pct_of_total,
       round(p.mean_tenure, 9) AS mean_tenure, round(p.mean_avg_order, 6) AS mean_avg_order,
       m.contract AS dominant_segment, round(p.churn_rate_pct, 9) AS churn_rate_pct, COALESCE(l.label, 'unlabeled') AS label
FROM prof p JOIN modes m ON m.cluster = p.cluster LEFT JOIN lab l ON l.cluster = p.cluster""",
    ),
)
def q_cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaned(spark, sf)
    assign = df.select(ID, F.least(F.lit(4), F.floor(F.col("tenure_months") / 12.0)).cast("bigint").alias("cluster"))
    labels = spark.createDataFrame(RULE_LABELS, "cluster bigint, label string")
    prof = profile_clusters(df, assign, ID, "tenure_months", "avg_order", "contract", "churn", "Yes", labels)
    return prof.select(
        "cluster",
        "size",
        F.round("pct_of_total", 9).alias("pct_of_total"),
        F.round("mean_tenure", 9).alias("mean_tenure"),
        F.round("mean_avg_order", 6).alias("mean_avg_order"),
        "dominant_segment",
        F.round("churn_rate_pct", 9).alias("churn_rate_pct"),
        "label",
    )


SCALED = O.CLEAN + """,
z AS (SELECT customer_id, least(4, CAST(floor(tenure_months / 12.0) AS BIGINT)) AS cluster, """ + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in NUMERIC
) + " FROM clean)"


@query(
    "silhouette_fixed",
    O.with_(
        SCALED
        + """,
sizes AS (SELECT cluster, COUNT(*) AS n FROM z GROUP BY cluster),
sums AS (SELECT a.customer_id, a.cluster AS own, b.cluster, SUM(sqrt("""
        + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NUMERIC)
        + """)) AS s FROM z a CROSS JOIN z b GROUP BY a.customer_id, a.cluster, b.cluster),
ab AS (SELECT customer_id, own, MAX(CASE WHEN s.cluster = own THEN s / (n - 1) END) AS a,
              MIN(CASE WHEN s.cluster <> own THEN s / n END) AS b, MAX(CASE WHEN s.cluster = own THEN n END) AS n
       FROM sums s JOIN sizes USING (cluster) GROUP BY customer_id, own)""",
        """SELECT customer_id, own AS cluster, round(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END, 9) AS silhouette
FROM ab""",
    ),
)
def q_silhouette_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's Euclidean silhouette for the tenure clusters."""
    df = cleaned(spark, sf)
    cluster = F.least(F.lit(4), F.floor(F.col("tenure_months") / 12.0)).cast("bigint")
    z = scale(df, scale_stats(df, NUMERIC), keep=[ID, "tenure_months"]).withColumn("cluster", cluster)
    found = point_silhouettes(z, ID, NUMERIC, {"cluster": 5}).withColumnRenamed("cluster", "silhouette")
    return z.select(ID, "cluster").join(found, ID).select(ID, "cluster", F.round("silhouette", 9).alias("silhouette"))


# Starting centres of two models, in scaled units.
STEP_CENTERS = [
    [[-1.0, -0.5, 0.0, 0.5], [1.0, 0.5, 0.0, -0.5]],
    [[0.0, 1.0, -0.5, 0.0], [0.5, -1.5, 0.5, 1.0], [-1.0, 0.0, 1.5, -1.0]],
]


@query(
    "lloyd_step_fixed",
    O.with_(
        SCALED
        + ",\nc AS (SELECT * FROM (VALUES "
        + ", ".join(
            f"({m}, {k}, " + ", ".join(f"CAST({x} AS DOUBLE)" for x in center) + ")"
            for m, model in enumerate(STEP_CENTERS)
            for k, center in enumerate(model)
        )
        + f") t(model, cluster, {', '.join(f'c{i}' for i in range(len(NUMERIC)))})),"
        + "\nd AS (SELECT z.*, c.model, c.cluster AS k, "
        + " + ".join(f"({f} - c{i}) * ({f} - c{i})" for i, f in enumerate(NUMERIC))
        + """ AS d FROM z CROSS JOIN c),
own AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY model, customer_id ORDER BY d, k) = 1),
t AS (SELECT model, SUM(d) AS inertia FROM own GROUP BY model)""",
        "SELECT CAST(model AS BIGINT) AS model, CAST(k AS BIGINT) AS cluster, CAST(COUNT(*) AS BIGINT) AS n, "
        + ", ".join(f"round(avg({f}), 8) AS {f}" for f in NUMERIC)
        + ", round(any_value(inertia), 5) AS inertia FROM own JOIN t USING (model) GROUP BY model, k",
    ),
)
def q_lloyd_step_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """One shared scan for two models with given centres: the new centres."""
    df = cleaned(spark, sf)
    z = scale(df, scale_stats(df, NUMERIC), keep=[ID])
    models = [np.array(m) for m in STEP_CENTERS]
    rows = []
    for m, (step, centers) in enumerate(zip(lloyd.scan(lloyd.points(z, ID, NUMERIC), NUMERIC, models), models)):
        for k, center in enumerate(step.moved(centers)):
            rows.append((m, k, int(step.n[k]), *(round(float(x), 8) for x in center), round(step.inertia, 5)))
    schema = "model bigint, cluster bigint, n bigint, " + ", ".join(f"{f} double" for f in NUMERIC) + ", inertia double"
    return spark.createDataFrame(rows, schema)


@query(
    "profile_saved_fixed",
    O.with_(
        SCALED
        + ",\nc AS (SELECT * FROM (VALUES "
        + ", ".join(f"({k}, " + ", ".join(f"CAST({x} AS DOUBLE)" for x in center) + ")" for k, center in enumerate(STEP_CENTERS[1]))
        + f") t(k, {', '.join(f'c{i}' for i in range(len(NUMERIC)))})),"
        + "\nd AS (SELECT z.customer_id, c.k, "
        + " + ".join(f"({f} - c{i}) * ({f} - c{i})" for i, f in enumerate(NUMERIC))
        + """ AS d FROM z CROSS JOIN c),
a AS (SELECT clean.*, own.k FROM clean JOIN (SELECT customer_id, k FROM d
      QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY d, k) = 1) own USING (customer_id)),
modes AS (SELECT k, contract FROM a GROUP BY k, contract
          QUALIFY row_number() OVER (PARTITION BY k ORDER BY COUNT(*) DESC, contract) = 1),
prof AS (SELECT k, COUNT(*) AS size, AVG(CAST(tenure_months AS DOUBLE)) AS t, AVG(avg_order) AS m,
                100.0 * AVG(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END) AS c FROM a GROUP BY k)""",
        """SELECT CAST(k AS BIGINT) AS cluster, CAST(size AS BIGINT) AS size, round(100.0 * size / SUM(size) OVER (), 9) AS pct_of_total,
       round(t, 9) AS mean_tenure, round(m, 6) AS mean_avg_order, contract AS dominant_segment, round(c, 9) AS churn_rate_pct,
       CASE k WHEN 0 THEN 'under one year' WHEN 1 THEN 'one to two years' ELSE 'two to three years' END AS label
FROM prof JOIN modes USING (k)""",
    ),
)
def q_profile_saved_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer assigned by a saved and reloaded segmentation of given
    centres, and profiled."""
    df, path = cleaned(spark, sf), new_path(spark, "segments")
    Segmentation(3, STEP_CENTERS[1], scale_stats(df, NUMERIC), NUMERIC, None).save(spark, path)
    assigned = Segmentation.load(spark, path).assign(df, ID)
    labels = spark.createDataFrame(RULE_LABELS, "cluster bigint, label string")
    prof = profile_clusters(df, assigned, ID, "tenure_months", "avg_order", "contract", "churn", "Yes", labels)
    digits = {"pct_of_total": 9, "mean_tenure": 9, "mean_avg_order": 6, "churn_rate_pct": 9}
    return prof.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "outcome_by_group",
    O.with_(
        O.CLEAN,
        """SELECT contract, CAST(COUNT(*) AS BIGINT) AS n,
       round(100.0 * AVG(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END), 9) AS churn_rate_pct
FROM clean GROUP BY contract""",
    ),
)
def q_outcome_by_group(spark: SparkSession, sf: str) -> DataFrame:
    out = outcome_by_group(cleaned(spark, sf), "contract", "churn", "Yes")
    return out.select("contract", F.col("n").cast("bigint").alias("n"), F.round("churn_rate_pct", 9).alias("churn_rate_pct"))


EXPLAIN_FEATURES = ["contract", "nation", "n_orders", "tenure_days", "tenure_months", "recency_days", "avg_order", "total_spend"]


@query(
    "feature_means",
    O.with_(
        TRAIN + ENC,
        "SELECT "
        + ", ".join(
            (f"round(AVG({enc_expr('train', c)}), 9) AS {c}" if c in CATS else f"round(AVG({c}), 6) AS {c}")
            for c in EXPLAIN_FEATURES
        )
        + " FROM train",
    ),
)
def q_feature_means(spark: SparkSession, sf: str) -> DataFrame:
    train = _train(spark, sf)
    enc = encode(train, fit_encoders(train, CATS), CATS)
    means = feature_means(enc, EXPLAIN_FEATURES)
    return means.select(*[F.round(c, 9 if c in CATS else 6).alias(c) for c in EXPLAIN_FEATURES])


@query(
    "feature_medians",
    O.with_(
        O.CLEAN,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median FROM clean" for c in NUMERIC
        ),
    ),
)
def q_feature_medians(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(medians(cleaned(spark, sf), NUMERIC).items()), "feature string, median double")


@query(
    "explain_closed_form",
    O.with_(
        TRAIN
        + f""",
mr AS (SELECT AVG(recency_days) AS m FROM train),
base AS (SELECT customer_id, {O.SCORE} AS p0, CAST(recency_days AS DOUBLE) AS r FROM test),
eff AS (
  SELECT customer_id, p0, k, feature,
         CASE WHEN feature = 'recency_days' THEN p0 - (mr.m / (mr.m + 180.0)) ELSE p0 - p0 END AS contribution
  FROM base CROSS JOIN mr CROSS JOIN (VALUES {", ".join(f"({i}, '{f}')" for i, f in enumerate(EXPLAIN_FEATURES))}) t(k, feature)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, k) AS rank FROM eff)""",
        """SELECT customer_id, p0 AS churn_probability, CAST(rank AS BIGINT) AS rank, feature, contribution,
       CASE WHEN contribution > 0 THEN 'up' ELSE 'down' END AS direction
FROM ranked WHERE rank <= 3""",
    ),
)
def q_explain_closed_form(spark: SparkSession, sf: str) -> DataFrame:
    train = split_of(spark, sf, "train")
    enc = fit_encoders(train, CATS)
    tr = align_features(encode(train, enc, CATS), EXPLAIN_FEATURES)
    means = feature_means(tr, EXPLAIN_FEATURES).collect()[0].asDict()
    test = align_features(encode(split_of(spark, sf, "test"), enc, CATS), EXPLAIN_FEATURES, keep=[ID])
    means = {c: means[c] for c in EXPLAIN_FEATURES}
    return explain_scores(test, ID, EXPLAIN_FEATURES, means, ClosedFormScorer().substituted)


# The bin edges of the single tree that SQL can grow as well.
TREE_EDGES = {
    "n_orders": [2.5, 5.5, 8.5, 11.5, 14.5, 17.5],
    "tenure_days": [365.5, 730.5, 1095.5, 1460.5, 1825.5],
    "recency_days": [30.5, 90.5, 180.5, 270.5, 365.5, 730.5],
    "avg_order": [100000.5, 125000.5, 150000.5, 175000.5, 200000.5],
}


def _splits_sql(source: str, out: str) -> str:
    """The best split of each node of ``source`` (node, r and the features)."""
    return f"""
c_{out} AS (
  SELECT node, f, e, SUM(CASE WHEN x <= e THEN r ELSE 0 END) AS sl, SUM(CASE WHEN x <= e THEN 1 ELSE 0 END) AS nl,
         SUM(r) AS s, COUNT(*) AS n
  FROM ({" UNION ALL ".join(f"SELECT node, r, {k} AS f, CAST({c} AS DOUBLE) AS x FROM {source}" for k, c in enumerate(TREE_EDGES))}) x
  JOIN edges USING (f) GROUP BY node, f, e),
{out} AS (
  SELECT node, f, e FROM c_{out} WHERE nl > 0 AND nl < n
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n, 9) DESC, f, e) = 1)"""


_SIDE = "CASE s.f " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(TREE_EDGES)) + " END <= s.e"


@query(
    "tree_fit_fixed",
    O.with_(
        TRAIN
        + """,
edges AS (SELECT * FROM (VALUES """
        + ", ".join(f"({k}, CAST({e} AS DOUBLE))" for k, es in enumerate(TREE_EDGES.values()) for e in es)
        + """) t(f, e)),
y AS (SELECT *, CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END AS y FROM train),
g0 AS (SELECT *, 'root' AS node, y - avg(y) OVER () AS r, avg(y) OVER () * (1 - avg(y) OVER ()) AS h FROM y),"""
        + _splits_sql("g0", "s0")
        + f""",
g1 AS (SELECT g0.* EXCLUDE (node), CASE WHEN {_SIDE} THEN 'root.l' ELSE 'root.r' END AS node FROM g0 JOIN s0 s USING (node)),"""
        + _splits_sql("g1", "s1")
        + f""",
g2 AS (SELECT g1.* EXCLUDE (node), g1.node || CASE WHEN {_SIDE} THEN '.l' ELSE '.r' END AS node FROM g1 JOIN s1 s USING (node)),
every AS (SELECT node, r, h FROM g0 UNION ALL SELECT node, r, h FROM g1 UNION ALL SELECT node, r, h FROM g2),
names AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{c}')" for k, c in enumerate(TREE_EDGES))}) t(f, feature)),
chosen AS (SELECT * FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1) JOIN names USING (f))""",
        """SELECT e.node, c.feature, c.e AS threshold, CAST(COUNT(*) AS BIGINT) AS n_rows, round(SUM(r) / SUM(h), 9) AS value
FROM every e LEFT JOIN chosen c ON c.node = e.node GROUP BY e.node, c.feature, c.e""",
    ),
)
def q_tree_fit_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """One boosted tree of depth two with given bins: splits by residual
    sums, leaves by Newton steps from the log-odds start."""
    train = split_of(spark, sf, "train").withColumn("_y", binarize(F.col("churn"), "Yes"))
    names = list(TREE_EDGES)
    edges = [np.array(e) for e in TREE_EDGES.values()]
    model = fit_trees(train, names, "_y", names, train.count(), True, n_trees=1, depth=2, rate=0.05, edges=edges)
    return spark.createDataFrame(_node_rows(model.trees[0], names), "node string, feature string, threshold double, n_rows bigint, value double")


def _node_rows(tree: list[Node], names: list[str], at: int = 0, path: str = "root") -> list[tuple]:
    node = tree[at]
    inner = node.feature >= 0
    rows = [(path, names[node.feature] if inner else None, node.threshold if inner else None, node.rows, round(node.value, 9))]
    for side, child in (("l", node.left), ("r", node.right)):
        rows += _node_rows(tree, names, child, f"{path}.{side}") if inner else []
    return rows


# Two small trees on the customer's features, rate 0.5 and start -0.25.
FIXED_TREES = [
    [Node(2, 180.0, 1, 2), Node(0, 5.0, 3, 4), Node(1, 900.0, 5, 6)] + [Node(value=v) for v in (-0.8, 0.3, 0.9, 1.7)],
    [Node(3, 140000.0, 1, 2), Node(value=-0.4), Node(2, 365.0, 3, 4), Node(value=0.2), Node(value=1.1)],
]


def _fixed_sql(columns: dict[str, str]) -> str:
    x = {c: columns.get(c, c) for c in NUMERIC}
    first = f"""CASE WHEN {x['recency_days']} <= 180 THEN CASE WHEN {x['n_orders']} <= 5 THEN -0.8 ELSE 0.3 END
      ELSE CASE WHEN {x['tenure_days']} <= 900 THEN 0.9 ELSE 1.7 END END"""
    second = f"""CASE WHEN {x['avg_order']} <= 140000 THEN -0.4 ELSE CASE WHEN {x['recency_days']} <= 365 THEN 0.2 ELSE 1.1 END END"""
    return f"1 / (1 + exp(-(-0.25 + 0.5 * (CAST({first} AS DOUBLE) + CAST({second} AS DOUBLE)))))"


@query(
    "explain_fixed_trees",
    O.with_(
        TRAIN
        + ",\nm AS (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}" for c in NUMERIC)
        + " FROM train),\neff AS ("
        + " UNION ALL ".join(
            f"SELECT customer_id, {_fixed_sql({})} AS p, {k} AS k, '{c}' AS feature, {_fixed_sql({c: 'm_' + c})} AS q FROM test CROSS JOIN m"
            for k, c in enumerate(NUMERIC)
        )
        + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(abs(p - q), 12) DESC, k) AS rank FROM eff)""",
        """SELECT customer_id, round(p, 9) AS churn_probability, CAST(rank AS BIGINT) AS rank, feature, round(p - q, 9) AS contribution,
       CASE WHEN round(p - q, 12) > 0 THEN 'up' ELSE 'down' END AS direction
FROM ranked WHERE rank <= 3""",
    ),
)
def q_explain_fixed_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Marginal effects under two given trees."""
    model = BoostedTrees(-0.25, 0.5, True, NUMERIC, FIXED_TREES)
    inputs = [f"_f{k}" for k in range(len(NUMERIC))]
    cols = [F.col(c).cast("double").alias(n) for c, n in zip(NUMERIC, inputs)]
    means = split_of(spark, sf, "train").select(*cols).agg(*[F.avg(n).alias(n) for n in inputs]).collect()[0].asDict()
    test = split_of(spark, sf, "test").select(ID, *cols)
    found = explain_scores(test, ID, NUMERIC, means, lambda df, m: substituted_scores(model, df, inputs, m))
    return found.withColumns({c: F.round(c, 9) for c in ("churn_probability", "contribution")})


@query(
    "lookup_status",
    O.with_(
        O.CLEAN + "," + O.split_cte(),
        """SELECT c.c_custkey AS customer_id,
       CASE WHEN m.split IS NULL THEN 'not_found' WHEN m.split = 'test' THEN 'ok' ELSE 'not_in_test' END AS status
FROM customer c LEFT JOIN manifest m ON m.id = c.c_custkey""",
    ),
)
def q_lookup_status(spark: SparkSession, sf: str) -> DataFrame:
    ids = read_table(spark, sf, "customer").select(F.col("c_custkey").alias(ID))
    return lookup_status(ids, manifest(spark, sf), ID)


# ---------------------------------------------------------------- tables / reports


@query(
    "pack_customers",
    O.with_(
        O.SNAP,
        """SELECT tenant_id, CAST(customer_id AS VARCHAR) AS customer_id, contract, n_orders, total_spend, churn
FROM snap""",
    ),
)
def q_pack_customers(spark: SparkSession, sf: str) -> DataFrame:
    packed = pack_customers(snapshot(spark, sf), S, LOAD_TS, tenant_column="tenant_id")
    j = F.col("raw_features")
    return packed.select(
        "tenant_id",
        "customer_id",
        F.get_json_object(j, "$.contract").alias("contract"),
        F.get_json_object(j, "$.n_orders").cast("bigint").alias("n_orders"),
        F.get_json_object(j, "$.total_spend").alias("total_spend"),
        F.get_json_object(j, "$.churn").alias("churn"),
    )


@query(
    "tenant_scope",
    O.with_(
        O.SNAP,
        """SELECT 'ASIA' AS asked, customer_id, contract, churn FROM snap WHERE tenant_id = 'ASIA'
UNION ALL SELECT '1', customer_id, contract, churn FROM snap""",
    ),
)
def q_tenant_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written for several tenants - look-alike names among them - and
    one tenant read back through the operator."""
    rows = snapshot(spark, sf).select(ID, "contract", "churn", "tenant_id")
    path = _sink_dir(spark, "scoped")
    alike = [rows.withColumn("tenant_id", F.lit(t)) for t in ("1", "001", "1.0")]
    write_partitioned(rows.unionByName(alike[0]).unionByName(alike[1]).unionByName(alike[2]), path, ["tenant_id"])
    one = tenant_scope(spark, path, "1").select(F.lit("1").alias("asked"), ID, "contract", "churn")
    asia = tenant_scope(spark, path, "ASIA").select(F.lit("ASIA").alias("asked"), ID, "contract", "churn")
    return asia.unionByName(one)


@query(
    "score_population",
    O.with_(
        O.CLEAN,
        f"""SELECT tenant_id, CAST(customer_id AS VARCHAR) AS customer_id, 'closed_form_v1' AS model_version,
       {O.SCORE} AS churn_probability FROM clean""",
    ),
)
def q_score_population(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaned(spark, sf)
    rows = score_population(df, ClosedFormScorer(), S, "snapshot", "closed_form_v1", LOAD_TS)
    tenants = df.select(F.col(ID).cast("string").alias("customer_id"), "tenant_id")
    return rows.drop("tenant_id", "predicted_at").join(tenants, "customer_id")


ANOMALY_SCORE = "-CAST(abs(recency_days - 180) AS DOUBLE) / 100.0"


@query(
    "anomaly_report",
    O.with_(
        O.CLEAN
        + f""",
sc AS (SELECT customer_id, {ANOMALY_SCORE} AS raw FROM clean),
off AS (SELECT quantile_cont(raw, 0.05) AS o FROM sc),
res AS (SELECT customer_id, CASE WHEN raw - o < 0 THEN -1 ELSE 1 END AS anomaly_flag, raw - o AS anomaly_score FROM sc, off)""",
        """SELECT customer_id, CAST(anomaly_flag AS BIGINT) AS anomaly_flag, round(anomaly_score, 9) AS anomaly_score
FROM res WHERE anomaly_flag = -1 ORDER BY anomaly_score, customer_id LIMIT 5""",
    ),
)
def q_anomaly_report(spark: SparkSession, sf: str) -> DataFrame:
    raw = cleaned(spark, sf).select(
        ID, (-F.abs(F.col("recency_days") - 180).cast("double") / F.lit(100.0)).alias("raw_score")
    )
    off = quantiles(raw, ["raw_score"], [0.05])["raw_score"][0]
    rep = anomaly_report(flag(raw, off, ID), ID, 5)
    return rep.select(ID, "anomaly_flag", F.round("anomaly_score", 9).alias("anomaly_score"))


# A small forest (tree, node, feature, threshold, left, right,
# size, depth), grown on eight rows.
FIXED_FOREST = [
    (0, 0, 2, 180.0, 1, 2, 8, 0),
    (0, 1, 0, 6.0, 3, 4, 5, 1),
    (0, 2, -1, 0.0, -1, -1, 3, 1),
    (0, 3, -1, 0.0, -1, -1, 1, 2),
    (0, 4, -1, 0.0, -1, -1, 4, 2),
    (1, 0, 3, 150000.0, 1, 2, 8, 0),
    (1, 1, -1, 0.0, -1, -1, 2, 1),
    (1, 2, 1, 1200.0, 3, 4, 6, 1),
    (1, 3, -1, 0.0, -1, -1, 5, 2),
    (1, 4, -1, 0.0, -1, -1, 1, 2),
]


def _path(n: int) -> str:
    """SQL of c(n), the mean path length of a search in n rows."""
    if n < 3:
        return "1.0" if n == 2 else "0.0"
    return f"(2.0 * (ln({n - 1}.0) + 0.5772156649015329) - 2.0 * {n - 1}.0 / {n}.0)"


@query(
    "forest_score_fixed",
    O.with_(
        O.CLEAN
        + f""",
h AS (SELECT customer_id,
  CASE WHEN recency_days < 180 THEN CASE WHEN n_orders < 6 THEN 2.0 + {_path(1)} ELSE 2.0 + {_path(4)} END ELSE 1.0 + {_path(3)} END AS a,
  CASE WHEN avg_order < 150000 THEN 1.0 + {_path(2)} ELSE CASE WHEN tenure_days < 1200 THEN 2.0 + {_path(5)} ELSE 2.0 + {_path(1)} END END AS b
FROM clean)""",
        f"SELECT customer_id, round(-pow(2.0, -((CAST(a AS DOUBLE) + CAST(b AS DOUBLE)) / 2.0) / {_path(8)}), 9) AS raw_score FROM h",
    ),
)
def q_forest_score_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's score under a given forest, saved and reloaded."""
    columns = ["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]
    path = new_path(spark, "forest")
    Forest(NUMERIC, pd.DataFrame(FIXED_FOREST, columns=columns), max_samples=8).save(spark, path)
    forest = Forest.load(spark, path)
    return forest.score_samples(cleaned(spark, sf), [ID]).withColumn("raw_score", F.round("raw_score", 9))


@query(
    "expectations",
    O.with_(
        O.CLEAN,
        """SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
       CAST(SUM(CASE WHEN churn NOT IN ('Yes','No') OR churn IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_label,
       CAST(SUM(CASE WHEN tenure_months < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_duration,
       CAST(COUNT(*) - COUNT(DISTINCT customer_id) AS BIGINT) AS duplicate_ids,
       CAST(SUM(CASE WHEN total_spend IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_total,
       CAST(SUM(CASE WHEN tenure_months = 0 AND total_spend <> avg_order THEN 1 ELSE 0 END) AS BIGINT) AS zero_duration_total_mismatch
FROM clean""",
    ),
)
def q_expectations(spark: SparkSession, sf: str) -> DataFrame:
    return expectations(cleaned(spark, sf), ID, "churn", ["Yes", "No"], "tenure_months", "total_spend", "avg_order")


@query(
    "ranking_expectations",
    O.with_(
        RANKS,
        """SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
       CAST(SUM(CASE WHEN churn_probability < 0 OR churn_probability > 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad_probability,
       CAST(SUM(CASE WHEN avg_order < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_revenue,
       CAST(SUM(CASE WHEN expected_revenue_at_risk < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_risk,
       CAST(MIN(r_rw) AS BIGINT) AS min_rank, CAST(MAX(r_rw) AS BIGINT) AS max_rank,
       CAST(COUNT(DISTINCT r_rw) AS BIGINT) AS distinct_ranks
FROM ranked""",
    ),
)
def q_ranking_expectations(spark: SparkSession, sf: str) -> DataFrame:
    return ranking_expectations(_ranking(spark, sf, "revenue_weighted"), "avg_order")


def _sink_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for each run: no run destroys another's result."""
    return new_path(spark, name)


@query(
    "file_sink_round_trip",
    O.with_(O.CLEAN, "SELECT customer_id, contract, tenure_months, avg_order, total_spend, churn FROM clean"),
)
def q_file_sink_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Write the cleaned table as CSV (header, no index), read it back with
    its schema."""
    df = cleaned(spark, sf).select(ID, "contract", "tenure_months", "avg_order", "total_spend", "churn")
    path = _sink_dir(spark, "cleaned_csv")
    write_table(df, path, "csv")
    return read_table_as(spark, path, df.schema, "csv")


@query(
    "customer_listing",
    O.with_(
        O.SNAP,
        """SELECT CAST(customer_id AS VARCHAR) AS customer_id, tenant_id, contract, n_orders
FROM snap WHERE tenant_id = 'ASIA'""",
    ),
)
def q_customer_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Pack every raw row into the tenant-partitioned customers table, then
    list the caller's tenant only (partition pruning on tenant_id)."""
    path = _sink_dir(spark, "customers")
    write_partitioned(pack_customers(snapshot(spark, sf), S, LOAD_TS, tenant_column="tenant_id"), path, ["tenant_id"])
    j = F.col("raw_features")
    return tenant_scope(spark, path, "ASIA", CUSTOMERS_SCHEMA).select(
        "customer_id",
        "tenant_id",
        F.get_json_object(j, "$.contract").alias("contract"),
        F.get_json_object(j, "$.n_orders").cast("bigint").alias("n_orders"),
    )


@query(
    "roc_auc_by_tenant",
    O.with_(
        O.TEST_SCORED
        + """,
sy AS (SELECT tenant_id, churn_probability AS s, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS y FROM test_scored),
sc AS (SELECT tenant_id, s, SUM(y) AS pos, SUM(1 - y) AS neg FROM sy GROUP BY tenant_id, s),
cum AS (SELECT tenant_id, s, pos, neg,
          SUM(neg) OVER (PARTITION BY tenant_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum
        FROM sc),
agg AS (SELECT tenant_id, SUM(pos) AS P, SUM(neg) AS N, SUM(pos * (2 * (neg_cum - neg) + neg)) AS num2
        FROM cum GROUP BY tenant_id)""",
        """SELECT tenant_id, CAST(P + N AS BIGINT) AS n, CAST(P AS DOUBLE) / (P + N) AS positive_rate,
       CASE WHEN P > 0 AND N > 0 THEN CAST(num2 AS DOUBLE) / (2.0 * P * N) END AS roc_auc
FROM agg""",
    ),
)
def q_roc_auc_by_tenant(spark: SparkSession, sf: str) -> DataFrame:
    """Per-tenant evaluation of one scoring on the test split."""
    t = test_scored(spark, sf).withColumn("_y", binarize(F.col("churn"), "Yes"))
    return M.roc_auc_by(t, "tenant_id", "_y", "churn_probability")


# ---------------------------------------------------------------- edge cases on the given tables


@query(
    "load_csv",
    O.with_(
        O.SNAP,
        """SELECT customer_id, CASE WHEN customer_id % 7 <> 0 THEN contract END AS contract,
       CAST(CASE WHEN customer_id % 5 <> 0 THEN tenure_months END AS DOUBLE) AS tenure_months,
       n_orders, avg_order, churn
FROM snap""",
    ),
)
def q_load_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The raw table as a CSV file with missing markers in a text and in a
    numeric column, loaded and typed by ``load_tenant``."""
    raw = snapshot(spark, sf).select(ID, "contract", "tenure_months", "n_orders", "avg_order", "churn")
    marked = raw.withColumns(
        {
            "contract": F.when(F.col(ID) % 7 == 0, F.lit("NULL")).otherwise(F.col("contract")),
            "tenure_months": F.when(F.col(ID) % 5 == 0, F.lit("NA")).otherwise(F.col("tenure_months").cast("string")),
        }
    )
    path = _sink_dir(spark, "raw_csv")
    write_table(marked, path, "csv")
    spec = TenantSpec("csv", ID, "churn", "Yes", "avg_order")
    return load_tenant(spark, spec, path, "csv")


@query(
    "encode_all_missing",
    O.with_(TRAIN, "SELECT customer_id, CAST(-1.0 AS DOUBLE) AS contract FROM test"),
)
def q_encode_all_missing(spark: SparkSession, sf: str) -> DataFrame:
    """A category that no training row has: -1 for every row."""
    train = _train(spark, sf).withColumn("contract", F.lit(None).cast("string"))
    encoders = fit_encoders(train, ["contract"])
    return encode(split_of(spark, sf, "test").select(ID, "contract"), encoders, ["contract"])


@query(
    "enrich_keeps_duplicates",
    O.with_(
        O.CLEAN,
        """SELECT c.customer_id, c.contract, o.o_orderkey AS order_key, o.o_totalprice AS price
FROM clean c LEFT JOIN orders o ON o.o_custkey = c.customer_id""",
    ),
)
def q_enrich_keeps_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """An extended table with many rows per id keeps them all."""
    orders = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias(ID), F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price")
    )
    return enrich_base_wins(cleaned(spark, sf).select(ID, "contract"), orders, ID, ["order_key", "price"])


@query(
    "regression_constant_target",
    """SELECT round(sqrt(avg(power(1.0 - l_quantity, 2))), 6) AS rmse, round(avg(abs(1.0 - l_quantity)), 6) AS mae,
       CAST(0.0 AS DOUBLE) AS r2
FROM lineitem""",
)
def q_regression_constant_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "lineitem").select(F.lit(1.0).alias("y"), F.col("l_quantity").cast("double").alias("p"))
    return M.regression_metrics(rows, "y", "p")


@query(
    "classification_unknown_labels",
    O.with_(
        O.TEST_SCORED,
        """SELECT 'unknown' AS label, CAST(COUNT(*) AS BIGINT) AS support FROM test_scored WHERE customer_id % 10 = 0
HAVING COUNT(*) > 0
UNION ALL SELECT 'weighted avg', CAST(COUNT(*) AS BIGINT) FROM test_scored WHERE customer_id % 10 <> 0""",
    ),
)
def q_classification_unknown_labels(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col(ID) % 10 != 0, yes_no_lenient(F.col("churn")))
    t = test_scored(spark, sf).select(label.alias("_t"), classify_at(0.5).alias("_p"))
    report = M.classification_report(t, "_t", "_p")
    return report.filter(F.col("label").isin("unknown", "weighted avg")).select("label", "support")


@query(
    "concordance_fractional",
    O.with_(
        O.CLEAN
        + f""",
s AS (SELECT tenure_days / 30.5 AS t, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS e, round({O.SCORE}, 2) AS r FROM clean),
pairs AS (
  SELECT SUM(CASE WHEN b.r < a.r THEN 2 WHEN b.r = a.r THEN 1 ELSE 0 END) AS num2, COUNT(*) AS den
  FROM s a JOIN s b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))""",
        "SELECT CAST(num2 AS DOUBLE) / (2.0 * den) AS c_index FROM pairs",
    ),
)
def q_concordance_fractional(spark: SparkSession, sf: str) -> DataFrame:
    """Durations that are no whole numbers, and many equal risks."""
    df = ClosedFormScorer().transform(cleaned(spark, sf)).select(
        (F.col("tenure_days") / F.lit(30.5)).alias("t"),
        binarize(F.col("churn"), "Yes").alias("e"),
        F.round("churn_probability", 2).alias("r"),
    )
    return M.concordance_index(df, "t", "e", "r")


COX_BETA = {"n_orders": -0.05, "avg_order": 0.000002}


def _cox_step_sql(duration: str) -> str:
    return O.with_(
        O.CLEAN
        + f""",
x AS (SELECT {duration} AS t, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS e, CAST(n_orders AS DOUBLE) AS a,
             avg_order AS b, exp(-0.05 * n_orders + 0.000002 * avg_order) AS w,
             -0.05 * n_orders + 0.000002 * avg_order AS lp FROM clean),
per AS (SELECT t, SUM(w) AS s0, SUM(w * a) AS sa, SUM(w * b) AS sb, SUM(e * w) AS d0, SUM(e * w * a) AS da,
               SUM(e * w * b) AS db, SUM(e) AS d, SUM(e * lp) AS elp, SUM(e * a) AS ea, SUM(e * b) AS eb FROM x GROUP BY t),
risk AS (SELECT *, SUM(s0) OVER w AS r0, SUM(sa) OVER w AS ra, SUM(sb) OVER w AS rb FROM per
         WINDOW w AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
terms AS (SELECT risk.*, unnest(range(0, CAST(d AS BIGINT))) AS l FROM risk WHERE d > 0),
summed AS (SELECT SUM(ln(r0 - l / d * d0)) AS logs, SUM((ra - l / d * da) / (r0 - l / d * d0)) AS ga,
                  SUM((rb - l / d * db) / (r0 - l / d * d0)) AS gb FROM terms),
events AS (SELECT SUM(elp) AS elp, SUM(ea) AS ea, SUM(eb) AS eb FROM per)""",
        """SELECT round(elp - logs, 4) AS log_likelihood, round(ea - ga, 4) AS gradient_n_orders,
       round((eb - gb) / 1000, 4) AS gradient_avg_order
FROM summed CROSS JOIN events""",
    )


def _cox_step(spark: SparkSession, sf: str, duration: str) -> DataFrame:
    """Log-likelihood (Efron) and gradient at fixed coefficients."""
    rows = cleaned(spark, sf).withColumn("_e", binarize(F.col("churn"), "Yes"))
    ll, gradient = partial_likelihood(rows, duration, "_e", COX_BETA)
    row = (round(ll, 4), round(gradient["n_orders"], 4), round(gradient["avg_order"] / 1000, 4))
    return spark.createDataFrame([row], "log_likelihood double, gradient_n_orders double, gradient_avg_order double")


@query("cox_step_fixed", _cox_step_sql("tenure_months"))
def q_cox_step_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _cox_step(spark, sf, "tenure_months")


@query("cox_step_days", _cox_step_sql("tenure_days"))
def q_cox_step_days(spark: SparkSession, sf: str) -> DataFrame:
    """Many distinct durations, most with few ties."""
    return _cox_step(spark, sf, "tenure_days")


# Coefficients of standardised covariates.
HAZARD_BETA = {"n_orders": -0.4, "recency_days": 0.25, "avg_order": 0.1}


@query(
    "hazard_order_fixed",
    O.with_(
        O.CLEAN
        + ",\nh AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, {b} / stddev_pop({c}) AS coef FROM clean" for c, b in HAZARD_BETA.items())
        + ")",
        """SELECT feature, round(coef, 9) AS coef, round(exp(coef), 9) AS hazard_ratio,
       row_number() OVER (ORDER BY abs(exp(coef) - 1) DESC, feature) AS place
FROM h""",
    ),
)
def q_hazard_order_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Hazard ratios by distance from 1, of a saved and reloaded model."""
    df, names = cleaned(spark, sf), list(HAZARD_BETA)
    stats = scale_stats(df, names)
    mean, std = (np.array([stats[c][i] for c in names]) for i in (0, 1))
    model = CoxModel(names, np.array(list(HAZARD_BETA.values())), mean, std, spark.createDataFrame([], BASELINE), 0.0, 0)
    path = new_path(spark, "cox")
    model.save(spark, path)
    rows = [tuple(r) for r in CoxModel.load(spark, path).hazard_ratios(spark).collect()]
    listed = [(f, round(c, 9), round(h, 9), i) for i, (f, c, h) in enumerate(rows, 1)]
    return spark.createDataFrame(listed, "feature string, coef double, hazard_ratio double, place bigint")


@query(
    "spearman_with_ties",
    O.with_(
        O.CLEAN
        + """,
r AS (SELECT rank() OVER (ORDER BY n_orders) + (COUNT(*) OVER (PARTITION BY n_orders) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY tenure_months) + (COUNT(*) OVER (PARTITION BY tenure_months) - 1) / 2.0 AS rb FROM clean)""",
        "SELECT round(corr(ra, rb), 9) AS spearman FROM r",
    ),
)
def q_spearman_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    return M.spearman(cleaned(spark, sf).select("n_orders", "tenure_months"), "n_orders", "tenure_months")


@query(
    "train_counts",
    O.with_(
        TRAIN,
        """SELECT split, CAST(COUNT(*) AS BIGINT) AS n, round(avg(CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END), 9) AS churn_rate
FROM (SELECT 'train' AS split, churn FROM train UNION ALL SELECT 'test', churn FROM test) GROUP BY split""",
    ),
)
def q_train_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A run record's counts and rates, written by ``record_run`` for two
    tenants and read back for one of them."""
    rows = with_split(spark, sf)
    counts = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(binarize(F.col("churn"), "Yes")), 9).alias("churn_rate")
    )
    path = _sink_dir(spark, "runs")
    record_run(counts.withColumn("tenant_id", F.lit("01")), path, "run-a", LOAD_TS)
    record_run(counts.withColumn("tenant_id", F.lit("1")).withColumn("n", -F.col("n")), path, "run-b", LOAD_TS)
    return read_runs(spark, path, "01").select("split", "n", "churn_rate")


@query(
    "conform_schema_full",
    O.with_(
        O.SNAP,
        """SELECT customer_id AS customerID, tenant_id, contract AS Contract, nation, n_orders, tenure_days,
       tenure_months AS tenure, recency_days, avg_order AS MonthlyCharges, total_spend AS TotalCharges, churn AS Churn
FROM snap""",
    ),
)
def q_conform_schema_full(spark: SparkSession, sf: str) -> DataFrame:
    """The full output: every column but the dropped one, renamed."""
    raw = snapshot(spark, sf).withColumn("ChurnValue", F.col("churn"))
    _slim, full = conform_schema(raw, CONFORM_RENAME, ["customerID"], ["ChurnValue"], drop_from_full=["ChurnValue"])
    return full
