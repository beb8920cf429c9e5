"""Registered queries over trained models (no exact SQL twin: the models are
held to bounds in ``tests/``; the driver records a rows-only check)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnframe.functions.columns import binarize
from churnframe.operators.anomaly import detect_anomalies
from churnframe.operators.clean import clean
from churnframe.operators.encode import categorical_columns, encode, fit_encoders
from churnframe.operators.explain import explain_scores
from churnframe.operators.feedback import feedback_batch, retrain_with_feedback, select_campaign
from churnframe.operators.models import encoder_table, input_names, train_churn, train_value
from churnframe.operators.prioritize import priority_ranking
from churnframe.operators.quantiles import medians
from churnframe.operators.segment import segment
from churnframe.operators import survival as SV
from churnframe.plans import oracle as O
from churnframe.plans.catalog import cleaned, manifest, query, split_of
from churnframe.plans.exact import TRAIN
from churnframe.sources.store import score_population
from churnframe.sources.tables import customer_snapshot
from churnframe.session import cut_lineage, new_path
from churnframe.spec import SNAPSHOT

S = SNAPSHOT
ID = S.id_column
_MODELS: dict = {}


def _churn(spark: SparkSession, sf: str):
    """Train once per (session, data folder); later queries reuse the model."""
    key = ("churn", spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        df = cleaned(spark, sf)
        m = manifest(spark, sf)
        model, run = train_churn(df, m, S)
        _MODELS[key] = (df, m, model, cut_lineage(run))
    return _MODELS[key]


@query("train_churn")
def q_train_churn(spark: SparkSession, sf: str) -> DataFrame:
    return _churn(spark, sf)[3]


@query("global_importance")
def q_global_importance(spark: SparkSession, sf: str) -> DataFrame:
    return _churn(spark, sf)[2].importance()


@query("score_population_model")
def q_score_population_model(spark: SparkSession, sf: str) -> DataFrame:
    df, _m, model, _run = _churn(spark, sf)
    return score_population(df, model, S, "snapshot", "v1", dt.datetime(2001, 1, 1)).drop("predicted_at")


@query("priority_model")
def q_priority_model(spark: SparkSession, sf: str) -> DataFrame:
    df, m, model, _run = _churn(spark, sf)
    return priority_ranking(model.transform(split_of(spark, sf, "test")), S, "revenue_weighted")


@query("explain_scores")
def q_explain_scores(spark: SparkSession, sf: str) -> DataFrame:
    df, m, model, _run = _churn(spark, sf)
    inputs = input_names(model.features)
    train = model.with_features(split_of(spark, sf, "train"))
    means = train.agg(*[F.avg(c).alias(c) for c in inputs]).collect()[0].asDict()
    test = model.with_features(split_of(spark, sf, "test")).select(ID, *inputs)
    return explain_scores(test, ID, model.features, means, model.substituted)


def _clv_frame(spark: SparkSession, sf: str) -> DataFrame:
    return clean(customer_snapshot(spark, sf, with_future_spend=True), S)


def _clv(spark: SparkSession, sf: str):
    """Lifetime-value model on revenue after the cutoff, trained once."""
    key = ("clv", spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        df = cut_lineage(_clv_frame(spark, sf))
        model, metrics = train_value(df, manifest(spark, sf), S, "future_spend")
        _MODELS[key] = (model, cut_lineage(metrics))
    return _MODELS[key]


@query("train_clv")
def q_train_clv(spark: SparkSession, sf: str) -> DataFrame:
    return _clv(spark, sf)[1]


@query("clv_importance")
def q_clv_importance(spark: SparkSession, sf: str) -> DataFrame:
    return _clv(spark, sf)[0].importance()


def _segment_inputs(spark: SparkSession, sf: str):
    df = cleaned(spark, sf)
    features = S.feature_columns(df.columns)
    cats = categorical_columns(df, features)
    # encoders fitted on the train split; scaling and clustering on everyone
    encoders = fit_encoders(split_of(spark, sf, "train"), cats)
    enc = encode(df, encoders, cats)
    return df, enc, features


@query("segment")
def q_segment(spark: SparkSession, sf: str) -> DataFrame:
    _df, enc, features = _segment_inputs(spark, sf)
    _seg, assignments = segment(enc, ID, features, k=4)
    return assignments


@query("k_search")
def q_k_search(spark: SparkSession, sf: str) -> DataFrame:
    _df, enc, features = _segment_inputs(spark, sf)
    seg, _assign = segment(enc, ID, features, k=None)
    return spark.createDataFrame(seg.search, "k long, inertia double, silhouette double").withColumn(
        "chosen", F.col("k") == F.lit(seg.k)
    )


@query("silhouette")
def q_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    _df, enc, features = _segment_inputs(spark, sf)
    seg, _assign = segment(enc, ID, features, k=4)
    return spark.createDataFrame([(seg.k, seg.silhouette(enc, ID))], "k long, silhouette double")


@query("detect_anomalies")
def q_detect_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    _df, enc, features = _segment_inputs(spark, sf)
    _forest, results = detect_anomalies(enc, ID, features, contamination=0.05)
    return results


def _cox(spark: SparkSession, sf: str):
    key = ("cox", spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        df = cleaned(spark, sf).withColumn("_event", binarize(F.col("churn"), "Yes"))
        event = binarize(F.col("churn"), "Yes")
        train = split_of(spark, sf, "train").withColumn("_event", event)
        test = split_of(spark, sf, "test").withColumn("_event", event)
        # duration excluded, and the billed total, which leaks duration
        features = S.feature_columns(df.columns, exclude=("tenure_months", "tenure_days", "total_spend", "_event"))
        cats = categorical_columns(df, features)
        enc = encoder_table(train, cats)
        model = SV.fit_cox(encode(train, enc, cats), "tenure_months", "_event", features)
        _MODELS[key] = (df, enc, cats, features, model, encode(train, enc, cats), encode(test, enc, cats))
    return _MODELS[key]


@query("fit_cox")
def q_fit_cox(spark: SparkSession, sf: str) -> DataFrame:
    return _cox(spark, sf)[4].hazard_ratios(spark)


@query("survival_c_index")
def q_survival_c_index(spark: SparkSession, sf: str) -> DataFrame:
    _df, _enc, _cats, _f, model, _train, test = _cox(spark, sf)
    return SV.concordance(model, test, "tenure_months", "_event")


@query("median_survival")
def q_median_survival(spark: SparkSession, sf: str) -> DataFrame:
    """Training-median profile, one row per contract code."""
    _df, enc, cats, features, model, train, _test = _cox(spark, sf)
    found = medians(train, features)
    contracts = enc.filter(F.col("column") == "contract").select(
        F.col("value").alias("contract_name"), F.col("code").cast("double").alias("contract")
    )
    profiles = contracts.select(
        "contract_name", *[F.lit(found[f]).alias(f) for f in features if f != "contract"], "contract"
    )
    return SV.median_survival(model, profiles, "contract_name")


@query(
    "median_survival_fixed",
    O.with_(
        TRAIN
        + """,
ev AS (SELECT tenure_months AS t, SUM(exp(-0.3 * n_orders)) AS w, SUM(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END) AS d
       FROM train GROUP BY tenure_months),
rs AS (SELECT t, d, SUM(w) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM ev),
h AS (SELECT t, SUM(d / r) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h0 FROM rs),
profiles AS (SELECT DISTINCT n_orders FROM train UNION ALL SELECT 1000)""",
        """SELECT n_orders, CAST(MIN(CASE WHEN h0 >= 0.6931471805599453 * exp(0.3 * n_orders) THEN t END) AS DOUBLE) AS median_survival
FROM profiles CROSS JOIN h GROUP BY n_orders""",
    ),
)
def q_median_survival_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Median survival by order count at a fixed coefficient: the weighted
    baseline and the search are checked exactly, NULL medians included."""
    train = split_of(spark, sf, "train").withColumn("_event", binarize(F.col("churn"), "Yes"))
    fixed = SV.fixed_model(train, "tenure_months", "_event", {"n_orders": -0.3})
    far = spark.range(1).select(F.lit(1000).cast("bigint").alias("n_orders"))
    return SV.median_survival(fixed, train.select("n_orders").distinct().unionByName(far), "n_orders")


@query("retrain_with_feedback")
def q_retrain_with_feedback(spark: SparkSession, sf: str) -> DataFrame:
    df, m, model, _run = _churn(spark, sf)
    ranking = priority_ranking(model.transform(split_of(spark, sf, "test")), S, "revenue_weighted")
    camp = select_campaign(ranking, ID, 100, 0.3, 0.2, 42)
    batch = feedback_batch(df, camp, S)
    _v2, record = retrain_with_feedback(df, m, batch, S, model.features, retention_rate=0.3)
    return record


def _saved_dir(spark: SparkSession, kind: str) -> str:
    return new_path(spark, kind)


# Label texts for the four fitted segments, by cluster index.
SEGMENT_LABELS = [
    (0, "segment 0"),
    (1, "segment 1"),
    (2, "segment 2"),
    (3, "segment 3"),
]


@query("profile_saved_segments")
def q_profile_saved_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Fit k=4 once, save it, reload it and profile every customer with the
    saved model (no refit)."""
    from churnframe.operators.segment import Segmentation, profile_clusters

    df, enc, features = _segment_inputs(spark, sf)
    seg, _assign = segment(enc, ID, features, k=4)
    path = _saved_dir(spark, "segments")
    seg.save(spark, path)
    saved = Segmentation.load(spark, path)
    labels = spark.createDataFrame(SEGMENT_LABELS[:3], "cluster bigint, label string")
    return profile_clusters(
        df, saved.assign(enc, ID), ID, "tenure_months", "avg_order", "contract", "churn", "Yes", labels
    )


@query("anomaly_report_saved")
def q_anomaly_report_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Fit the forest, save it, reload it, score everyone with the saved
    forest and list the five most extreme flagged customers."""
    from churnframe.operators.anomaly import Forest, anomaly_report

    df, enc, features = _segment_inputs(spark, sf)
    forest, _res = detect_anomalies(enc, ID, features, contamination=0.05)
    path = _saved_dir(spark, "anomalies")
    forest.save(spark, path)
    saved = Forest.load(spark, path)
    return anomaly_report(saved.score(enc, ID), ID, 5)


@query("outcome_by_segment")
def q_outcome_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Churn rate per fitted segment and among flagged anomalies (the label
    is looked up only here, never used to fit)."""
    from churnframe.operators.reports import outcome_by_group

    df, enc, features = _segment_inputs(spark, sf)
    _seg, assign = segment(enc, ID, features, k=4)
    _forest, res = detect_anomalies(enc, ID, features, contamination=0.05)
    seg = outcome_by_group(df.join(assign, ID), "cluster", "churn", "Yes").select(
        F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("grp"), "n", "churn_rate_pct"
    )
    ano = outcome_by_group(df.join(res, ID), "anomaly_flag", "churn", "Yes").select(
        F.concat(F.lit("anomaly_flag "), F.col("anomaly_flag").cast("string")).alias("grp"), "n", "churn_rate_pct"
    )
    return seg.unionByName(ano)


# ---------------------------------------------------------------- checked expectations and jobs


def _checks(spark: SparkSession, rows: list[tuple[str, bool]]) -> DataFrame:
    return spark.createDataFrame([(n, bool(ok)) for n, ok in rows], "expectation string, ok boolean")


def _all_true(*names: str) -> str:
    return "SELECT expectation, TRUE AS ok FROM (VALUES " + ", ".join(f"('{n}')" for n in names) + ") t(expectation)"


@query(
    "segment_expectations",
    O.with_(
        O.CLEAN,
        """SELECT CAST(COUNT(*) AS BIGINT) AS customers, CAST(COUNT(*) AS BIGINT) AS assigned,
       CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS distinct_customers, CAST(4 AS BIGINT) AS clusters
FROM clean""",
    ),
)
def q_segment_expectations(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer is in exactly one of the four clusters."""
    df, enc, features = _segment_inputs(spark, sf)
    _seg, assign = segment(enc, ID, features, k=4)
    return assign.agg(
        F.lit(df.count()).alias("customers"),
        F.count(F.lit(1)).alias("assigned"),
        F.countDistinct(ID).alias("distinct_customers"),
        F.countDistinct("cluster").alias("clusters"),
    )


@query(
    "anomaly_expectations",
    O.with_(
        O.CLEAN,
        """SELECT CAST(COUNT(*) AS BIGINT) AS scored, CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS distinct_customers,
       TRUE AS share_near_contamination, TRUE AS flags_below_zero
FROM clean""",
    ),
)
def q_anomaly_expectations(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer is flagged once; the flagged share is within 10 % of the
    contamination, and flags follow the score's sign."""
    _df, enc, features = _segment_inputs(spark, sf)
    _forest, res = detect_anomalies(enc, ID, features, contamination=0.05)
    share = F.avg((F.col("anomaly_flag") == -1).cast("int"))
    return res.agg(
        F.count(F.lit(1)).alias("scored"),
        F.countDistinct(ID).alias("distinct_customers"),
        (F.abs(share / 0.05 - 1) <= 0.1).alias("share_near_contamination"),
        F.bool_and((F.col("anomaly_score") < 0) == (F.col("anomaly_flag") == -1)).alias("flags_below_zero"),
    )


@query("importance_expectations", _all_true("sums to 1", "none negative", "all features listed", "falling order"))
def q_importance_expectations(spark: SparkSession, sf: str) -> DataFrame:
    model = _churn(spark, sf)[2]
    values = [r["importance"] for r in model.importance().collect()]
    return _checks(
        spark,
        [
            ("sums to 1", abs(sum(values) - 1) < 1e-9),
            ("none negative", min(values) >= 0),
            ("all features listed", len(values) == len(model.features)),
            ("falling order", values == sorted(values, reverse=True)),
        ],
    )


@query(
    "model_bounds",
    _all_true("churn roc_auc over 0.65", "c-index between 0.55 and 0.90", "lifetime value r2 between 0.1 and 0.95"),
)
def q_model_bounds(spark: SparkSession, sf: str) -> DataFrame:
    auc = _churn(spark, sf)[3].first()["roc_auc"]
    _df, _enc, _cats, _f, model, _train, test = _cox(spark, sf)
    c_index = SV.concordance(model, test, "tenure_months", "_event").first()["c_index"]
    r2 = _clv(spark, sf)[1].first()["r2"]
    return _checks(
        spark,
        [
            ("churn roc_auc over 0.65", auc > 0.65),
            ("c-index between 0.55 and 0.90", 0.55 < c_index < 0.90),
            ("lifetime value r2 between 0.1 and 0.95", 0.1 < r2 < 0.95),
        ],
    )


@query(
    "training_job",
    O.with_(
        TRAIN,
        """SELECT 'run-1' AS run_id, CAST((SELECT COUNT(*) FROM train) AS BIGINT) AS n_train,
       CAST((SELECT COUNT(*) FROM test) AS BIGINT) AS n_test,
       CAST((SELECT COUNT(*) FROM manifest) AS BIGINT) AS n_manifest, TRUE AS same_scores""",
    ),
)
def q_training_job(spark: SparkSession, sf: str) -> DataFrame:
    """The training job's outputs - split manifest, model with its encoders,
    run record - written, read back, and the loaded model compared with the
    trained one on the test split."""
    from churnframe.operators.models import ChurnModel
    from churnframe.sources.store import read_manifest, read_runs, record_run, write_manifest

    _df, m, model, run = _churn(spark, sf)
    folder = _saved_dir(spark, "training-job")
    write_manifest(m, f"{folder}/manifest", "t1")
    model.save(f"{folder}/models/v1")
    record_run(run.withColumn("tenant_id", F.lit("t1")), f"{folder}/runs", "run-1", dt.datetime(2001, 1, 1))
    loaded = ChurnModel.load(spark, f"{folder}/models/v1", S)
    test = split_of(spark, sf, "test")
    a = model.transform(test).select(ID, F.col("churn_probability").alias("a"))
    b = loaded.transform(test).select(ID, F.col("churn_probability").alias("b"))
    differ = a.join(b, ID).filter(F.abs(F.col("a") - F.col("b")) > 1e-12).count()
    record = read_runs(spark, f"{folder}/runs", "t1")
    return record.select(
        "run_id",
        "n_train",
        "n_test",
        F.lit(read_manifest(spark, f"{folder}/manifest", "t1").count()).alias("n_manifest"),
        F.lit(differ == 0).alias("same_scores"),
    )
