"""Registered queries of whole jobs: loading, publishing, records."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnframe.functions.columns import binarize
from churnframe.operators.boosting import BoostedTrees, Node
from churnframe.operators.feedback import disclosed, feedback_batch, retrain_with_feedback, select_campaign
from churnframe.operators.models import ChurnModel, encoder_table, fit_churn
from churnframe.operators.prioritize import priority_ranking
from churnframe.operators.reports import CAPABILITIES, NOT_TRAINED, NOT_VALIDATED, capability_matrix
from churnframe.plans import oracle as O
from churnframe.plans.catalog import cleaned, manifest, query, snapshot, split_of, test_scored
from churnframe.plans.exact import CAMPAIGN
from churnframe.session import new_path
from churnframe.sources.registry import Registry, load_population
from churnframe.sources.store import (
    CUSTOMERS_SCHEMA,
    PREDICTIONS_SCHEMA,
    read_runs,
    read_tenants,
    record_run,
    tenant_scope,
    write_table,
)
from churnframe.sources.tables import read_table
from churnframe.sources.tenant_files import load_tenant, read_tenant, validate, validate_with
from churnframe.spec import SNAPSHOT, TenantSpec

S = SNAPSHOT
ID = S.id_column
WHEN = dt.datetime(2001, 1, 1)


# ---------------------------------------------------------------- loading and its checks


@query(
    "load_csv_schema",
    """SELECT CAST(900719925474099300 + c_custkey AS BIGINT) AS account, CAST(c_acctbal AS DECIMAL(12,2)) AS balance,
       CAST(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey * 1000 END AS BIGINT) AS quota,
       c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'Yes' ELSE 'No' END AS overdrawn
FROM customer""",
)
def q_load_csv_schema(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file loaded under a given schema: ids of 18 digits that differ in
    the last ones, decimals, numbers written as 1e3, missing markers."""
    rows = read_table(spark, sf, "customer").select(
        (F.lit(900719925474099300) + F.col("c_custkey")).alias("account"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("balance"),
        F.when(F.col("c_custkey") % 9 == 0, F.lit("n/a")).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit("e3"))).alias("quota"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") < 0, "Yes").otherwise("No").alias("overdrawn"),
    )
    path = new_path(spark, "accounts-csv")
    write_table(rows, path, "csv")
    spec = TenantSpec("accounts", "account", "overdrawn", "Yes", "balance")
    schema = "account bigint, balance decimal(12,2), quota bigint, segment string, overdrawn string"
    return load_tenant(spark, spec, path, "csv", schema)


@query(
    "load_status",
    O.with_(
        O.SNAP,
        """SELECT 'complete table' AS load, CAST(COUNT(*) AS BIGINT) || ' rows' AS status FROM snap
UNION ALL SELECT 'columns missing', 'tenant snapshot: no label column ''churn'', no revenue column ''avg_order'''
UNION ALL SELECT 'ids repeated', 'an id occurs in several rows of column ''customer_id'''
UNION ALL SELECT 'one null id', CAST(COUNT(*) AS BIGINT) || ' rows' FROM snap
UNION ALL SELECT 'two null ids', 'an id occurs in several rows of column ''customer_id'''
UNION ALL SELECT 'path missing', 'PATH_NOT_FOUND'""",
    ),
)
def q_load_status(spark: SparkSession, sf: str) -> DataFrame:
    """What a load says of a good table and of each kind of bad one."""
    good = cleaned(spark, sf)
    order = good.select(F.min(ID).alias("low"), F.max(ID).alias("high")).first()

    def null_ids(*ids):
        return good.withColumn(ID, F.when(~F.col(ID).isin(*ids), F.col(ID)))

    loads = {
        "complete table": lambda: validate(good, S),
        "columns missing": lambda: validate(good.drop("churn", "avg_order"), S),
        "ids repeated": lambda: validate(good.unionByName(good.where(F.col(ID) == order.low)), S),
        "one null id": lambda: validate(null_ids(order.low), S),
        "two null ids": lambda: validate(null_ids(order.low, order.high), S),
        "path missing": lambda: read_tenant(spark, new_path(spark, "nowhere"), "csv"),
    }

    def status(load) -> str:
        try:
            return f"{load().count()} rows"
        except PySparkException as fault:
            return fault.getCondition() or type(fault).__name__
        except ValueError as fault:
            return str(fault)

    return spark.createDataFrame([(name, status(load)) for name, load in loads.items()], "load string, status string")


@query(
    "load_expectations",
    O.with_(
        O.SNAP,
        """SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
       CAST(SUM(CASE WHEN churn IS NULL OR churn NOT IN ('Yes', 'No') THEN 1 ELSE 0 END) AS BIGINT) AS bad_label,
       CAST(SUM(CASE WHEN tenure_months < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_duration,
       CAST(SUM(CASE WHEN trim(total_spend) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_total,
       CAST(SUM(CASE WHEN trim(total_spend) = '' AND tenure_months > 0 THEN 1 ELSE 0 END) AS BIGINT) AS blank_total_later,
       CAST(SUM(CASE WHEN avg_order > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS large_revenue,
       CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS distinct_ids
FROM snap""",
    ),
)
def q_load_expectations(spark: SparkSession, sf: str) -> DataFrame:
    """Violations counted while the raw table is written: one scan of it."""
    blank = F.trim("total_spend") == ""
    table, seen = validate_with(
        snapshot(spark, sf),
        S,
        {
            "bad_label": F.col("churn").isNull() | ~F.col("churn").isin("Yes", "No"),
            "negative_duration": F.col("tenure_months") < 0,
            "blank_total": blank,
            "blank_total_later": blank & (F.col("tenure_months") > 0),
            "large_revenue": F.col("avg_order") > 200000,
        },
    )
    names = ["n_rows", "bad_label", "negative_duration", "blank_total", "blank_total_later", "large_revenue"]
    return table.agg(*[F.lit(seen[n]).cast("bigint").alias(n) for n in names], F.countDistinct(ID).alias("distinct_ids"))


# ---------------------------------------------------------------- population load

# Each tenant's model - the recency that splits, and the raw
# scores of recent customers, of others with few and with many orders.
TENANT_TREES = {
    "AFRICA": (120.0, -1.0, 0.5, 1.5),
    "AMERICA": (150.0, -0.75, 0.25, 1.0),
    "ASIA": (180.0, -1.25, 0.75, 1.25),
    "EUROPE": (210.0, -0.5, 1.0, 2.0),
    "MIDDLE EAST": (240.0, -1.5, 0.5, 0.75),
}
UNTRAINED = "PACIFIC"  # a tenant with customers and no model
INTEGER_LABEL = "EUROPE"  # delivers an integer label, a balance and no durations
EUROPE = TenantSpec(INTEGER_LABEL, "CustomerId", "Exited", 1, "Balance")


def _tenant_model(spec: TenantSpec, spark: SparkSession) -> ChurnModel:
    split, recent, few, many = TENANT_TREES[spec.tenant_id]
    tree = [Node(0, split, 1, 2), Node(value=recent), Node(1, 7.0, 3, 4), Node(value=few), Node(value=many)]
    features = ["recency_days", "n_orders"]
    trees = BoostedTrees(-0.125, 0.5, True, features, [tree])
    return ChurnModel(spec, features, [], encoder_table(spark.createDataFrame([], "x int"), []), trees)


def _raw_tenants(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], dict[str, TenantSpec]]:
    snap = snapshot(spark, sf)
    raw, specs = {}, {}
    for tenant in TENANT_TREES:
        raw[tenant] = snap.where(F.col("tenant_id") == tenant).drop("tenant_id")
        specs[tenant] = TenantSpec(tenant, ID, "churn", "Yes", "avg_order", "tenure_months", "total_spend")
    raw[INTEGER_LABEL] = raw[INTEGER_LABEL].select(
        F.col(ID).alias("CustomerId"),
        (F.col("churn") == "Yes").cast("int").alias("Exited"),
        F.when(F.col("n_orders") > 2, F.col("avg_order").cast("string")).otherwise(F.lit("unknown")).alias("Balance"),
        "contract",
        "recency_days",
        "n_orders",
    )
    specs[INTEGER_LABEL] = EUROPE
    raw[UNTRAINED] = snap.where((F.col("tenant_id") == "ASIA") & (F.col(ID) % 10 == 0)).drop("tenant_id")
    specs[UNTRAINED] = TenantSpec(UNTRAINED, ID, "churn", "Yes", "avg_order", "tenure_months", "total_spend")
    return raw, specs


def _tenant_score(tenant: str) -> str:
    split, recent, few, many = TENANT_TREES[tenant]
    return (
        f"1 / (1 + exp(-(-0.125 + 0.5 * CAST(CASE WHEN recency_days <= {split} THEN {recent} "
        f"ELSE CASE WHEN n_orders <= 7 THEN {few} ELSE {many} END END AS DOUBLE))))"
    )


@query(
    "load_job",
    O.with_(
        O.SNAP,
        "SELECT tenant_id, CAST(customer_id AS VARCHAR) AS customer_id, 'v1' AS model_version, round(CASE tenant_id "
        + " ".join(f"WHEN '{t}' THEN {_tenant_score(t)}" for t in TENANT_TREES)
        + f""" END, 9) AS churn_probability, contract,
       CASE WHEN tenant_id = '{INTEGER_LABEL}' THEN CASE churn WHEN 'Yes' THEN '1' ELSE '0' END ELSE churn END AS label,
       '2001-01-01 00:00' AS created_at, '2001-01-01 00:00' AS predicted_at
FROM snap
UNION ALL SELECT '{UNTRAINED}', CAST(customer_id AS VARCHAR), NULL, NULL, contract, churn, '2001-01-01 00:00', NULL
FROM snap WHERE tenant_id = 'ASIA' AND customer_id % 10 = 0""",
    ),
)
def q_load_job(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenant's customers and predictions, each scored by its own
    published model; one tenant delivers other columns, one has no model.  One
    tenant is loaded again, which must change nothing.  Read back per tenant."""
    raw, specs = _raw_tenants(spark, sf)
    registry = Registry(spark, new_path(spark, "registry"))
    for tenant in TENANT_TREES:
        registry.publish(tenant, "v1", _tenant_model(specs[tenant], spark).save)
    customers, predictions = new_path(spark, "customers"), new_path(spark, "predictions")
    load_population(registry, raw, specs, customers, predictions, WHEN)
    load_population(registry, {"ASIA": raw["ASIA"]}, specs, customers, predictions, WHEN)
    out = None
    for tenant in raw:
        body = F.col("raw_features")
        who = tenant_scope(spark, customers, tenant, CUSTOMERS_SCHEMA).select(
            "tenant_id",
            "customer_id",
            F.get_json_object(body, "$.contract").alias("contract"),
            F.get_json_object(body, f"$.{specs[tenant].target_column}").alias("label"),
            F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"),
        )
        scores = tenant_scope(spark, predictions, tenant, PREDICTIONS_SCHEMA).drop("tenant_id")
        scores = scores.withColumn("predicted_at", F.date_format("predicted_at", "yyyy-MM-dd HH:mm"))
        rows = who.join(scores, "customer_id", "left")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("churn_probability", F.round("churn_probability", 9))


# ---------------------------------------------------------------- versions


def _digest(spark: SparkSession, folder: str) -> list[tuple]:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return sorted(tuple(r) for r in files.select("path", "modificationTime", F.sha2("content", 256)).collect())


VERSION_TREES = 5  # trees of the two published versions


@query(
    "retrain_published",
    O.with_(
        CAMPAIGN
        + ","
        + """
train AS (SELECT c.* FROM clean c JOIN manifest m ON m.id = c.customer_id AND m.split = 'train'),
batch AS (SELECT c.customer_id, CASE WHEN k.retained THEN 'No' ELSE c.churn END AS churn
          FROM clean c JOIN campaign k ON k.customer_id = c.customer_id),
everyone AS (SELECT churn FROM train UNION ALL SELECT churn FROM batch),
rate AS (SELECT (SELECT avg(CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END) FROM train) AS a,
                (SELECT avg(CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END) FROM batch) AS b,
                (SELECT avg(CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END) FROM everyone) AS c)""",
        """SELECT 'v1' AS before, 'v2' AS current, 'run-v2' AS run_id, 'training rows and a synthetic feedback batch' AS data_source,
       TRUE AS discloses_simulation, CAST((SELECT COUNT(*) FROM batch) AS BIGINT) AS n_customers_sampled,
       CAST(0.3 AS DOUBLE) AS retention_rate_applied, 'top 20 % of the test ranking' AS feedback_source,
       CAST((SELECT COUNT(*) FROM train) AS BIGINT) AS n_train_original, CAST((SELECT COUNT(*) FROM everyone) AS BIGINT) AS n_train_combined,
       CAST((SELECT COUNT(*) FROM ranked) - (SELECT COUNT(*) FROM batch) AS BIGINT) AS n_test,
       round(a, 9) AS churn_rate_train_original, round(b, 9) AS churn_rate_feedback, round(c, 9) AS churn_rate_train_combined,
       TRUE AS v1_unchanged, TRUE AS scores_differ
FROM rate""",
    ),
)
def q_retrain_published(spark: SparkSession, sf: str) -> DataFrame:
    """A model retrained with feedback and published as v2: its disclosure
    record is read through the registry, and v1 lies as it was."""
    df, m = cleaned(spark, sf), manifest(spark, sf)
    registry = Registry(spark, new_path(spark, "registry"))
    params = {"n_estimators": VERSION_TREES}
    v1 = fit_churn(split_of(spark, sf, "train"), S, params=params)
    old = registry.publish("snapshot", "v1", v1.save)
    before, digest = registry.current("snapshot")[0], _digest(spark, old)
    ranking = priority_ranking(test_scored(spark, sf), S, "revenue_weighted")
    batch = feedback_batch(df, select_campaign(ranking, ID, 100, 0.3, 0.2, 42), S)
    v2, record = retrain_with_feedback(df, m, batch, S, v1.features, params=params, retention_rate=0.3)

    def save(folder: str) -> None:
        v2.save(folder)
        disclosed(record, "run-v2", "top 20 % of the test ranking").coalesce(1).write.parquet(f"{folder}/record")

    registry.publish("snapshot", "v2", save)
    current, folder = registry.current("snapshot")
    unchanged = _digest(spark, registry.folder("snapshot", "v1")) == digest
    rows = split_of(spark, sf, "train")
    scores = [ChurnModel.load(spark, f, S).transform(rows).agg(F.avg("churn_probability")).first()[0] for f in (old, folder)]
    info = F.col("feedback_batch_info")
    return spark.read.parquet(f"{folder}/record").select(
        F.lit(before).alias("before"),
        F.lit(current).alias("current"),
        "run_id",
        "data_source",
        F.col("synthetic_data_disclosure").contains("simulated").alias("discloses_simulation"),
        info["n_customers_sampled"].alias("n_customers_sampled"),
        info["retention_rate_applied"].alias("retention_rate_applied"),
        info["source"].alias("feedback_source"),
        "n_train_original",
        "n_train_combined",
        "n_test",
        *[F.round(c, 9).alias(c) for c in ("churn_rate_train_original", "churn_rate_feedback", "churn_rate_train_combined")],
        F.lit(unchanged).alias("v1_unchanged"),
        F.lit(scores[0] != scores[1]).alias("scores_differ"),
    )


# ---------------------------------------------------------------- run records


def _write_records(spark: SparkSession, sf: str) -> str:
    """Records of AMERICA (every kind, each with its own nested figures) and
    of ASIA (a classifier only)."""
    path = new_path(spark, "records")
    df = cleaned(spark, sf)
    y = binarize(F.col("churn"), "Yes")
    kinds = {
        "classifier": F.struct(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(y), 9).alias("positive_rate")),
        "backtest": F.struct(F.round(F.sum("avg_order"), 4).alias("revenue")),
        "survival": F.struct(F.count_if(y == 1).alias("events"), F.max("tenure_months").alias("longest")),
        "segments": F.struct(F.countDistinct("contract").alias("k")),
        "anomalies": F.struct(F.count_if(F.col("recency_days") > 900).alias("flagged")),
        "clv": F.struct(F.round(F.avg("total_spend"), 4).alias("mean")),
    }
    for tenant, own in (("AMERICA", list(kinds)), ("ASIA", ["classifier"])):
        rows = df.where(F.col("tenant_id") == tenant)
        for kind in own:
            run = rows.agg(kinds[kind].alias("figures")).select(F.lit(tenant).alias("tenant_id"), F.lit(kind).alias("kind"), "figures")
            record_run(run, path, f"{tenant.lower()}-{kind}", WHEN)
    return path


@query(
    "run_records",
    O.with_(
        O.CLEAN
        + """,
t AS (SELECT tenant_id, COUNT(*) AS n, round(avg(CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END), 9) AS r,
             SUM(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END) AS e, MAX(tenure_months) AS l, COUNT(DISTINCT contract) AS k,
             SUM(CASE WHEN recency_days > 900 THEN 1 ELSE 0 END) AS f
      FROM clean WHERE tenant_id IN ('AMERICA', 'ASIA') GROUP BY tenant_id),
kinds AS (SELECT * FROM (VALUES ('classifier'), ('backtest'), ('survival'), ('segments'), ('anomalies'), ('clv')) v(kind))""",
        """SELECT tenant_id, kind, lower(tenant_id) || '-' || kind AS run_id,
       CASE WHEN kind = 'classifier' THEN CAST(n AS BIGINT) END AS n_rows, CASE WHEN kind = 'classifier' THEN r END AS positive_rate,
       CASE WHEN kind = 'survival' THEN CAST(e AS BIGINT) END AS events, CASE WHEN kind = 'survival' THEN CAST(l AS BIGINT) END AS longest,
       CASE WHEN kind = 'segments' THEN CAST(k AS BIGINT) END AS k, CASE WHEN kind = 'anomalies' THEN CAST(f AS BIGINT) END AS flagged
FROM t CROSS JOIN kinds WHERE tenant_id = 'AMERICA' OR kind = 'classifier'
UNION ALL SELECT 'EUROPE', 'none', 'no_model', NULL, NULL, NULL, NULL, NULL, NULL""",
    ),
)
def q_run_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested run records with differing fields, read as one table per tenant;
    a tenant without any says so."""
    path = _write_records(spark, sf)
    out = None
    for tenant in ("AMERICA", "ASIA"):
        own = read_runs(spark, path, tenant)
        figures = [F.col("figures")[c].alias(c) for c in ("n_rows", "positive_rate", "events", "longest", "k", "flagged")]
        own = own.select("tenant_id", "kind", "run_id", *figures)
        out = own if out is None else out.unionByName(own)
    none = read_runs(spark, path, "EUROPE").select("tenant_id", F.lit("none").alias("kind"), F.col("reason").alias("run_id"))
    return out.unionByName(none, allowMissingColumns=True)


@query(
    "capability_matrix",
    O.with_(
        O.SNAP,
        "SELECT t.tenant_id, c.capability, t.tenant_id = 'AMERICA' OR (t.tenant_id = 'ASIA' AND c.kind = 'classifier') AS available, "
        "CASE WHEN t.tenant_id = 'AMERICA' OR (t.tenant_id = 'ASIA' AND c.kind = 'classifier') THEN NULL ELSE c.reason END AS reason "
        "FROM (SELECT DISTINCT tenant_id FROM snap) t CROSS JOIN (VALUES "
        + ", ".join(f"('{c}', '{kind}', '{NOT_VALIDATED if kind == 'backtest' else NOT_TRAINED}')" for c, (kind, _) in CAPABILITIES.items())
        + ") c(capability, kind, reason)",
    ),
)
def q_capability_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """What each tenant may ask for, from the run records alone."""
    runs = read_tenants(spark, _write_records(spark, sf))
    return capability_matrix(snapshot(spark, sf).select("tenant_id"), runs.select("tenant_id", "kind"))

