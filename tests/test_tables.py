"""Tenant tables: isolation, idempotent reloads, JSON packing, runs,
streaming scoring, and plan checks (pruning, pushdown)."""

import datetime as dt
import time

import pytest


from churnframe.operators.scoring import ClosedFormScorer
from churnframe.sources import store
from churnframe.spec import SNAPSHOT, TenantSpec
from churnframe.streaming.scoring import run_once, scored_stream

TS = dt.datetime(2024, 1, 1)


def _customers(spark):
    telco = spark.createDataFrame([("T-001", 1), ("T-002", 2)], "cid string, a long")
    bank = spark.createDataFrame([("B-001", 1), ("B-002", 2), ("B-003", 3)], "cid string, b long")
    spec = TenantSpec("x", "cid", "y", "Yes", "r")
    return store.pack_customers(telco, spec, TS, "telco"), store.pack_customers(bank, spec, TS, "banking")


def test_tenant_isolation_and_idempotent_reload(spark, scratch):
    path = f"{scratch}/customers"
    t, b = _customers(spark)
    store.write_partitioned(t, path, ["tenant_id"])
    store.write_partitioned(b, path, ["tenant_id"])
    store.write_partitioned(t, path, ["tenant_id"])  # rerun: replaces, no duplicates
    assert store.tenant_scope(spark, path, "telco").count() == 2
    assert store.tenant_scope(spark, path, "banking").count() == 3
    assert store.tenant_scope(spark, path, "nobody").count() == 0
    raw = {r["customer_id"]: r["raw_features"] for r in store.tenant_scope(spark, path, "telco").collect()}
    assert raw == {"T-001": '{"cid":"T-001","a":1}', "T-002": '{"cid":"T-002","a":2}'}
    plan = store.tenant_scope(spark, path, "telco")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "telco" in plan


def test_predictions_partitioned_by_version(spark, scratch):
    path = f"{scratch}/predictions"
    rows = spark.createDataFrame([(1, 30)], "customer_id long, recency_days long")
    for version in ("v1", "v2"):
        p = store.score_population(rows, ClosedFormScorer(), SNAPSHOT, "telco", version, TS)
        store.write_partitioned(p, path, ["tenant_id", "model_version"])
    p = store.score_population(rows, ClosedFormScorer(), SNAPSHOT, "banking", "banking_v1", TS)
    store.write_partitioned(p, path, ["tenant_id", "model_version"])
    assert store.tenant_scope(spark, path, "telco").count() == 2
    assert store.tenant_scope(spark, path, "banking").count() == 1


def test_json_keeps_null_fields(spark):
    df = spark.createDataFrame([("A", None)], "cid string, note string")
    spec = TenantSpec("x", "cid", "y", "Yes", "r")
    assert store.pack_customers(df, spec, TS, "t").collect()[0]["raw_features"] == '{"cid":"A","note":null}'


def test_runs_not_available(spark, scratch):
    out = store.read_runs(spark, f"{scratch}/runs", "banking").collect()[0]
    assert out["available"] is False
    run = spark.createDataFrame([("telco", 0.8)], "tenant_id string, roc_auc double")
    store.record_run(run, f"{scratch}/runs", "v1", TS)
    got = store.read_runs(spark, f"{scratch}/runs", "telco").collect()[0]
    assert got["roc_auc"] == 0.8 and got["run_id"] == "v1"


def test_streaming_scoring(spark, scratch):
    src = f"{scratch}/incoming"
    sink = f"{scratch}/scored"
    df = spark.createDataFrame(
        [(1, "Yes", "10.0", 30), (2, "No", "x", 365)], "customer_id long, churn string, avg_order string, recency_days long"
    )
    df.write.parquet(f"{src}/batch1")
    spec = TenantSpec("s", "customer_id", "churn", "Yes", "avg_order")
    stream = scored_stream(spark, f"{src}/*", df.schema, ClosedFormScorer(), spec, "telco", "closed_form_v1")
    run_once(stream, sink, f"score_{int(time.time() * 1000)}")
    out = {r["customer_id"]: r["churn_probability"] for r in spark.read.parquet(sink).collect()}
    assert out == {"1": 30 / 210, "2": 365 / 545}


def test_snapshot_scan_prunes_columns(spark):
    from churnframe.sources.tables import customer_snapshot

    plan = customer_snapshot(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert "BroadcastHashJoin" in plan  # nation / region after the size check


def test_capability_matrix_reasons(spark):
    from churnframe.operators.reports import NOT_TRAINED, NOT_VALIDATED, capability_matrix

    runs = spark.createDataFrame([("telco", "classifier"), ("telco", "backtest"), ("telco", "survival"), ("banking", "classifier")], "tenant_id string, kind string")
    tenants = spark.createDataFrame([("telco",), ("banking",), ("new",), ("new",)], "tenant_id string")
    m = {(r["tenant_id"], r["capability"]): (r["available"], r["reason"]) for r in capability_matrix(tenants, runs).collect()}
    assert len(m) == 24 and m[("new", "metrics")] == (False, NOT_TRAINED)
    assert m[("telco", "priority")] == (True, None)
    assert m[("banking", "priority")] == (False, NOT_VALIDATED)
    assert m[("banking", "survival")] == (False, NOT_TRAINED)
    assert m[("banking", "metrics")] == (True, None)


def test_manifest_round_trip(spark, scratch):
    m = spark.createDataFrame([("a", "Yes", "test"), ("b", "No", "train")], "id string, label string, split string")
    store.write_manifest(m, f"{scratch}/manifest", "telco")
    store.write_manifest(m.limit(1), f"{scratch}/manifest", "banking")
    back = store.read_manifest(spark, f"{scratch}/manifest", "telco")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in m.collect())


def test_look_alike_tenants_stay_apart(spark, scratch):
    path = f"{scratch}/rows"
    rows = spark.createDataFrame([(t, t + "-id") for t in ("1", "001", "1.0")], "tenant_id string, customer_id string")
    store.write_partitioned(rows, path, ["tenant_id"])
    for t in ("1", "001", "1.0"):
        assert [r["customer_id"] for r in store.tenant_scope(spark, path, t).collect()] == [t + "-id"]
        assert [r["customer_id"] for r in store.tenant_scope(spark, path, t, "tenant_id string, customer_id string").collect()] == [t + "-id"]


def test_a_tenant_named_like_a_column_is_a_name(spark):
    df = spark.createDataFrame([("A", "z")], "cid string, telco string")
    spec = TenantSpec("t", "cid", "y", "Yes", "rev")
    assert store.pack_customers(df, spec, TS, "telco").collect()[0]["tenant_id"] == "telco"
    assert store.pack_customers(df, spec, TS, tenant_column="telco").collect()[0]["tenant_id"] == "z"
    with pytest.raises(ValueError):
        store.pack_customers(df, spec, TS)
