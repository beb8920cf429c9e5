"""Published versions, population loads, exact typing of text."""

import datetime as dt

import pytest

from churnframe.operators.boosting import BoostedTrees, Node
from churnframe.operators.models import ChurnModel, encoder_table
from churnframe.sources import store
from churnframe.sources.registry import Registry, load_population
from churnframe.sources.tenant_files import load_tenant, validate_with
from churnframe.spec import TenantSpec
from pyspark.sql import functions as F

WHEN = dt.datetime(2024, 5, 1)
SPEC = TenantSpec("a", "cid", "y", "Yes", "rev")


def model(spark, low):
    trees = BoostedTrees(0.0, 1.0, True, ["x"], [[Node(0, 1.5, 1, 2), Node(value=low), Node(value=2.0)]])
    return ChurnModel(SPEC, ["x"], [], encoder_table(spark.createDataFrame([], "x int"), []), trees)


def rows(spark, ids):
    return spark.createDataFrame([(i, "Yes", 1.0, float(i)) for i in ids], "cid long, y string, rev double, x double")


def test_a_version_that_fails_to_write_is_never_seen(spark, scratch):
    registry = Registry(spark, f"{scratch}/r")
    assert registry.current("a") is None and registry.model(SPEC) is None
    registry.publish("a", "v1", model(spark, -1.0).save)

    def broken(folder):
        model(spark, -2.0).save(folder)
        raise OSError("disk full")

    with pytest.raises(OSError):
        registry.publish("a", "v2", broken)
    assert registry.current("a")[0] == "v1"
    folder = registry.publish("a", "v2", model(spark, -3.0).save)
    assert registry.current("a") == ("v2", folder) and registry.folder("a", "v1") != folder
    version, found = registry.model(SPEC)
    assert version == "v2" and found.trees.trees[0][1].value == -3.0
    assert registry.current("b") is None


def test_a_folder_without_metadata_gives_no_predictions(spark, scratch):
    registry = Registry(spark, f"{scratch}/r")
    registry.publish("a", "v1", lambda folder: spark.range(1).write.parquet(f"{folder}/other"))
    customers, predictions = f"{scratch}/c", f"{scratch}/p"
    load_population(registry, {"a": rows(spark, range(4))}, {"a": SPEC}, customers, predictions, WHEN)
    assert store.tenant_scope(spark, customers, "a", store.CUSTOMERS_SCHEMA).count() == 4
    assert spark.read.schema(store.PREDICTIONS_SCHEMA).parquet(predictions).count() == 0


def test_a_reload_replaces_one_tenant_only(spark, scratch):
    registry = Registry(spark, f"{scratch}/r")
    specs = {"a": SPEC, "b": TenantSpec("b", "cid", "y", "Yes", "rev")}
    for tenant in specs:
        registry.publish(tenant, "v1", model(spark, -1.0).save)
    customers, predictions = f"{scratch}/c", f"{scratch}/p"
    load_population(registry, {"a": rows(spark, range(5)), "b": rows(spark, range(7))}, specs, customers, predictions, WHEN)
    load_population(registry, {"a": rows(spark, range(3))}, specs, customers, predictions, WHEN)
    counts = {t: store.tenant_scope(spark, predictions, t, store.PREDICTIONS_SCHEMA).count() for t in specs}
    assert counts == {"a": 3, "b": 7}


def test_ids_of_18_digits_are_read_exactly(spark, scratch):
    with open(f"{scratch}/t.csv", "w") as f:
        f.write("cid,y,rev,n\n9007199254740993,Yes,1.10,1e3\n123456789012345678,No,2.25, 7.0 \n9007199254740992,No,x,NA\n")
    df = load_tenant(spark, SPEC, f"{scratch}/t.csv", schema="cid bigint, y string, rev decimal(20,2), n int")
    got = {r.cid: (None if r.rev is None else str(r.rev), r.n) for r in df.collect()}
    assert got == {9007199254740993: ("1.10", 1000), 123456789012345678: ("2.25", 7), 9007199254740992: (None, None)}


def test_violations_are_counted_in_the_pass_that_writes(spark):
    df = spark.createDataFrame([(1, "Yes", 1.0), (2, None, -1.0), (3, "No", None)], "cid long, y string, rev double")
    calls = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    read = df.mapInArrow(touch, df.schema)
    table, seen = validate_with(read, SPEC, {"no_label": F.col("y").isNull(), "negative": F.col("rev") < 0})
    assert seen == {"n_rows": 3, "no_label": 1, "negative": 1}
    assert table.count() == 3 and calls.value == 3


def test_records_with_other_nested_fields_are_one_table(spark, scratch):
    for kind, figures in (("x", "named_struct('a', 1)"), ("y", "named_struct('b', 'z', 'c', 2.5D)")):
        run = spark.sql(f"SELECT 't' AS tenant_id, '{kind}' AS kind, {figures} AS figures")
        store.record_run(run, f"{scratch}/runs", f"run-{kind}", WHEN)
    got = {r.kind: r.figures.asDict() for r in store.read_runs(spark, f"{scratch}/runs", "t").collect()}
    assert got == {"x": {"a": 1, "b": None, "c": None}, "y": {"a": None, "b": "z", "c": 2.5}}
    assert store.read_runs(spark, f"{scratch}/runs", "u").collect()[0].reason == "no_model"
