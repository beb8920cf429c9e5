"""Distributed rank / top-k / prefix sums against single-partition windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnframe.operators.ordering import PART, global_rank, kth_keys, placed, prefix_sums, rank_within, top



def _lineitem(spark):
    # 60,000 unique ids; scores from lineitem-like hashing with ~200 distinct
    # values, so ties are heavy
    return spark.range(60000).select(
        F.col("id"),
        (F.abs(F.xxhash64("id")) % 200).cast("double").alias("score"),
        (F.col("id") % 3).cast("string").alias("grp"),
    )


def test_global_rank_matches_window_with_many_buckets(spark):
    df = _lineitem(spark)
    ranked = global_rank(df, [("score", False), ("id", True)], "rank", parts=15)
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    bad = ranked.join(ref, "id").filter(F.col("rank") != F.col("ref")).count()
    assert bad == 0
    assert ranked.count() == df.count()


def test_hot_key_is_split_over_buckets(spark):
    # a third of all rows share one score: ranges still stay balanced
    df = _lineitem(spark).withColumn("score", F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("score")))
    sizes = [r["count"] for r in placed(df, [("score", False), ("id", True)], 15).groupBy(PART).count().collect()]
    assert len(sizes) == 15 and max(sizes) < 3 * 4000
    ranked = global_rank(df, [("score", False), ("id", True)], "rank", parts=15)
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    assert ranked.join(ref, "id").filter(F.col("rank") != F.col("ref")).count() == 0


def test_no_single_partition_exchange(spark):
    df = _lineitem(spark)
    ranked = global_rank(df, [("score", False), ("id", True)], "rank", parts=15)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_rank_within_groups(spark):
    df = _lineitem(spark)
    got = rank_within(df, "grp", [("score", True), ("id", True)], "r", parts=12)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("grp").orderBy("score", "id")))
    assert got.join(ref, "id").filter(F.col("r") != F.col("ref")).count() == 0


@pytest.mark.parametrize("k", [0, 1, 250, 60000])
def test_top(spark, k):
    df = _lineitem(spark)
    got = top(df, [("score", False), ("id", True)], k)
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    both = got.join(ref.select("id", "ref"), "id")
    assert both.count() == k and both.filter(F.col("rank") != F.col("ref")).count() == 0


def test_kth_keys(spark):
    df = _lineitem(spark)
    keys = [("score", True), ("id", True)]
    b = kth_keys(df, keys, [-1, 0, 1, 100, 30000, 59999, 60000, 70000], parts=15)
    ordered = df.orderBy("score", "id").select("score", "id").collect()
    for k in (1, 100, 30000, 59999):
        assert b[k] == tuple(ordered[k - 1])
    assert b[-1] is False and b[0] is False and b[60000] is True and b[70000] is True


@pytest.mark.parametrize("groups", [1, 3, 40, 3000])
def test_rank_within_any_number_of_groups(spark, groups):
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") % groups > 0, F.col("id") % groups).alias("g"),  # NULL is a group
        (F.abs(F.xxhash64("id")) % 50).alias("s"),
    )
    got = rank_within(df, "g", [("s", False), ("id", True)], "r", parts=9)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "id")))
    assert got.join(ref.select("id", "ref"), "id").filter(F.col("r") == F.col("ref")).count() == 3000


def test_empty_input(spark):
    df = _lineitem(spark).filter("id < 0")
    assert global_rank(df, ["score", "id"]).count() == 0
    assert rank_within(df, "grp", ["id"]).count() == 0
    assert prefix_sums(df, ["id"], ["id"]).count() == 0
    assert kth_keys(df, ["id"], [1])[1] is True


def test_prefix_sums(spark):
    df = _lineitem(spark).withColumn("one", F.lit(1)).withColumn("q", (F.col("id") % 7).cast("long"))
    got = prefix_sums(df, [("score", True), ("id", True)], ["one", "q"], parts=12)
    w = Window.orderBy("score", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = df.withColumn("r1", F.sum("one").over(w)).withColumn("r2", F.sum("q").over(w))
    j = got.join(ref.select("id", "r1", "r2"), "id")
    assert j.filter((F.col("one_cum") != F.col("r1")) | (F.col("q_cum") != F.col("r2"))).count() == 0


def test_nulls_sort_smallest(spark):
    df = spark.createDataFrame(
        [(1, None), (2, 3.0), (3, None), (4, 1.0), (5, 2.0)], "id long, score double"
    )
    asc = {r["id"]: r["rank"] for r in global_rank(df, [("score", True), ("id", True)], "rank").collect()}
    assert asc == {1: 1, 3: 2, 4: 3, 5: 4, 2: 5}
    desc = {r["id"]: r["rank"] for r in global_rank(df, [("score", False), ("id", True)], "rank").collect()}
    assert desc == {2: 1, 5: 2, 4: 3, 1: 4, 3: 5}


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_next_value_across_ranges(spark, parts):
    from churnframe.operators.ordering import next_value

    rows = [(i, i * 7 % 90, float(i) if (i % 11 == 0 or 30 < i < 34) and i * 7 % 90 < 80 else None) for i in range(180)]
    df = spark.createDataFrame(rows, "id long, k long, v double").repartition(5)
    got = {r.id: r.n for r in next_value(df, [("k", True), ("id", False)], "v", "n", parts).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], -r[0]))
    want, last = {}, None
    for i, _, v in reversed(ordered):
        last = v if v is not None else last
        want[i] = last
    assert got == want and None in want.values()


def test_running_sums_of_doubles_and_null(spark):
    rows = [(i, None if i % 5 == 0 else i / 4, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, n int").repartition(6)
    got = {r.id: r for r in prefix_sums(df, ["id"], ["x", "n"], parts=9).collect()}
    x = n = 0
    for i, a, b in rows:
        x, n = x + (a or 0), n + b
        assert got[i].x_cum == pytest.approx(x) and got[i].n_cum == n


def test_one_shuffle_and_no_window_after_the_write(spark):
    df = _lineitem(spark)
    for made in (rank_within(df, "grp", ["score", "id"], "r"), prefix_sums(df, ["id"], ["score"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
