import os

from churnframe.llm import common as C


def test_a_discarded_table_is_gone_and_others_stay(spark):
    a, b = (C.materialise(spark.range(n)) for n in (3, 5))
    assert os.path.isdir(a._written) and os.path.isdir(b._written)
    C.discard(a)
    assert not os.path.exists(a._written) and b.count() == 5


def test_tasks_grow_with_the_groups(spark):
    cores = spark.sparkContext.defaultParallelism
    tasks = lambda groups: C.dealt(spark.range(4), "id", groups).rdd.getNumPartitions()
    assert tasks(1) == cores
    assert tasks(8 * 500) == 500
    assert tasks(8 * 5_000) == 1_000
    assert tasks(64 * 1_300) == 1_300
