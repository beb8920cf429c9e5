import numpy as np
import pytest
from helpers import docs, empty, hard

from churnframe.llm import common as C
from churnframe.llm import quality as Q

SF01 = "/root/testdata/sf0.01"


def test_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in Q.query(spark, SF01).collect()}
    texts = {r.doc_id: r.text for r in C.table(spark, SF01, "documents").collect()}
    good = {r.doc_id for r in C.table(spark, SF01, "labels").where("quality = 1").collect()}
    grams = Q.Grams(Q.BUCKETS)
    bags = {i: np.bincount(grams.of(t.encode()), minlength=Q.BUCKETS) for i, t in texts.items()}
    raw = sum(bags.values())
    target = sum(bags[i] for i in good)
    ratio = np.log((target + 1) / (target.sum() + Q.BUCKETS)) - np.log((raw + 1) / (raw.sum() + Q.BUCKETS))
    for i, bag in bags.items():
        assert got[i].log_weight == pytest.approx(float(bag @ ratio), abs=1e-6)
    keys = sorted((r.sample_key for r in got.values()), reverse=True)
    k = round(Q.SHARE * len(texts))
    assert {r.doc_id for r in got.values() if r.selected} == {r.doc_id for r in got.values() if r.sample_key >= keys[k - 1]}
    assert sum(r.selected for r in got.values()) == k


def test_resampling_prefers_good_documents(spark):
    got = Q.query(spark, SF01).join(C.table(spark, SF01, "labels"), "doc_id").toPandas()
    assert got[got.quality == 1].selected.mean() > got[got.quality == 0].selected.mean() + 0.3


def test_gumbel_keys_sample_in_proportion_to_weights(spark):
    """With equal texts the choice is uniform and depends on the id alone."""
    df = docs(spark, ["a b"] * 4000)
    a = Q.resample(df, df.select("doc_id").limit(5), share=0.25, carry=["doc_id"]).toPandas()
    assert a.selected.sum() == 1000
    ids = np.array([r["doc_id"] for r in a.row[a.selected]])
    assert abs(ids.mean() - 2000) < 120


def test_exactly_k_rows_but_for_equal_keys(spark):
    """Keys that agree in all but their last bits are told apart; rows of one
    id and text have one key and stay together."""
    df = docs(spark, ["a b c"] * 3000)
    for share in (0.001, 0.3337, 0.999, 1.0):
        got = Q.resample(df, df.select("doc_id").limit(3), share=share, carry=["doc_id"]).toPandas()
        assert got.selected.sum() == round(3000 * share)
        assert got[got.selected].sample_key.min() >= got[~got.selected].sample_key.max() if share < 1 else got.selected.all()
    twice = Q.resample(df.unionByName(df), df.select("doc_id").limit(3), share=0.25, carry=["doc_id"]).toPandas()
    assert twice.selected.sum() == 1500 and set(twice[twice.selected].sample_key.value_counts()) == {2}
    assert Q.resample(df, df.select("doc_id"), share=0.0).where("selected").count() == 0


def test_edge_cases(spark):
    df = hard(spark)
    got = Q.resample(df, df.select("doc_id"))
    assert got.count() == 10 and got.select("row.*").columns == df.columns
    weights = {r.row.doc_id: r.log_weight for r in got.collect()}
    assert weights[1] == weights[2] == weights[3] == 0.0
    assert Q.resample(empty(spark), df.select("doc_id")).count() == 0
    none = Q.resample(df, empty(spark).select("doc_id")).collect()
    assert {r.log_weight for r in none} == {0.0}
