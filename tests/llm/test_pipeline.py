"""Each stage against a brute-force reading of its own input, then run()."""

import corpus_pipeline
import pytest
from helpers import docs, hard, labels, save
from test_decontaminate import brute as contamination
from test_secret_scan import brute as rule_spans
from test_simhash import plain_components, plain_print

from churnframe.llm import common as C
from churnframe.llm import packing as P
from churnframe.llm import secret_scan, toxicity

SF001 = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    """The input of each stage and the result of the last, at sf0.001."""
    out, df = [], C.table(spark, SF001, "documents")
    for _, stage in corpus_pipeline.STAGES:
        out.append(df)
        df = C.materialise(stage(spark, df, SF001))
    return [*out, df]


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing",
    ]


def test_columns_stay(tables):
    for df in tables[:-1]:
        assert df.dtypes == tables[0].dtypes


def test_toxic_documents_go(spark, tables):
    model = toxicity.train(tables[0], C.table(spark, SF001, "labels"))
    scored = toxicity.score(tables[0], model, carry=["doc_id"]).collect()
    want = {r.row.doc_id for r in scored if r.score < 0.7}
    before, after = rows_of(tables[0]), rows_of(tables[1])
    assert set(after) == want and all(after[i] == before[i] for i in after)


def test_one_document_of_each_group_stays(tables):
    before, after = rows_of(tables[1]), rows_of(tables[2])
    ids = sorted(before)
    roots = plain_components([plain_print(before[i].text) for i in ids])
    assert set(after) == {ids[r] for r in roots} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_contaminated_documents_go(spark, tables):
    items = [(r.item_id, r.text) for r in C.table(spark, SF001, "benchmark").collect()]
    before, after = rows_of(tables[2]), rows_of(tables[3])
    want = set()
    for i, r in before.items():
        n, hit, _ = contamination(r.text, items)
        if not (hit > 0 and 20 * hit >= n):
            want.add(i)
    assert set(after) == want and all(after[i] == before[i] for i in after)


def test_secrets_are_replaced_and_nothing_else(tables):
    before, after = rows_of(tables[3]), rows_of(tables[4])
    assert set(before) == set(after)
    for i, r in after.items():
        spans = [(a, b) for a, _, b in rule_spans(before[i].text)]
        assert not rule_spans(r.text) and r.n_chars == len(r.text)
        if "[SECRET]" not in r.text:
            assert r == before[i] and not spans
        elif r.text.count("[SECRET]") <= len(spans):
            assert r.text == secret_scan.redacted(before[i].text, spans)


def test_every_document_is_packed(spark, tables):
    before = rows_of(tables[4])
    bins = corpus_pipeline.run(spark, SF001).collect()
    assert {i for b in bins for i in b.doc_ids} == set(before)
    assert all(b.n_tokens <= P.CAPACITY for b in bins)
    for b in bins:
        sources = [before[i].source for i in b.doc_ids]
        assert len(set(sources)) == len(sources)
    assert sorted(map(str, bins)) == sorted(map(str, tables[5].collect()))


def test_hard_rows_and_an_empty_table(spark, scratch):
    save(hard(spark), scratch, "documents")
    save(labels(spark, [(1, 1, 0), (4, None, 1), (None, 0, 1)]), scratch, "labels")
    save(spark.createDataFrame([(1, "nothing in common at all"), (2, None)], "item_id long, text string"), scratch, "benchmark")
    bins = corpus_pipeline.run(spark, scratch).collect()
    assert sorted((i for b in bins for i, s in zip(b.doc_ids, b.starts) if s == 0), key=str) == [1, 4, 5, 7, 8, None, None]
    save(docs(spark, []), scratch, "documents")
    assert corpus_pipeline.run(spark, scratch).count() == 0
