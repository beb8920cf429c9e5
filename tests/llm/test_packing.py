import random

import numpy as np
import pytest
from helpers import docs, empty, hard

from churnframe.llm import common as C
from churnframe.llm import packing as P
from churnframe.llm import token_output as O
from churnframe.llm import tokenizing

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    with open(tokenizing.VOCABULARY_FILE, "rb") as f:
        return tokenizing.Tokenizer(f.read())


def plain_best_fit(pieces, capacity):
    bins = []
    for k, (n, s, c) in enumerate(pieces):
        fits = []
        for b, bin_ in enumerate(bins):
            rest = capacity - sum(pieces[i][0] for i in bin_)
            clash = any((s is not None and pieces[i][1] == s) or (c is not None and pieces[i][2] == c) for i in bin_)
            if rest >= n and not clash:
                fits.append((rest, b))
        if fits:
            bins[min(fits)[1]].append(k)
        else:
            bins.append([k])
    return bins


@pytest.mark.parametrize("seed", range(20))
def test_conflict_best_fit_matches_brute_force(seed):
    rng = random.Random(seed)
    pieces = [
        (rng.randint(0, 30), rng.choice([None, "hot", "hot", "a", "b", "c", "d"]), rng.choice([None, 1, 2, 3, rng.randint(4, 99)]))
        for _ in range(120)
    ]
    pieces.sort(key=lambda p: -p[0])
    assert P.best_fit(pieces, 30) == plain_best_fit(pieces, 30)


@pytest.mark.parametrize("seed", range(20))
def test_segment_tree_best_fit_is_tightest(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(0, 40) for _ in range(200)), reverse=True)
    got = O.best_fit_decreasing(lengths, 40)
    assert sorted(k for row in got for k in row) == list(range(200))
    # same residual profile as a plain scan for the tightest row
    rooms = []
    for n in lengths:
        fits = sorted(r for r in rooms if r >= n)
        if fits:
            rooms.remove(fits[0])
        rooms.append((fits[0] if fits else 40) - n)
    assert sorted(40 - sum(lengths[k] for k in row) for row in got) == sorted(rooms)


def test_query_packs_every_token_of_every_document(spark, tokenizer):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    want = {i: len(tokenizer.ids(r.text.encode())) for i, r in rows.items()}
    got, seen = {}, set()
    for b in P.query(spark, SF01).collect():
        assert b.n_tokens == sum(b.lengths) <= P.CAPACITY and b.n_pieces == len(b.doc_ids) and b.bin_id not in seen
        seen.add(b.bin_id)
        sources = [rows[i].source for i in b.doc_ids]
        clusters = [P.cluster_of(rows[i].text.encode()) for i in b.doc_ids]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
        for i, start, n in zip(b.doc_ids, b.starts, b.lengths):
            got.setdefault(i, []).append((start, n))
    assert set(got) == set(want)
    for i, spans in got.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert spans[-1][0] + spans[-1][1] == want[i]


def restore(rows, tokenizer):
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.input_ids, tokenizer.dtype)
        positions = np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == O.CAPACITY and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens :] == tokenizer.pad).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (positions[a:b] == np.arange(b - a)).all()
            pieces.setdefault(doc, []).append((start, ids[a:b]))
        assert (positions[r.n_tokens :] == np.arange(O.CAPACITY - r.n_tokens)).all()
    return {d: np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])]) for d, p in pieces.items()}


def test_token_rows_round_trip(spark, tokenizer, scratch):
    O.write_rows(O.query(spark, SF01), f"{scratch}/matrix")
    rows = spark.read.parquet(f"{scratch}/matrix").collect()
    assert len({r.row_id for r in rows}) == len(rows)
    back = restore(rows, tokenizer)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert set(back) == set(texts)
    for i, text in texts.items():
        assert tokenizer.text(back[i]) == text
    filled = sum(r.n_tokens for r in rows) / (len(rows) * O.CAPACITY)
    assert filled > 0.9


def test_long_texts_are_encoded_whole(tokenizer):
    text = " ".join(f"word{i} It's, {i}  x\n" for i in range(9000))
    old = tokenizing.PIECE
    tokenizing.PIECE = 1000
    try:
        pieces = tokenizer.ids(text.encode())
    finally:
        tokenizing.PIECE = old
    assert (pieces == tokenizer.ids(text.encode())).all()


def test_edge_cases(spark, tokenizer):
    df = hard(spark)
    bins = P.pack(df).collect()
    placed = sorted((i for b in bins for i, s in zip(b.doc_ids, b.starts) if s == 0), key=lambda x: (x is None, x))
    assert placed == [1, 2, 3, 4, 5, 5, 7, 8, None, None]
    assert all(b.doc_ids.count(5) <= 1 for b in bins)
    assert P.pack(empty(spark)).count() == 0 and O.token_rows(empty(spark)).count() == 0
    rows = O.token_rows(df).collect()
    starts = sorted((i for r in rows for i, s in zip(r.doc_ids, r.starts) if s == 0), key=lambda x: (x is None, x))
    assert starts == placed


def test_given_clusters_keep_documents_apart(spark):
    df = docs(spark, [f"text {i}" for i in range(9)], sources=list("abcdefghi")).selectExpr("*", "doc_id % 3 AS c")
    bins = P.pack(df, cluster_col="c").collect()
    assert len(bins) == 3 and all(len({i % 3 for i in b.doc_ids}) == len(b.doc_ids) for b in bins)
    assert len(P.pack(df).collect()) == 1


def test_pipeline_tables_have_the_document_columns(spark):
    assert C.table(spark, SF01, "documents").columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeated_rows_spread_over_groups(spark):
    """One row repeated is a third of the table: no group holds it all."""
    hot = docs(spark, ["the same text"] * 3000, ids=[7] * 3000).repartition(8)
    sized = P.lengths(hot, "doc_id", "text", "source", None, tokenizing.VOCABULARY_FILE)
    assert sized.select("split").distinct().count() == 8
    bins = P.pack(hot, group_rows=100).collect()
    assert len(bins) == 3000 and len({b.bin_id >> 32 for b in bins}) > 4
