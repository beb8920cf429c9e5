import math
import random

import duckdb
import numpy as np
import pytest

from churnframe.llm import hard_negatives as H
from churnframe.llm import vectors as V

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=5, every=100):
    """Rows (vec_id, vector, label), each vec_id once."""
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, va, la in kept:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in kept if i != a)
        for ps, p in [(-s, i) for s, i, label in scored if label == la][:positives]:
            window = [(-s, i) for s, i, label in scored if label != la and 80 * ps <= -100 * s <= 100 * ps]
            out += [(a, p, r, n, ps, ns) for r, (ns, n) in enumerate(window[:negatives], 1)]
    return sorted(out)


def found(df, **options):
    rows = H.hard_negatives(df, options.pop("anchors", "vec_id % 100 = 0"), **options).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows)


def test_query_matches_sql(spark):
    got = H.query(spark, SF01).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF01}/embeddings.parquet')")
    want = con.sql(H.SQL).df()
    key = lambda d: sorted(d[sorted(d.columns)].itertuples(index=False, name=None))
    assert len(got) > 50 and key(got) == key(want)


def test_many_blocks_clusters_and_copies(spark, monkeypatch):
    """Deep trees, several blocks for a cell, chunks of anchors, a third of
    all rows one vector, ties throughout."""
    for name, value in (("LEAF", 8), ("LEAST_BLOCK", 40), ("BLOCK_ROWS", 40), ("FANOUT", 6), ("SAMPLE", 50), ("CHUNK", 4), ("SPLITS", 3)):
        monkeypatch.setattr(H, name, value)
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(900):
        c = centres[0] if i % 3 == 0 else [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]
        rows.append((i, c, rng.randrange(3)))
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows], every=50)
    assert len(want) > 100 and found(df, anchors="vec_id % 50 = 0") == want


def test_eliminates_far_subtrees_and_keeps_results():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c * 300, 5, (400, 4)) for c in range(10)]).astype(np.int64)
    space = H.Space(int((x * x).sum(1).max()))
    tree, compared = H.Tree(space, x), 0

    q = x[[3999, 3400]]
    want = V.products(q, x)
    low = np.array([np.sort(w)[-3] for w in want])
    real = V.products

    def counting(a, b):
        nonlocal compared
        compared += a.shape[0] * b.shape[0]
        return real(a, b)

    H.V.products = counting
    try:
        ids = np.arange(len(x))
        n, s, v = H.search(tree, x, np.zeros(len(x)), ids, q, np.zeros(2), np.array([-1, -1]), np.arange(2), low, np.full(2, H.HIGHEST), True, 3)
    finally:
        H.V.products = real
    assert compared < 0.4 * want.size
    for k in range(2):
        order = sorted((-w, i) for i, w in enumerate(want[k].tolist()))[:3]
        assert [(-a, b) for a, b in zip(s[n == k].tolist(), v[n == k].tolist())] == order


def test_edge_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1),
        (1, [1.0, 0.5], 1),
        (2, [0.9, 0.5], 2),
        (3, [1.0, 0.4], 2),
        (4, None, 2),
        (5, [1.0, None], 2),
        (6, [float("nan"), 1.0], 2),
        (7, [float("inf"), 1.0], 2),
        (8, [1.0, 0.5], None),
        (9, [], 2),
        (10, [0.95], 2),
        (None, [1.0, 0.5], 2),
        (100, [-1.0, -1.0], 3),  # an anchor without positives
        (200, [0.0, 0.0], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert want and found(df) == want
    assert found(df.unionByName(df)) == want  # repeated rows take part once
    clashing = df.selectExpr("*", "7 AS v", "8 AS norm", "'x' AS block", "9 AS lows")
    assert found(clashing) == want
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(df.where("vec_id = 0")) == []


def test_exact_beyond_doubles():
    big = np.array([[V.EXACT >> 27, 3], [1, 1]])
    assert V.products(big, big).tolist() == (big @ big.T).tolist()
    wide = np.array([[1 << 26] * 8])
    assert V.products(wide, wide - 1)[0, 0] == sum((1 << 26) * ((1 << 26) - 1) for _ in range(8))


def test_negative_floor_and_bound(spark):
    df = spark.createDataFrame([(1, [-0.001, 0.999, 1e30])], "vec_id long, embedding array<double>")
    v = V.integer_vectors(df, "embedding", 256, 1 << 26).collect()[0].v
    assert np.frombuffer(bytes(v), "<i4").tolist() == [-1, 255, 1 << 26]
    assert pytest.approx(1 << 26) == V.matrix([bytes(v)], 3)[0, 2]
