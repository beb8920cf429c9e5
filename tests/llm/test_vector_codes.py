import math
import random

import duckdb
import numpy as np
import pytest

from churnframe.llm import vector_codes as P

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Plain loops over the kept rows (vec_id, vector, label)."""
    kept = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max(len(v) for _, v, _ in kept)
    length = max(1, -(-width // parts))
    kept = [(i, v + [0] * (parts * length - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0]))[:entries]
    cut = lambda v, k: v[k * length : (k + 1) * length]
    books = [[cut(v, k) for _, v, _ in first] for k in range(parts)]

    def pick(v, k):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, k), e)), n) for n, e in enumerate(books[k]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for k in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(pick(v, k)[1], []).append(cut(v, k))
            for n, members in groups.items():
                new[k][n] = [sum(c) // len(members) for c in zip(*members)]
        books = new
    coded = [(i, [pick(v, k) for k in range(parts)], label) for i, v, label in kept]
    return sorted(((i, [n for _, n in c], sum(d for d, _ in c)) for i, c, _ in coded), key=str), books


def found(df, **options):
    coded, books = P.compress(df, **options)
    return sorted(((r.row.vec_id, r.codes, r.error) for r in coded.collect()), key=str), books


def test_query_matches_sql(spark):
    got = P.query(spark, SF01).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF01}/embeddings.parquet')")
    want = con.sql(P.SQL).df()
    key = lambda d: sorted(d[sorted(d.columns)].itertuples(index=False, name=None))
    assert len(got) == 500 and key(got) == key(want)


def test_query_matches_plain_loops(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    want, books = brute(rows)
    got = {r.vec_id: r for r in P.query(spark, SF01).collect()}
    errors = {}
    for (i, codes, error), label in zip(sorted(want), (r[2] for r in sorted(rows))):
        assert got[i].code == "".join(f"{c:02x}" for c in codes) and got[i].error == error
        errors[label] = errors.get(label, 0) + error
    assert all(got[i].label_error == errors[label] for i, _, label in rows)
    assert {r.codebooks_sha256 for r in got.values()} == {P.books_digest(np.array(books))}


def test_bounds_prune_and_ties_go_to_the_lower_entry():
    rng = np.random.default_rng(1)
    entries = np.concatenate([rng.integers(-2000, 2000, (14, 8))] * 2)  # every entry twice
    parts = np.concatenate([entries, entries[rng.integers(0, 28, 3000)] + rng.integers(-90, 90, (3000, 8))])
    pivots = entries[P.choose_pivots(entries, 4)]
    assert len(pivots) == 4
    own = np.sqrt(P.distances(parts, pivots))
    index, best, tried = P.nearest(parts, own, entries, pivots)
    every = P.distances(parts, entries)
    assert (index == every.argmin(1)).all() and (best == every.min(1)).all() and (index < 14).all()
    assert tried < 0.5 * every.size


@pytest.mark.parametrize("width", [1, 5, 11])
def test_edge_rows(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.choice([-0.75, 0.1, rng.uniform(-1, 1)]) for _ in range(width)], i % 3) for i in range(40)]
    rows += [(41, None, 1), (42, [None] * width, 1), (43, [float("nan")] * width, 1), (44, [float("-inf")], 1), (45, [], None)]
    rows += [(46, rows[3][1], None), (47, rows[3][1] + [0.5], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want, books = brute(rows, parts=3, entries=4, rounds=3)
    got, mine = found(df, parts=3, entries=4, rounds=3)
    assert got == want and mine.tolist() == books
    repeated, _ = found(df.unionByName(df.where("vec_id >= 20")), parts=3, entries=4, rounds=3)
    assert len(repeated) == len(want) + sum(i >= 20 for i, *_ in want)
    clashing = df.selectExpr("*", "7 AS v", "'x' AS codes", "9 AS error", "1 AS to_pivots")
    assert found(clashing, parts=3, entries=4, rounds=3)[0] == want


def test_few_rows_null_ids_and_none(spark):
    rows = [(None, [0.5, 0.25], 1), (3, [0.125, -0.25], None)]
    want, books = brute(rows, parts=2)
    got, mine = found(spark.createDataFrame(rows, SCHEMA), parts=2)
    assert got == want and mine.tolist() == books
    coded, books = P.compress(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and books.size == 0 and coded.columns == ["row", "codes", "error"]


def test_absurd_components_are_held(spark):
    coded, books = P.compress(spark.createDataFrame([(1, [1e30, -1e30], 0), (2, [0.0, 0.0], 0)], SCHEMA), parts=1, entries=1, rounds=1)
    assert books.ravel().tolist() == [1 << 26, -(1 << 26)] and {r.error for r in coded.collect()} == {2 << 52}
