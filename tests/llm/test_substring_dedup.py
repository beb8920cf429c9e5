import hashlib
import random
import re

import pytest
from helpers import docs, duck, empty, hard, same

from churnframe.llm import substring_dedup as D

SF01 = "/root/testdata/sf0.01"


def brute(rows, window):
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in tokens:
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in tokens:
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and least[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def run(df, window, run):
    got = D.dedup_substrings(df, carry=["doc_id"], window=window, run=run).collect()
    return sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr)


def test_query_matches_sql(spark):
    same(D.query(spark, SF01), duck(SF01, D.SQL))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    """Few words and shared passages give repeats, overlaps and boundaries."""
    rng = random.Random(seed)
    passages = [[f"p{rng.randint(0, 30)}" for _ in range(rng.randint(5, 40))] for _ in range(8)]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) - 1)
                words += p[a : a + rng.randint(1, 40)]
            else:
                words += [f"u{rng.randint(0, 4)}" for _ in range(rng.randint(1, 15))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += rng.sample(texts, 20)
    ids = rng.sample(range(1000), len(texts))
    assert run(docs(spark, texts, ids), 10, 3) == brute(list(zip(ids, texts)), 10)


def test_periodic_and_very_long_texts(spark):
    texts = ["a b " * 100, "a b " * 30_000, "a " * 49, "c " * 60 + "a b " * 40, "a b c " * 50]
    assert run(docs(spark, texts), 50, 8) == brute(list(enumerate(texts, 1)), 50)


def test_edge_cases(spark):
    df = hard(spark)
    assert run(df, 50, 8) == brute([(r.doc_id, r.text) for r in df.collect()], 50)
    full = D.dedup_substrings(df)
    assert full.select("row.*").columns == df.columns
    assert D.dedup_substrings(empty(spark)).count() == 0


def test_equal_ids_never_remove_from_each_other(spark):
    long = " ".join(f"w{i}" for i in range(80))
    got = run(docs(spark, [long, long, long], [4, 4, 9]), 50, 8)
    assert [(i, gone) for i, _, gone, _ in got] == [(4, 0), (4, 0), (9, 80)]


def test_digest_is_of_the_kept_words(spark):
    rows = {r.doc_id: r for r in D.query(spark, SF01).where("n_removed = n_words AND n_words > 0").collect()}
    assert rows
    assert all(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in rows.values())


def sources(df, window, run):
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in df.collect()}
    for r in D.dedup_substrings(df, carry=["doc_id"], window=window, run=run).collect():
        yield r.row.doc_id, texts, [(f.first, f.words, f.source, f.source_first) for f in r.factors], r.n_removed


@pytest.mark.parametrize("seed", range(2))
def test_factors_are_copies_of_earlier_documents(spark, seed):
    rng = random.Random(seed + 10)
    passages = [[f"p{rng.randint(0, 60)}" for _ in range(rng.randint(12, 60))] for _ in range(6)]
    texts = [" ".join(w for _ in range(rng.randint(1, 5)) for w in [*rng.choice(passages), f"u{rng.randint(0, 99)}"]) for _ in range(80)]
    seen = 0
    for doc, all_words, factors, removed in sources(docs(spark, texts), 10, 3):
        words = all_words[doc]
        covered = set()
        for first, n, source, at in factors:
            assert source < doc and n >= 10
            assert words[first : first + n] == all_words[source][at : at + n]
            covered.update(range(first, first + n))
        assert len(covered) == removed
        assert [f[0] for f in factors] == sorted(f[0] for f in factors)
        seen += len(factors)
    assert seen > 100


def test_factors_are_as_long_as_a_plain_parser_finds_them(spark):
    """Documents that copy from one reference text, each from a part of its
    own: each factor is the longest match at its place."""
    rng = random.Random(4)
    reference = [f"w{i}" for i in range(60_000)]
    part = iter(range(0, 60_000, 400))
    texts, want = [" ".join(reference)], {}
    for doc in range(2, 30):
        words, spans = [], []
        for k in range(rng.randint(1, 5)):
            words += [f"new{doc}_{k}_{j}" for j in range(rng.randint(1, 30))]
            a, n = next(part) + rng.randrange(90), rng.randint(3, 300)
            if n >= 50:
                spans.append((len(words), n, 1, a))
            words += reference[a : a + n]
        texts.append(" ".join(words))
        want[doc] = spans
    got = {doc: factors for doc, _, factors, _ in sources(docs(spark, texts), 50, 8)}
    assert got.pop(1) == [] and got == want and sum(map(len, want.values())) > 40


def test_extension_stops_at_the_first_other_word():
    own, other = (t.encode().split() for t in ("x a b c d e y", "q q a b c d e z"))
    assert D.extend(own, 3, other, 4) == (1, 6)
    assert D.extend(own, 0, other, 0) == (0, 0)
    assert D.extend(own, 1, own, 1) == (0, 7)


def test_greedy_parse_joins_and_takes_the_farthest():
    copies = [(0, 50, 1, 100), (10, 50, 1, 110), (60, 50, 1, 160), (5, 120, 2, 0), (300, 50, 3, 7), (310, 50, 3, 99)]
    assert D.greedy_parse(copies) == [(0, 110, 1, 100), (5, 120, 2, 0), (300, 50, 3, 7), (310, 50, 3, 99)]
    assert D.greedy_parse([(0, 50, 1, 0), (20, 50, 2, 0), (40, 50, 3, 0)]) == [(0, 50, 1, 0), (40, 50, 3, 0)]
    assert D.greedy_parse([]) == []
