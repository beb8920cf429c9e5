import random
import re
from array import array

import pytest
from helpers import docs, duck, empty, hard, same

from churnframe.llm import decontaminate as D

SF01 = "/root/testdata/sf0.01"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=13):
    words, hit, found = tokens(text), set(), set()
    for name, item in items:
        own = tokens(item)
        n = min(window, len(own))
        patterns = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for a in range(len(words) - n + 1 if n else 0):
            if tuple(words[a : a + n]) in patterns:
                hit.update(range(a, a + n))
                found.add(name)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_query_matches_sql(spark):
    same(D.query(spark, SF01), duck(SF01, D.SQL))


@pytest.mark.parametrize("block_bytes", [70, 100, D.BLOCK_BYTES])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "ab", "É", "ñ9"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 13, 14, 20])))) for k in range(12)]
    items += [(items[-1][0], items[-1][1]), (None, "b a c"), (77, None)]
    texts = [rng.choice([" ", "-", ", "]).join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"x {items[8][1].upper()} y", items[9][1], "a"]
    got = D.decontaminate(docs(spark, texts), bench(spark, items), carry=["doc_id"], window=5, block_bytes=block_bytes)
    for r in got.collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute(texts[r.row.doc_id - 1], items, 5)


def test_edge_cases(spark):
    items = [(1, "the same text"), (2, "word"), (3, "日本 a")]
    df = hard(spark)
    got = D.decontaminate(df, bench(spark, items))
    assert got.select("row.*").columns == df.columns
    for r in got.collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.row.text, items)
    assert D.decontaminate(empty(spark), bench(spark, items)).count() == 0
    assert D.decontaminate(df, bench(spark, [])).where("n_hit > 0").count() == 0


def test_windows_of_one_hash_are_told_apart():
    # Python hashes -1 and -2 alike; word ids never are, so force a shared bucket
    own = D.Patterns(array("i", [-1, 5, -2, 5]), 10, 2)
    own.add(0, 0)
    own.add(2, 1)
    assert hash((-1, 5)) == hash((-2, 5)) and len(own.bucket) == 1
    assert own.items(own.find((-1, 5))) == {0} and own.items(own.find((-2, 5))) == {1}
    own.add(0, 3)
    assert own.items(own.find((-1, 5))) == {0, 3}


def test_search_agrees_with_a_scan_on_random_words():
    rng = random.Random(9)
    for _ in range(200):
        items = [(str(k), [rng.choice("abc").encode() for _ in range(rng.randint(1, 9))]) for k in range(4)]
        text = [rng.choice("abcd").encode() for _ in range(rng.randint(0, 30))]
        spans, found = D.Index(items, 4).search(text)
        want, own = set(), set()
        for k, (_, item) in enumerate(items):
            n = min(4, len(item))
            for i in range(len(item) - n + 1):
                for a in range(len(text) - n + 1):
                    if text[a : a + n] == item[i : i + n]:
                        want.add((a, a + n))
                        own.add(k)
        assert set(spans) == want and found == own


@pytest.mark.parametrize("most", [1, 30, 60, 1000])
def test_pieces_of_an_item_hold_every_window_and_stay_small(most):
    item = [b"w%d" % i if i % 7 else b"a-long-word-%d" % i for i in range(100)]
    parts = D.pieces(item, 5, most)
    windows = [tuple(item[i : i + 5]) for i in range(96)]
    held = [tuple(p[i : i + 5]) for p in parts for i in range(len(p) - 4)]
    assert held == windows  # each of them once
    assert all(len(p) == 5 or D._cost(p) <= max(most, D._cost(p[:5])) for p in parts)
    assert D.pieces(item[:3], 5, 1) == [item[:3]] and len(D.pieces(item, 5, 10**6)) == 1
