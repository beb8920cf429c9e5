import random
import re

import numpy as np
import pytest
import xxhash
from helpers import docs, empty, hard

from churnframe.llm import simhash as S
from churnframe.llm.components import components

SF01 = "/root/testdata/sf0.01"


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, most=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fps[i:] ^ fps[i]) <= most) + i:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in S.query(spark, SF01).collect()}
    rows = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_print(r.text) for r in rows]
    roots = plain_components(prints)
    for r, p, root in zip(rows, prints, roots):
        assert got[r.doc_id].fingerprint == f"{p:016x}"
        assert got[r.doc_id].component_id == rows[root].doc_id
    assert len(set(roots)) < len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_reach_every_pair_within_four_bits(spark, seed):
    rng = random.Random(seed)
    prints = set()
    for _ in range(150):
        center = rng.getrandbits(64)
        prints.add(center)
        for _ in range(rng.randint(0, 12)):  # chains drift away from the centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                center ^= 1 << b
            prints.add(center)
    tight = rng.getrandbits(64)  # one tight group, far more than fits a small bucket
    prints |= {tight ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.root for r in components(S.links(df)).collect()}
    roots = plain_components(prints)
    groups = {}
    for p, root in zip(signed, roots):
        groups.setdefault(root, []).append(p)
    for group in groups.values():
        if len(group) > 1:
            assert {got[p] for p in group} == {min(group)}
        else:
            assert group[0] not in got


def test_large_anchors_are_cut_into_tiles_and_lose_no_link(spark, monkeypatch):
    """Fingerprints that agree in a block, with edits elsewhere: one anchor
    holds them all."""
    monkeypatch.setattr(S, "ANCHOR_ROWS", 40)
    rng = random.Random(8)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(700):
        p = rng.choice(sorted(prints)) if rng.random() < 0.6 else base
        for b in rng.sample(range(22, 64), rng.randint(1, 7)):
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    sizes = [r["count"] for r in S._tiled(S._anchor_rows(df)).groupBy("anchor").count().collect()]
    assert max(sizes) < 3 * 40
    got = {r.node: r.root for r in components(S.links(df)).collect()}
    groups = {}
    for p, root in zip(signed, plain_components(prints)):
        groups.setdefault(root, []).append(p)
    assert max(map(len, groups.values())) > 20
    for group in groups.values():
        assert {got.get(p, p) for p in group} == {min(group)}


def test_every_value_has_its_home_anchor_within_the_radius():
    for _, bits in S.BLOCKS:
        for masks in S._flips(bits, 2):
            assert int(masks[0]).bit_count() <= S.RADIUS
            assert all(int(m).bit_count() <= 2 for m in masks) and len(set(masks.tolist())) == len(masks)


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([((i * 37) % 301, ((i + 1) * 37) % 301) for i in range(n)], "u long, v long")
    got = {(r.node, r.root) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(301)}


def test_edge_cases(spark):
    got = S.near_duplicates(hard(spark)).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].fp == by[2].fp == by[3].fp == 0
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert [r.component_id for r in got if r.doc_id == 5] == [5, 5]
    assert S.near_duplicates(empty(spark)).count() == 0
    staged = S.stage(spark, hard(spark), None)
    assert staged.columns == hard(spark).columns
    ids = sorted((r.doc_id for r in staged.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 4, 5, 7, 8, None, None]


def test_different_texts_of_one_id_are_different_rows(spark):
    texts = ["one two three four five six", "une deux trois quatre cinq", "One two  three four five six", "one two three four five six"]
    staged = S.one_of_each(docs(spark, texts, ids=[5, 5, 9, 5]))
    assert sorted((r.doc_id, r.text.lower().split()[0]) for r in staged.collect()) == [(5, "one"), (5, "une")]


def test_fewer_words_hash_as_one_sequence(spark):
    rows = S.near_duplicates(docs(spark, ["Two  words", "two words", "two  other"])).orderBy("doc_id").collect()
    assert rows[0].fp == rows[1].fp and rows[0].component_id == rows[1].component_id == 1
    assert np.int64(rows[0].fp).view(np.uint64) == xxhash.xxh64_intdigest(b"two words", 42)
