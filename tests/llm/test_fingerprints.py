import hashlib
import random
import re

import pytest
from helpers import docs, empty, hard
from pyspark.sql import functions as F

from churnframe.llm import common as C
from churnframe.llm import fingerprints as P

SF01 = "/root/testdata/sf0.01"


def paragraphs(text):
    out = set()
    for line in text.split("\n"):
        out.update(re.split(r"(?<=[a-mA-M][.!?])\s+", line, flags=re.A) if len(line) > 400 else [line])
    return out


def brute(rows):
    """rows: (doc_id, text), distinct."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        h = len(text) // 2
        edited = text[: len(text) - h] + following[:h]
        like = lambda a, b: 1 - len(paragraphs(a) ^ paragraphs(b)) / (len(paragraphs(a)) + len(paragraphs(b)))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), like(text, edited), like(text, following))
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        n, sha, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(near_edited, abs=1e-12)
        assert r.near_next == pytest.approx(near_next, abs=1e-12)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in C.table(spark, SF01, "documents").collect()]
    got = P.query(spark, SF01).collect()
    check(got, brute(rows))
    prints = {}
    text = dict(rows)
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_a_text_of_one_line_keeps_what_is_not_edited(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghmnoprst") for _ in range(6)) for _ in range(9)) + ". "
    rows = [(i, "".join(sentence() for _ in range(60)).strip()) for i in range(1, 9)] + [(9, "x" * 900), (10, "no end " * 90)]
    got = {r.doc_id: r for r in P.compare_versions(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    check(list(got.values()), brute(rows))
    assert all(0.3 < got[i].near_edited < 0.8 and got[i].near_next == 0 for i in range(1, 9))


def test_very_long_texts(spark):
    rng = random.Random(3)
    lines = [f"line {k} é" for k in range(20_000)]
    changed = lines.copy()
    for k in rng.sample(range(20_000), 500):
        changed[k] = f"other {k}"
    rows = [(3, "\n".join(lines)), (2, "\n".join(changed)), (1, "x\n" * 30_000), (9, "\U0001f600" * 5)]
    check(P.compare_versions(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect(), brute(rows))


@pytest.mark.parametrize("n", [0, 1, 5, 10])
def test_peeling_recovers_the_difference(spark, n):
    shared, a, b = list(range(100, 600)), list(range(n)), list(range(1000, 1000 + n // 2))
    df = spark.createDataFrame([(shared + a, shared + b)], "a array<bigint>, b array<bigint>")
    cells = F.lit(60)
    left = P.peel(P.subtract(P.sketch(F.col("a"), cells), P.sketch(F.col("b"), cells)), cells)
    r = df.select(left.alias("r")).first().r
    assert sorted(r.found) == sorted(a + b) and all((c.n, c.k, c.c) == (0, 0, 0) for c in r.cells)


def test_too_small_a_sketch_is_noticed_and_retried(spark):
    a = list(range(300))
    df = spark.createDataFrame([(0, a, a[:100] + [999])], "pair long, a array<bigint>, b array<bigint>")
    assert df.select(P.base_differing(F.col("a"), F.col("b"))).first()[0] is None
    assert P.differing(df).first().n == 201
    assert P.differing_in_parts(df).first().n == 201


def test_single_document_is_its_own_next(spark):
    r = P.compare_versions(docs(spark, ["abc\ndef"])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abc\nabc").hexdigest()
    assert r.near_next == 1.0 and r.near_edited == pytest.approx(1 - 1 / 3)


def test_edge_cases(spark):
    df = hard(spark)
    got = P.compare_versions(df)
    assert got.count() == 10
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].sketch == by[2][0].sketch and by[1][0].n_chars == 0
    assert by[5][0] == by[5][1] and by[None][0] == by[None][1]
    # 1 is followed by the NULL id, which is followed by the largest id
    assert by[2][0].near_next == 1.0
    assert P.compare_versions(empty(spark)).count() == 0


def test_many_ranges_keep_the_order(spark):
    rows = [(i * 3 % 1009, f"doc {i * 3 % 1009}\nend") for i in range(1, 1009)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        check(P.compare_versions(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect(), brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_main_path_has_no_python(spark, capsys):
    P.query(spark, SF01).explain()
    plan = capsys.readouterr().out
    assert not any(w in plan for w in ("Python", "Pandas", "InArrow"))
