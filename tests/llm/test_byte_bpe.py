import hashlib
import random

import pytest
import tiktoken
from helpers import docs, empty, hard

from churnframe.llm import byte_bpe as B
from churnframe.llm import tokenizing

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def codec():
    with open(tokenizing.VOCABULARY_FILE, "rb") as f:
        return B.Codec(f.read())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_the_queue_is_empty_after_each_pre_token(codec):
    pieces = [b"ab", b"abababab", b"zzzzzzz", b"q" * 300, b" unbelievablest", b"ab"]
    together = codec.merge(pieces)
    assert not any(codec.words)
    assert together == [codec.merge([p])[0] for p in pieces] and codec.merge([]) == []


def test_ids_are_the_librarys(codec, library):
    rng = random.Random(5)
    signs = "aaabcde  \n\t's've!?.,0123456789éßÅ日本語\U0001f600  \x1c\x85 ABCthe ing"
    for _ in range(600):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(120)))
        ids = codec.ids(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    for text in ("<|endoftext|>", "", " ", "a" * 5000, "ab" * 3000, "x" * 200 + "日" * 300, "\n" * 999, "the" * 4000):
        assert codec.ids(text) == library.encode_ordinary(text)


def test_random_letters_in_one_long_pre_token(codec, library):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    assert codec.ids(text) == library.encode_ordinary(text)


def test_segments_do_not_show(codec, library, monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice(["we've ", "they're", "  \n ", "abc", "'r", "12", "!!", " x", "q" * 40]) for _ in range(3000))
    want = library.encode_ordinary(text)
    for width in (5, 9, 33, 64, 1000):
        monkeypatch.setattr(B, "SEGMENT", width)
        assert codec.ids(text) == want


def test_ids_outside_the_vocabulary_decode_to_nothing(codec):
    ids = codec.ids("a text")
    assert codec.decode([-1, *ids, 50256, None, 10**6]) == b"a text"
    assert codec.decode([]) == b""


def test_query_against_the_library(spark, library):
    rows = {r.doc_id: r for r in B.query(spark, SF01).collect()}
    texts = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        got = rows[doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_edge_rows(spark, library):
    df = hard(spark)
    got = B.decode(B.encode(df)).collect()
    assert len(got) == df.count()
    for r in got:
        text = r.row.row.text or ""
        assert bytes(r.decoded) == text.encode() and r.row.ids == library.encode_ordinary(text)
    assert B.encode(empty(spark)).count() == 0 and B.decode(B.encode(empty(spark))).count() == 0
    repeated = B.encode(docs(spark, ["one", "one"], ids=[1, 1])).collect()
    assert len(repeated) == 2 and repeated[0].ids == repeated[1].ids
    missing = spark.createDataFrame([(1, None), (2, [1, None])], "doc_id long, ids array<int>")
    assert {r.row.doc_id: bytes(r.decoded) for r in B.decode(missing).collect()} == {1: b"", 2: b'"'}
