"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the vocabulary's pattern.  A pre-token that
is a vocabulary entry is its id; any other starts as single bytes and merges
pairs, the lowest rank first and leftmost among equals:

* positions form a linked list (``nxt``, ``prv``); each position knows the
  rank of the pair that starts there;
* a bucket per rank holds the positions whose pair had that rank when they
  were put there, and is worked off from the left;
* a bitmap over the ranks, 256 ranks to a word, has a bitmap over its non-zero
  words above it: find-first-set in that one and then in the word gives the
  lowest rank that has a bucket;
* entries are never searched for and removed: one whose pair has changed
  meanwhile is stale and skipped when it comes up.

The new pre-tokens of a text share one queue, so a bucket is found once for
all of them.  A merge costs two lookups and at most two pushes whatever the
length of a pre-token, so a run of a million letters takes n log n steps and
not n squared.  Pre-tokens seen before come from a bounded memory, which a
Python worker keeps from task to task.

Map-only: a row needs nothing but the vocabulary (under 2 MB, sent once to
each executor), so nothing is shuffled, and a lost task is read again.  Texts
over ``SEGMENT`` characters are cut into segments between two pre-tokens.

Defined results: NULL and empty texts have no ids and decode to the empty
text; bytes that are no valid UTF-8 are read as U+FFFD; repeated rows are
encoded one by one; an empty table gives no rows; extra columns ride in
``row``, whatever their names; ids that are NULL or outside the vocabulary
decode to nothing.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C
from churnframe.llm import tokenizing

SEGMENT = 1 << 20  # characters whose pre-tokens are listed at once
TOGETHER = 100_000  # pre-tokens whose new ones are merged together
REMEMBERED = 400_000  # pre-tokens in each of a worker's two memories (some 90 MB each)
LONGEST_REMEMBERED = 64  # characters
LISTED = 1 << 16  # bytes of pre-tokens up to which links are lists, which are faster than arrays
BITS = 8  # ranks to a bitmap word, as a power of two
MASK = (1 << BITS) - 1
ONE = [1 << i for i in range(1 << 12)]  # bits; enough words for a million ranks
MARGIN = 4  # a pre-token that ends this far before a cut does not depend on it


class Memory(dict):
    """Ids of pre-tokens seen before.  A new one gets an empty list, kept in
    ``pending``, which is filled when the new ones are merged together."""

    def __init__(self, older: dict[str, tuple[int, ...]]):
        super().__init__()
        self.older = older
        self.pending: dict[str, list[int]] = {}

    def __missing__(self, piece: str) -> Sequence[int]:
        ids = self.older.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        return self.pending.setdefault(piece, [])


class Codec:
    """Ids of texts and bytes of ids for one vocabulary (a file of base64
    texts and ranks)."""

    def __init__(self, content: bytes, pattern: str = tokenizing.PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.longest = max(map(len, self.ranks))
        size = max(self.ranks.values()) + 1
        self.texts = [b""] * size
        for text, rank in self.ranks.items():
            self.texts[rank] = text
        self.words = [0] * ((size >> BITS) + 1)  # the queue's bitmap, empty between two calls of merge
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.sizes = np.array([*map(len, self.texts), 0])  # the last one stands for no entry
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.texts), np.uint8)
        self.cut = regex.compile(pattern)
        self.known = Memory({})

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens that are no entries themselves.  They lie one
        after the other and share the queue: no pair reaches over an ``edge``,
        so each is merged as if it were alone, and a bucket is found once for
        all of them."""
        rank_of, longest, words, pairs = self.ranks.get, self.longest, self.words, self.pairs
        data = b"".join(pieces)
        n = len(data)
        edge = bytearray(n + 1)  # where a pre-token starts, and the end
        at = 0
        for piece in pieces:
            edge[at] = 1
            at += len(piece)
        edge[n] = 1
        links = list if n <= LISTED else lambda values: array("q", values)
        nxt, prv = links(range(1, n + 1)), links(range(-1, n - 1))
        # the rank of the pair at a position, -1 for none
        pair = links([-1 if e else pairs[a << 8 | b] for a, b, e in zip(data, data[1:], edge[1:])])
        pair.append(-1)
        buckets: dict[int, list[int]] = {}
        held = buckets.get
        for at, rank in enumerate(pair):
            if rank >= 0:
                bucket = held(rank)
                if bucket is None:
                    buckets[rank] = [at]
                else:
                    bucket.append(at)
        top = 0  # a bit for each word that is not 0
        for rank in buckets:
            words[rank >> BITS] |= ONE[rank & MASK]
            top |= ONE[rank >> BITS]
        while top:
            # the lowest rank: find first set, twice
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word << BITS | ((bits & -bits).bit_length() - 1)
            words[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            for k, at in enumerate(bucket):
                if pair[at] != rank:  # stale
                    continue
                gone = nxt[at]
                nxt[at] = end = nxt[gone]
                pair[gone] = right = before = -1
                if not edge[end]:
                    prv[end] = at
                    far = nxt[end]
                    if far - at <= longest:
                        right = rank_of(data[at:far], -1)
                        if right >= 0:
                            own = held(right)
                            if own is None:
                                buckets[right] = [at]
                                words[right >> BITS] |= ONE[right & MASK]
                                top |= ONE[right >> BITS]
                            else:
                                own.append(at)
                pair[at] = right
                if not edge[at]:
                    left = prv[at]
                    if end - left <= longest:
                        before = rank_of(data[left:end], -1)
                        if before >= 0:
                            own = held(before)
                            if own is None:
                                buckets[before] = [left]
                                words[before >> BITS] |= ONE[before & MASK]
                                top |= ONE[before >> BITS]
                            else:
                                own.append(left)
                    pair[left] = before
                if 0 <= right <= rank or 0 <= before <= rank:  # comes first: the rest of the bucket waits
                    rest = bucket[k + 1 :]
                    if rest:
                        buckets.setdefault(rank, []).extend(rest)
                        words[rank >> BITS] |= ONE[rank & MASK]
                        top |= ONE[rank >> BITS]
                    break
        out, ranks, at = [], self.ranks, 0
        for piece in pieces:
            end, ids = at + len(piece), []
            while at < end:
                after = nxt[at]
                ids.append(ranks[data[at:after]])
                at = after
            out.append(tuple(ids))
        return out

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of the whole text, a segment at a time.  What ends near
        the end of a segment is read again with the next one, so no cut shows."""
        at, width = 0, SEGMENT
        while len(text) - at > width:
            found = self.cut.findall(text, at, at + width)
            end = at + sum(map(len, found))
            while found and end > at + width - MARGIN:
                end -= len(found.pop())
            if found:
                yield found
                at, width = end, SEGMENT
            else:  # one pre-token longer than the segment
                width *= 2
        yield self.cut.findall(text, at)

    def ids(self, text: str) -> list[int]:
        return self.ids_all([text])[0]

    def ids_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text.  New pre-tokens are merged together."""
        out: list[list[int]] = [[] for _ in texts]
        held: list[tuple[list[int], list[Sequence[int]]]] = []
        waiting = 0
        for own, text in zip(out, texts):
            for found in self.pieces(text):
                held.append((own, list(map(self.known.__getitem__, found))))
                waiting += len(found)
                if waiting > TOGETHER:
                    self.settle(held)
                    waiting = 0
        self.settle(held)
        return out

    def settle(self, held: list[tuple[list[int], list[Sequence[int]]]]) -> None:
        """Fills the lists of the pending pre-tokens, then the texts' ids.  When
        the memory is full, it becomes the older one, and that is given up."""
        known, pending = self.known, self.known.pending
        todo = []
        for piece, ids in pending.items():
            whole = self.ranks.get(piece.encode())
            if whole is None:
                todo.append(piece)
            else:
                ids.append(whole)
        for piece, ids in zip(todo, self.merge([piece.encode() for piece in todo])):
            pending[piece].extend(ids)
        for own, ids in held:
            own.extend(chain.from_iterable(ids))
        held.clear()
        known.update((piece, tuple(ids)) for piece, ids in pending.items() if len(piece) <= LONGEST_REMEMBERED)
        pending.clear()
        if len(known) >= REMEMBERED:
            known.older = {}
            self.known = Memory(known)

    def decode(self, ids: Sequence[int | None]) -> bytes:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids: gathered from all entries' texts."""
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        ids = lists.flatten().fill_null(-1).to_numpy()
        none = len(self.texts)
        ids = np.where((ids >= 0) & (ids < none), ids, none)
        parts = []
        for at in range(0, len(ids), TOGETHER):
            some = ids[at : at + TOGETHER]
            size = self.sizes[some]
            shift = self.starts[some] - (np.cumsum(size) - size)
            parts.append(self.blob[np.repeat(shift, size) + np.arange(size.sum())].tobytes())
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends].astype(np.int32)
        buffers = [None, pa.py_buffer(at.tobytes()), pa.py_buffer(b"".join(parts))]
        return pa.Array.from_buffers(pa.binary(), len(lists), buffers)


_CODECS: dict[tuple, Codec] = {}


def codec_of(content: bytes, pattern: str = tokenizing.PATTERN) -> Codec:
    """This worker's codec of the vocabulary, with what it remembers."""
    key = (len(content), hash(content), pattern)
    if key not in _CODECS:
        _CODECS.clear()  # one vocabulary at a time
        _CODECS[key] = Codec(content, pattern)
    return _CODECS[key]


def encode(
    docs: DataFrame,
    vocabulary: str = tokenizing.VOCABULARY_FILE,
    pattern: str = tokenizing.PATTERN,
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (all or the given columns) and ``ids``."""
    shipped = tokenizing.ship(C.prepare(docs.sparkSession), vocabulary)
    texts = docs.select(C.packed(docs, carry), C.utf8(text_col).alias("text"))

    def make():
        codec = codec_of(shipped.value, pattern)

        def work(batch):
            found = codec.ids_all([t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()])
            values = np.fromiter(chain.from_iterable(found), np.int32)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(values))}

        return work

    return _by_bytes(texts, make, C.field("ids", T.ArrayType(T.IntegerType())), "text")


def decode(
    coded: DataFrame,
    vocabulary: str = tokenizing.VOCABULARY_FILE,
    pattern: str = tokenizing.PATTERN,
    ids_col: str = "ids",
) -> DataFrame:
    """``row`` (all columns) and ``decoded``: the bytes that the ids stand
    for, valid UTF-8 or not."""
    shipped = tokenizing.ship(C.prepare(coded.sparkSession), vocabulary)
    ids = F.coalesce(F.col(C.quoted(ids_col)).cast("array<int>"), F.array().cast("array<int>"))

    def make():
        codec = codec_of(shipped.value, pattern)

        def work(batch):
            return {"decoded": codec.decode_all(batch.column("coded_ids"))}

        return work

    both = coded.select(C.packed(coded), ids.alias("coded_ids"))
    return _by_bytes(both, make, C.field("decoded", "binary"), "coded_ids")


def _by_bytes(df: DataFrame, make, added: T.StructField, drop: str) -> DataFrame:
    """``mapInArrow`` in slices of about ``SEGMENT`` bytes, at least a row."""
    kept = [f for f in df.schema.fields if f.name != drop]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            step = max(1, whole.num_rows * SEGMENT // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                made = work(batch)[added.name]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], names=[*names, added.name])

    return df.mapInArrow(run, T.StructType([*kept, added]))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(C.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, carry=["doc_id"])
    both = decode(coded.select("row.doc_id", "ids"), path, public_tokenizers.PATTERN)
    digits = F.array_join(F.col("row.ids").cast("array<string>"), " ")
    return both.select(
        "row.doc_id",
        F.size("row.ids").cast("long").alias("n_tokens"),
        F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
