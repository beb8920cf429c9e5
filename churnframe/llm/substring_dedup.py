"""Substring dedup by relative Lempel-Ziv parsing.

A word goes if a window of 50 consecutive words that covers it also starts in
a document with a smaller doc_id.  Documents are parsed into factors, copies of
runs of words of earlier documents, against an index of reference blocks:

1. Blocks.  The smallest (mixed) hash of the 8-word runs inside a window is
   the window's anchor.  It depends on the window's words only, so equal
   windows have equal anchors, and a block - consecutive windows with one
   anchor - is where a copy of any of its windows can be found: about 1 in 22
   words starts one.  Every block of every document is indexed under its
   anchor, with a 128-bit hash of all its words.
2. Whole blocks.  Only anchors of two or more documents can repeat.  A block
   whose words are a block of an earlier document is a factor of that
   document's text.
3. Extension.  Any other block is laid against the reference block of its
   anchor, the earliest one, at the anchor's 8 words, and the copy is extended
   from there word by word to both sides as far as the words agree.  A copy of
   50 words or more is a factor.
4. Factor boundaries.  The windows of such a block that lie in no factor reach
   over a factor's end, or may stem from another document.  They alone are
   looked up, by a 128-bit hash against the first document and place that has
   the window; a hit is a factor of 50 words.
5. The greedy parse.  Factors of one document that continue each other in the
   same source are one; from left to right, the factor that reaches farthest
   is taken.  The words of the taken factors go.

All reference blocks of all documents are indexed; nothing is sampled or
capped, and step 4 makes the result exact whichever reference step 3 takes.
Hot anchors and passages: blocks are first reduced to one row for each
content, a block is laid against one reference only, and the joins read
written tables on both sides, which lets Spark split a hot key's rows
(``spark.sql.adaptive.skewJoin.enabled`` must be on, as it is by default).

Defined results: NULL text has no words; under 50 words nothing goes; rows of
equal doc_id never remove from each other (a repeated row stays), rows with a
NULL doc_id lose nothing and remove nothing; very long texts are one row of
numpy work; an empty table gives no rows; extra columns ride in ``row``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C

WINDOW = 50
RUN = 8  # words in an anchor's run
VOCABULARY = 500_000  # word hashes remembered by a task

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers
_WRAP = 1 << 64


class Rolling:
    """Hashes of word runs, vectorised: prefix sums of word hash times
    base^position, divided by base^start (odd bases invert modulo 2^64)."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.power = [np.ones(1, np.uint64)] * 2
        self.inverse = [np.ones(1, np.uint64)] * 2

    def grow(self, n: int) -> None:
        if len(self.power[0]) >= n:
            return
        n = max(n, 2 * len(self.power[0]), 4096)
        for k, base in enumerate(_BASES):
            for store, factor in ((self.power, base), (self.inverse, pow(base, -1, _WRAP))):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                store[k] = np.multiply.accumulate(steps)

    def words(self, tokens: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > VOCABULARY:
            known.clear()
        out = []
        for w in tokens:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def sums(self, hashes: np.ndarray, k: int) -> np.ndarray:
        self.grow(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.power[k][: len(hashes)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverse[k][start]


def anchors(hashes: np.ndarray, roll: Rolling, window: int, run: int) -> np.ndarray:
    """The anchor of every window: the smallest mixed hash of its runs."""
    sums = roll.sums(hashes, 0)
    at = np.arange(len(hashes) - run + 1)
    least = C.mixed(roll.spans(sums, 0, at, at + run))
    width, have = window - run + 1, 1
    while 2 * have <= width:  # minima over doubling widths
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def blocks(hashes: np.ndarray, roll: Rolling, window: int, run: int):
    """(anchor, hash, hash, first window, windows) of a document's blocks."""
    least = anchors(hashes, roll, window, run)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(start, len(least)))
    end = start + count + window - 1
    length = C.mixed(count.astype(np.uint64))
    b = [roll.spans(roll.sums(hashes, k), k, start, end) ^ length for k in (0, 1)]
    return least[start], b[0], b[1], start, count


def _tokens(text: bytes) -> list[bytes]:
    return text.split()  # on bytes: exactly space and \x09-\x0D


_BLOCK = T.StructType(
    [C.field(n, "long") for n in ("anchor", "b1", "b2", "doc", "text_hash", "first", "windows")]
)


def _block_rows(docs: DataFrame, window: int, run: int) -> DataFrame:
    """One row for each block of each document."""

    def make():
        roll = Rolling()

        def rows(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch, parts = whole.slice(at, 1024), []
                    columns = (batch.column(n).to_pylist() for n in ("doc", "text_hash", "text"))
                    for doc, text_hash, text in zip(*columns):
                        tokens = _tokens(text)
                        if len(tokens) >= window:
                            found = blocks(roll.words(tokens), roll, window, run)
                            parts.append((*found, np.full(len(found[0]), doc), np.full(len(found[0]), text_hash)))
                    if parts:
                        a, b1, b2, first, count, doc, text_hash = (np.concatenate(x) for x in zip(*parts))
                        yield {
                            "anchor": a.view(np.int64),
                            "b1": b1.view(np.int64),
                            "b2": b2.view(np.int64),
                            "doc": doc,
                            "text_hash": text_hash,
                            "first": first,
                            "windows": count,
                        }

        return rows

    return C.emit_rows(docs, make, _BLOCK)


_PIECE = T.StructType(
    [C.field(n, "long") for n in ("anchor", "doc", "text_hash", "first", "at")]
    + [C.field("head", "boolean"), C.field("words", "binary")]
)


def _piece_rows(docs: DataFrame, window: int, run: int) -> DataFrame:
    """The words of each document's listed blocks, and where in them the
    anchor's run of words begins."""

    def make():
        roll = Rolling()

        def rows(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    out: dict[str, list] = {n: [] for n in _PIECE.names}
                    columns = (batch.column(n).to_pylist() for n in ("doc", "text_hash", "text", "blocks"))
                    for doc, text_hash, text, listed in zip(*columns):
                        tokens = _tokens(text)
                        hashes = roll.words(tokens)
                        sums = roll.sums(hashes, 0)
                        place = np.arange(len(hashes) - run + 1)
                        runs = C.mixed(roll.spans(sums, 0, place, place + run)).view(np.int64)
                        for b in listed:
                            first, end = b["first"], b["first"] + b["windows"] + window - 1
                            own = runs[first : end - run + 1]
                            out["anchor"].append(b["anchor"])
                            out["doc"].append(doc)
                            out["text_hash"].append(text_hash)
                            out["first"].append(first)
                            out["at"].append(int((own == b["anchor"]).argmax()))
                            out["head"].append(b["head"])
                            out["words"].append(b" ".join(tokens[first:end]))
                    yield out

        return rows

    return C.emit_rows(docs, make, _PIECE)


def extend(own: list[bytes], at: int, other: list[bytes], there: int) -> tuple[int, int]:
    """The run of ``own`` around place ``at`` that equals the run of ``other``
    around ``there``, word by word to both sides: (start, end)."""
    start = at
    for a, b in zip(reversed(own[:at]), reversed(other[:there])):
        if a != b:
            break
        start -= 1
    end = at
    for a, b in zip(own[at:], other[there:]):
        if a != b:
            break
        end += 1
    return start, end


_COPY = T.StructType(
    [C.field(n, "long") for n in ("w1", "w2", "doc", "text_hash", "first", "words", "source", "source_first")]
)


def _copies(pairs: DataFrame, window: int) -> DataFrame:
    """For each block and the reference of its anchor (NULL if it is that
    itself): its factor, if long enough (``source`` is set), and the windows
    outside it (``w1`` and ``w2`` are set)."""

    def make():
        roll = Rolling()

        def rows(batches):
            for whole in batches:
                for k in range(0, whole.num_rows, 1024):
                    batch = whole.slice(k, 1024)
                    names = ("doc", "text_hash", "first", "at", "words", "ref_doc", "ref_first", "ref_at", "ref_words")
                    factors, windows = [], []
                    for doc, text_hash, first, at, words, ref, ref_first, ref_at, ref_words in zip(
                        *(batch.column(n).to_pylist() for n in names)
                    ):
                        own = words.split(b" ")
                        place = np.arange(len(own) - window + 1)
                        if ref is not None:
                            start, end = extend(own, at, ref_words.split(b" "), ref_at)
                            if end - start >= window:
                                factors.append((None, None, doc, text_hash, first + start, end - start, ref, ref_first + ref_at + start - at))
                                place = place[(place < start) | (place > end - window)]
                        if len(place):
                            hashes = roll.words(own)
                            w = [roll.spans(roll.sums(hashes, j), j, place, place + window).view(np.int64) for j in (0, 1)]
                            n = len(place)
                            windows.append((*w, np.full(n, doc), np.full(n, text_hash), first + place))
                    if factors:
                        yield dict(zip(_COPY.names, zip(*factors)))
                    if windows:
                        found = [np.concatenate(c) for c in zip(*windows)]
                        none = [None] * len(found[0])
                        yield dict(zip(_COPY.names, (*found, np.full(len(none), window), none, none)))

        return rows

    return C.emit_rows(pairs, make, _COPY)


def repeated_spans(
    docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, run: int = RUN
) -> tuple[DataFrame, list[DataFrame]]:
    """doc, text_hash, first, words, source, source_first: copies of words of
    an earlier document (they overlap); and the written tables it reads."""
    texts = docs.select(
        F.col(C.quoted(id_col)).cast("long").alias("doc"),
        F.xxhash64(C.utf8(text_col)).alias("text_hash"),
        C.utf8(text_col).alias("text"),
    ).where("doc IS NOT NULL")
    blocks = C.materialise(_block_rows(texts, window, run))

    # anchors of two or more documents; all else occurs once
    shared = blocks.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    shared = C.materialise(shared.where("low < high").select("anchor"))
    rows = C.materialise(blocks.join(shared, "anchor", "left_semi"))
    C.discard(blocks, shared)

    # reference blocks: one row for each content, held by its first document
    owners = C.materialise(rows.groupBy("anchor", "b1", "b2").agg(F.min(F.struct("doc", "first")).alias("owner")))
    heads = owners.groupBy("anchor").agg(F.min("owner").alias("reference"), F.max("owner.doc").alias("high"))
    heads = C.materialise(heads.where("reference.doc < high").select("anchor", "reference"))
    index = C.materialise(owners.join(heads, "anchor", "left"))
    parsed = C.materialise(rows.join(index, ["anchor", "b1", "b2"]).where("owner.doc < doc OR reference IS NOT NULL"))
    C.discard(rows, owners, heads, index)
    whole = parsed.where("owner.doc < doc").select(
        "doc",
        "text_hash",
        "first",
        (F.col("windows") + (window - 1)).alias("words"),
        F.col("owner.doc").alias("source"),
        F.col("owner.first").alias("source_first"),
    )

    # blocks with other words than any earlier block of their anchor
    listed = (
        parsed.where("owner.doc = doc")
        .select("doc", "text_hash", "first", "windows", "anchor", F.expr("reference = owner AND owner.first = first").alias("head"))
        .distinct()  # repeated rows
        .groupBy("doc", "text_hash")
        .agg(F.collect_list(F.struct("first", "windows", "anchor", "head")).alias("blocks"))
    )
    listed = C.materialise(listed)
    pieces = C.materialise(_piece_rows(texts.join(listed, ["doc", "text_hash"]), window, run))
    # texts of one doc_id may share a reference place: one of them is laid against
    named = [F.col(c).alias(f"ref_{c}") for c in ("doc", "first", "at", "words")]
    reference = pieces.where("head").select("anchor", F.struct("text_hash", *named).alias("r"))
    reference = reference.groupBy("anchor").agg(F.min("r").alias("r")).select("anchor", "r.*").drop("text_hash")
    reference = C.materialise(reference)
    pairs = pieces.join(reference, "anchor", "left")
    earlier = F.col("ref_doc") < F.col("doc")
    pairs = pairs.withColumns({f"ref_{c}": F.when(earlier, F.col(f"ref_{c}")) for c in ("doc", "first", "at", "words")})
    found = C.materialise(_copies(pairs.drop("head", "anchor"), window))
    C.discard(listed, pieces, reference)
    extended = found.where("source IS NOT NULL").drop("w1", "w2")

    # windows at factor boundaries
    single = found.where("source IS NULL").drop("source", "source_first", "words")
    least = single.groupBy("w1", "w2").agg(F.min(F.struct("doc", "first")).alias("low"), F.max("doc").alias("high"))
    least = C.materialise(least.where("low.doc < high").select("w1", "w2", "low"))
    boundary = single.join(least, ["w1", "w2"]).where("low.doc < doc").select(
        "doc",
        "text_hash",
        "first",
        F.lit(window).cast("long").alias("words"),
        F.col("low.doc").alias("source"),
        F.col("low.first").alias("source_first"),
    )
    return whole.unionByName(extended).unionByName(boundary), [parsed, found, least]


def greedy_parse(copies: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Factors (first, words, source, source_first) from left to right.
    Copies that continue each other in one source are joined; then, of those
    that begin at or before the end of what is covered, the one that reaches
    farthest is next.  Literal words between factors are left out."""
    joined: list[list[int]] = []
    for shift, source, first, words in sorted((f - at, s, f, n) for f, n, s, at in copies):
        last = joined[-1] if joined else None
        if last and last[0] == shift and last[1] == source and first <= last[3]:
            last[3] = max(last[3], first + words)
        else:
            joined.append([shift, source, first, first + words])
    out, covered, k = [], -1, 0
    joined.sort(key=lambda x: x[2])
    while k < len(joined):
        covered = max(covered, joined[k][2])
        best = None
        while k < len(joined) and joined[k][2] <= covered:
            if best is None or joined[k][3] > best[3]:
                best = joined[k]
            k += 1
        if best[3] > covered:
            shift, source, first, end = best
            out.append((first, end - first, source, first - shift))
            covered = end
    return out


def cut(tokens: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """The words outside all (first, words) spans."""
    if not spans:
        return tokens
    change = np.zeros(len(tokens) + 1, np.int64)
    first = np.array([a for a, _ in spans])
    np.add.at(change, first, 1)
    np.add.at(change, first + np.array([n for _, n in spans]), -1)
    keep = np.cumsum(change)[:-1] == 0
    return [tokens[i] for i in np.flatnonzero(keep)]


_FACTORS = T.ArrayType(T.StructType([C.field(n, "long") for n in ("first", "words", "source", "source_first")]))


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    window: int = WINDOW,
    run: int = RUN,
) -> DataFrame:
    """``row``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined
    by one space) and ``factors`` (first, words, source, source_first: the
    runs of words taken out and the earlier document and place that has
    them)."""
    C.prepare(docs.sparkSession)
    copies, read = repeated_spans(docs, id_col, text_col, window, run)
    entry = F.struct("first", "words", "source", "source_first")
    listed = C.materialise(copies.distinct().groupBy("doc", "text_hash").agg(F.collect_list(entry).alias("copies")))
    C.discard(*read)
    texts = docs.select(
        C.packed(docs, carry),
        F.col(C.quoted(id_col)).cast("long").alias("doc"),
        F.xxhash64(C.utf8(text_col)).alias("text_hash"),
        C.utf8(text_col).alias("text"),
    )
    both = texts.join(listed, ["doc", "text_hash"], "left").select("row", "text", "copies")

    def make():
        def work(batch):
            n, removed, kept, factors = [], [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist()):
                tokens = _tokens(text)
                parsed = greedy_parse([(c["first"], c["words"], c["source"], c["source_first"]) for c in own or ()])
                left = cut(tokens, [f[:2] for f in parsed])
                n.append(len(tokens))
                removed.append(len(tokens) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
                factors.append([dict(zip(("first", "words", "source", "source_first"), f)) for f in parsed])
            return {"n_words": n, "n_removed": removed, "kept": kept, "factors": factors}

        return work

    added = [C.field("n_words", "long"), C.field("n_removed", "long"), C.field("kept", "string"), C.field("factors", _FACTORS)]
    return C.map_batches(both, make, added, ("text", "copies"))


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(C.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i AS first, array_to_string(words[i:i + 49], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
least AS (SELECT seq, min(doc_id) AS low FROM win GROUP BY seq),
cut AS (SELECT doc_id, first FROM win JOIN least USING (seq) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, first + 50)) AS i FROM cut),
listed AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
    array_to_string(list_filter(words, lambda x, i: places IS NULL OR NOT list_contains(places, i)), ' ') AS text
  FROM w LEFT JOIN listed USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM kept
"""
