"""Benchmark decontamination by Wu-Manber multi-pattern search on words.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
characters.  A pattern is a window of 13 consecutive benchmark words (an item
with fewer words is one shorter pattern).  Per pattern length, a shift table
on blocks of two words tells how far the search may jump; at a block that ends
some pattern, the hash of the window it ends selects the suffix bucket, whose
windows are compared directly.

Defined results: NULL text has no words; an empty table gives no rows; a NULL
item id matches like any other but is not listed; repeated items and rows are
handled one by one; very long texts are searched whole; other columns ride
along untouched inside ``row``.

The benchmark is the query set.  It is read in blocks of ``BLOCK_BYTES`` of
text, a word counted as 8 bytes at least; each block is one broadcast and one
narrow pass over the documents.  A block has at most 2^20 windows, whose tables
take about 190 bytes each (measured on words that hardly repeat a pair), so
200 MB.  An item longer than a block is cut into pieces that share a window
less one word, so no window is lost.  With several blocks the rows are written
between passes and a block's broadcast is released after its pass, so neither
the driver nor a worker ever holds more than one block.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C

WINDOW = 13
BLOCK_BYTES = 8 << 20

#: Byte map: A-Z to a-z, every ASCII byte that is no word character to a space.
_MAP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_MAP).split()


class Patterns:
    """Shift table and suffix buckets of all windows of one length.  A window
    is its place in ``flat``, the word ids of all items one after the other."""

    def __init__(self, flat: array, base: int, length: int):
        self.flat, self.base, self.length = flat, base, length
        self.shift: dict[int, int] = {}  # of blocks (of words, if the length is 1)
        self.bucket: dict[int, int] = {}  # window's hash to its last entry
        self.before: dict[int, int] = {}  # entry to the one before in its bucket
        self.start = array("q")
        self.owner = array("q")
        self.owners: dict[int, set[int]] = {}  # only of windows in several items

    def find(self, window: tuple) -> int | None:
        """The entry of an equal window, by direct comparison."""
        entry = self.bucket.get(hash(window))
        while entry is not None:
            at = self.start[entry]
            if tuple(self.flat[at : at + self.length]) == window:
                return entry
            entry = self.before.get(entry)
        return None

    def items(self, entry: int) -> set[int]:
        return self.owners.get(entry) or {self.owner[entry]}

    def add(self, at: int, item: int) -> None:
        length, shift = self.length, self.shift
        window = tuple(self.flat[at : at + length])
        entry = self.find(window)
        if entry is not None:
            if self.owner[entry] != item:
                self.owners.setdefault(entry, {self.owner[entry]}).add(item)
            return
        entry, key = len(self.start), hash(window)
        if key in self.bucket:
            self.before[entry] = self.bucket[key]
        self.bucket[key] = entry
        self.start.append(at)
        self.owner.append(item)
        if length == 1:
            shift[window[0]] = 0
        for end in range(2, length + 1):
            block = window[end - 2] * self.base + window[end - 1]
            shift[block] = min(shift.get(block, length), length - end)

    def search(self, ids: list[int]) -> list[tuple[int, int]]:
        """(end, entry) of every occurring window."""
        length, base, get = self.length, self.base, self.shift.get
        out, n = [], len(ids)
        if length == 1:
            return [(at + 1, self.find((w,))) for at, w in enumerate(ids) if w in self.shift]
        step, end = length - 1, length
        while end <= n:
            move = get(ids[end - 2] * base + ids[end - 1], step)
            if move:
                end += move
                continue
            entry = self.find(tuple(ids[end - length : end]))
            if entry is not None:
                out.append((end, entry))
            end += 1
        return out


class Index:
    """The windows of one block of benchmark items, by length."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        flat, begin = array("i"), array("q", [0])
        for _, item in items:
            flat.extend(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item)
            begin.append(len(flat))
        base = len(self.vocabulary) + 1
        self.classes: dict[int, Patterns] = {}
        for k, (a, b) in enumerate(zip(begin, begin[1:])):
            length = min(window, b - a)
            if length:
                own = self.classes.setdefault(length, Patterns(flat, base, length))
                for at in range(a, b - length + 1):
                    own.add(at, k)

    def search(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Occurring windows as (start, end), and the items they belong to."""
        get = self.vocabulary.get
        ids = [get(w, 0) for w in tokens]
        spans, found = [], set()
        for length, own in self.classes.items():
            for end, entry in own.search(ids):
                spans.append((end - length, end))
                found |= own.items(entry)
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cost(tokens: list[bytes]) -> int:
    return sum(max(8, len(w) + 1) for w in tokens)


def pieces(tokens: list[bytes], window: int, most: int) -> list[list[bytes]]:
    """The words in pieces of a bounded cost (of a window at least) that hold
    every window."""
    out, start, size = [], 0, 0
    for at, w in enumerate(tokens):
        more = max(8, len(w) + 1)
        if size + more > most and at - start >= window:
            out.append(tokens[start:at])
            start = at - window + 1
            size = _cost(tokens[start:at])
        size += more
    return [*out, tokens[start:]]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int):
    """The benchmark's items in blocks of bounded size."""
    rows = benchmark.select(F.col(C.quoted(item_col)).cast("string").alias("item"), C.utf8(text_col).alias("text"))
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        tokens = words(bytes(text))
        if not tokens:
            continue
        for piece in pieces(tokens, window, block_bytes):
            more = _cost(piece)
            if block and size + more > block_bytes:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += more
    if block:
        yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: list[str] | None = None,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``row`` (the carried columns), ``n_words``, ``n_hit``, ``items`` (ids
    with an occurring window, sorted as strings) and ``spans`` (hit words as
    [start, end) pairs of word positions)."""
    spark = C.prepare(docs.sparkSession)
    span = T.ArrayType(T.ArrayType(T.IntegerType()))
    df = docs.select(
        C.packed(docs, carry),
        C.utf8(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast(span).alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    added = [C.field("n_words", "long"), C.field("spans", span), C.field("items", T.ArrayType(T.StringType()))]
    dropped = ("n_words", "spans", "items")
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes, window)
    block = next(blocks, [])
    while block is not None:
        index = spark.sparkContext.broadcast(Index(block, window))

        def make(index=index):
            at = index.value

            def work(batch):
                n, spans, items = [], [], []
                for text, old, had in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "items"))):
                    tokens = words(text)
                    new, found = at.search(tokens)
                    n.append(len(tokens))
                    spans.append(merged([*map(tuple, old or ()), *new]))
                    items.append(sorted({*(had or ()), *(at.names[k] for k in found if at.names[k] is not None)}))
                return {"n_words": n, "spans": [[list(s) for s in x] for x in spans], "items": items}

            return work

        df = C.map_batches(df, make, added, dropped)
        block = next(blocks, None)
        if block is not None:
            df = C.materialise(df)
            index.unpersist()
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return df.select("row", "n_words", hit.alias("n_hit"), "items", "spans")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, the rest stay unchanged."""
    found = decontaminate(docs, C.table(spark, sf_dir, "benchmark"))
    return found.where(~is_contaminated()).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS seq
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM patterns),
win AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS seq
  FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)),
hits AS (SELECT doc_id, win.n, i, item_id FROM win JOIN patterns USING (seq, n)),
hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
