"""Conflict-constrained best-fit packing of documents into fixed-size bins.

A document is as long as its token ids; one longer than a bin is cut into full
pieces and a rest.  No bin may hold two pieces of one source or of one
duplicate cluster (equal texts up to A-Z and white space, unless the caller
names a cluster column).  Pieces are placed by decreasing length.  Open bins
are ordered by residual capacity and carry bitmaps of their sources and
clusters; from the first bin that is large enough, the successor search goes
on until a bin has neither bit set: the tightest compatible bin.

Scale: only (id, source, cluster, length) leave the tokenizing task.  Rows are
dealt by a hash of id, cluster and input split to packing groups of about
``GROUP_ROWS`` rows - the number of groups, and of the tasks that pack them,
grows with the table, a group's memory does not - so hot sources, clusters and repeated rows spread over the
groups.

Defined results: NULL and empty texts have length 0 and still take a place;
NULL source or id conflicts with nothing (the cluster still counts); repeated
rows are packed one by one, never two in a bin; ties go to the smaller id, then
the lower piece, and among equal residuals to the older bin; an empty table
gives no bins; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.llm import common as C
from churnframe.llm import tokenizing

CAPACITY = 2048
GROUP_ROWS = 1024

BIN_SCHEMA = (
    "bin_id long, n_tokens int, n_pieces int, doc_ids array<long>, starts array<int>, lengths array<int>"
)


def cluster_of(text: bytes) -> int:
    digest = xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))
    return digest - (1 << 64) if digest >> 63 else digest


def best_fit(pieces: list[tuple], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``pieces`` - (length, source, cluster) in
    the order of placement; None conflicts with nothing."""
    seen: dict = {}
    for _, source, cluster in pieces:
        for key in (("s", source), ("c", cluster)):
            seen[key] = seen.get(key, 0) + 1
    bit: dict = {}  # a value that occurs once can't conflict and needs no bit
    for key, n in seen.items():
        if n > 1 and key[1] is not None:
            bit[key] = 1 << len(bit)
    bins: list[list[int]] = []
    bitmap: list[int] = []
    order: list[tuple[int, int]] = []  # (residual, bin)
    for k, (length, source, cluster) in enumerate(pieces):
        mine = bit.get(("s", source), 0) | bit.get(("c", cluster), 0)
        at = bisect_left(order, (length, -1))
        while at < len(order) and bitmap[order[at][1]] & mine:
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
            bins[b].append(k)
            bitmap[b] |= mine
        else:
            residual, b = capacity, len(bins)
            bins.append([k])
            bitmap.append(mine)
        # a full bin can still take empty pieces
        insort(order, (residual - length, b))
    return bins


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length): full pieces, then the rest; one empty piece for 0."""
    out = [(at, capacity) for at in range(0, length - capacity + 1, capacity)]
    rest = length % capacity
    return out + [(length - rest, rest)] if rest or not length else out


def lengths(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    cluster_col: str | None,
    vocabulary: str,
) -> DataFrame:
    """doc_id, source, cluster, n_tokens and input split of every row."""
    spark = C.prepare(docs.sparkSession)
    shipped = tokenizing.ship(spark, vocabulary)
    given = F.xxhash64(C.quoted(cluster_col)) if cluster_col else F.lit(None).cast("long")
    df = docs.select(
        F.col(C.quoted(id_col)).cast("long").alias("doc_id"),
        F.col(C.quoted(source_col)).cast("string").alias("source"),
        given.alias("given"),
        F.spark_partition_id().alias("split"),
        C.utf8(text_col).alias("text"),
    )

    def make():
        tokenizer = tokenizing.Tokenizer(shipped.value)

        def work(batch):
            texts = batch.column("text").to_pylist()
            return {"n_tokens": [len(tokenizer.ids(t)) for t in texts], "own": [cluster_of(t) for t in texts]}

        return work

    made = C.map_batches(df, make, [C.field("n_tokens", "int"), C.field("own", "long")], ("text",))
    return made.select("doc_id", "source", F.coalesce("given", "own").alias("cluster"), "n_tokens", "split")


def pack_group(key, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The bins of one packing group."""
    pieces = []
    for doc, source, cluster, n in zip(rows.doc_id, rows.source, rows.cluster, rows.n_tokens):
        doc = None if pd.isna(doc) else int(doc)
        source = None if pd.isna(source) else source
        for start, length in pieces_of(int(n), capacity):
            pieces.append((length, source, int(cluster), doc, start))
    pieces.sort(key=lambda p: (-p[0], p[3] is None, p[3] or 0, p[4], p[2], p[1] or ""))
    made = best_fit([p[:3] for p in pieces], capacity)
    return pd.DataFrame(
        {
            "bin_id": [int(key[0]) << 32 | i for i in range(len(made))],
            "n_tokens": np.array([sum(pieces[k][0] for k in b) for b in made], np.int32),
            "n_pieces": np.array([len(b) for b in made], np.int32),
            "doc_ids": [[pieces[k][3] for k in b] for b in made],
            "starts": [[pieces[k][4] for k in b] for b in made],
            "lengths": [[pieces[k][0] for k in b] for b in made],
        }
    )


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    vocabulary: str = tokenizing.VOCABULARY_FILE,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per bin: bin_id, n_tokens, n_pieces, and of its pieces doc_ids,
    starts (first token of the document) and lengths."""
    sized = lengths(docs, id_col, text_col, source_col, cluster_col, vocabulary)
    groups = max(1, -(-docs.count() // group_rows))
    dealt = F.xxhash64("doc_id", "cluster", "split")
    sized = sized.withColumn("packing_group", F.pmod(dealt, F.lit(groups)))
    sized = C.dealt(sized, "packing_group", groups)
    return sized.groupBy("packing_group").applyInPandas(lambda key, rows: pack_group(key, rows, capacity), BIN_SCHEMA)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, packed."""
    return pack(docs)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
