"""Token-id output: documents as rows of a packed id matrix.

Best-fit-decreasing: pieces by decreasing length, each into the open row with
the least sufficient room.  A segment tree over capacities holds how many open
rows have each residual; its descent finds the tightest one in log(capacity)
steps.  Documents longer than a row are cut losslessly: full rows and a rest,
each piece with its first token's place in the document.

A row of the result is one matrix row: ids (little-endian, padded), cumulative
segment lengths (from 0), and positions that restart at 0 with each segment
and in the padding.

Scale: ids are shuffled once, to packing groups of about ``GROUP_ROWS``
documents dealt by a hash of id, text, place and input split (so repeated rows
spread as well); the number of groups, and of the tasks that pack them, grows
with the table.

Defined results: NULL and empty texts have no ids; they are listed in a row as
a segment of length 0, so every document is in the output; ties go to the
smaller id (NULL last), then the lower start; repeated rows are packed one by
one; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C
from churnframe.llm import tokenizing

CAPACITY = 2048
GROUP_ROWS = 1024

ROW_SCHEMA = (
    "row_id long, n_tokens int, doc_ids array<long>, starts array<int>, cu_seqlens array<int>, "
    "input_ids binary, position_ids binary"
)


class CapacityTree:
    """Open rows by residual; ``take(need)`` gives the tightest fit."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, residual: int, n: int) -> None:
        node = self.size + residual
        while node:
            self.count[node] += n
            node //= 2

    def put(self, residual: int, row: int) -> None:
        self.open[residual].append(row)
        self._add(residual, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(residual, row) with the least residual of at least ``need``."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up, to a right sibling with rows
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:  # down, leftmost
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        residual = node - self.size
        row = self.open[residual].pop()
        self._add(residual, -1)
        return residual, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of positions; ``lengths`` come in decreasing order."""
    tree, rows = CapacityTree(capacity), []
    for k, n in enumerate(lengths):
        found = tree.take(n)
        if found is None:
            rows.append([])
            found = (capacity, len(rows) - 1)
        residual, row = found
        rows[row].append(k)
        tree.put(residual - n, row)
    return rows


def _pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, shipped) -> DataFrame:
    """doc, text_hash, split (of the input), start, ids: one row per piece."""
    schema = T.StructType(
        [
            C.field("doc", "long"),
            C.field("text_hash", "long"),
            C.field("split", "int"),
            C.field("start", "int"),
            C.field("ids", "binary"),
        ]
    )
    df = docs.select(
        F.col(C.quoted(id_col)).cast("long").alias("doc"),
        F.xxhash64(C.utf8(text_col)).alias("text_hash"),
        F.spark_partition_id().alias("split"),
        C.utf8(text_col).alias("text"),
    )

    def make():
        tokenizer = tokenizing.Tokenizer(shipped.value)

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    made: dict[str, list] = {n: [] for n in schema.names}
                    for doc, h, split, text in zip(*(batch.column(n).to_pylist() for n in ("doc", "text_hash", "split", "text"))):
                        ids = tokenizer.ids(text)
                        for start in range(0, max(1, len(ids)), capacity):
                            made["doc"].append(doc)
                            made["text_hash"].append(h)
                            made["split"].append(split)
                            made["start"].append(start)
                            made["ids"].append(ids[start : start + capacity].tobytes())
                    yield made

        return run

    return C.emit_rows(df, make, schema)


def pack_rows(key, pieces: pd.DataFrame, capacity: int, pad: int, dtype: np.dtype) -> pd.DataFrame:
    """The matrix rows of one packing group."""
    items = [
        (np.frombuffer(ids, dtype), None if pd.isna(doc) else int(doc), int(start), int(h))
        for doc, h, start, ids in zip(pieces.doc, pieces.text_hash, pieces.start, pieces.ids)
    ]
    items.sort(key=lambda x: (-len(x[0]), x[1] is None, x[1] or 0, x[2], x[3]))
    made = best_fit_decreasing([len(x[0]) for x in items], capacity)
    out: dict[str, list] = {n: [] for n in ("row_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids")}
    for i, row in enumerate(made):
        own = [items[k] for k in row]
        cu = np.concatenate([[0], np.cumsum([len(x[0]) for x in own])]).astype(np.int32)
        ids = np.full(capacity, pad, dtype)
        ids[: cu[-1]] = np.concatenate([x[0] for x in own])
        reset = np.zeros(capacity, np.int64)  # where the segment of each place begins
        starts = np.append(cu[:-1][np.diff(cu) > 0], cu[-1])
        reset[starts[starts < capacity]] = starts[starts < capacity]
        position = np.arange(capacity) - np.maximum.accumulate(reset)
        out["row_id"].append(int(key[0]) << 32 | i)
        out["n_tokens"].append(int(cu[-1]))
        out["doc_ids"].append([x[1] for x in own])
        out["starts"].append([x[2] for x in own])
        out["cu_seqlens"].append(cu.tolist())
        out["input_ids"].append(ids.tobytes())
        out["position_ids"].append(position.astype("<u4" if capacity > 1 << 16 else "<u2").tobytes())
    return pd.DataFrame(out)


def token_rows(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = tokenizing.VOCABULARY_FILE,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The packed matrix: see ROW_SCHEMA."""
    shipped = tokenizing.ship(C.prepare(docs.sparkSession), vocabulary)
    tokenizer = tokenizing.Tokenizer(shipped.value)
    pad, dtype = tokenizer.pad, tokenizer.dtype
    groups = max(1, -(-docs.count() // group_rows))
    pieces = _pieces(docs, id_col, text_col, capacity, shipped)
    pieces = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc", "text_hash", "start", "split"), F.lit(groups)))

    def run(key, rows):
        return pack_rows(key, rows, capacity, pad, dtype)

    return C.dealt(pieces, "packing_group", groups).groupBy("packing_group").applyInPandas(run, ROW_SCHEMA)


def write_rows(packed: DataFrame, path: str) -> None:
    """Write the matrix as Parquet: ``input_ids`` of consecutive rows,
    concatenated, are the id matrix in row order."""
    packed.write.mode("overwrite").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return token_rows(C.table(spark, sf_dir, "documents"))
