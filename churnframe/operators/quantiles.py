"""Exact order statistics and quantiles of many columns at once, unsorted.

A double's bits, with the sign turned round, order like the number.  The value
at a rank is found eight bits at a time: one pass counts, for every column and
every prefix still looked for, the rows by their next eight bits; the rank
picks one of the 256 and goes on below it.  Eight passes over the rows settle
all ranks of all columns; a pass shuffles and collects at most 256 counts per
rank, task and column, and nothing is sorted.

NULLs do not count; NaN comes after every number; -0.0 is 0.0.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.session import ship_code

DIGIT = 8
_TOP = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    bits = (x + 0.0).view(np.uint64)  # -0.0 + 0.0 is 0.0
    bits = np.where(np.isnan(x), np.uint64(0x7FF8 << 48), bits)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def from_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Rows that are not NULL."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).collect()[0]
    return {c: int(row[c]) for c in columns}


def order_statistics(df: DataFrame, ranks: Mapping[str, Iterable[int]]) -> dict[str, dict[int, float]]:
    """For each column, the value at each rank (from 0, NULLs left out)."""
    ship_code(df.sparkSession)
    columns = list(ranks)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    # (column, rank) -> (bits found, rank below them)
    found = {(c, r): (0, r) for c in columns for r in ranks[c]}
    schema = "col int, prefix int, digit int, n bigint"
    for shift in range(64 - DIGIT, -1, -DIGIT):
        wanted = [sorted({found[c, r][0] for r in ranks[c]}) for c in columns]

        def run(batches, shift=shift, wanted=wanted):
            totals = [np.zeros(len(p) << DIGIT, np.int64) for p in wanted]
            for batch in batches:
                for i, prefixes in enumerate(wanted):
                    bits = ordered_bits(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                    if not prefixes:
                        continue
                    above = bits >> np.uint64(shift + DIGIT) if shift + DIGIT < 64 else np.zeros_like(bits)
                    known = np.array(prefixes, np.uint64)
                    at = np.minimum(np.searchsorted(known, above), len(known) - 1)
                    hit = known[at] == above
                    digit = (bits[hit] >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)
                    cell = (at[hit] << DIGIT) | digit.astype(np.int64)
                    totals[i] += np.bincount(cell, minlength=len(totals[i]))
            for i, total in enumerate(totals):
                used = np.flatnonzero(total)
                if len(used):
                    made = [np.full(len(used), i), used >> DIGIT, used & ((1 << DIGIT) - 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(m.astype(np.int32)) for m in made), pa.array(total[used])],
                        names=["col", "prefix", "digit", "n"],
                    )

        table: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in rows.mapInArrow(run, schema).groupBy("col", "prefix", "digit").agg(F.sum("n").alias("n")).collect():
            table.setdefault((r.col, r.prefix), []).append((r.digit, r.n))
        for i, c in enumerate(columns):
            place = {p: k for k, p in enumerate(wanted[i])}
            for rank in ranks[c]:
                prefix, left = found[c, rank]
                for digit, n in sorted(table.get((i, place[prefix]), [])):
                    if left < n:
                        found[c, rank] = (prefix << DIGIT | digit, left)
                        break
                    left -= n
                else:
                    raise ValueError(f"column {c} has no row at rank {rank}")
    return {c: {r: from_bits(found[c, r][0]) for r in ranks[c]} for c in columns}


def quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles (numpy's default) of every column; a
    column without values has None."""
    n = counts(df, columns)
    places = {c: [(n[c] - 1) * q for q in qs] for c in columns if n[c]}
    ranks = {c: sorted({f(p) for p in at for f in (math.floor, math.ceil)}) for c, at in places.items()}
    values = order_statistics(df, ranks) if ranks else {}

    def at(c: str, p: float) -> float:
        lo, hi = values[c][math.floor(p)], values[c][math.ceil(p)]
        return lo if lo == hi else lo + (p - math.floor(p)) * (hi - lo)

    return {c: [at(c, p) for p in places[c]] if n[c] else [None] * len(qs) for c in columns}


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, columns, [0.5]).items()}
