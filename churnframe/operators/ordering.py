"""Distributed ordered computations: global rank, rank within groups, k-th
keys, running sums and next values without moving all rows to one task.

``row_number().over(Window.orderBy(x))`` sends every row to one task.  Here
Spark's own range sort orders the rows - ``repartitionByRange`` on the key,
``sortWithinPartitions`` - and one Arrow pass over each sorted range numbers
its rows, counts within groups and sums, before the result is written (the
ranges come from a sample, so they must not be drawn again).  That is the only
shuffle.  What a range needs from the ranges before it - a row count, a sum,
the rows of a group that goes on - is one row per range, added up on the
driver and joined back.  There is one path for every size.

Sort keys are composite and should end with a unique column (the id): then
even a key value held by a third of all rows is cut over many ranges.  NULL
sorts as the smallest value (Spark's default: first ascending, last
descending).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.session import cut_lineage, ship_code

Key = tuple[str, bool]  # (column, ascending)

PART, PLACE, RUN = "_part", "_place", "_run"


def _norm(keys: Sequence[Key | str]) -> list[Key]:
    return [(k, True) if isinstance(k, str) else (k[0], bool(k[1])) for k in keys]


def after(keys: list[Key], bound: tuple) -> Column:
    """Row strictly after ``bound`` in the order given by ``keys``."""
    expr: Column | None = None
    for (name, asc), v in reversed(list(zip(keys, bound))):
        c = F.col(name)
        if v is None:
            gt = c.isNotNull() if asc else F.lit(False)
            eq = c.isNull()
        else:
            gt = F.coalesce((c > F.lit(v)) if asc else (c < F.lit(v)), F.lit(not asc))
            eq = F.coalesce(c == F.lit(v), F.lit(False))
        expr = gt if expr is None else (gt | (eq & expr))
    return expr


def order_columns(keys: list[Key]) -> list[Column]:
    return [F.col(n).asc_nulls_first() if a else F.col(n).desc_nulls_last() for n, a in keys]


def placed(
    df: DataFrame,
    keys: Sequence[Key | str],
    parts: int | None = None,
    group: str | None = None,
    sums: Sequence[str] = (),
    suffix: str = "_cum",
) -> DataFrame:
    """``df`` in key order as a written table with ``_part`` (the range) and
    ``_place`` (0.. in it); with ``group`` (the first key), ``_run`` counts the
    rows of the group so far in the range, from 1; ``sums`` are summed up to
    and with the row, NULL as 0.  ``parts`` defaults to the shuffle
    partitions."""
    ship_code(df.sparkSession)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = order_columns(_norm(keys))
    ordered = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    floating = {c: isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) for c in sums}
    schema = T.StructType(list(df.schema.fields)).add(PART, "integer").add(PLACE, "long")
    if group is not None:
        schema = schema.add(RUN, "long")
    for c in sums:
        schema = schema.add(c + suffix, "double" if floating[c] else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, began = TaskContext.get().partitionId(), 0, None, 0
        total = {c: 0.0 if floating[c] else 0 for c in sums}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place = np.arange(seen, seen + n)
            added = [pa.array(np.full(n, part, np.int32)), pa.array(place)]
            if group is not None:
                values = batch.column(group)
                new = np.ones(n, bool)
                same = pc.equal(values[1:], values[:-1]).fill_null(False)
                both_null = pc.and_(values[1:].is_null(), values[:-1].is_null())
                new[1:] = ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
                new[0] = not seen or values[0].as_py() != last
                start = np.maximum.accumulate(np.where(new, place, began))
                began, last = int(start[-1]), values[n - 1].as_py()
                added.append(pa.array(place - start + 1))
            for c in sums:
                x = batch.column(c).cast(pa.float64() if floating[c] else pa.int64()).fill_null(0).to_numpy()
                up_to = np.cumsum(x) + total[c]
                total[c] = up_to[-1]
                added.append(pa.array(up_to))
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return cut_lineage(ordered.mapInArrow(run, schema))


def _carry(
    df: DataFrame,
    parts: list[Row],
    carry: Callable[[Row | None, Row, tuple], tuple],
    names: list[str],
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with, for each range, what ``carry(previous range, range, its
    carry)`` gives, as long columns or of ``kinds``.  ``parts``: one row per
    range."""
    rows, before, last = [], None, (0,) * len(names)
    for r in sorted(parts, key=lambda r: r[PART]):
        last = carry(before, r, last)
        rows.append((r[PART], *last))
        before = r
    schema = f"{PART} int, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds or ["bigint"] * len(names)))
    # one row per range: a bounded broadcast
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), PART)


def _sizes(df: DataFrame) -> list[Row]:
    return df.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()


def global_rank(df: DataFrame, keys: Sequence[Key | str], rank_col: str = "rank", parts: int | None = None) -> DataFrame:
    """1..n in key order; exact when the key is unique (end it with the id)."""
    rows = placed(df, keys, parts)
    rows = _carry(rows, _sizes(rows), lambda before, r, last: (last[0] + (before.n if before else 0),), ["_before"])
    return rows.withColumn(rank_col, (F.col("_before") + F.col(PLACE) + 1).cast("bigint")).drop("_before", PART, PLACE)


def rank_within(
    df: DataFrame, group_col: str, keys: Sequence[Key | str], rank_col: str = "rank", parts: int | None = None
) -> DataFrame:
    """Rank 1..n_g inside each group of ``group_col``, any number of groups,
    NULL being one of them.  Rows are ordered by (group, keys), so a group
    that holds most rows is cut over many ranges; a range is told how many
    rows its first group has in the ranges before it."""
    rows = placed(df, [(group_col, True), *_norm(keys)], parts, group=group_col)
    runs = rows.groupBy(PART, F.col(group_col).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min(PLACE).alias("at"))
    ends = runs.groupBy(PART).agg(
        F.min_by(F.struct("g"), "at").alias("first"),
        F.max_by(F.struct("g"), "at").alias("last"),
        F.max_by("n", "at").alias("n_last"),
    )

    def carry(before: Row | None, r: Row, last: tuple) -> tuple:
        if before is None or before["last"] != r["first"]:
            return (0,)
        # the group goes on; it may have filled the range before as well
        return (before.n_last + (last[0] if before["first"] == before["last"] else 0),)

    rows = _carry(rows, ends.collect(), carry, ["_before"])
    first = F.col(PLACE) + 1 == F.col(RUN)  # the range's first group
    rank = F.col(RUN) + F.when(first, F.col("_before")).otherwise(F.lit(0))
    return rows.withColumn(rank_col, rank.cast("bigint")).drop("_before", RUN, PART, PLACE)


def kth_keys(df: DataFrame, keys: Sequence[Key | str], ks: Sequence[int], parts: int | None = None) -> dict[int, tuple | bool]:
    """For each k, the key of the k-th row in order (True: all rows, False:
    none).  Only key columns are ordered."""
    keys = _norm(keys)
    names = [n for n, _ in keys]
    rows = placed(df.select(*names), keys, parts)
    sizes = {r[PART]: r.n for r in _sizes(rows)}
    total = sum(sizes.values())
    out: dict[int, tuple | bool] = {k: k > 0 for k in ks}
    wanted: dict[tuple[int, int], int] = {}
    for k in ks:
        if 0 < k < total:
            run = 0
            for part in sorted(sizes):
                if run + sizes[part] >= k:
                    wanted[(part, k - run - 1)] = k
                    break
                run += sizes[part]
    if wanted:
        at = [(F.col(PART) == p) & (F.col(PLACE) == i) for p, i in wanted]
        hit = at[0]
        for other in at[1:]:
            hit = hit | other
        for r in rows.where(hit).collect():
            out[wanted[(r[PART], r[PLACE])]] = tuple(r[n] for n in names)
    return out


def top(df: DataFrame, keys: Sequence[Key | str], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows with their rank: a top-k, then k rows numbered."""
    columns = order_columns(_norm(keys))
    return (
        df.orderBy(*columns)
        .limit(k)
        .withColumn(rank_col, F.row_number().over(Window.orderBy(*columns)).cast("bigint"))
    )


def prefix_sums(
    df: DataFrame,
    keys: Sequence[Key | str],
    sum_cols: Sequence[str],
    suffix: str = "_cum",
    parts: int | None = None,
) -> DataFrame:
    """Running (inclusive) sums in key order: longs of integer columns,
    doubles of floating ones."""
    rows = placed(df, keys, parts, sums=sum_cols, suffix=suffix)
    totals = rows.groupBy(PART).agg(*[F.max_by(c + suffix, PLACE).alias(c) for c in sum_cols]).collect()
    kinds = [rows.schema[c + suffix].dataType.simpleString() for c in sum_cols]

    def carry(before: Row | None, r: Row, last: tuple) -> tuple:
        if before is None:
            return tuple(0.0 if k == "double" else 0 for k in kinds)
        return tuple(x + before[c] for x, c in zip(last, sum_cols))

    names = [f"_before_{c}" for c in sum_cols]
    rows = _carry(rows, totals, carry, names, kinds)
    for c, b in zip(sum_cols, names):
        rows = rows.withColumn(c + suffix, F.col(c + suffix) + F.col(b))
    return rows.drop(*names, PART, PLACE)


def next_value(df: DataFrame, keys: Sequence[Key | str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with, as ``out``, the first ``value`` that is not NULL in this
    row or a later one in key order; NULL if there is none."""
    turned = [(name, not asc) for name, asc in _norm(keys)]
    schema = T.StructType(list(df.schema.fields)).add(out, df.schema[value].dataType).add(PART, "integer").add(PLACE, "long")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ship_code(df.sparkSession)
    # NULL keys sort last when turned, as they sort first in order
    columns = [F.col(n).asc_nulls_first() if a else F.col(n).desc_nulls_last() for n, a in turned]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(value)
            known = ~values.is_null().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(known, np.arange(n), -1))
            filled = values.take(pa.array(np.maximum(at, 0)))
            filled = pc.if_else(pa.array(at >= 0), filled, pa.scalar(last, values.type))
            last = filled[n - 1].as_py()
            made = [filled, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    rows = cut_lineage(df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).mapInArrow(run, schema))
    ends = rows.groupBy(PART).agg(F.max_by(out, PLACE).alias("last")).collect()

    def carry(before: Row | None, r: Row, last: tuple) -> tuple:
        if before is None:
            return (None,)
        return (last[0] if before["last"] is None else before["last"],)

    kind = rows.schema[out].dataType.simpleString()
    rows = _carry(rows, ends, carry, ["_later"], [kind])
    return rows.withColumn(out, F.coalesce(out, "_later")).drop("_later", PART, PLACE)
