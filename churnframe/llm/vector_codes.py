"""Vector code compression (product quantisation) with LAESA pivots.

A vector is cut into equal consecutive parts; each part position has a
codebook, and a part's code is its nearest entry.  Codebooks start as given
rows' parts and move to their parts' floored means for a fixed number of
rounds.  All of it is integer work, so results do not depend on the
partitioning.

LAESA.  A few fixed pivots for each part position (the first codebook's
entries that lie farthest apart).  The distances from every part to its
pivots are computed once and written with the row.  In a round only the
distances from pivots to entries are new, and for each part and entry
|d(part, pivot) - d(entry, pivot)|, the largest over the pivots, is a lower
bound of d(part, entry).  Entries are tried in the order of their bounds by
the exact integer distance; a part is settled as soon as the next bound lies
above its best distance.  An entry with a bound equal to it (within a slack
for rounding) is still tried, so ties go to the lower index.

Scale.  Every round is one map over the written rows; a task returns the
counts and sums of its parts (parts x entries rows), so a round shuffles some
kilobytes a task whatever the rows, and the driver holds the codebooks only.
The driver never sees rows but the initial ones.  Sums are decimals.

Defined results: rows with a NULL vector or any NULL or non-finite component
are not coded; vectors are padded with zeros to the longest and to a multiple
of ``parts``; components are held within +-2^27; fewer rows than entries: that
many entries; equal ids take their place by vector, a NULL id comes last; a
repeated row is coded as often as it occurs; NULL labels are one group; error
sums stop at the largest long; an empty table gives no rows and empty
codebooks; extra columns ride in ``row`` whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C
from churnframe.llm import vectors as V

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BOUND = 1 << 27
PIVOTS = 4
LONG = 9_223_372_036_854_775_807


def distances(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``parts`` and ``points``."""
    return np.stack([((parts - p) ** 2).sum(1) for p in points], axis=1)


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Places of up to ``n`` entries that lie far apart."""
    chosen, gap = [0], distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(n, len(entries)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(entries, entries[chosen[-1:]])[:, 0])
    return np.array(chosen)


def nearest(parts: np.ndarray, own: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each part, and the exact evaluations made.
    ``own``: (part, pivot) distances."""
    table = np.sqrt(distances(entries, pivots))
    bound = np.zeros((len(parts), len(entries)))
    for p in range(len(pivots)):
        bound = np.maximum(bound, np.abs(own[:, p, None] - table[None, :, p]))
    slack = 1e-9 + 1e-12 * (own.max(initial=0) + table.max(initial=0))
    order = bound.argsort(axis=1, kind="stable")
    index = order[:, 0].copy()
    best = ((parts - entries[index]) ** 2).sum(1)
    live, tried = np.arange(len(parts)), len(parts)
    for step in range(1, len(entries)):
        entry = order[live, step]
        ahead = bound[live, entry] - slack <= np.sqrt(best[live])
        live, entry = live[ahead], entry[ahead]
        if not len(live):
            break
        d = ((parts[live] - entries[entry]) ** 2).sum(1)
        tried += len(live)
        better = (d < best[live]) | ((d == best[live]) & (entry < index[live]))
        best[live[better]], index[live[better]] = d[better], entry[better]
    return index, best, tried


class Coder:
    """Codebooks of all part positions with their pivots; it travels whole to
    the tasks (parts x entries x part length integers)."""

    def __init__(self, books: np.ndarray, pivots: list[np.ndarray]):
        self.books, self.pivots = books, pivots  # (part, entry, place)
        self.parts, _, self.length = books.shape
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pivots])])

    def cut(self, v: list[bytes]) -> np.ndarray:
        """(row, part, place)."""
        return V.matrix(v, self.parts * self.length).reshape(len(v), self.parts, self.length)

    def to_pivots(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.concatenate([distances(rows[:, k], p) for k, p in enumerate(self.pivots)], axis=1))

    def assign(self, batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, (row, part) entries, (row, part) squared distances)."""
        rows = self.cut(batch.column("v").to_pylist())
        own = np.frombuffer(b"".join(batch.column("to_pivots").to_pylist()), "<f8").reshape(len(rows), -1)
        found = [
            nearest(rows[:, k], own[:, self.offsets[k] : self.offsets[k + 1]], self.books[k], self.pivots[k])
            for k in range(self.parts)
        ]
        return rows, np.stack([x[0] for x in found], 1), np.stack([x[1] for x in found], 1)


def _first_books(rows: DataFrame, id_col: str, parts: int, entries: int) -> np.ndarray | None:
    width = rows.agg(F.max(F.length("v"))).collect()[0][0]
    if width is None:
        return None
    length = max(1, -(-(int(width) // 4) // parts))
    first = rows.select(F.col(f"row.{C.quoted(id_col)}").alias("i"), "v").orderBy(F.asc_nulls_last("i"), "v").limit(entries)
    first = first.collect()
    return V.matrix([bytes(r.v) for r in first], parts * length).reshape(len(first), parts, length).transpose(1, 0, 2).copy()


def _sums(rows: DataFrame, coder: Coder) -> list:
    """part, entry, place, total, n: the parts of each entry, summed."""
    schema = T.StructType([C.field(n, "int") for n in ("part", "entry", "place")] + [C.field(n, "long") for n in ("total", "n")])
    parts, entries, length = coder.books.shape
    index = np.indices((parts, entries, length)).reshape(3, -1)

    def make():
        def run(batches):
            total, n, seen = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64), 0

            def out():
                used = np.repeat(n.ravel() > 0, length)
                part, entry, place = index[:, used]
                return {"part": part, "entry": entry, "place": place, "total": total.ravel()[used], "n": np.repeat(n.ravel(), length)[used]}

            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    cut, own, _ = coder.assign(whole.slice(at, 4096))
                    for k in range(parts):
                        np.add.at(total[k], own[:, k], cut[:, k])
                        n[k] += np.bincount(own[:, k], minlength=entries)
                    seen += len(cut)
                    if seen > 1 << 30:  # far below a 64-bit sum's limit
                        yield out()
                        total[:], n[:], seen = 0, 0, 0
            if seen:
                yield out()

        return run

    found = C.emit_rows(rows.select("v", "to_pivots"), make, schema)
    total = F.sum(F.col("total").cast("decimal(19,0)"))
    return found.groupBy("part", "entry", "place").agg(total.alias("total"), F.sum("n").alias("n")).collect()


def compress(
    df: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = SCALE,
    pivots: int = PIVOTS,
    carry: list[str] | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(``row``, ``codes`` and ``error``) of the rows that take part, and the
    codebooks: integers by (part, entry, place)."""
    spark = C.prepare(df.sparkSession)
    schema_codes = [C.field("codes", T.ArrayType(T.IntegerType())), C.field("error", "long")]
    vectors = df.select(C.packed(df, carry), F.col(C.quoted(vector_col)).alias("vector"))
    rows = C.materialise(V.integer_vectors(vectors, "vector", scale, BOUND))
    books = _first_books(rows, id_col, parts, entries)
    if books is None:
        return spark.createDataFrame([], T.StructType([rows.schema["row"], *schema_codes])), np.zeros((parts, 0, 0), np.int64)
    coder = Coder(books, [b[choose_pivots(b, pivots)] for b in books])

    def measure():
        def work(batch):
            return {"to_pivots": [d.astype("<f8").tobytes() for d in coder.to_pivots(coder.cut(batch.column("v").to_pylist()))]}

        return work

    rows = C.materialise(C.map_batches(rows, measure, [C.field("to_pivots", "binary")]))
    for _ in range(rounds):
        coder = Coder(coder.books.copy(), coder.pivots)
        for r in _sums(rows, coder):
            coder.books[r.part, r.entry, r.place] = int(r.total) // int(r.n)
    final = coder

    def code():
        def work(batch):
            _, own, d = final.assign(batch)
            return {"codes": own.tolist(), "error": [min(sum(e), LONG) for e in d.tolist()]}

        return work

    return C.map_batches(rows, code, schema_codes, ("v", "to_pivots")), final.books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(C.table(spark, sf_dir, "embeddings"), carry=["vec_id", "label"])
    coded = C.materialise(coded.select("row.vec_id", "row.label", "codes", "error"))
    total = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(LONG).cast("decimal(38,0)"))
    labels = coded.groupBy("label").agg(total.cast("long").alias("label_error"))
    labels = C.materialise(labels.withColumnRenamed("label", "of"))  # its size on disk tells Spark how to join
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", hexed.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _sql() -> str:
    """The rounds written out one after the other."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT p.id, p.label, p.part, p.x, arg_min(b.entry, (list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))), b.entry)) AS entry,
    min(CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS BIGINT)) AS d
  FROM p JOIN b{r} b USING (part) GROUP BY p.id, p.label, p.part, p.x),"""
    move = """
m{r} AS (
  SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY part, entry, i),
u{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{r} GROUP BY part, entry),
b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN u{r} u USING (part, entry)),"""
    body = "".join(assign.format(r=r) + move.format(r=r, n=r + 1) for r in range(ROUNDS)) + assign.format(r=ROUNDS)
    return f"""
WITH k AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT id, label, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x
  FROM (SELECT *, unnest(range({PARTS})) AS part FROM k)),
f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM k QUALIFY entry < {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN f USING (id)),{body}
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (
  SELECT id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY id, label)
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c, h
"""


SQL = _sql()
