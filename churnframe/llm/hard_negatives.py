"""Hard-negative mining over a GNAT-style multiway hyperplane tree.

For an anchor, its positives are the best other rows of its label, and the
hard negatives of a positive are the best rows of other labels whose score
lies in a window under the positive's score.  A score is the integer inner
product; higher first, ties by smaller vec_id.

Inner products become distances: a row x gets one more coordinate, the square
root of M - |x|^2 with M the largest squared norm, an anchor q gets 0 there.
Then d(q, x)^2 = |q|^2 + M - 2 q.x: a window of scores is an annulus around
the anchor, and the triangle inequality holds.

The tree.  A node has split points; each row goes to its nearest one (so cells
are bounded by hyperplanes); for each split point i and subtree j the node
keeps the range of distances from i to the rows of j.  With the anchor's
distance d to split point i, subtree j is out if its range misses
[d - outer, d + outer], or ends before inner - d, where inner and outer are
the annulus' radii.  Every split point can eliminate every sibling.  Leaves
are compared exactly, in integers; float distances carry a slack, so rounding
never loses a row.

Spark.  The split points of the top node are fitted on a bounded sample
(``SAMPLE`` rows of least hash), every row is indexed: one pass assigns cells
and gathers the ranges (a table of split points squared), a cell is cut into
blocks of at most ``BLOCK_ROWS`` rows by a hash of vec_id, so a cell with any
share of the rows is spread.  An anchor is sent to the blocks of those cells
that the ranges leave; in a block (a cogroup of its rows and of at most
``CHUNK`` anchors) the tree goes on to leaves.  A block returns at most
``positives`` or ``negatives`` rows for an anchor and window, and a window
function keeps the best of them (Spark keeps that many before the shuffle as
well).  The sample gives every search its first bound.  Nothing is dropped:
elimination is exact.

Defined results: rows with a NULL label or vec_id, a NULL vector, or any NULL
or non-finite component take no part; of rows that repeat a vec_id one takes
part (least label, then vector); vectors of different lengths count as padded
with zeros; components are held within +-2^26; equal vectors tie by vec_id; no
row of the same (another) label: no positives (negatives) and no rows for
them; a negative positive score has an empty window; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C
from churnframe.llm import vectors as V

SCALE = 256
BOUND = 1 << 26
SAMPLE = 4096  # rows that fit the top split points and give first bounds
SAMPLE_BYTES = 64 << 20
FANOUT = 32  # split points of the top node
SPLITS = 8  # split points of a node in a block
LEAF = 128
BLOCK_ROWS = 16_384
LEAST_BLOCK = 256
CHUNK = 16_384  # anchors that meet a block at once
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Places of up to ``k`` rows that lie far from each other."""
    chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


class Space:
    """Distances after the added coordinate, for a largest squared norm."""

    def __init__(self, most: int):
        self.most = float(max(most, 1))
        self.slack = 1e-6 * np.sqrt(self.most)

    def lift(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(np.float64)
        return np.column_stack([f, np.sqrt(np.maximum(self.most - (f * f).sum(1), 0))])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of lifted rows."""
        return np.sqrt(np.maximum(2 * self.most - 2 * (a @ b.T), 0))

    def of_anchor(self, q: np.ndarray, norms: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norms[:, None] + self.most - 2 * (q @ points[:, :-1].T), 0))

    def radius(self, norms: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norms + self.most - 2.0 * score, 0))


def reached(d: np.ndarray, lo: np.ndarray, hi: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """(anchor, subtree): not eliminated by any split point's range.
    ``d``: (anchor, split point); ``lo``, ``hi``: (split point, subtree)."""
    alive = np.ones((len(d), lo.shape[1]), bool)
    for i in range(d.shape[1]):
        near, far = (d[:, i] - outer)[:, None], (d[:, i] + outer)[:, None]
        alive &= (hi[i] >= near) & (lo[i] <= far) & (hi[i] >= (inner - d[:, i])[:, None])
    return alive


class Tree:
    """The tree over the rows of a block."""

    def __init__(self, space: Space, x: np.ndarray):
        self.space, self.lifted = space, space.lift(x)
        self.root = self.node(np.arange(len(x)))

    def node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        some = rows[:: max(1, len(rows) // 256)]
        points = self.lifted[some[farthest_first(self.lifted[some], SPLITS)]]
        d = self.space.between(self.lifted[rows], points)
        own = d.argmin(1)
        members = [np.flatnonzero(own == j) for j in range(len(points))]
        members = [m for m in members if len(m)]
        if len(members) < 2:  # equal rows
            return rows
        lo = np.array([d[m].min(0) for m in members]).T
        hi = np.array([d[m].max(0) for m in members]).T
        return points, lo, hi, [self.node(rows[m]) for m in members]


class Best:
    """The best ``k`` (score, vec_id) of each of ``n`` searches."""

    def __init__(self, n: int, k: int, low: np.ndarray):
        self.n, self.k, self.low = n, k, low.copy()
        self.kept = [np.zeros(0, np.int64)] * 3
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, search: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        self.new.append((search, score, vec_id))
        self.waiting += len(search)
        if self.waiting > 2 * self.k * self.n + 4096:
            self.settle()

    def settle(self) -> None:
        q, s, v = (np.concatenate(x) for x in zip(self.kept, *self.new))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.concatenate([[True], q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        top = place < self.k
        full = place == self.k - 1
        self.low[q[full]] = np.maximum(self.low[q[full]], s[full])
        self.kept, self.new, self.waiting = [q[top], s[top], v[top]], [], 0


def search(tree: Tree, x, labels, ids, q, q_labels, q_ids, owner, low, high, same: bool, k: int):
    """(search, score, vec_id) of the best ``k`` rows of each search: rows of
    the anchor's label (or of others) with a score in [low, high].  ``owner``
    is the anchor of each search."""
    space, best = tree.space, Best(len(owner), k, low)
    f = q.astype(np.float64)
    norms = (f * f).sum(1)
    todo = [(tree.root, np.arange(len(owner)))]
    while todo:
        node, live = todo.pop()
        own = owner[live]
        if isinstance(node, np.ndarray):
            s = V.products(q[own], x[node])
            ok = (s >= best.low[live][:, None]) & (s <= high[live][:, None])
            ok &= (labels[node] == q_labels[own][:, None]) == same
            ok &= ids[node] != q_ids[own][:, None]
            a, b = np.nonzero(ok)
            best.add(live[a], s[a, b], ids[node[b]])
            continue
        points, lo, hi, children = node
        outer = space.radius(norms[own], best.low[live]) + space.slack
        inner = space.radius(norms[own], high[live]) - space.slack
        d = space.of_anchor(f[own], norms[own], points)
        alive = reached(d, lo - space.slack, hi + space.slack, inner, outer)
        for j in np.argsort(-lo.mean(0)):  # a narrow cell is searched first
            if alive[:, j].any():
                todo.append((children[j], live[alive[:, j]]))
    best.settle()
    return best.kept


class Index:
    """The indexed rows: ``rows`` (vec_id, label, v, block) and what the
    driver holds of the top node, all bounded by the sample and the fanout."""

    def __init__(self, points: DataFrame, positives: int, negatives: int):
        spark = points.sparkSession
        self.points, self.k = points, {True: positives, False: negatives}
        size = points.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.max(F.length("v")).alias("width"))
        n, most, width = size.collect()[0]
        self.n, self.width = int(n), int(width or 0) // 4
        self.space = Space(int(most or 0))
        take = max(FANOUT, min(SAMPLE, SAMPLE_BYTES // max(1, 8 * self.width)))
        some = points.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(take).select("vec_id", "label", "v").collect()
        x = V.matrix([bytes(r.v) for r in some], self.width)
        self.sample = (x, np.array([r.label for r in some], np.int64), np.array([r.vec_id for r in some], np.int64))
        if not self.n:
            return
        lifted = self.space.lift(x)
        self.split = lifted[farthest_first(lifted, FANOUT)]
        self._ranges()
        limit = min(BLOCK_ROWS, (64 << 20) // max(1, 8 * self.width))
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        limit = max(LEAST_BLOCK, min(limit, self.n // (2 * partitions)))
        self.parts = -(-self.count // limit)
        self.first_block = np.concatenate([[0], np.cumsum(self.parts)])

    def _cells(self):
        """A function of a batch: matrix, distances to split points, cells."""
        space, split, width = self.space, self.split, self.width

        def of(batch):
            x = V.matrix(batch.column("v").to_pylist(), width)
            d = space.between(space.lift(x), split)
            return d, d.argmin(1)

        return of

    def _ranges(self) -> None:
        k, cells = len(self.split), self._cells()
        schema = T.StructType([C.field("cell", "int"), C.field("point", "int"), C.field("rows", "long")] + [C.field(c, "double") for c in ("lo", "hi")])

        def make():
            def run(batches):
                count, lo, hi = np.zeros(k, np.int64), np.full((k, k), np.inf), np.full((k, k), -np.inf)
                for whole in batches:
                    for at in range(0, whole.num_rows, 4096):
                        d, own = cells(whole.slice(at, 4096))
                        for j in np.unique(own):
                            part = d[own == j]
                            count[j] += len(part)
                            lo[j], hi[j] = np.minimum(lo[j], part.min(0)), np.maximum(hi[j], part.max(0))
                for j in np.flatnonzero(count):
                    yield {"cell": [j] * k, "point": range(k), "rows": [count[j]] * k, "lo": lo[j], "hi": hi[j]}

            return run

        found = C.emit_rows(self.points.select("v"), make, schema)
        found = found.groupBy("cell", "point").agg(F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        self.count = np.zeros(k, np.int64)
        self.lo, self.hi = np.full((k, k), np.inf), np.full((k, k), -np.inf)  # (point, cell)
        for r in found.collect():
            self.count[r.cell] = r.rows
            self.lo[r.point, r.cell], self.hi[r.point, r.cell] = r.lo, r.hi

    def blocks(self, chunks: int) -> DataFrame:
        """All rows with their block, once for each chunk of anchors."""
        cells, parts, first = self._cells(), self.parts, self.first_block

        def make():
            def work(batch):
                own = cells(batch)[1]
                part = np.asarray(batch.column("deal")).astype(np.uint64) % parts[own].astype(np.uint64)
                return {"block": first[own] + part.astype(np.int64)}

            return work

        rows = self.points.select("vec_id", "label", "v", F.xxhash64("vec_id").alias("deal"))
        rows = C.map_batches(rows, make, [C.field("block", "long")], ("deal",))
        return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def sent(self, anchors: DataFrame, chunks: int, same: bool) -> DataFrame:
        """A row for each anchor and block that its windows reach.  ``lows``
        and ``highs`` come out with lows raised to what the sample proves."""
        space, split, lo, hi, k = self.space, self.split, self.lo - self.space.slack, self.hi + self.space.slack, self.k[same]
        width, parts, first = self.width, self.parts, self.first_block
        shipped = anchors.sparkSession.sparkContext.broadcast(self.sample)
        schema = T.StructType(
            [C.field(n, "long") for n in ("block", "vec_id", "label")]
            + [C.field("v", "binary"), C.field("lows", T.ArrayType(T.LongType())), C.field("highs", T.ArrayType(T.LongType()))]
        )

        def make():
            x, labels, ids = shipped.value

            def run(batches):
                for whole in batches:
                    for at in range(0, whole.num_rows, 64):
                        batch = whole.slice(at, 64)
                        columns = {n: batch.column(n).to_pylist() for n in ("vec_id", "label", "v", "lows", "highs")}
                        q = V.matrix(columns["v"], width)
                        owner = np.repeat(np.arange(len(q)), [len(a) for a in columns["lows"]])
                        low = np.array([s for a in columns["lows"] for s in a], np.int64)
                        high = np.array([s for a in columns["highs"] for s in a], np.int64)
                        own_id, own_label = np.array(columns["vec_id"]), np.array(columns["label"])
                        s = V.products(q, x)[owner]
                        ok = ((labels == own_label[owner][:, None]) == same) & (ids != own_id[owner][:, None])
                        s = np.where(ok & (s >= low[:, None]) & (s <= high[:, None]), s, LOWEST)
                        if s.shape[1] >= k:
                            low = np.maximum(low, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                        f = q.astype(np.float64)
                        norms = (f * f).sum(1)
                        d = space.of_anchor(f, norms, split)[owner]
                        outer = space.radius(norms[owner], low) + space.slack
                        inner = space.radius(norms[owner], high) - space.slack
                        alive = np.zeros((len(q), lo.shape[1]), bool)
                        np.logical_or.at(alive, owner, reached(d, lo, hi, inner, outer))
                        for a in np.flatnonzero(alive.any(1)):
                            own = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in np.flatnonzero(alive[a])])
                            yield {
                                "block": own,
                                "vec_id": np.full(len(own), own_id[a]),
                                "label": np.full(len(own), own_label[a]),
                                "v": [columns["v"][a]] * len(own),
                                "lows": [low[owner == a].tolist()] * len(own),
                                "highs": [columns["highs"][a]] * len(own),
                            }

            return run

        rows = C.emit_rows(anchors.select("vec_id", "label", "v", "lows", "highs"), make, schema)
        return rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))

    def best(self, anchors: DataFrame, same: bool) -> DataFrame:
        """anchor_id, slot (place in ``lows``), rank, vec_id, score."""
        chunks = max(1, -(-anchors.count() // CHUNK))
        k, width, space = self.k[same], self.width, self.space
        schema = "anchor_id long, slot int, vec_id long, score long"
        arrow = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

        def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
            if not rows.num_rows or not asked.num_rows:
                return arrow.empty_table()
            x = V.matrix(rows.column("v").to_pylist(), width)
            labels, ids = np.asarray(rows.column("label")), np.asarray(rows.column("vec_id"))
            tree, parts = Tree(space, x), []
            for at in range(0, asked.num_rows, 512):
                some = asked.slice(at, 512)
                q = V.matrix(some.column("v").to_pylist(), width)
                lows, highs = some.column("lows").to_pylist(), some.column("highs").to_pylist()
                owner = np.repeat(np.arange(len(q)), [len(a) for a in lows])
                slot = np.concatenate([np.arange(len(a)) for a in lows]).astype(np.int32)
                low, high = (np.array([s for a in b for s in a], np.int64) for b in (lows, highs))
                q_ids = np.asarray(some.column("vec_id"))
                n, s, v = search(tree, x, labels, ids, q, np.asarray(some.column("label")), q_ids, owner, low, high, same, k)
                parts.append((q_ids[owner[n]], slot[n], v, s))
            return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=arrow)

        rows = self.blocks(chunks).groupBy("block", "chunk")
        found = rows.cogroup(self.sent(anchors, chunks, same).groupBy("block", "chunk")).applyInArrow(run, schema)
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def labelled_points(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, label, v, norm of the rows that take part, one for each id."""
    rows = df.select(
        F.col(C.quoted(id_col)).cast("long").alias("vec_id"),
        F.col(C.quoted(label_col)).cast("long").alias("label"),
        F.col(C.quoted(vector_col)).alias("vector"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = V.integer_vectors(rows, "vector", scale, BOUND)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.*")

    def make():
        def work(batch):
            found = (np.frombuffer(v, "<i4").astype(np.int64) for v in batch.column("v").to_pylist())
            return {"norm": [int(v @ v) for v in found]}

        return work

    return C.materialise(C.map_batches(rows, make, [C.field("norm", "long")]))


def hard_negatives(
    df: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: float = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, positive_rank, positive_score, rank,
    negative_id, negative_score.  ``is_anchor`` is a condition on ``vec_id``;
    a negative's score lies between ``least_percent`` of the positive's and
    the positive's."""
    spark = C.prepare(df.sparkSession)
    index = Index(labelled_points(df, id_col, label_col, vector_col, scale), positives, negatives)
    if not index.n:
        names = ("anchor_id", "positive_id", "positive_rank", "positive_score", "rank", "negative_id", "negative_score")
        return spark.createDataFrame([], ", ".join(f"{n} {'int' if 'rank' in n else 'long'}" for n in names))
    anchors = index.points.where(is_anchor).select("vec_id", "label", "v")
    every = anchors.withColumn("lows", F.array(F.lit(LOWEST))).withColumn("highs", F.array(F.lit(HIGHEST)))
    first = C.materialise(index.best(every, same=True).select("anchor_id", "rank", "vec_id", "score"))

    # a window for each positive of an anchor, in the order of ``slot``
    windows = (
        first.where("score >= 0")  # a negative score has an empty window
        .withColumn("low", F.expr(f"({least_percent} * score + 99) div 100"))
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "low", "score"))).alias("w"))
    )
    asked = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "v", F.col("w.low").alias("lows"), F.col("w.score").alias("highs"), "w"
    )
    asked = C.materialise(asked)
    found = index.best(asked, same=False)
    slots = asked.select(F.col("vec_id").alias("anchor_id"), F.posexplode("w").alias("slot", "own")).select(
        "anchor_id", "slot", F.col("own.rank").alias("positive_rank"), F.col("own.score").alias("positive_score")
    )
    ids = first.select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"))
    return (
        found.join(slots, ["anchor_id", "slot"])
        .join(ids, ["anchor_id", "positive_rank"])
        .select(
            "anchor_id",
            "positive_id",
            "positive_rank",
            "positive_score",
            "rank",
            F.col("vec_id").alias("negative_id"),
            F.col("score").alias("negative_score"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(rows.withColumn("label", moved), "vec_id % 100 = 0")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH k AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
    CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
  FROM k a JOIN k x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""
