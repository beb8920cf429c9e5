"""Gradient-boosted trees by histograms, with the usual losses.

Binary labels: the start is the log-odds of the positive share, trees are
fitted to label - probability, and a leaf's value is the Newton step, the sum
of residuals over the sum of p (1 - p).  Numbers: the start is the mean, trees
are fitted to the residuals, a leaf is their mean.  A split is the (feature,
bin edge) that lowers the squared error of the residuals most; ties go to the
first feature, then the lower edge.

Features are cut into bins once: at the midpoints of their values where there
are at most ``MAX_BINS``, else at exact quantiles.  A pass over the rows sums
residuals, curvatures and rows per (node, feature, bin); the values of the
last level's leaves come from the same sums, and the new raw scores ride along
with the next tree's first pass.  A level needs one pass at most: a pass deals
the rows to nodes below the asked ones too, as the last tree with these splits
above cut them.  Sums of the asked nodes are sums over those, and where the
new tree then splits alike, its lower levels are known already.

The rows are blocks of bins (a byte for each value) with label and raw score,
cached on the executors.  A fit is hundreds of passes of a few milliseconds of
work; planning a query for each would cost more than the pass, so the passes
aggregate the cached blocks directly.  The histograms of the partitions meet on
the executors, feature by feature and in the partitions' order (the sums are
the same in every run), and a feature's best splits are found there: what
reaches the driver has one short row per node and feature, whatever the number
of rows, partitions and bins.  Every ``CHECKPOINT`` trees the blocks go to the shared checkpoint
folder, so a lost executor costs a few trees and not the fit.

Scoring is a vectorised Arrow function of the inputs; as nested CASE
expressions, 200 trees are beyond what Spark compiles into one method.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnframe.operators.quantiles import order_statistics
from churnframe.session import ensure_checkpoint_dir, iteration_partitions, ship_code

MAX_BINS = 256
BLOCK_ROWS = 262_144
CHECKPOINT = 20
DIRECT = 1  # partitions whose sums need no exchange
FAN = 256  # partitions' sums that one task adds up


@dataclass
class Node:
    """An inner node (``x[feature] <= threshold`` goes left) or a leaf."""

    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    value: float = 0.0
    rows: int = 0
    gain: float = 0.0


@dataclass
class BoostedTrees:
    start: float
    rate: float
    logistic: bool
    features: list[str]
    trees: list[list[Node]] = field(default_factory=list)

    # -- scoring

    def heaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, threshold) of inner nodes and value of leaves, each tree
        a complete binary tree of the deepest one's depth: children of node i
        are 2 i + 1 and 2 i + 2, and a leaf above the last level goes on to
        itself on either side."""

        def depth(tree: list[Node], at: int = 0) -> int:
            node = tree[at]
            return 0 if node.feature < 0 else 1 + max(depth(tree, node.left), depth(tree, node.right))

        levels = max((depth(t) for t in self.trees), default=0)
        inner = (1 << levels) - 1
        feature = np.zeros((len(self.trees), inner), np.int64)
        threshold = np.zeros((len(self.trees), inner))
        value = np.zeros((len(self.trees), inner + 1))

        def fill(t: int, tree: list[Node], at: int, slot: int) -> None:
            node = tree[at]
            if slot >= inner:
                value[t, slot - inner] = node.value
                return
            split = node.feature >= 0
            if split:
                feature[t, slot], threshold[t, slot] = node.feature, node.threshold
            fill(t, tree, node.left if split else at, 2 * slot + 1)
            fill(t, tree, node.right if split else at, 2 * slot + 2)

        for t, tree in enumerate(self.trees):
            fill(t, tree, 0, 0)
        return feature, threshold, value

    def score(self, df: DataFrame, inputs: Sequence[str], name: str) -> DataFrame:
        """``df`` with the probability (or value) as ``name``: an Arrow pass
        over the inputs only, all trees of a batch level by level."""
        ship_code(df.sparkSession)
        heaps, out = self.heaps(), self._link()

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(np.float64) for c in columns])
            return pd.Series(out(_walk(x, *heaps).sum(1)))

        return df.withColumn(name, scored(*[F.col(c) for c in inputs]))

    def substituted(self, df: DataFrame, inputs: Sequence[str], means: dict[str, float], name: str) -> DataFrame:
        """``df`` with a struct ``name``: ``base``, the score, and ``f0`` ..,
        the score with each input at its mean.  Trees that do not split on an
        input keep their leaf; only the others are walked again for it."""
        ship_code(df.sparkSession)
        (feature, threshold, value), out = self.heaps(), self._link()
        held = [float(means[c]) for c in inputs]
        inner = [np.array([any(n.feature == k for n in t) for t in self.trees], bool) for k in range(len(inputs))]
        names = ["base", *[f"f{k}" for k in range(len(inputs))]]

        @F.pandas_udf(", ".join(f"{n} double" for n in names))
        def scored(*columns: pd.Series) -> pd.DataFrame:
            x = np.column_stack([c.to_numpy(np.float64) for c in columns])
            leaves = _walk(x, feature, threshold, value)
            total = leaves.sum(1)
            made = [out(total)]
            for k, (mean, uses) in enumerate(zip(held, inner)):
                own = x[:, k].copy()
                x[:, k] = mean
                moved = _walk(x, feature[uses], threshold[uses], value[uses]) - leaves[:, uses]
                x[:, k] = own
                made.append(out(total + moved.sum(1)))
            return pd.DataFrame(dict(zip(names, made)))

        return df.withColumn(name, scored(*[F.col(c) for c in inputs]))

    def _link(self):
        start, rate, logistic = self.start, self.rate, self.logistic

        def out(total: np.ndarray) -> np.ndarray:
            raw = start + rate * total
            return 1.0 / (1.0 + np.exp(-raw)) if logistic else raw

        return out

    def importances(self) -> np.ndarray:
        """Shares of the lowered squared error, averaged over the trees that
        split at all."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            for node in tree:
                if node.feature >= 0:
                    total[node.feature] += node.gain / tree[0].rows
        return total / total.sum() if total.sum() > 0 else total

    # -- persistence

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(t, i, *vars(n).values()) for t, tree in enumerate(self.trees) for i, n in enumerate(tree)]
        schema = "tree int, node int, feature int, threshold double, left int, right int, value double, rows bigint, gain double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"start": self.start, "rate": self.rate, "logistic": self.logistic, "features": self.features}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedTrees":
        out = cls(**json.loads(spark.read.text(f"{path}/trees").collect()[0][0]))
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            if r.node == 0:
                out.trees.append([])
            out.trees[-1].append(Node(*r[2:]))
        return out


def _walk(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(row, tree): the value of the leaf that the row ends in.  ``<=`` goes
    left."""
    rows, trees = np.arange(len(x))[:, None], np.arange(len(feature))[None, :]
    at = np.zeros((len(x), len(feature)), np.int64)
    for _ in range(value.shape[1].bit_length() - 1):
        right = x[rows, feature[trees, at]] > threshold[trees, at]
        at = 2 * at + 1 + right
    return value[trees, at - feature.shape[1]]


# ---------------------------------------------------------------- bins


def bin_edges(df: DataFrame, columns: Sequence[str], n_rows: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """For each column, increasing edges; a value's bin is the number of edges
    below it.  Two passes: the values of columns with few of them, and the
    quantiles of the others."""
    ship_code(df.sparkSession)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] = [np.zeros(0)] * len(columns)
        for batch in batches:
            for i, values in enumerate(held):
                if values is not None:
                    values = np.unique(np.concatenate([values, batch.column(i).to_numpy(zero_copy_only=False) + 0.0]))
                    held[i] = values if len(values) <= max_bins else None
        for i, values in enumerate(held):
            values = [None] if values is None else values.tolist()  # None: too many
            if values:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), pa.array(values, pa.float64())], names=["col", "value"])

    seen = rows.mapInArrow(run, "col int, value double").distinct().persist()
    sizes = seen.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("many")).collect()
    few = [r.col for r in sizes if not r.many and r.n <= max_bins]
    values: dict[int, list[float]] = {i: [] for i in few}
    for r in seen.where(F.col("col").isin(few)).collect() if few else []:  # at most max_bins for each column
        values[r.col].append(r.value)
    seen.unpersist()
    many = [i for i in range(len(columns)) if i not in values]
    ranks = sorted({n_rows * k // max_bins for k in range(1, max_bins)})
    found = order_statistics(rows, {f"c{i}": ranks for i in many}) if many else {}
    out = []
    for i in range(len(columns)):
        if i in values:
            v = np.sort(np.array(values[i]))
            out.append((v[:-1] + v[1:]) / 2)
        else:
            out.append(np.unique(list(found[f"c{i}"].values())))
    return out


@dataclass
class Block:
    bins: np.ndarray  # (feature, row), small unsigned integers
    y: np.ndarray
    raw: np.ndarray

    def residuals(self, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
        if not logistic:
            return self.y - self.raw, np.ones(len(self.y))
        p = 1.0 / (1.0 + np.exp(-self.raw))
        return self.y - p, p * (1.0 - p)

    def place(self, splits: list[tuple[int, int, int, int]], size: int) -> np.ndarray:
        """The node of each row after ``splits``: (node, feature, bin, left
        child), right child next to it, parents first."""
        node = np.zeros(len(self.y), np.int64)
        for at, feature, edge, left in splits:
            own = np.flatnonzero(node == at)
            node[own] = left + (self.bins[feature, own] > edge)
        return node


def _blocks(df: DataFrame, columns: Sequence[str], label: str, edges: list[np.ndarray], start: float):
    """The rows as an RDD of blocks, made by one Arrow pass."""
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            bins, y = (np.concatenate(x, axis=-1) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([bins.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["bins", "y"]
            )

        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(edges))]
            held.append((np.array([np.searchsorted(e, v, side="left") for e, v in zip(edges, x)], kind).reshape(len(edges), -1), batch.column("y").to_numpy(zero_copy_only=False)))
            if sum(len(y) for _, y in held) >= BLOCK_ROWS:
                yield out()
        if held:
            yield out()

    def block(r) -> Block:
        y = np.frombuffer(r.y)
        return Block(np.frombuffer(r.bins, kind).reshape(len(edges), -1), y, np.full(len(y), start))

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y"))
    return rows.mapInArrow(run, "bins binary, y binary").rdd.map(block)


# ---------------------------------------------------------------- fit


Path = tuple[int, ...]  # from the root: 0 left, 1 right
Cuts = dict[Path, tuple[int, int]]  # (feature, bin edge) of inner nodes


def _histograms(
    blocks, parts: int, cuts: Cuts, asked: list[Path], widths: list[int], logistic: bool
) -> dict[Path, tuple[np.ndarray, "Split | None"]]:
    """For the ``asked`` nodes and all nodes that ``cuts`` has below them: the
    sums - residuals, curvatures, rows - and the best split, from histograms
    that stay on the executors."""
    number, splits = {(): 0}, []
    for path in sorted(cuts, key=len):
        if path in number:
            left = len(number)
            number[path + (0,)], number[path + (1,)] = left, left + 1
            splits.append((number[path], *cuts[path], left))
    lowest = [p for p in number if p + (0,) not in number and any(p[: len(a)] == a for a in asked)]
    size = len(number)
    slot = np.full(size, -1)
    slot[[number[p] for p in lowest]] = np.arange(len(lowest))
    n_slots = len(lowest)
    # a node's sums are those of the lowest nodes in it
    within: dict[Path, list[int]] = {}
    for k, path in enumerate(lowest):
        for up in range(len(path) + 1):
            if any(path[:up][: len(a)] == a for a in asked):
                within.setdefault(path[:up], []).append(k)

    def sums(index: int, part: Iterator[Block]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        """(feature, (partition, its histogram of the feature))"""
        totals = [np.zeros((3, n_slots, width)) for width in widths]
        for b in part:
            residual, curve = b.residuals(logistic)
            own = slot[b.place(splits, size)]
            keep = np.flatnonzero(own >= 0)
            whole = len(keep) == len(own)
            if not whole:
                own, residual, curve = own[keep], residual[keep], curve[keep]
            for f, width in enumerate(widths):
                cell = own * width + (b.bins[f] if whole else b.bins[f, keep])
                for k, weight in enumerate((residual, curve, None)):
                    got = np.bincount(cell, weights=weight, minlength=n_slots * width)
                    totals[f][k] += got.reshape(n_slots, width)
        for f, total in enumerate(totals):
            yield f, (index, total)

    def added(rows: Iterator[tuple]) -> Iterator[tuple]:
        """(key, (least partition, sum)), added in the partitions' order."""
        held: dict = {}
        for key, value in rows:
            held.setdefault(key, []).append(value)
        for key, values in held.items():
            values.sort(key=lambda v: v[0])
            yield key, (values[0][0], sum(v for _, v in values))

    def found(rows: Iterator[tuple]) -> Iterator[tuple]:
        """(feature, its sums and best split of each node)"""
        for f, (_, total) in rows:
            nodes = (sum(total[:, k] for k in slots) for slots in within.values())
            yield f, [(h.sum(1), _best_edge(h)) for h in nodes]

    if parts <= DIRECT:
        best = blocks.mapPartitionsWithIndex(lambda i, part: found(added(sums(i, part)))).collect()
    else:
        tasks = max(1, min(len(widths), blocks.context.defaultParallelism))
        rows = blocks.mapPartitionsWithIndex(sums)
        step = FAN
        while step < parts:  # first by groups of neighbours, then groups of groups
            groups = -(-parts // step)
            rows = rows.map(lambda r, step=step: ((r[0], r[1][0] // step), r[1]))
            rows = rows.partitionBy(tasks * groups, lambda key, groups=groups: key[0] % tasks * groups + key[1])
            rows = rows.mapPartitions(added).map(lambda r: (r[0][0], r[1]))
            step *= FAN
        best = rows.partitionBy(tasks, lambda f: f % tasks).mapPartitions(lambda part: found(added(part))).collect()
    by_feature = [b for _, b in sorted(best, key=lambda r: r[0])]
    return {path: (by_feature[0][i][0], _best_split([b[i][1] for b in by_feature])) for i, path in enumerate(within)}


Split = tuple[float, int, int, np.ndarray]  # gain, feature, edge, left sums


def _best_edge(h: np.ndarray) -> tuple[float, int, np.ndarray] | None:
    """(gain, edge, left sums) of a node by one feature; ``h``: (3, bins)."""
    left = np.cumsum(h, axis=1)[:, :-1]
    total = h.sum(1)
    n, m = left[2], total[2] - left[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / n + (total[0] - left[0]) ** 2 / m - total[0] ** 2 / total[2]
    gain = np.where((n > 0) & (m > 0), gain, -np.inf)
    if len(gain):
        edge = int(gain.argmax())
        if gain[edge] > 1e-12 * max(1.0, total[2]):
            return float(gain[edge]), edge, left[:, edge].copy()
    return None


def _best_split(edges: list[tuple[float, int, np.ndarray] | None]) -> Split | None:
    """The best of the features' best edges; ties go to the first feature."""
    best = None
    for f, found in enumerate(edges):
        if found is not None and (best is None or found[0] > best[0] * (1 + 1e-12)):
            best = (found[0], f, *found[1:])
    return best


def _leaf(sums: np.ndarray) -> float:
    return float(sums[0] / sums[1]) if abs(sums[1]) > 1e-150 else 0.0


def grow(
    blocks, parts: int, edges: list[np.ndarray], depth: int, logistic: bool, last: dict[tuple, Cuts]
) -> tuple[list[Node], list[tuple[int, int, int, int]]]:
    """One tree on the blocks' residuals, and its splits by bin.  ``last``
    keeps the cuts of earlier trees, all of them and by their first cut, as
    guesses of what this tree will do."""
    widths = [len(e) + 1 for e in edges]
    nodes, number, splits, frontier = [Node()], {(): 0}, [], [()]
    cuts: Cuts = {}
    used: Cuts = {}
    known: dict[Path, tuple[np.ndarray, Split | None]] = {}
    for _ in range(depth):
        asked = [p for p in frontier if p not in known]
        if asked:
            guess = last.get((cuts[()],), {}) if cuts else last.get((), {})
            below = {p: c for p, c in guess.items() if len(p) < depth - 1 and any(p[: len(a)] == a for a in asked)}
            used = {**used, **below, **cuts}  # how the pass deals the rows
            known.update(_histograms(blocks, parts, used, asked, widths, logistic))
        further = []
        for path in frontier:
            (total, found), node = known[path], nodes[number[path]]
            node.rows, node.value = int(round(total[2])), _leaf(total)
            if found is None or used.get(path) != found[1:3]:  # what lies below was another guess's
                known = {p: v for p, v in known.items() if p[: len(path)] != path or p == path}
            if found is None:
                continue
            gain, f, edge, left = found
            cuts[path] = used[path] = (f, edge)
            child = len(nodes)
            node.feature, node.threshold, node.gain = f, float(edges[f][edge]), gain
            node.left, node.right = child, child + 1
            for side, sums in enumerate((left, total - left)):
                nodes.append(Node(value=_leaf(sums), rows=int(round(sums[2]))))
                number[path + (side,)] = child + side
                further.append(path + (side,))
            splits.append((number[path], f, edge, child))
        frontier = further
        if not frontier:
            break
    if cuts:
        last[()] = last[(cuts[()],)] = cuts
    return nodes, splits


def fit_trees(
    data: DataFrame,
    columns: Sequence[str],
    label: str,
    names: Sequence[str],
    n_rows: int,
    logistic: bool,
    n_trees: int,
    depth: int,
    rate: float,
    max_bins: int = MAX_BINS,
    edges: list[np.ndarray] | None = None,
) -> BoostedTrees:
    """``data``: complete numeric columns and a label (0 / 1 if ``logistic``).
    ``edges`` gives the bins, where they are fixed."""
    spark = data.sparkSession
    ship_code(spark)
    ensure_checkpoint_dir(spark)
    if not n_rows:
        raise ValueError("no rows to fit")
    mean = float(data.agg(F.avg(F.col(label).cast("double"))).collect()[0][0])
    tiny = np.finfo(float).eps
    start = math.log(min(max(mean, tiny), 1 - tiny) / (1 - min(max(mean, tiny), 1 - tiny))) if logistic else mean
    if edges is None:
        edges = bin_edges(data, columns, n_rows, max_bins)
    model = BoostedTrees(start, rate, logistic, list(names))
    state = _blocks(data.coalesce(iteration_partitions(spark, n_rows)), columns, label, edges, start).persist(StorageLevel.MEMORY_AND_DISK)
    held, parts, last = [state], state.getNumPartitions(), {}
    try:
        for t in range(n_trees):
            nodes, splits = grow(state, parts, edges, depth, logistic, last)
            model.trees.append(nodes)
            for old in held[:-1]:  # the passes have filled the cache of the last one
                old.unpersist()
            held = held[-1:]
            values, size = np.array([n.value for n in nodes]), len(nodes)

            def moved(b: Block, splits=splits, values=values, size=size) -> Block:
                return Block(b.bins, b.y, b.raw + rate * values[b.place(splits, size)])

            state = state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(state)
            if t % CHECKPOINT == CHECKPOINT - 1:
                state.checkpoint()  # written with the next pass
    finally:
        for rdd in held:
            rdd.unpersist()
    return model
