"""Isolation forest: small trees grown in parallel, scored over the whole
population with a forest of literals.

* Sampling: a Bernoulli pool of about ``n_trees * max_samples`` rows (one
  hash per row, so the pool does not grow with the table); each pool row
  joins on average two trees by a per-tree hash, and each tree keeps its
  ``max_samples`` smallest hashes.  Every tree's sample is a uniform
  sample without replacement of the population.
* Growth: ``groupBy(tree).applyInPandas`` -- one task per tree, at most
  ``max_samples`` rows each; random feature, uniform split between the
  node's min and max, depth limit ceil(log2(max_samples)).
* Scoring: expressions only.  The forest is five array literals (feature,
  threshold, left, right, path length of every node of every tree, at most
  n_trees * 2 * max_samples nodes); a row walks all trees at once, in as many
  steps as the deepest tree has levels, with leaves leading to themselves.
* Offset: the contamination quantile of the scores, exact, by radix
  selection (``quantiles``), without a sort.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnframe.functions.columns import hash_unit
from churnframe.operators.quantiles import quantiles
from churnframe.session import cut_lineage, ship_code

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size long, depth int"


def average_path_length(n):
    """c(n): mean path length of an unsuccessful search in a BST of n nodes."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(tree_id: int, X: np.ndarray, max_depth: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed * 1_000_003 + tree_id)
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree_id, me, -1, 0.0, -1, -1, int(len(idx)), depth])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            return me
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        if len(left) == 0 or len(right) == 0:
            return me
        nodes[me][2], nodes[me][3] = f, thr
        nodes[me][4] = build(left, depth + 1)
        nodes[me][5] = build(right, depth + 1)
        return me

    build(np.arange(len(X)), 0)
    return [tuple(n) for n in nodes]


@dataclass
class Forest:
    features: list[str]
    nodes: pd.DataFrame  # NODE_SCHEMA
    max_samples: int
    offset: float | None = None

    def arrays(self) -> tuple[dict[str, list], list[int], int]:
        """The trees' nodes one after the other, by column, with children as
        places in the whole; the trees' roots; the deepest level."""
        t = self.nodes.sort_values(["tree", "node"])
        at = np.arange(len(t))
        root = t["node"].to_numpy() == 0
        base = np.maximum.accumulate(np.where(root, at, 0))
        leaf = t["feature"].to_numpy() < 0
        length = t["depth"].to_numpy(np.float64) + average_path_length(t["size"].to_numpy())
        columns = {
            "feature": np.where(leaf, 0, t["feature"].to_numpy()),
            "threshold": np.where(leaf, 0.0, t["threshold"].to_numpy(np.float64)),
            "left": np.where(leaf, at, base + t["left"].to_numpy()),
            "right": np.where(leaf, at, base + t["right"].to_numpy()),
            "length": np.where(leaf, length, 0.0),
        }
        return {k: v.tolist() for k, v in columns.items()}, np.flatnonzero(root).tolist(), int(t["depth"].max())

    def save(self, spark, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = json.dumps({"features": self.features, "max_samples": self.max_samples, "offset": self.offset})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> "Forest":
        meta = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(meta["features"], nodes, meta["max_samples"], meta["offset"])

    def score(self, df: DataFrame, id_column: str, keep: Sequence[str] = ()) -> DataFrame:
        """Flag and score rows with the fitted forest and offset (no refit);
        ``keep`` columns (e.g. the raw features) pass through."""
        raw = self.score_samples(df, [id_column, *keep])
        s = F.col("raw_score") - F.lit(float(self.offset))
        return raw.select(
            id_column,
            *keep,
            F.when(s < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint").alias("anomaly_flag"),
            s.alias("anomaly_score"),
        )

    def score_samples(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Adds ``raw_score`` = -2^(-E[h(x)] / c(max_samples)) (lower is more
        anomalous)."""
        columns, roots, levels = self.arrays()
        norm = float(average_path_length([self.max_samples])[0])
        kinds = {"feature": "int", "threshold": "double", "left": "int", "right": "int", "length": "double"}
        # texts that Spark folds into one literal each
        of = {k: F.from_json(F.lit(json.dumps(v)), f"array<{kinds[k]}>") for k, v in columns.items()}
        starts, steps = (F.from_json(F.lit(json.dumps(v)), "array<int>") for v in (roots, list(range(levels))))

        def leaf(x: F.Column, root: F.Column) -> F.Column:
            def down(node: F.Column, _step: F.Column) -> F.Column:
                return F.when(x[of["feature"][node]] < of["threshold"][node], of["left"][node]).otherwise(of["right"][node])

            return F.aggregate(steps, root, down)

        def total(x: F.Column) -> F.Column:
            return F.aggregate(starts, F.lit(0.0), lambda acc, root: acc + of["length"][leaf(x, root)])

        # the row's features are put together once, as the lambda's variable
        inputs = F.array(F.array(*[F.col(f).cast("double") for f in self.features]))
        mean = F.transform(inputs, total)[0] / F.lit(float(len(roots)))
        score = -F.pow(F.lit(2.0), -mean / F.lit(norm)) if norm > 0 else F.lit(-1.0)
        return df.select(*keep, score.alias("raw_score"))


def grow_forest(
    X: DataFrame,
    id_column: str,
    features: Sequence[str],
    n_trees: int = 100,
    max_samples: int = 256,
    seed: int = 42,
) -> Forest:
    features = list(features)
    ship_code(X.sparkSession)
    n = X.count()
    psi = min(max_samples, n)
    pool_rate = min(1.0, n_trees * psi / max(n, 1))
    pool = X.filter(hash_unit(f"{seed}:pool:", F.col(id_column)) < F.lit(pool_rate))
    m = max(1, int(round(n * pool_rate)))
    tree_rate = min(1.0, 2.0 * psi / m)
    # each pool row joins the trees whose per-tree hash falls below the rate
    member = F.filter(
        F.sequence(F.lit(0), F.lit(n_trees - 1)),
        lambda t: (F.xxhash64(F.lit(seed), t, F.col(id_column)) % 1_000_000 + 1_000_000) % 1_000_000
        < F.lit(int(tree_rate * 1_000_000)),
    )
    per_tree = pool.select(
        F.col(id_column), *[F.col(f).cast("double").alias(f) for f in features], F.explode(member).alias("tree")
    ).withColumn("_h", F.xxhash64(F.lit(seed + 1), F.col("tree"), F.col(id_column)))
    w = Window.partitionBy("tree").orderBy("_h", id_column)
    samples = per_tree.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree"].iloc[0])
        rows = _grow(tree_id, pdf[features].to_numpy(np.float64), max_depth, seed)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

    nodes = samples.select("tree", *features).groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    if len(nodes) > n_trees * 2 * max_samples:
        raise RuntimeError("forest larger than its bound")
    return Forest(features, nodes, psi)


def detect_anomalies(
    X: DataFrame,
    id_column: str,
    features: Sequence[str],
    contamination: float = 0.05,
    n_trees: int = 100,
    max_samples: int = 256,
    seed: int = 42,
) -> tuple[Forest, DataFrame]:
    """(forest, (id, anomaly_flag, anomaly_score)); flag -1 when the score
    (raw - offset) is below 0."""
    forest = grow_forest(X, id_column, features, n_trees, max_samples, seed)
    raw = cut_lineage(forest.score_samples(X, [id_column]))
    forest.offset = quantiles(raw, ["raw_score"], [contamination])["raw_score"][0]
    return forest, flag(raw, forest.offset, id_column)


def flag(raw: DataFrame, offset: float, id_column: str) -> DataFrame:
    score = F.col("raw_score") - F.lit(offset)
    return raw.select(
        id_column,
        F.when(score < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint").alias("anomaly_flag"),
        score.alias("anomaly_score"),
    )


def anomaly_report(results: DataFrame, id_column: str, limit: int = 5) -> DataFrame:
    """Flagged rows, most extreme first (a top-k)."""
    if limit < 0:
        raise ValueError("limit must be >= 0")
    return results.filter(F.col("anomaly_flag") == -1).orderBy("anomaly_score", id_column).limit(limit)
