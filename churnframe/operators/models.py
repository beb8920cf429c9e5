"""Trained churn classifier and lifetime-value regressor (boosted trees over
histograms, ``boosting``).

Categorical codes enter the trees as plain doubles, so splits are ordered
thresholds on the codes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnframe.functions.columns import binarize
from churnframe.operators.boosting import BoostedTrees, fit_trees
from churnframe.operators.encode import categorical_columns, encode, fit_encoders
from churnframe.operators.metrics import average_precision, regression_metrics, roc_auc
from churnframe.operators.prioritize import PROBABILITY
from churnframe.operators.split import split_rows
from churnframe.session import cut_lineage
from churnframe.spec import TenantSpec

# The classifier's configured hyper-parameters.
CHURN_PARAMS = {"n_estimators": 200, "max_depth": 3, "learning_rate": 0.05, "random_state": 42}
# Library defaults of the boosted regressor used for CLTV.
CLV_PARAMS = {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1, "random_state": 42}

LABEL = "_label"


def require_complete(df: DataFrame, features: list[str]) -> int:
    """Numeric features must be present: fail early with the column names
    instead of deep inside the fit.  Returns the row count (same pass)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in features]
    ).collect()[0]
    missing = [f for f in features if counts[f]]
    if missing:
        raise ValueError(f"missing values in features: {missing}")
    return int(counts["_n"])


@dataclass
class ChurnModel:
    spec: TenantSpec
    features: list[str]
    categorical: list[str]
    encoders: DataFrame
    trees: BoostedTrees
    metadata: dict = field(default_factory=dict)

    def with_features(self, df: DataFrame) -> DataFrame:
        """Adds the model inputs ``_f0.._fk`` (codes for categoricals, doubles
        otherwise, 0 for absent features) and keeps every input column."""
        return with_feature_vector_inputs(df, self.encoders, self.features, self.categorical)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``churn_probability`` (probability of the positive class)."""
        return self.score_features(self.with_features(df))

    def score_features(self, feats: DataFrame) -> DataFrame:
        """Score rows that already carry ``_f0.._fk``."""
        inputs = input_names(self.features)
        return self.trees.score(feats, inputs, PROBABILITY).drop(*inputs)

    def substituted(self, feats: DataFrame, means: dict[str, float]) -> tuple[DataFrame, str, list[str]]:
        """``feats`` (with ``_f0.._fk``) with its probability and, for each
        feature, the probability with that feature at its mean; and the names
        of these columns."""
        return substituted_scores(self.trees, feats, input_names(self.features), means)

    def importance(self) -> DataFrame:
        """Global importance, descending (sums to 1)."""
        return importance_table(self.encoders.sparkSession, self.features, self.trees)

    # -- persistence
    def save(self, path: str) -> None:
        self.trees.save(self.encoders.sparkSession, path)
        self.encoders.write.mode("overwrite").parquet(f"{path}/encoders")
        meta = dict(self.metadata, features=self.features, categorical=self.categorical)
        spark = self.encoders.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str, spec: TenantSpec) -> "ChurnModel":
        meta = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
        return cls(
            spec=spec,
            features=meta.pop("features"),
            categorical=meta.pop("categorical"),
            encoders=spark.read.parquet(f"{path}/encoders"),
            trees=BoostedTrees.load(spark, path),
            metadata=meta,
        )


def input_names(features: list[str]) -> list[str]:
    return [f"_f{i}" for i in range(len(features))]


def with_feature_vector_inputs(df: DataFrame, encoders: DataFrame, features: list[str], categorical: list[str]) -> DataFrame:
    enc = encode(df, encoders, categorical, prefix="_enc_")
    cols = []
    for i, f in enumerate(features):
        src = f"_enc_{f}" if f in categorical else f
        cols.append((F.col(src).cast("double") if src in enc.columns else F.lit(0.0)).alias(f"_f{i}"))
    return enc.select("*", *cols).drop(*[f"_enc_{c}" for c in categorical])


def encoder_table(train: DataFrame, categorical: list[str]) -> DataFrame:
    """Fitted encoders as a written table."""
    if not categorical:
        return train.sparkSession.createDataFrame([], "column string, value string, code bigint")
    return cut_lineage(fit_encoders(train, categorical))


def fit_churn(
    train: DataFrame,
    spec: TenantSpec,
    features: list[str] | None = None,
    params: dict | None = None,
    encoders: DataFrame | None = None,
) -> ChurnModel:
    params = dict(CHURN_PARAMS, **(params or {}))
    features = features or spec.feature_columns(train.columns)
    present = [f for f in features if f in train.columns]
    categorical = categorical_columns(train, present)
    if encoders is None:
        encoders = encoder_table(train, categorical)
    n_rows = require_complete(train, [f for f in present if f not in categorical])
    data = with_feature_vector_inputs(train, encoders, list(features), categorical).select(
        binarize(F.col(spec.target_column), spec.positive_value).cast("double").alias(LABEL),
        *input_names(list(features)),
    )
    trees = _fit(data, LABEL, list(features), n_rows, params, logistic=True)
    return ChurnModel(spec, list(features), categorical, encoders, trees, {"params": params})


def _fit(data: DataFrame, label: str, features: list[str], n_rows: int, params: dict, logistic: bool) -> BoostedTrees:
    data = data.persist()
    try:
        return fit_trees(
            data,
            input_names(features),
            label,
            features,
            n_rows,
            logistic,
            n_trees=params["n_estimators"],
            depth=params["max_depth"],
            rate=params["learning_rate"],
        )
    finally:
        data.unpersist()


def substituted_scores(
    trees: BoostedTrees, df: DataFrame, inputs: list[str], means: dict[str, float]
) -> tuple[DataFrame, str, list[str]]:
    """See ``ChurnModel.substituted``; ``means`` by input column."""
    scored = trees.substituted(df, inputs, means, "_held")
    return scored, "_held.base", [f"_held.f{k}" for k in range(len(inputs))]


def importance_table(spark: SparkSession, features: list[str], trees: BoostedTrees) -> DataFrame:
    df = spark.createDataFrame(list(zip(features, trees.importances().tolist())), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")


def train_churn(df: DataFrame, manifest: DataFrame, spec: TenantSpec, params: dict | None = None):
    """Fit on the train split, evaluate on the test split.  Returns the
    model and a one-row run record (counts, class rates, ROC-AUC, PR-AUC)."""
    train = split_rows(df, manifest, spec, "train").persist()
    test = split_rows(df, manifest, spec, "test")
    model = fit_churn(train, spec, params=params)
    scored = model.transform(test).withColumn("_y", binarize(F.col(spec.target_column), spec.positive_value))
    scored = scored.persist()
    run = evaluation_record(train, scored, spec, model.metadata.get("params", {}))
    scored.unpersist()
    train.unpersist()
    return model, run


def evaluation_record(train: DataFrame, test_scored: DataFrame, spec: TenantSpec, params: dict) -> DataFrame:
    y = binarize(F.col(spec.target_column), spec.positive_value)
    tr = train.agg(F.count(F.lit(1)).alias("n_train"), F.avg(y).alias("churn_rate_train"))
    te = test_scored.agg(F.count(F.lit(1)).alias("n_test"), F.avg("_y").alias("churn_rate_test"))
    auc = roc_auc(test_scored, "_y", PROBABILITY)
    ap = average_precision(test_scored, "_y", PROBABILITY)
    vals = {}
    for part in (tr, te, auc, ap):
        vals.update(part.collect()[0].asDict())
    spark = train.sparkSession
    return spark.createDataFrame(
        [
            (
                spec.tenant_id,
                json.dumps(params, sort_keys=True),
                int(vals["n_train"]),
                int(vals["n_test"]),
                float(vals["churn_rate_train"]),
                float(vals["churn_rate_test"]),
                vals["roc_auc"],
                vals["average_precision"],
            )
        ],
        "tenant_id string, config string, n_train bigint, n_test bigint, churn_rate_train double, "
        "churn_rate_test double, roc_auc double, pr_auc double",
    )


# ---------------------------------------------------------------- lifetime value


@dataclass
class ValueModel:
    features: list[str]
    categorical: list[str]
    encoders: DataFrame
    trees: BoostedTrees
    target: str

    def importance(self) -> DataFrame:
        return importance_table(self.encoders.sparkSession, self.features, self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        feats = with_feature_vector_inputs(df, self.encoders, self.features, self.categorical)
        inputs = input_names(self.features)
        return self.trees.score(feats, inputs, "prediction").drop(*inputs)

    def save(self, path: str) -> None:
        self.trees.save(self.encoders.sparkSession, path)
        self.encoders.write.mode("overwrite").parquet(f"{path}/encoders")
        meta = json.dumps({"features": self.features, "categorical": self.categorical, "target": self.target})
        spark = self.encoders.sparkSession
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ValueModel":
        meta = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
        return cls(
            meta["features"],
            meta["categorical"],
            spark.read.parquet(f"{path}/encoders"),
            BoostedTrees.load(spark, path),
            meta["target"],
        )


def train_value(
    df: DataFrame,
    manifest: DataFrame,
    spec: TenantSpec,
    target: str,
    exclude: tuple[str, ...] = (),
    params: dict | None = None,
):
    """Boosted regression of ``target`` on the train split; RMSE, MAE, R^2 on
    the test split."""
    params = dict(CLV_PARAMS, **(params or {}))
    train = split_rows(df, manifest, spec, "train").persist()
    test = split_rows(df, manifest, spec, "test")
    features = spec.feature_columns(df.columns, exclude=(target, *exclude))
    categorical = categorical_columns(train, features)
    encoders = encoder_table(train, categorical)
    n_rows = require_complete(train, [f for f in features if f not in categorical])
    data = with_feature_vector_inputs(train, encoders, features, categorical)
    data = data.select(F.col(target).cast("double").alias(LABEL), *input_names(features))
    trees = _fit(data, LABEL, features, n_rows, params, logistic=False)
    train.unpersist()
    model = ValueModel(features, categorical, encoders, trees, target)
    preds = model.transform(test.withColumn(target, F.col(target).cast("double")))
    return model, regression_metrics(preds, target, "prediction")
