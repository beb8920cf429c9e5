"""Published model versions of many tenants.

A version is written whole to a folder of its own, then published by one
appended row that names the folder.  A reader looks the newest row up, so it
sees the version before or the version after, never one half written, and no
published folder is ever written to again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnframe.operators.clean import clean
from churnframe.operators.models import ChurnModel
from churnframe.session import path_exists
from churnframe.sources.store import PREDICTIONS_SCHEMA, pack_customers, score_population, write_partitioned
from churnframe.spec import TenantSpec

PUBLISHED = "tenant_id string, model_version string, folder string, sequence bigint"


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def published(self) -> DataFrame:
        """Every publication, oldest to newest by ``sequence``."""
        path = f"{self.root}/published"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], PUBLISHED)
        return self.spark.read.schema(PUBLISHED).parquet(path)

    def publish(self, tenant_id: str, model_version: str, save: Callable[[str], None]) -> str:
        """``save(folder)`` writes the version; then it becomes current."""
        folder = f"{self.root}/versions/{uuid.uuid4().hex}"
        save(folder)
        last = self.published().agg(F.max("sequence")).first()[0]
        row = (tenant_id, model_version, folder, (last or 0) + 1)
        self.spark.createDataFrame([row], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{self.root}/published")
        return folder

    def current(self, tenant_id: str) -> tuple[str, str] | None:
        """(version, folder) published last, or None."""
        own = self.published().where(F.col("tenant_id") == tenant_id)
        row = own.orderBy(F.desc("sequence"), "folder").limit(1).collect()
        return (row[0].model_version, row[0].folder) if row else None

    def folder(self, tenant_id: str, model_version: str) -> str | None:
        """The folder of a version, its last publication."""
        own = self.published().where((F.col("tenant_id") == tenant_id) & (F.col("model_version") == model_version))
        row = own.orderBy(F.desc("sequence"), "folder").limit(1).collect()
        return row[0].folder if row else None

    def model(self, spec: TenantSpec) -> tuple[str, ChurnModel] | None:
        """The tenant's current model; None without one, or without its
        metadata."""
        found = self.current(spec.tenant_id)
        if found is None or not path_exists(self.spark, f"{found[1]}/meta"):
            return None
        return found[0], ChurnModel.load(self.spark, found[1], spec)


def score_tenants(
    registry: Registry, cleaned: Mapping[str, DataFrame], specs: Mapping[str, TenantSpec], predicted_at: dt.datetime
) -> DataFrame:
    """Prediction rows of all tenants in one plan, each scored by its own
    current model; a tenant without one has none."""
    out = registry.spark.createDataFrame([], PREDICTIONS_SCHEMA)
    for tenant, df in cleaned.items():
        found = registry.model(specs[tenant])
        if found is not None:
            out = out.unionByName(score_population(df, found[1], specs[tenant], tenant, found[0], predicted_at))
    return out


def load_population(
    registry: Registry,
    raw: Mapping[str, DataFrame],
    specs: Mapping[str, TenantSpec],
    customers_path: str,
    predictions_path: str,
    when: dt.datetime,
) -> None:
    """Every tenant's raw rows into the customers table and its scored
    population into the predictions table: one write each.  A reload replaces
    the partitions of the tenants it covers, and no others."""
    packed = None
    for tenant, df in raw.items():
        rows = pack_customers(df, specs[tenant], when, tenant_id=tenant)
        packed = rows if packed is None else packed.unionByName(rows)
    if packed is None:
        return
    write_partitioned(packed, customers_path, ["tenant_id"])
    cleaned = {t: clean(df, specs[t]) for t, df in raw.items()}
    write_partitioned(score_tenants(registry, cleaned, specs, when), predictions_path, ["tenant_id", "model_version"])
