"""Schema conformance and enrichment joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnframe.functions.columns import yes_no_strict

# Extended telco export names -> original schema names.
TELCO_RENAME = {
    "CustomerID": "customerID",
    "Gender": "gender",
    "Senior Citizen": "SeniorCitizen",
    "Partner": "Partner",
    "Dependents": "Dependents",
    "Tenure Months": "tenure",
    "Phone Service": "PhoneService",
    "Multiple Lines": "MultipleLines",
    "Internet Service": "InternetService",
    "Online Security": "OnlineSecurity",
    "Online Backup": "OnlineBackup",
    "Device Protection": "DeviceProtection",
    "Tech Support": "TechSupport",
    "Streaming TV": "StreamingTV",
    "Streaming Movies": "StreamingMovies",
    "Contract": "Contract",
    "Paperless Billing": "PaperlessBilling",
    "Payment Method": "PaymentMethod",
    "Monthly Charges": "MonthlyCharges",
    "Total Charges": "TotalCharges",
    "Churn Label": "Churn",
}

# The 21 columns of the original telco schema, in order.
TELCO_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaperlessBilling", "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
]

# Columns the extended export adds to the original schema.
TELCO_ENRICHMENT = ["City", "State", "Zip Code", "Latitude", "Longitude", "Churn Score", "CLTV", "Churn Reason"]


def conform_schema(
    df: DataFrame,
    rename: Mapping[str, str],
    slim_columns: Sequence[str],
    strict_yes_no: Sequence[str] = (),
    drop_from_full: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Rename, recode Yes/No columns strictly (anything else fails the job),
    then return (slim: exactly ``slim_columns`` in order, full: everything
    but ``drop_from_full``).  Pure projections."""
    renamed = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    for c in strict_yes_no:
        renamed = renamed.withColumn(c, yes_no_strict(F.col(f"`{c}`"), c))
    slim = renamed.select(*[F.col(f"`{c}`") for c in slim_columns])
    full = renamed.drop(*[c for c in drop_from_full if c in renamed.columns])
    return slim, full


def enrich_base_wins(base: DataFrame, extended: DataFrame, id_column: str, new_columns: Sequence[str]) -> DataFrame:
    """Left join adding only ``new_columns`` from ``extended``; a column the
    base already has always comes from the base.  As in any left join, a base
    row appears once for each extended row of its id; a NULL id matches
    nothing."""
    overlap = set(new_columns) & set(base.columns)
    if overlap:
        raise ValueError(f"new columns already in base: {sorted(overlap)}")
    ext = extended.select(F.col(f"`{id_column}`"), *[F.col(f"`{c}`") for c in new_columns])
    return base.join(ext, id_column, "left")
