"""Tenant specification: which columns play which role in one tenant's table."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class TenantSpec:
    tenant_id: str
    id_column: str
    target_column: str
    positive_value: Any
    revenue_column: str
    # Optional roles.  ``duration_column`` is the survival time; when both it
    # and ``total_column`` exist, cleaning takes the zero-tenure branch.
    duration_column: str | None = None
    total_column: str | None = None
    segment_column: str | None = None
    path: str | None = None
    extra_excluded: tuple[str, ...] = field(default_factory=tuple)

    @property
    def required(self) -> list[str]:
        return [self.id_column, self.target_column, self.revenue_column]

    def feature_columns(self, columns: list[str], exclude: tuple[str, ...] = ()) -> list[str]:
        """All columns except id and label (and any extra exclusions), in
        table order."""
        dropped = {self.id_column, self.target_column, *self.extra_excluded, *exclude}
        return [c for c in columns if c not in dropped]


# The telco tenant's configured roles.
TELCO = TenantSpec(
    tenant_id="telco",
    id_column="customerID",
    target_column="Churn",
    positive_value="Yes",
    revenue_column="MonthlyCharges",
    duration_column="tenure",
    total_column="TotalCharges",
    segment_column="Contract",
)

# The banking tenant's configured roles.
BANKING = TenantSpec(
    tenant_id="banking",
    id_column="CustomerId",
    target_column="Exited",
    positive_value=1,
    revenue_column="Balance",
)

# Roles of the customer snapshot derived from the orders tables.
SNAPSHOT = TenantSpec(
    tenant_id="snapshot",
    id_column="customer_id",
    target_column="churn",
    positive_value="Yes",
    revenue_column="avg_order",
    duration_column="tenure_months",
    total_column="total_spend",
    segment_column="contract",
    extra_excluded=("tenant_id",),
)
