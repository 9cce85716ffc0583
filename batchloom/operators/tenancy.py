"""Tenant views. A filtered view is a convention and no security boundary: whoever has the files has all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(df: DataFrame, tenant: str | None) -> DataFrame:
    """The tenant's rows; without a tenant, none."""
    return df.where(F.lit(False)) if not tenant else df.where(F.col("tenant_scope") == tenant)
