"""Tenants and federated sources: who sees a row, what goes with a tenant, how far another store is believed."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

TENANT = re.compile(r"[A-Za-z0-9_-]{1,64}")


def checked(tenant: str) -> str:
    """The id itself; one with other characters than letters, digits, _ and - is refused."""
    if not TENANT.fullmatch(tenant):
        raise ValueError(f"{tenant!r} is no tenant id")
    return tenant


def erased(rows: DataFrame, tenant: str) -> DataFrame:
    """The rows without a tenant's; shared rows (null tenant) stay."""
    return rows.where(F.col("tenant_id").isNull() | (F.col("tenant_id") != F.lit(checked(tenant))))


def assigned(rows: DataFrame, tenant: str) -> DataFrame:
    """Rows of no tenant become the tenant's."""
    return rows.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(checked(tenant))))


def federated(sources: list[tuple[DataFrame, float]]) -> DataFrame:
    """graph, s, p, o, o_kind, confidence: remote quads with their source's weight as confidence, the highest where several have one."""
    rows = reduce(DataFrame.unionByName, [q.select("graph", "s", "p", "o", "o_kind", F.lit(float(w)).alias("confidence")) for q, w in sources])
    return rows.groupBy("graph", "s", "p", "o", "o_kind").agg(F.max("confidence").alias("confidence"))
