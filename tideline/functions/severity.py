"""Severity scale and cut-offs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered scale, default cut-offs.
SEVERITIES = ("low", "medium", "high")
PSI_WARN = 0.1
PSI_HIGH = 0.25
CHI2_HIGH_P = 0.01
CHI2_ALPHA = 0.05


def psi_severity(psi: Column, warn: float = PSI_WARN, high: float = PSI_HIGH) -> Column:
    """NULL where nothing could be measured."""
    return F.when(psi.isNull() | F.isnan(psi), None).when(psi >= high, "high").when(psi >= warn, "medium").otherwise("low")


def chi2_severity(p_value: Column, alpha: float = CHI2_ALPHA) -> Column:
    """NULL where nothing could be measured."""
    return F.when(p_value.isNull() | F.isnan(p_value), None).when(p_value < CHI2_HIGH_P, "high").when(p_value < alpha, "medium").otherwise("low")


def severity_rank(severity: Column) -> Column:
    """1 for low, 2 for medium, 3 for high, 0 for anything else."""
    return F.coalesce(
        F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0)
    ).cast("int")


def severity_name(rank: Column) -> Column:
    """Inverse of :func:`severity_rank`; NULL and 0 read as low."""
    return F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")


def highest_severity(ranks: Column, unknown: Column) -> Column:
    """Name of the highest rank. Medium and high stand as they are; low is not claimed (NULL) if a
    measure is unknown."""
    return F.when(unknown & (F.coalesce(ranks, F.lit(0)) <= 1), None).otherwise(severity_name(ranks))


def should_act(severity: Column) -> Column:
    return severity.isin("medium", "high")
