"""Numeric defaulting and money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    """Round a double to cents and carry it as an exact decimal for summing."""
    return F.round(c.cast("double"), 2).cast(MONEY)


def money_sum(c: Column) -> Column:
    """Order-independent sum of per-row cent amounts, back as double."""
    return F.sum(money(c)).cast("double")


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(c, F.lit(hi)))
