"""Column expressions over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def histogram_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0 for equal bins; the last bin includes its upper edge, values outside are null."""
    inside = value.between(low, high)
    return F.when(inside, F.least(F.floor((value - low) / F.lit((high - low) / bins)), F.lit(bins - 1)))


def right_closed_bin(value: Column, low: float, high: float, width: float) -> Column:
    """Bin number from 1 for bins (low, low + width], ...; values outside, the lowest edge included, are null."""
    return F.when((value > low) & (value <= high), F.ceil((value - low) / F.lit(float(width))))


def log_weight(count: Column, most: float) -> Column:
    """1 + log(1 + count), at most ``most``."""
    return F.least(1 + F.log1p(count), F.lit(float(most)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0 or either is missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
