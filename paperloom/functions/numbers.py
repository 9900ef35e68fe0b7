"""Numeric helpers with one result on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, places: int) -> Column:
    """Half-up rounding of a non-negative double by its binary value, written so that other engines agree to the last bit."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5).cast("double") / scale


def half_even_index(n: Column, share: float) -> Column:
    """Zero-based index of the last of the top ``share`` of ``n`` items, half-even, 0 at least."""
    return F.greatest(F.rint(n * F.lit(share)).cast("int") - 1, F.lit(0))
