"""Colours of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(c: Column, scale: float | None) -> Column:
    """A channel as 0 to 255: null gives 0, other values wrap as unsigned bytes do."""
    v = c if scale is None else c * F.lit(scale)
    return F.pmod(F.coalesce(v, F.lit(0)).cast("long"), F.lit(256)).cast("int")


def sixteen_bit_scale(high: Column) -> Column:
    """1/257 if the largest value seen needs more than eight bits, else 1."""
    return F.when(high > 255, F.lit(1 / 257)).otherwise(F.lit(1.0))


def grey(intensity: Column, r: Column, g: Column, b: Column) -> list[Column]:
    """Colours, or the intensity where they are missing."""
    return [F.coalesce(c, intensity) for c in (r, g, b)]
