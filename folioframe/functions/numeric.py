"""Arithmetic helpers that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Half-up rounding by floor: no decimal boxing, and the same bits on every engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def units(value: Column, digits: int) -> Column:
    """A rounded value as a whole number of 10^-digits, so that sums do not depend on row order."""
    return F.floor(value * F.lit(float(10**digits)) + F.lit(0.5)).cast("bigint")


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def compact(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression tree that would otherwise repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rnd_sql(expr: str, digits: int) -> str:
    """The same rounding as an expression text."""
    scale = f"{10**digits}D"
    return f"(floor(({expr}) * {scale} + 0.5D) / {scale})"


def clamp_sql(expr: str) -> str:
    return f"greatest(0D, least(1D, {expr}))"
