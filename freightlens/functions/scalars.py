"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MICRO = 1_000_000


def snap(value: Column | str, scale: int = MICRO) -> Column:
    """Round half up to 1/scale with the same IEEE steps in every engine."""
    c = F.col(value) if isinstance(value, str) else value
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def micros(value: Column | str) -> Column:
    """A score in [0, 1] as whole millionths."""
    c = F.col(value) if isinstance(value, str) else value
    return F.floor(c * F.lit(float(MICRO)) + F.lit(0.5)).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den as double; 0 when the denominator is zero or either side is missing."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; missing stays missing."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def no_nan(value: Column) -> Column:
    """NaN becomes NULL: NULL is the only missing value in this package."""
    return F.when(~F.isnan(value), value)


def add_all(terms: list[Column]) -> Column:
    """Left-to-right sum."""
    return reduce(lambda a, b: a + b, terms)


def hash01(*parts: Column) -> Column:
    """A repeatable draw in [0, 1) from the given values; retried tasks redraw the same number."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def hash_int(modulus: Column | int, *parts: Column) -> Column:
    """A repeatable integer draw in [0, modulus)."""
    m = modulus if isinstance(modulus, Column) else F.lit(modulus)
    return F.pmod(F.xxhash64(*parts), m.cast("bigint"))


def unpivot_structs(rows: list[Column]) -> Column:
    """`inline`-able array: one output row per struct of a single wide aggregate row."""
    return F.inline(F.array(*rows))


def unpivot_cells(df: DataFrame, columns: list[str], name: str = "column", keep: list[str] = ()) -> DataFrame:
    """One row per cell: (keep..., name, value as double)."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))
