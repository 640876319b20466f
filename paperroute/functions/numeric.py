"""Rounding that follows the exact binary value of a double, ties to the even digit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def _halves(value: float) -> tuple[float, float]:
    carry = _SPLIT * value
    high = carry - (carry - value)
    return high, value - high


def with_exact_round(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Round the named double columns in place.

    ``F.round`` rounds the decimal text half up; a gate that compares a stored three-place
    score needs the rounding of the exact binary value instead.  ``x * 10**places`` is formed
    as an unevaluated sum of two doubles, so the comparison with one half is exact.  Each step
    is its own projection, which keeps the expressions small and inside code generation.
    """
    scale = float(10**places)
    s_hi, s_lo = _halves(scale)
    keep = df.columns

    def tmp(step: str, name: str) -> str:
        return f"__{step}_{name}"

    df = df.withColumns({tmp("a", n): F.abs(F.col(n)) for n in names})
    df = df.withColumns({tmp("c", n): F.col(tmp("a", n)) * F.lit(_SPLIT) for n in names})
    df = df.withColumns(
        {tmp("h", n): F.col(tmp("c", n)) - (F.col(tmp("c", n)) - F.col(tmp("a", n))) for n in names}
    )
    df = df.withColumns(
        {
            **{tmp("l", n): F.col(tmp("a", n)) - F.col(tmp("h", n)) for n in names},
            **{tmp("p", n): F.col(tmp("a", n)) * F.lit(scale) for n in names},
        }
    )
    df = df.withColumns(
        {
            **{
                tmp("e", n): (
                    (F.col(tmp("h", n)) * F.lit(s_hi) - F.col(tmp("p", n)))
                    + F.col(tmp("h", n)) * F.lit(s_lo)
                    + F.col(tmp("l", n)) * F.lit(s_hi)
                )
                + F.col(tmp("l", n)) * F.lit(s_lo)
                for n in names
            },
            **{tmp("f", n): F.floor(tmp("p", n)).cast("double") for n in names},
        }
    )
    df = df.withColumns(
        {
            tmp("g", n): (F.col(tmp("p", n)) - F.col(tmp("f", n)) - F.lit(0.5)) + F.col(tmp("e", n))
            for n in names
        }
    )

    def rounded(n: str) -> Column:
        base, over = F.col(tmp("f", n)), F.col(tmp("g", n))
        up = (over > 0) | ((over == 0) & (base % F.lit(2.0) == 1.0))
        magnitude = (base + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)
        return F.when(F.col(n) < 0, -magnitude).otherwise(magnitude)

    done = {n: rounded(n) for n in names}
    return df.select(*[done[c].alias(c) if c in done else F.col(c) for c in keep])


def ratio(numerator: Column, denominator: Column) -> Column:
    """Plain division, null when there is nothing to divide by."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
