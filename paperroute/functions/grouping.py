"""Ordered per-key computations that stay spread out when one key holds most rows.

A plain window puts a whole key into one task.  These helpers cut every key into time slices,
run the window inside a slice, and carry the last value of earlier slices over: the second
window sees one row per key and slice only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, greatest by ``order``.  Aggregates map-side, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row")).select(*keys, "__row.*")


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row")).select(*keys, "__row.*")


def time_slice(ts: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))


def with_previous(
    df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[str], cols: dict[str, str]
) -> DataFrame:
    """Add the value each column had in the row before, per key.  ``cols`` maps new to old."""
    df = df.withColumn("__slice", slice_col)
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    packed = F.struct(*[F.col(old).alias(new) for new, old in cols.items()])
    within = df.withColumn("__in", F.lag(packed).over(inside))
    ends = df.groupBy(*keys, "__slice").agg(
        F.max_by(packed, F.struct(*[F.col(c) for c in order])).alias("__end")
    )
    across = Window.partitionBy(*keys).orderBy("__slice")
    ends = ends.select(*keys, "__slice", F.lag("__end").over(across).alias("__before"))
    joined = within.join(ends, [*keys, "__slice"], "left")
    joined = joined.withColumn("__prev", F.coalesce("__in", "__before"))
    return joined.select(*[c for c in df.columns if c != "__slice"], "__prev.*")


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: Column,
    order: Sequence[str],
    totals: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running sums and running maxima, current row included, per key."""
    totals, maxima = totals or {}, maxima or {}
    df = df.withColumn("__slice", slice_col)
    span = (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(*span)
    within = df.withColumns(
        {
            **{f"__{n}": F.sum(c).over(inside) for n, c in totals.items()},
            **{f"__{n}": F.max(c).over(inside) for n, c in maxima.items()},
        }
    )
    ends = df.groupBy(*keys, "__slice").agg(
        *[F.sum(c).alias(n) for n, c in totals.items()],
        *[F.max(c).alias(n) for n, c in maxima.items()],
    )
    across = (
        Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = ends.select(
        *keys,
        "__slice",
        *[F.sum(n).over(across).alias(f"__before_{n}") for n in totals],
        *[F.max(n).over(across).alias(f"__before_{n}") for n in maxima],
    )
    joined = within.join(ends, [*keys, "__slice"], "left")
    return joined.select(
        *[c for c in df.columns if c != "__slice"],
        *[
            (F.coalesce(F.col(f"__{n}"), F.lit(0)) + F.coalesce(F.col(f"__before_{n}"), F.lit(0))).alias(n)
            for n in totals
        ],
        *[F.greatest(f"__{n}", f"__before_{n}").alias(n) for n in maxima],
    )


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_order: Sequence[str],
    payload: str = "as_of",
    seconds: int = 3600,
) -> DataFrame:
    """Attach to each left row the last right row of its key at or before its time.

    Both sides are merged into one ordered stream, so no key ever forms left times right pairs.
    """
    body = [c for c in left.columns if c not in keys]
    value = [c for c in right.columns if c not in keys]
    a = left.select(
        *keys,
        F.col(left_ts).alias("__ts"),
        F.lit(1).alias("__side"),
        F.struct(*body).alias("__left"),
        F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType).alias("__right"),
    )
    b = right.select(
        *keys,
        F.col(right_ts).alias("__ts"),
        F.lit(0).alias("__side"),
        F.lit(None).cast(left.select(F.struct(*body)).schema[0].dataType).alias("__left"),
        F.struct(*value).alias("__right"),
    )
    ties = [F.col(f"__right.{c}") for c in right_order]
    merged = a.unionByName(b).withColumn("__slice", time_slice(F.col("__ts"), seconds))
    inside = (
        Window.partitionBy(*keys, "__slice")
        .orderBy("__ts", "__side", *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = merged.withColumn("__in", F.last("__right", ignorenulls=True).over(inside))
    rank = F.struct(F.col("__ts"), *ties)
    ends = (
        merged.groupBy(*keys, "__slice")
        .agg(F.max_by("__right", F.when(F.col("__side") == 0, rank)).alias("__end"))
    )
    across = (
        Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = ends.select(*keys, "__slice", F.last("__end", ignorenulls=True).over(across).alias("__before"))
    return (
        within.filter(F.col("__side") == 1)
        .join(ends, [*keys, "__slice"], "left")
        .select(*keys, "__left.*", F.coalesce("__in", "__before").alias(payload))
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: Column, slices: int = 64
) -> DataFrame:
    """The first ``k`` rows of each group, ranked in column ``rank``.

    A group is cut into ``slices`` parts first and each part keeps its own best ``k``; the best
    of the parts are the best of the group.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(slices))
    first = Window.partitionBy(*keys, "__part").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__part", part)
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= k)
        .drop("__part", "rank")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
    )
