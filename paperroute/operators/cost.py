"""What the model calls cost, per call, scope, document and in total."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..sources.dimensions import PRICES

KINDS = ["input", "output", "cache_write", "cache_read"]
TOKENS = ["input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"]


def price_list(
    overrides: Mapping[tuple[str, str], float] | None = None, prices: Sequence[tuple] = PRICES
) -> list[tuple]:
    """Prices with some entries replaced: ``overrides`` maps (prefix, kind) to a price."""
    overrides = overrides or {}
    return [
        (row[0], *[float(overrides.get((row[0], kind), p)) for kind, p in zip(KINDS, row[1:])]) for row in prices
    ]


def _price_of(model: Column, prices: Sequence[tuple]) -> Column:
    """The price row with the longest matching prefix; null when no prefix matches."""
    found = F.lit(None).cast("struct<prefix:string,input:double,output:double,cache_write:double,cache_read:double>")
    for prefix, *row in sorted(prices, key=lambda r: len(r[0])):
        entry = F.struct(F.lit(prefix).alias("prefix"), *[F.lit(float(p)).alias(k) for k, p in zip(KINDS, row)])
        found = F.when(model.startswith(prefix), entry).otherwise(found)
    return found


def price_calls(calls: DataFrame, prices: Sequence[tuple] = PRICES) -> DataFrame:
    """Cost of each call; null when the model has no price, 0 for a local model.

    The price list is short and fixed, so matching is a conditional expression, not a join.
    """
    df = calls.withColumn("__price", _price_of(F.col("model"), prices))

    def tokens(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("double") if name in calls.columns else F.lit(0.0)

    total = None
    for name, kind in zip(TOKENS, KINDS):
        part = tokens(name) * F.col(f"__price.{kind}")
        total = part if total is None else total + part
    cost = total / F.lit(1_000_000.0)
    if "local" in calls.columns:
        cost = F.when(F.coalesce("local", F.lit(False)), F.lit(0.0)).otherwise(cost)
    return df.withColumns({"price_prefix": F.col("__price.prefix"), "cost_usd": cost}).drop("__price")


def usage_scopes(calls: DataFrame, scopes: DataFrame, keys: Sequence[str] = ("tracking_id", "stage")) -> DataFrame:
    """One row per scope with the totals of its calls; a scope without calls costs 0.

    Costs are added as decimals, so the total does not depend on the order of the rows.
    """
    sums = calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        *[F.sum(t).alias(t) for t in TOKENS if t in calls.columns],
        F.sum(F.col("cost_usd").cast("decimal(24,10)")).alias("__cost"),
        F.count_if(F.col("cost_usd").isNull()).alias("__unpriced"),
        F.min_by("model", F.when(F.coalesce("model", F.lit("")) != "", F.col("call_no"))).alias("model"),
    )
    df = scopes.select(*keys).distinct().join(sums, list(keys), "left")
    known = F.coalesce("__unpriced", F.lit(0)) == 0
    df = df.select(
        *keys, F.coalesce("calls", F.lit(0)).alias("calls"),
        *[F.coalesce(t, F.lit(0)).alias(t) for t in TOKENS if t in calls.columns],
        "model", known.alias("cost_known"),
        F.when(known, F.coalesce(F.round("__cost", 6).cast("double"), F.lit(0.0))).alias("cost_usd"),
    )
    return df


def cost_per_doc(usage: DataFrame) -> DataFrame:
    """One row per tracking id over all its usage lines; reruns add up.

    ``usage``: ``tracking_id``, ``stage``, ``at``, ``file_name``, ``category``, the token
    totals, ``cost_usd`` and ``calls array<struct<call, model, ...>>``.  Call lists are reduced
    inside their row, so nothing is exploded.
    """
    extract = F.coalesce(F.col("stage") == "extract", F.lit(False))
    n_calls = F.coalesce(F.size("calls"), F.lit(0))
    models = F.array_sort(F.array_distinct(F.filter(F.transform("calls", lambda c: c["model"]), lambda m: m != "")))
    repairs = F.size(F.filter("calls", lambda c: c["call"] == "repair"))
    df = usage.withColumns(
        {
            "tracking_id": F.coalesce("tracking_id", F.lit("unknown")),
            "__x": extract, "__n": n_calls, "__models": F.array_join(models, "\n"),
            "__repairs": F.greatest(repairs, F.lit(0)),
        }
    )

    def total(value: Column, stage: Column) -> Column:
        return F.coalesce(F.sum(F.when(stage, value)), F.lit(0))

    def usd(stage: Column) -> Column:
        exact = F.col("cost_usd").cast("decimal(20,6)")
        return F.coalesce(F.sum(F.when(stage, exact)), F.lit(0).cast("decimal(20,6)"))

    def named(stage: Column) -> Column:
        # distinct model lists, not calls: there are as many as combinations of models in use
        lists = F.array_join(F.collect_set(F.when(stage, F.col("__models"))), "\n")
        names = F.filter(F.split(lists, "\n"), lambda m: m != "")
        return F.array_join(F.array_sort(F.array_distinct(names)), ", ")

    x = F.col("__x")
    first_file = F.min_by("file_name", F.when(F.coalesce("file_name", F.lit("")) != "", F.col("at")))
    first_category = F.min_by("category", F.when(F.coalesce("category", F.lit("")) != "", F.col("at")))
    df = df.groupBy("tracking_id").agg(
        F.coalesce(first_file, F.lit("")).alias("file_name"),
        F.coalesce(first_category, F.lit("")).alias("category"),
        named(~x).alias("classify_models"), named(x).alias("extract_models"),
        F.sum("__n").alias("calls"), F.sum("__repairs").alias("repairs"),
        total(F.col("input_tokens"), ~x).alias("classify_input"),
        total(F.col("output_tokens"), ~x).alias("classify_output"),
        usd(~x).alias("classify_usd"),
        total(F.col("input_tokens"), x).alias("extract_input"),
        total(F.col("output_tokens"), x).alias("extract_output"),
        usd(x).alias("extract_usd"),
        F.sum(F.coalesce("cache_read_tokens", F.lit(0))).alias("cache_read"),
        F.bool_or(F.col("cost_usd").isNull()).alias("__unknown"),
    )
    df = df.withColumns(
        {
            "total_input": F.col("classify_input") + F.col("extract_input"),
            "total_output": F.col("classify_output") + F.col("extract_output"),
            "total_usd": F.when(~F.col("__unknown"), F.col("classify_usd") + F.col("extract_usd")),
        }
    ).drop("__unknown")
    return df.withColumns(
        {c: F.round(c, 4).cast("double") for c in ("classify_usd", "extract_usd", "total_usd")}
    )


def exact_median(df: DataFrame, col: str) -> DataFrame:
    """The exact median of a non-negative column, as one row, without one task seeing all values.

    Values are counted, then counted again by their two leading digits; only the few values of
    the one or two slices that hold the middle are looked at in order.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    power = F.floor(F.log10("v"))
    slot = F.when(F.col("v") <= 0, F.lit(-1000.0)).otherwise(
        power * F.lit(100.0) + F.floor(F.col("v") / F.pow(F.lit(10.0), power - 1))
    )
    counts = counts.withColumn("slot", slot)
    # at most 90 slices per power of ten, so these windows are over a few thousand rows
    ahead = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        counts.groupBy("slot").agg(F.sum("n").alias("m"))
        .select("slot", "m", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    )
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = slices.filter((F.col("before") < high) & (F.col("before") + F.col("m") >= low))
    inside = Window.partitionBy("slot").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(F.broadcast(middle), "slot").withColumn(
        "start", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    end = F.col("start") + F.col("n")
    return ranked.agg(
        ((F.max(F.when((F.col("start") < low) & (end >= low), F.col("v")))
          + F.max(F.when((F.col("start") < high) & (end >= high), F.col("v")))) / 2.0).alias("median")
    )


def cost_summary(per_doc: DataFrame) -> DataFrame:
    """Totals over all documents as (metric, value); unpriced documents are counted apart."""
    exact = lambda c: F.col(c).cast("decimal(20,4)")  # noqa: E731  rounded amounts add up without error
    spend = F.sum(exact("total_usd")).cast("double")
    priced = F.col("total_usd").isNotNull()
    one = per_doc.agg(
        F.count("*").alias("documents"), F.sum("calls").alias("calls"),
        F.sum("total_input").alias("input_tokens"), F.sum("total_output").alias("output_tokens"),
        spend.alias("spend"), (spend / F.count("total_usd")).alias("mean_usd"),
        F.min("total_usd").alias("min_usd"), F.max("total_usd").alias("max_usd"),
        F.sum(F.when(priced, exact("classify_usd"))).cast("double").alias("classify_usd"),
        F.sum("repairs").alias("repairs"), F.count_if(~priced).alias("unpriced"),
    )
    share = F.try_divide("classify_usd", F.when(F.col("spend") == 0, F.lit(1.0)).otherwise(F.col("spend")))
    figures = {
        "documents": F.col("documents"), "calls": F.col("calls"),
        "calls_per_document": ratio(F.col("calls"), F.col("documents")),
        "input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"),
        "mean_input_tokens": F.floor(F.col("input_tokens") / F.col("documents")),
        "mean_output_tokens": F.floor(F.col("output_tokens") / F.col("documents")),
        "spend": F.col("spend"), "mean_usd": F.col("mean_usd"), "min_usd": F.col("min_usd"),
        "max_usd": F.col("max_usd"), "classify_share": share, "repairs": F.col("repairs"),
        "unpriced": F.col("unpriced"),
    }
    rows = one.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v.cast("double"), 6).alias("value")) for k, v in figures.items()]))
    )
    median = exact_median(per_doc, "total_usd").select(
        F.lit("median_usd").alias("metric"), F.round("median", 6).alias("value")
    )
    return rows.unionByName(median)
