"""Operating figures over documents, classifications and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _metric(name: str, key, value):
    return F.struct(F.lit(name).alias("metric"), key.alias("key"), value.cast("double").alias("value"))


def dashboard(docs: DataFrame, cls: DataFrame, decisions: DataFrame, today: str, days: int = 7) -> DataFrame:
    """All dashboard figures as (metric, key, value).

    Each table is read once: it is reduced to a handful of groups first and every figure is
    formed from those.
    """
    every = F.lit("all")
    by_status = docs.groupBy("processing_status").agg(F.count("*").alias("n"))
    status = by_status.select(
        F.inline(F.array(_metric("by_status", F.col("processing_status"), F.col("n")), _metric("total", every, F.col("n"))))
    )
    day = F.lit(today).cast("date")
    due = F.coalesce("action_required", F.lit(False)) & F.col("response_deadline").between(
        day, F.date_add(day, days)
    )
    grouped = cls.groupBy(
        F.coalesce("category", F.lit("UNKNOWN")).alias("category"),
        F.coalesce("confidence_band", F.lit("UNCLASSIFIED")).alias("band"),
    ).agg(
        F.count("*").alias("n"), F.sum("latency_ms").alias("latency"),
        F.count("latency_ms").alias("timed"), F.count_if(due).alias("due"),
    )
    classified = grouped.select(
        F.inline(
            F.array(
                _metric("by_category", F.col("category"), F.col("n")),
                _metric("by_band", F.col("band"), F.col("n")),
                _metric("latency_sum", every, F.col("latency")),
                _metric("latency_count", every, F.col("timed")),
                _metric("action_due_soon", every, F.col("due")),
            )
        )
    )
    counts = status.unionByName(classified).groupBy("metric", "key").agg(F.sum("value").alias("value"))
    latency = (
        counts.filter(F.col("metric").isin("latency_sum", "latency_count"))
        .agg(
            F.max(F.when(F.col("metric") == "latency_sum", F.col("value"))).alias("s"),
            F.max(F.when(F.col("metric") == "latency_count", F.col("value"))).alias("c"),
        )
        .select(
            F.lit("avg_latency_ms").alias("metric"), every.alias("key"),
            F.floor(F.try_divide("s", "c") + F.lit(0.5)).cast("double").alias("value"),
        )
    )
    routed = decisions.agg(
        F.count_if(F.col("routing_status") == "CONFIRMED").alias("c"),
        F.count_if(F.col("routing_status") == "OVERRIDDEN").alias("o"),
    )
    total = F.col("c") + F.col("o")

    def rate(c):
        share = F.coalesce(F.try_divide(F.col(c).cast("double"), total.cast("double")), F.lit(0.0))
        return F.floor(share * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)

    rates = routed.select(
        F.inline(
            F.array(
                _metric("auto_route_rate", every, rate("c")),
                _metric("override_rate", every, rate("o")),
                _metric("total_routed", every, total),
            )
        )
    )
    plain = counts.filter(~F.col("metric").isin("latency_sum", "latency_count"))
    return plain.unionByName(latency).unionByName(rates)


def counts_descending(df: DataFrame, col: str) -> DataFrame:
    """Group sizes, largest first, equal sizes by name."""
    return df.groupBy(F.col(col).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def pipeline_strip(docs: DataFrame, cls: DataFrame) -> DataFrame:
    """Filed, in review and errored with their shares.

    ``in_review_old`` counts a low-band document still in status CLASSIFIED twice, as older
    reports did; ``in_review`` counts documents.
    """
    df = docs.select(F.col("id").alias("doc_id"), "processing_status").join(
        cls.select("doc_id", "confidence_band"), "doc_id", "left"
    )
    low = F.col("confidence_band").eqNullSafe("LOW")
    waiting = F.col("processing_status") == "CLASSIFIED"
    done = F.col("processing_status").isin("ROUTED", "ERRORED")
    df = df.agg(
        F.count_if(F.col("processing_status") == "ROUTED").alias("filed"),
        F.count_if((low | waiting) & ~done).alias("in_review"),
        F.count_if(F.col("processing_status") == "ERRORED").alias("errored"),
        (F.count_if(low) + F.count_if(waiting)).alias("in_review_old"),
    )
    total = (F.col("filed") + F.col("in_review") + F.col("errored")).cast("double")
    return df.select(
        "*", *[F.try_divide(F.col(c).cast("double"), total).alias(f"{c}_share") for c in ("filed", "in_review", "errored")]
    )
