"""From a classification to a destination: categories, precedence, outcome."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import pyarrow as pa

from ..functions.text import blank_to_null, strip
from ..sources.dimensions import Policy, category_aliases, complete_rules, default_rules, local_table

Rules = DataFrame | Sequence[Mapping[str, object]]


def normalise_category(
    df: DataFrame, col: str = "category", out: str = "category_now", aliases: DataFrame | None = None
) -> DataFrame:
    """Current category of a possibly retired or misspelt code; anything else is UNKNOWN.

    ``aliases`` (``alias``, ``current``; each alias once) may replace the default ones.
    """
    key = F.upper(F.translate(strip(F.col(col)), "- ", "__"))
    names = category_aliases(df.sparkSession) if aliases is None else aliases.select("alias", "current")
    return (
        df.withColumn("__alias", key)
        .join(names.withColumnRenamed("alias", "__alias"), "__alias", "left")
        .withColumn(out, F.coalesce("current", F.lit("UNKNOWN")))
        .drop("__alias", "current")
    )


def _attach(df: DataFrame, rules: Rules | None, keys: dict[str, str], out: str) -> DataFrame:
    """Left join one rule list; of rules with equal keys the first in list order wins."""
    wanted = list(keys)
    if rules is None or (not isinstance(rules, DataFrame) and not complete_rules(rules, wanted)):
        return df.withColumn(out, F.lit(None).cast("string"))
    if isinstance(rules, DataFrame):
        table = (
            rules.dropna(subset=[*wanted, "folder"])
            .groupBy(*wanted)
            .agg(F.min_by("folder", "pos").alias(out))
        )
    else:
        rows = complete_rules(rules, wanted)
        table = local_table(
            df.sparkSession,
            {**{k: pa.array([r[k] for r in rows]) for k in wanted}, out: pa.array([r["folder"] for r in rows])},
        )
    table = table.select(*[F.col(k).alias(f"__{k}") for k in wanted], out)
    on = None
    for rule_key, column in keys.items():
        match = F.col(f"__{rule_key}") == F.col(column)
        on = match if on is None else on & match
    return df.join(table, on, "left").drop(*[f"__{k}" for k in wanted])


def route(
    cls: DataFrame,
    rules: Rules | None = None,
    subtype_overrides: Rules | None = None,
    sender_overrides: Rules | None = None,
    policy: Policy = Policy(),
) -> DataFrame:
    """Destination folder by sender, then subtype, then category, then the review folder.

    Needs ``category``, ``subtype`` and ``sender_fax``; adds ``suggested_folder`` and
    ``rule_matched``.
    """
    df = cls.withColumn("__sender", blank_to_null(F.col("sender_fax")))
    df = _attach(df, sender_overrides, {"sender_fax": "__sender"}, "__by_sender")
    df = _attach(df, subtype_overrides, {"category": "category", "subtype": "subtype"}, "__by_subtype")
    df = _attach(df, default_rules() if rules is None else rules, {"category": "category"}, "__by_category")
    return df.withColumns(
        {
            "suggested_folder": F.coalesce(
                "__by_sender", "__by_subtype", "__by_category", F.lit(policy.review_folder)
            ),
            "rule_matched": F.when(
                F.col("__by_sender").isNotNull(), F.concat(F.lit("sender:"), "__sender")
            )
            .when(
                F.col("__by_subtype").isNotNull(),
                F.concat(F.lit("subtype:"), "category", F.lit("/"), "subtype"),
            )
            .when(F.col("__by_category").isNotNull(), F.concat(F.lit("category:"), "category"))
            .otherwise(F.lit("unmapped")),
        }
    ).drop("__sender", "__by_sender", "__by_subtype", "__by_category")


def filing_outcome(routed: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """What happens to a routed document.

    Needs ``category``, ``calibrated_confidence``, ``confidence_band``, ``force_manual_review``
    and ``suggested_folder``; adds ``meets_gate``, ``routing_status``, ``final_folder``,
    ``filed`` and ``hold_reason``.
    """
    forced = F.coalesce("force_manual_review", F.lit(False))
    disabled = F.coalesce(F.col("category").isin(*policy.route_disabled), F.lit(False)) if (
        policy.route_disabled
    ) else F.lit(False)
    gate = (
        F.lit(True)
        if policy.min_confidence <= 0
        else F.coalesce(F.col("calibrated_confidence") >= policy.min_confidence, F.lit(False))
    )
    df = routed.withColumns({"meets_gate": gate, "__forced": forced, "__disabled": disabled})
    high = F.coalesce(F.col("confidence_band") == "HIGH", F.lit(False))
    confident = high & F.col("meets_gate") & ~F.col("__forced") & ~F.col("__disabled")
    held = F.col("__forced") | F.col("__disabled") | ~F.col("meets_gate")
    waiting = F.when(held, F.lit("MANUAL_REVIEW")).otherwise(F.lit("SUGGESTED"))
    if policy.mode == "AUTO":
        to_review = F.lit(policy.file_uncertain)
        status = (
            F.when(confident, F.lit("CONFIRMED"))
            .when(to_review, F.lit("MANUAL_REVIEW"))
            .otherwise(waiting)
        )
        folder = F.when(confident, F.col("suggested_folder")).when(
            to_review, F.lit(policy.review_folder)
        )
        filed = confident | to_review
    else:
        status, folder, filed = waiting, F.lit(None).cast("string"), F.lit(False)
    reason = (
        F.when(F.col("__forced"), F.lit("FORCED"))
        .when(F.col("__disabled"), F.lit("CATEGORY_DISABLED"))
        .when(~F.col("meets_gate"), F.lit("BELOW_GATE"))
        .when(~high, F.lit("NOT_HIGH_BAND"))
    )
    return df.withColumns(
        {"routing_status": status, "final_folder": folder, "filed": filed, "hold_reason": reason}
    ).drop("__forced", "__disabled")
