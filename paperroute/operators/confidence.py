"""Calibrated confidence: how far a classification can be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import with_exact_round
from ..sources.dimensions import Policy

# Weights and limits of the score.
WEIGHTS = {"model": 0.55, "margin": 0.20, "evidence": 0.15, "quality": 0.10}
FULL_MARGIN = 0.4
THIN_TEXT = 200
FULL_TEXT = 400.0
AMBIGUOUS_MARGIN = 0.15
WEAK_EVIDENCE = 0.34


def calibrate(cls: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Weighted score, band and forced-review flag.

    Needs ``category``, ``model_confidence``, ``runner_up_confidence``, ``evidence_score``,
    ``ocr_char_count`` and ``render_ok``.  The band follows the unrounded score; the stored
    scores have three places.  A missing model confidence leaves the score null.
    """
    unknown = F.coalesce(F.col("category") == "UNKNOWN", F.lit(False))
    chars = F.coalesce(F.col("ocr_char_count"), F.lit(0)).cast("double")
    df = cls.withColumns(
        {
            "__unknown": unknown,
            "__margin": F.col("model_confidence") - F.col("runner_up_confidence"),
            "evidence_score": F.when(unknown, F.lit(0.0))
            .when(chars < THIN_TEXT, F.lit(0.5))
            .otherwise(F.coalesce("evidence_score", F.lit(0.5))),
        }
    )
    render = F.when(F.coalesce("render_ok", F.lit(True)), F.lit(1.0)).otherwise(F.lit(0.7))
    quality = F.greatest(
        F.lit(0.3),
        F.least(
            F.lit(1.0),
            render * (F.lit(0.3) + F.lit(0.7) * F.least(F.lit(1.0), chars / F.lit(FULL_TEXT))),
        ),
    )
    df = df.withColumns(
        {
            "margin_score": F.when(F.col("__unknown"), F.lit(0.0)).when(
                F.col("__margin").isNotNull(), F.least(F.lit(1.0), F.col("__margin") / F.lit(FULL_MARGIN))
            ),
            "input_quality_score": F.when(F.col("__unknown"), F.lit(0.0)).otherwise(quality),
        }
    )
    score = (
        F.lit(WEIGHTS["model"]) * F.col("model_confidence")
        + F.lit(WEIGHTS["margin"]) * F.col("margin_score")
        + F.lit(WEIGHTS["evidence"]) * F.col("evidence_score")
        + F.lit(WEIGHTS["quality"]) * F.col("input_quality_score")
    )
    bounded = F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    df = df.withColumn("calibrated_confidence", F.when(F.col("__unknown"), F.lit(0.0)).otherwise(bounded))
    value = F.col("calibrated_confidence")
    reason = F.when(F.col("__unknown"), F.lit("UNKNOWN")).when(
        F.col("__margin") < AMBIGUOUS_MARGIN, F.lit("AMBIGUOUS")
    ).when(F.col("evidence_score") < WEAK_EVIDENCE, F.lit("UNVERIFIED_EVIDENCE"))
    if policy.score_disabled:
        reason = reason.when(
            F.col("category").isin(*policy.score_disabled),
            F.concat(F.lit("AUTO_ROUTE_DISABLED:"), "category"),
        )
    df = df.withColumns(
        {
            "confidence_band": F.when(value >= policy.high_band, F.lit("HIGH"))
            .when(value >= policy.medium_band, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")),
            "review_reason": reason,
            "force_manual_review": reason.isNotNull(),
        }
    ).drop("__unknown", "__margin")
    return with_exact_round(
        df, 3, "calibrated_confidence", "evidence_score", "input_quality_score", "margin_score"
    )
