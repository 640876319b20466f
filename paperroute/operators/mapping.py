"""Automatic filing against what people filed by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, with_exact_round
from ..functions.text import base_name, clerk_form, parent_path, strip


def manual_mapping(manual: DataFrame, preds: DataFrame) -> DataFrame:
    """Manual folder beside the predicted one; ``match`` is blank where nobody filed by hand.

    ``manual``: ``file``, ``manual_folder``, ``fax_line``; ``preds``: ``file``, ``suggested_folder``,
    ``suggested_file_name``, ``calibrated_confidence``, ``force_manual_review``, ``category``,
    ``subtype``, ``error``.
    """
    df = manual.join(preds.withColumn("__seen", F.lit(True)), "file", "left")
    failed = F.col("error").isNotNull() | F.col("__seen").isNull()

    def shown(c):
        return F.when(failed, F.lit("")).otherwise(F.coalesce(c, F.lit("")))

    def fold(c):
        return F.lower(strip(F.coalesce(F.col(c), F.lit(""))))

    match = (
        F.when(failed | F.col("manual_folder").isNull(), F.lit(""))
        .when(fold("manual_folder") == fold("suggested_folder"), F.lit("YES"))
        .otherwise(F.lit("NO"))
    )
    percent = F.format_string("%.0f%%", F.col("calibrated_confidence") * 100)
    return df.select(
        "file", F.coalesce("manual_folder", F.lit("")).alias("manual_folder"),
        F.when(failed, F.lit("ERROR")).otherwise(F.coalesce("suggested_folder", F.lit(""))).alias("predicted_folder"),
        F.when(failed, F.substring(F.coalesce("error", F.lit("no prediction")), 1, 120))
        .otherwise(F.coalesce("suggested_file_name", F.lit("")))
        .alias("predicted_file_name"),
        match.alias("match"),
        F.when(failed | F.col("calibrated_confidence").isNull(), F.lit("")).otherwise(percent).alias("confidence"),
        F.when(~failed & F.coalesce("force_manual_review", F.lit(False)), F.lit("YES"))
        .otherwise(F.lit(""))
        .alias("held_for_review"),
        F.coalesce("fax_line", F.lit("")).alias("fax_line"),
        shown(F.col("category")).alias("category"), shown(F.col("subtype")).alias("subtype"),
    )


def mapping_agreement(mapping: DataFrame) -> DataFrame:
    """Agreement over comparable rows, and how many were held, failed or lack a manual answer."""
    df = mapping.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("match").isin("YES", "NO")).alias("comparable"),
        F.count_if(F.col("match") == "YES").alias("agreed"),
        F.count_if(F.col("held_for_review") == "YES").alias("held"),
        F.count_if(F.col("predicted_folder") == "ERROR").alias("errors"),
        F.count_if(F.col("manual_folder") == "").alias("awaiting_input"),
    )
    df = df.withColumn("agreement_rate", ratio(F.col("agreed"), F.col("comparable")))
    return with_exact_round(df, 4, "agreement_rate")


def blind_rerun(expected: DataFrame, filed: DataFrame) -> DataFrame:
    """Folder and name matches of a rerun under neutral names.

    ``expected``: ``file``, ``filed_path`` (folder/name as filed by hand); ``filed``: ``file``,
    ``routed_folder``, ``routed_file_name``.
    """
    df = expected.join(filed, "file", "left")
    folder_ok = F.col("routed_folder").eqNullSafe(parent_path(F.col("filed_path")))
    name_ok = clerk_form(F.col("routed_file_name")) == clerk_form(base_name(F.col("filed_path")))
    return df.agg(
        F.count("*").alias("files"),
        F.count_if(folder_ok).alias("folder_matches"),
        F.count_if(name_ok).alias("name_matches"),
    )
