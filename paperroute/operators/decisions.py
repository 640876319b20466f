"""What people decide: confirmations, feedback, reruns, override signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import as_of, latest_by
from ..functions.numeric import ratio, with_exact_round
from ..functions.text import ILLEGAL_IN_NAME, blank_to_null, strip
from .inbox import latest_decision

FINAL = ["CONFIRMED", "OVERRIDDEN"]
MAX_NAME = 120


def _clean_name(requested, original):
    """A typed name made safe: no illegal characters, no leading dots, original extension."""
    s = strip(F.regexp_replace(requested, ILLEGAL_IN_NAME, ""))
    s = strip(F.regexp_replace(s, r"^\.+", ""))
    s = strip(F.substring(s, 1, MAX_NAME))
    suffix = F.lower(F.regexp_extract(original, r"^.+(\.[^.]*)$", 1))
    bare = (s != "") & ~F.contains(s, F.lit("."))
    return F.when(bare, F.concat(s, F.coalesce(suffix, F.lit("")))).otherwise(s)


def apply_confirmations(confirms: DataFrame, decisions: DataFrame, docs: DataFrame) -> DataFrame:
    """Every confirmation request with its outcome.

    ``confirms``: ``confirm_id``, ``doc_id``, ``confirmed_at``, ``folder``, ``file_name``,
    ``override_reason``, ``decided_by``.  ``status_code`` is 200, 400, 404 or 409; of several
    requests for one document the first acceptable one settles it.
    """
    last = latest_decision(
        decisions.select("id", "doc_id", "decided_at", "routing_status", "suggested_folder", "suggested_file_name")
    ).drop("decided_at").withColumnRenamed("id", "decision_id")
    names = docs.select(F.col("id").alias("doc_id"), "original_file_name")
    df = confirms.join(names, "doc_id", "left").join(last, "doc_id", "left")
    df = df.withColumn("__suggested", F.coalesce("suggested_file_name", "original_file_name"))
    typed = blank_to_null(F.col("file_name"))
    df = df.withColumn(
        "final_file_name",
        F.when(typed.isNotNull(), _clean_name(typed, F.col("original_file_name"))).otherwise(F.col("__suggested")),
    )
    df = df.withColumns(
        {
            "folder_override": ~F.col("folder").eqNullSafe(F.col("suggested_folder")),
            "name_override": ~F.col("final_file_name").eqNullSafe(F.col("__suggested")),
        }
    )
    override = F.col("folder_override") | F.col("name_override")
    df = df.withColumn(
        "__code",
        F.when(F.col("original_file_name").isNull(), 404)
        .when(F.col("decision_id").isNull() | F.col("routing_status").isin(*FINAL), 409)
        .when(blank_to_null(F.col("folder")).isNull(), 400)
        .when(F.col("final_file_name") == "", 400)
        .when(override & blank_to_null(F.col("override_reason")).isNull(), 400)
        .otherwise(200),
    )
    # the first acceptable request of each document, then anything after it is too late
    winner = (
        df.filter(F.col("__code") == 200)
        .groupBy("doc_id")
        .agg(F.min(F.struct("confirmed_at", "confirm_id")).alias("__won"))
    )
    df = df.join(winner, "doc_id", "left")
    mine = F.struct("confirmed_at", "confirm_id")
    code = F.when(F.col("__won").isNotNull() & (mine > F.col("__won")) & (F.col("__code") != 404), 409).otherwise(
        F.col("__code")
    )
    df = df.withColumn("status_code", code)
    ok = F.col("status_code") == 200
    return df.select(
        "confirm_id", "doc_id", "decision_id", "status_code",
        F.when(ok, F.when(override, F.lit("OVERRIDDEN")).otherwise(F.lit("CONFIRMED"))).alias("routing_status"),
        F.when(ok, F.col("folder")).alias("final_folder"),
        F.when(ok, F.col("final_file_name")).alias("final_file_name"),
        F.when(ok, F.col("folder_override")).alias("folder_override"),
        F.when(ok, F.col("name_override")).alias("name_override"),
        F.when(ok, F.coalesce("decided_by", F.lit("MANUAL"))).alias("decided_by"),
        F.when(ok & override, F.col("override_reason")).alias("override_reason"),
    )


def judge_feedback(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Feedback with its verdict cleaned and ``rejected`` set where it cannot be taken."""
    verdict = F.upper(strip(F.coalesce("verdict", F.lit(""))))
    summary = blank_to_null(F.col("summary"))
    known = docs.select(F.col("id").alias("doc_id")).distinct().withColumn("__known", F.lit(True))
    df = events.withColumns({"verdict": verdict, "summary": strip(summary)}).join(known, "doc_id", "left")
    rejected = (
        F.when(~F.col("verdict").isin("UP", "DOWN"), F.lit("VERDICT"))
        .when((F.col("verdict") == "DOWN") & F.col("summary").isNull(), F.lit("SUMMARY_REQUIRED"))
        .when(F.col("__known").isNull(), F.lit("NO_DOCUMENT"))
    )
    return df.withColumns(
        {"rejected": rejected, "summary": F.when(F.col("verdict") == "DOWN", F.col("summary"))}
    ).drop("__known")


def apply_feedback(events: DataFrame, docs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Current feedback, one row per document, and the rejected events."""
    judged = judge_feedback(events, docs)
    current = latest_by(judged.filter(F.col("rejected").isNull()).drop("rejected"), ["doc_id"], order)
    return current, judged.filter(F.col("rejected").isNotNull())


def feedback_snapshot(feedback: DataFrame, cls: DataFrame, decisions: DataFrame) -> DataFrame:
    """Feedback with the classification and decision as they stood when it was given.

    ``cls`` is the history of classifications with ``classified_at``.
    """
    fb = as_of(
        feedback, cls.select("doc_id", "classified_at", "category", "subtype", "calibrated_confidence"),
        ["doc_id"], "given_at", "classified_at", ["category"], payload="__cls",
    )
    fb = as_of(
        fb,
        decisions.select(
            "doc_id", "decided_at", "id",
            F.coalesce("final_folder", "suggested_folder").alias("folder"),
            F.coalesce("final_file_name", "suggested_file_name").alias("file_name"),
        ),
        ["doc_id"], "given_at", "decided_at", ["id"], payload="__dec",
    )
    return fb.select(
        *feedback.columns,
        F.col("__cls.category").alias("ai_category"),
        F.col("__cls.subtype").alias("ai_subtype"),
        F.col("__cls.calibrated_confidence").alias("ai_confidence"),
        F.col("__dec.folder").alias("ai_folder"),
        F.col("__dec.file_name").alias("ai_file_name"),
    )


def feedback_counts(feedback: DataFrame, verdict: str | None = None) -> DataFrame:
    """Total under the filter; thumbs up and down over everything."""
    chosen = F.lit(True) if not (verdict and verdict.strip()) else F.col("verdict") == verdict.strip().upper()
    return feedback.agg(
        F.count_if(chosen).alias("total"),
        F.count_if(F.col("verdict") == "UP").alias("up_count"),
        F.count_if(F.col("verdict") == "DOWN").alias("down_count"),
    )


def judge_reclassify(requests: DataFrame, docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rerun requests with ``accepted``: refused once the latest decision is final."""
    last = latest_decision(decisions.select("id", "doc_id", "decided_at", "routing_status"))
    known = docs.select(F.col("id").alias("doc_id"), "tracking_id")
    return (
        requests.select("doc_id").distinct()
        .join(known, "doc_id")
        .join(last.select("doc_id", "routing_status"), "doc_id", "left")
        .withColumn("accepted", ~F.coalesce(F.col("routing_status").isin(*FINAL), F.lit(False)))
    )


def apply_reclassify(
    requests: DataFrame, docs: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Documents and decisions after the accepted reruns: status back to RECEIVED, open decisions gone."""
    accepted = judge_reclassify(requests, docs, decisions).filter("accepted").select("doc_id")
    marked = docs.join(
        accepted.select(F.col("doc_id").alias("id"), F.lit(True).alias("__again")), "id", "left"
    )
    docs_out = marked.withColumns(
        {
            "processing_status": F.when(F.col("__again"), F.lit("RECEIVED")).otherwise(F.col("processing_status")),
            "error_reason": F.when(F.col("__again").isNull(), F.col("error_reason")),
        }
    ).select(*docs.columns)
    gone = decisions.join(accepted.withColumn("__again", F.lit(True)), "doc_id", "left")
    open_row = ~F.coalesce(F.col("routing_status").isin(*FINAL), F.lit(False))
    decisions_out = gone.filter(~(F.coalesce("__again", F.lit(False)) & open_row)).select(*decisions.columns)
    return docs_out, decisions_out


def override_signals(decisions: DataFrame, cls: DataFrame) -> DataFrame:
    """How often people change the folder and how often the name, by category and folder.

    All subtotals: a null category or folder with its ``all_`` flag set stands for every value.
    """
    folder = F.coalesce(~F.col("final_folder").eqNullSafe(F.col("suggested_folder")), F.lit(False))
    # counted per document and folder first, so a document decided very often joins as few rows
    counted = (
        decisions.filter(F.col("routing_status").isin(*FINAL))
        .groupBy("doc_id", "suggested_folder")
        .agg(
            F.count("*").alias("n"), F.count_if(folder).alias("f"),
            F.count_if(F.coalesce("file_name_overridden", F.lit(False))).alias("m"),
        )
    )
    fine = (
        counted.join(cls.select("doc_id", "category"), "doc_id", "left")
        .groupBy("category", "suggested_folder")
        .agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("m").alias("m"))
    )
    cube = fine.cube("category", "suggested_folder").agg(
        F.grouping("category").cast("int").alias("all_categories"),
        F.grouping("suggested_folder").cast("int").alias("all_folders"),
        F.sum("n").alias("decided"),
        F.sum("f").alias("folder_overrides"),
        F.sum("m").alias("name_overrides"),
    )
    cube = cube.withColumns(
        {
            "folder_override_rate": ratio(F.col("folder_overrides"), F.col("decided")),
            "name_override_rate": ratio(F.col("name_overrides"), F.col("decided")),
        }
    )
    return with_exact_round(cube, 4, "folder_override_rate", "name_override_rate")
