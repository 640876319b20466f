"""The working lists: inbox, review queue, due queue, latest decision, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import latest_by, top_per_group
from ..functions.text import blank_to_null, strip
from ..sources.dimensions import REVIEW_FOLDER

# Ledger states.
TERMINAL_STATES = ["FILED", "QUARANTINED", "SKIPPED_DUPLICATE"]
OPEN_STATES = ["DISCOVERED", "AWAITING_HYDRATION", "UNSTABLE", "INGESTED", "PROCESSING", "FAILED"]
WORKED_STATES = ["DISCOVERED", "FAILED", "AWAITING_HYDRATION", "UNSTABLE"]
MOST_ROWS = 1_000  # of a page
SETTLED_DOCUMENT_STATES = ["CLASSIFIED", "ROUTED", "ERRORED"]


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The newest decision of each document; equal times are settled by id."""
    return latest_by(decisions, ["doc_id"], ["decided_at", "id"])


def extracted_sender(meta: DataFrame) -> DataFrame:
    """Three sender fields from the extraction JSON and nothing else; bad JSON gives nulls."""
    shape = "senderOrganization string, senderFax string, destinationFax string"

    def clean(c: str) -> Column:
        text = strip(F.col(f"__core.{c}"))
        return F.when((text != "") & (F.lower(text) != "null"), text)

    return meta.withColumn("__core", F.from_json("core_json", shape)).select(
        "doc_id",
        clean("senderOrganization").alias("extracted_organization"),
        clean("senderFax").alias("extracted_fax"),
        clean("destinationFax").alias("extracted_destination_fax"),
    )


def _first_with_source(*candidates: tuple[Column, str]) -> tuple[Column, Column]:
    present = [(blank_to_null(c), label) for c, label in candidates]
    value = F.coalesce(*[c for c, _ in present])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(label)) for c, label in present], F.lit("NONE"))
    return value, source


def inbox_rows(docs: DataFrame, cls: DataFrame, decisions: DataFrame, meta: DataFrame) -> DataFrame:
    """One summary row per document, each sender value with the source it came from."""
    # only what the row shows travels through the aggregate
    shown = decisions.select(
        "id", "doc_id", "decided_at", "routing_status", "suggested_folder", "suggested_file_name"
    )
    last = latest_decision(shown).select(
        "doc_id", "routing_status", "suggested_folder",
        F.col("suggested_file_name").alias("__decided_name"),
    )
    cls = cls.select(
        "doc_id", "category", "subtype", "confidence_band", "calibrated_confidence",
        "force_manual_review", "sender_organization", "sender_callback_fax",
        F.col("suggested_file_name").alias("__suggested_name"), "alternate_file_name",
    )
    df = (
        docs.withColumnRenamed("id", "doc_id")
        .join(cls, "doc_id", "left")
        .join(last, "doc_id", "left")
        .join(extracted_sender(meta), "doc_id", "left")
    )
    org, org_source = _first_with_source(
        (F.col("extracted_organization"), "EXTRACTION"), (F.col("sender_organization"), "DOCUMENT")
    )
    fax, fax_source = _first_with_source(
        (F.col("extracted_fax"), "EXTRACTION"),
        (F.col("sender_callback_fax"), "DOCUMENT"),
        (F.col("sender_fax_number"), "FILENAME"),
    )
    dest, dest_source = _first_with_source((F.col("extracted_destination_fax"), "EXTRACTION"))
    held = (
        F.coalesce("force_manual_review", F.lit(False))
        | F.coalesce(F.col("routing_status") == "MANUAL_REVIEW", F.lit(False))
        | F.coalesce(F.col("confidence_band") == "LOW", F.lit(False))
    )
    state = (
        F.when(
            (F.col("processing_status") == "ERRORED") | (F.col("routing_status") == "FAILED"),
            F.lit("crit"),
        )
        .when(held, F.lit("warn"))
        .when(~F.col("processing_status").isin(*SETTLED_DOCUMENT_STATES), F.lit("busy"))
        .when(F.col("processing_status") == "ROUTED", F.lit("ok"))
        .otherwise(F.lit(""))
    )
    return df.select(
        "doc_id", "tracking_id", "original_file_name", "processing_status", "created_at",
        "category", "subtype", "confidence_band", "calibrated_confidence", "force_manual_review",
        org.alias("sender_organization"), org_source.alias("sender_organization_source"),
        fax.alias("sender_fax_number"), fax_source.alias("sender_fax_number_source"),
        dest.alias("destination_fax"), dest_source.alias("destination_fax_source"),
        "suggested_folder", "routing_status",
        F.coalesce("__decided_name", "__suggested_name").alias("suggested_file_name"),
        "alternate_file_name", state.alias("row_state"),
    )


def inbox_page(
    docs: DataFrame, cls: DataFrame, decisions: DataFrame, meta: DataFrame, size: int = 20,
    after: tuple[str, int] | None = None, **filters: str | None,
) -> DataFrame:
    """One page of the inbox in full, newest first, and only what the page shows is joined.

    ``after`` is time and id of the last row of the page before, so a later page costs no more than the
    first.  The ids of the page, at most ``size`` and bounded by ``MOST_ROWS``, are read first; as
    literals they reach the scans of all four tables, instead of joining whole tables for a few rows.
    """
    df = _matching(docs, cls, **filters)
    if after is not None:
        time, last = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1]).cast("long")
        df = df.filter((F.col("created_at") < time) | ((F.col("created_at") == time) & (F.col("id") < last)))
    top = df.select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(min(size, MOST_ROWS))
    ids = [r["id"] for r in top.collect()]

    def shown(table: DataFrame, key: str) -> DataFrame:
        return table.filter(F.col(key).isin(ids) if ids else F.lit(False))

    rows = inbox_rows(shown(docs, "id"), shown(cls, "doc_id"), shown(decisions, "doc_id"), shown(meta, "doc_id"))
    return rows.orderBy(F.desc("created_at"), F.desc("doc_id"))


def inbox_search(
    docs: DataFrame, cls: DataFrame, status: str | None = None, category: str | None = None,
    q: str | None = None, date_from: str | None = None, date_to: str | None = None,
    page: int = 0, size: int = 20,
) -> DataFrame:
    """One page of documents, newest first; every filter is optional."""
    df = _matching(docs, cls, status, category, q, date_from, date_to)
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset(page * size).limit(size)


def _matching(
    docs: DataFrame, cls: DataFrame, status: str | None = None, category: str | None = None,
    q: str | None = None, date_from: str | None = None, date_to: str | None = None,
) -> DataFrame:
    """Documents with their category that pass all filters given."""
    df = docs
    if status and status.strip():
        df = df.filter(F.col("processing_status") == status.upper())
    if q and q.strip():
        df = df.filter(F.contains(F.lower("original_file_name"), F.lit(q.lower())))
    if date_from and date_from.strip():
        df = df.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to and date_to.strip():
        df = df.filter(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    side = cls.select(F.col("doc_id").alias("id"), "category")
    if category and category.strip():
        df = df.join(side.filter(F.col("category") == category), "id")
    else:
        df = df.join(side, "id", "left")
    return df


def review_queue(
    docs: DataFrame, cls: DataFrame, decisions: DataFrame, manual_folder: str = REVIEW_FOLDER
) -> DataFrame:
    """Documents a person still has to look at, with the reasons."""
    waiting = docs.filter(F.col("processing_status").isin("CLASSIFIED", "ROUTED")).select(
        F.col("id").alias("doc_id"), "tracking_id", "processing_status"
    )
    last = latest_decision(
        decisions.select("id", "doc_id", "decided_at", "routing_status", "final_folder")
    ).drop("id", "decided_at")
    df = waiting.join(cls.select("doc_id", "confidence_band", "force_manual_review"), "doc_id", "left")
    df = df.join(last, "doc_id", "left")
    in_manual = F.col("final_folder").eqNullSafe(manual_folder)
    df = df.withColumns(
        {
            "low_band": F.col("confidence_band").eqNullSafe("LOW"),
            "forced": F.coalesce("force_manual_review", F.lit(False)),
            "manual_status": F.col("routing_status").eqNullSafe("MANUAL_REVIEW"),
            "sent_to_manual": in_manual,
        }
    )
    elsewhere = F.coalesce(F.col("routing_status").isin("CONFIRMED", "OVERRIDDEN"), F.lit(False)) & ~in_manual
    wanted = F.col("low_band") | F.col("forced") | F.col("manual_status") | F.col("sent_to_manual")
    return df.filter(wanted & ~elsewhere).select(
        "doc_id", "tracking_id", "processing_status", "low_band", "forced", "manual_status", "sent_to_manual"
    )


def due_queue(ledger: DataFrame, now: str, limit: int | None = None) -> DataFrame:
    """All scanner rows ready for another attempt, oldest first; at most ``limit`` if one is given."""
    due = ledger.filter(
        (F.col("origin") == "SCANNER")
        & F.col("state").isin(*WORKED_STATES)
        & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(now).cast("timestamp_ntz")))
    ).orderBy("first_seen_at", "content_sha256")
    return due if limit is None else due.limit(limit)


def recent(ledger: DataFrame, state: str | None = None, k: int = 25) -> DataFrame:
    """The rows seen last, or every row of one state, oldest first."""
    if state and state.strip():
        return ledger.filter(F.col("state") == state.upper()).orderBy("first_seen_at", "content_sha256")
    return ledger.orderBy(F.desc("last_seen_at"), "content_sha256").limit(k)


def top_files(files: DataFrame, k: int = 500) -> DataFrame:
    """The newest ``k`` files of each folder and whether the folder holds more."""
    sizes = files.groupBy("folder").agg(F.count("*").alias("file_count"))
    best = top_per_group(
        files, ["folder"], [F.desc("modified_at"), F.col("path")], k, F.col("path")
    )
    return best.join(sizes, "folder").withColumn("truncated", F.col("file_count") > k)
