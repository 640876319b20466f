"""Intake by content: readiness, gate, claims, duplicates, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import time_slice, with_previous, with_running

from .inbox import TERMINAL_STATES

# Leading bytes of the accepted types, and the limits of the document gate.
MAGIC = {
    "25504446": "application/pdf", "89504E47": "image/png", "FFD8FF": "image/jpeg",
    "49492A00": "image/tiff", "4D4D002A": "image/tiff",
}
ACCEPTED_EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "tif", "tiff"]
MAX_BYTES = 25 * 1024 * 1024
MAX_PAGES = 50
BLANK_VARIANCE = 25.0
MIN_STABLE_MS = 10_000
RETRY_BASE_MS = 60_000
MAX_ATTEMPTS = 3


def _mime(head_hex):
    found = F.lit(None).cast("string")
    for magic, mime in MAGIC.items():
        found = F.when(head_hex.startswith(magic), F.lit(mime)).otherwise(found)
    return found


def document_gate(manifest: DataFrame) -> DataFrame:
    """Admission checks in order, first failure wins.

    Needs ``file_name``, ``size_bytes``, ``head_hex``, ``pages``, ``page_variance`` and the
    flags ``opens`` and ``renders``; adds ``valid``, ``reason``, ``mime_type``, ``page_count``.
    """
    ext = F.when(
        F.contains("file_name", F.lit(".")), F.lower(F.substring_index("file_name", ".", -1))
    ).otherwise(F.lit(""))
    df = manifest.withColumns({"__ext": ext, "mime_type": _mime(F.upper("head_hex"))})
    pdf = F.col("mime_type") == "application/pdf"
    reason = (
        F.when(~F.col("__ext").isin(*ACCEPTED_EXTENSIONS), F.concat(F.lit("UNSUPPORTED_EXTENSION:"), "__ext"))
        .when(F.col("size_bytes") > MAX_BYTES, F.concat(F.lit("FILE_TOO_LARGE:"), F.col("size_bytes").cast("string"), F.lit("_bytes")))
        .when(F.col("mime_type").isNull(), F.lit("UNSUPPORTED_MIME:application/octet-stream"))
        .when(pdf & ~F.coalesce("opens", F.lit(True)), F.lit("PDF_CANNOT_OPEN"))
        .when(pdf & (F.col("pages") == 0), F.lit("PDF_NO_PAGES"))
        .when(pdf & (F.col("pages") > MAX_PAGES), F.concat(F.lit("PDF_TOO_MANY_PAGES:"), F.col("pages").cast("string")))
        .when(pdf & ~F.coalesce("renders", F.lit(True)), F.lit("PAGE_RENDER_FAILED"))
        .when(pdf & (F.col("page_variance") < BLANK_VARIANCE), F.lit("FIRST_PAGE_BLANK"))
    )
    df = df.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return df.withColumns(
        {
            "valid": ok,
            "page_count": F.when(ok, F.when(pdf, F.col("pages")).otherwise(F.lit(1))),
            "mime_type": F.when(ok, F.col("mime_type")),
        }
    ).drop("__ext")


def gate_reasons(gated: DataFrame) -> DataFrame:
    """How many documents each reason stopped."""
    code = F.coalesce(F.substring_index("reason", ":", 1), F.lit("OK"))
    return gated.groupBy(code.alias("reason_code")).agg(F.count("*").alias("n"))


def readiness(observations: DataFrame, min_stable_ms: int = MIN_STABLE_MS) -> DataFrame:
    """Readiness of a path at each poll, compared with the poll before.

    Needs ``path``, ``poll_ts``, ``size_bytes`` (null when the file vanished), ``mtime_ms`` and
    ``head_hex``; adds ``readiness``.
    """
    df = with_previous(
        observations, ["path"], time_slice(F.col("poll_ts")), ["poll_ts"],
        {"previous_size": "size_bytes", "previous_mtime": "mtime_ms"},
    )
    return df.withColumn("readiness", readiness_rule(min_stable_ms)).drop("previous_size", "previous_mtime")


def readiness_rule(min_stable_ms: int = MIN_STABLE_MS):
    """The readiness decision given ``previous_size`` and ``previous_mtime``."""
    known = F.col("previous_size").isNotNull() & F.col("previous_mtime").isNotNull()
    age = F.unix_millis(F.col("poll_ts").cast("timestamp")) - F.col("mtime_ms")
    changed = (F.col("previous_size") != F.col("size_bytes")) | (F.col("previous_mtime") != F.col("mtime_ms"))
    head = F.upper(F.coalesce("head_hex", F.lit("")))
    return (
        F.when(F.col("size_bytes").isNull(), F.lit("UNSTABLE"))
        .when(F.col("size_bytes") == 0, F.lit("AWAITING_HYDRATION"))
        .when(known & changed, F.lit("UNSTABLE"))
        .when(~known & (age < min_stable_ms), F.lit("UNSTABLE"))
        .when(F.length(head) < 8, F.lit("AWAITING_HYDRATION"))
        .when(_mime(head).isNull(), F.lit("UNSUPPORTED"))
        .otherwise(F.lit("READY"))
    )


def first_sightings(manifest: DataFrame) -> DataFrame:
    """One row per content hash: who saw it first, and how often it came again.

    Copies are combined before the shuffle, so content that makes up much of the intake is
    one row per task on the wire.
    """
    rest = [c for c in manifest.columns if c != "content_sha256"]
    return (
        manifest.groupBy("content_sha256")
        .agg(
            F.min_by(F.struct(*rest), F.struct("seen_at", "source_path")).alias("__first"),
            F.count("*").alias("sightings"),
        )
        .select("content_sha256", "__first.*", (F.col("sightings") - 1).alias("later_sightings"))
    )


def claim(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each content hash once, CLAIMED if the ledger never had it, KNOWN otherwise."""
    known = ledger.select("content_sha256").distinct().withColumn("__known", F.lit(True))
    return (
        first_sightings(manifest)
        .join(known, "content_sha256", "left")
        .withColumn("outcome", F.when(F.col("__known"), F.lit("KNOWN")).otherwise(F.lit("CLAIMED")))
        .drop("__known")
    )


def new_claims(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Only the hashes not yet in the ledger."""
    return first_sightings(manifest).join(ledger.select("content_sha256"), "content_sha256", "left_anti")


def duplicates(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """For content the ledger already has: where the earlier copy went, once per hash."""
    again = manifest.groupBy("content_sha256").agg(
        F.min("source_path").alias("source_path"), F.count("*").alias("files")
    )
    earlier = ledger.select("content_sha256", "state", "routed_folder", "routed_file_name")
    filed = F.col("routed_folder").isNotNull() & F.col("routed_file_name").isNotNull()
    return again.join(earlier, "content_sha256").select(
        "content_sha256", "source_path", "files", "state",
        F.when(F.col("state").isin(*TERMINAL_STATES), F.lit("DUPLICATE"))
        .otherwise(F.lit("IN_PROGRESS"))
        .alias("verdict"),
        F.when(filed, F.concat(F.lit("already filed as "), "routed_folder", F.lit("/"), "routed_file_name"))
        .when(F.col("state").isin(*TERMINAL_STATES), F.lit("already received earlier"))
        .otherwise(F.concat(F.lit("already received and currently "), "state"))
        .alias("detail"),
    )


def retry_schedule(
    events: DataFrame, base_ms: int = RETRY_BASE_MS, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Attempt number, state and next attempt after each failure, retry, ingestion or filing event.

    Needs ``content_sha256``, ``event_id``, ``at`` and ``kind`` (FAILED, RETRY, INGESTED, FILED).  A retry
    starts the count again and is refused once the row is filed.
    """
    failed, filed = F.col("kind") == "FAILED", F.col("kind") == "FILED"
    key, order = ["content_sha256"], ["at", "event_id"]
    df = with_running(
        events, key, time_slice(F.col("at"), 86_400), order,
        totals={"__failures": F.when(failed, 1).otherwise(0)},
        maxima={"__filed": F.when(filed, 1).otherwise(0)},
    )
    retry = (F.col("kind") == "RETRY") & (F.col("__filed") == 0)
    df = df.withColumn("__reset", F.when(retry, F.col("__failures")).otherwise(F.lit(0)))
    df = with_running(
        df, key, time_slice(F.col("at"), 86_400), order, maxima={"__base": F.col("__reset")}
    )
    df = df.withColumn("attempt", (F.col("__failures") - F.col("__base")).cast("int"))
    quarantined = failed & (F.col("attempt") >= max_attempts)
    wait = F.lit(base_ms) * F.pow(F.lit(2.0), F.col("attempt") - 1)
    return df.select(
        *events.columns, "attempt",
        F.when(F.col("__filed") == 1, F.when(F.col("kind") == "RETRY", F.lit("RETRY_REFUSED")).otherwise(F.lit("FILED")))
        .when(quarantined, F.lit("QUARANTINED"))
        .when(failed, F.lit("FAILED"))
        .when(F.col("kind") == "INGESTED", F.lit("INGESTED"))
        .otherwise(F.lit("DISCOVERED"))
        .alias("state"),
        F.when(
            failed & ~quarantined & (F.col("__filed") == 0),
            (F.unix_millis(F.col("at").cast("timestamp")) + wait).cast("long"),
        ).alias("next_attempt_ms"),
    )


def ledger_status(ledger: DataFrame) -> DataFrame:
    """Rows per state, plus backlog, filed and quarantined totals."""
    by_state = ledger.groupBy("state").agg(F.count("*").alias("n"))
    open_row = ~F.col("state").isin(*TERMINAL_STATES)
    def figure(metric: str, key, n):
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"), n.alias("n"))

    def only(condition):
        return F.when(condition, F.col("n")).otherwise(F.lit(0).cast("long"))

    shown = F.array(
        figure("state", F.col("state"), F.col("n")),
        figure("backlog", F.lit("all"), only(open_row)),
        figure("filed", F.lit("all"), only(F.col("state") == "FILED")),
        figure("quarantined", F.lit("all"), only(F.col("state") == "QUARANTINED")),
    )
    return by_state.select(F.inline(shown)).groupBy("metric", "key").agg(F.sum("n").alias("n"))


def scan_cycles(events: DataFrame) -> DataFrame:
    """Per poll cycle what was seen and done, with a note that tells silence from idleness.

    Needs ``cycle`` and ``outcome`` (CLAIMED, KNOWN, NOT_READY, INGESTED, DEFERRED, FAILED).
    """
    def count(name: str):
        return F.count_if(F.col("outcome") == name)

    df = events.groupBy("cycle").agg(
        F.count_if(F.col("outcome").isin("CLAIMED", "KNOWN", "NOT_READY")).alias("candidates"),
        count("CLAIMED").alias("claimed"), count("KNOWN").alias("known"),
        count("NOT_READY").alias("not_ready"), count("INGESTED").alias("ingested"),
        count("DEFERRED").alias("deferred"), count("FAILED").alias("failed"),
    )
    idle = (F.col("candidates") > 0) & (F.col("claimed") == 0) & (F.col("ingested") == 0)
    return df.withColumn(
        "note",
        F.when(
            idle,
            F.concat(
                F.lit("ok: nothing new ("), F.col("known").cast("string"), F.lit(" already known, "),
                F.col("not_ready").cast("string"), F.lit(" not ready, of "),
                F.col("candidates").cast("string"), F.lit(" seen)"),
            ),
        ).otherwise(F.lit("ok")),
    )


def throughput(events: DataFrame, interval: str = "15 seconds") -> DataFrame:
    """Documents filed, held and failed per interval of event time."""
    return (
        events.groupBy(F.window("ts", interval).alias("w"))
        .agg(
            F.count_if(F.col("state") == "FILED").alias("filed"),
            F.count_if(F.col("state").isin("UNSTABLE", "AWAITING_HYDRATION")).alias("held"),
            F.count_if(F.col("state").isin("FAILED", "QUARANTINED")).alias("failed"),
            F.count("*").alias("events"),
        )
        .select(F.col("w.start").alias("interval_start"), "filed", "held", "failed", "events")
    )
