"""Streaming queries: the input arrives in two instalments, the stream runs after each.

The result table must equal what the batch job says about all rows together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cost
from ..session import stream_session, work_dir
from ..sources.files import inbound_manifest
from ..streaming import jobs
from .catalog import SQL_PRICE, TEST_PRICES, Get, query
from .catalog_operations import SQL_READY, SQL_ROUTE

HALF = "2024-01-16"


def _arrive(
    parts: list[DataFrame], label: str, start: Callable[[DataFrame, str, str], StreamingQuery]
) -> tuple[SparkSession, str]:
    """Write each part to an intake folder and run the stream over what is new."""
    spark = parts[0].sparkSession
    streams = stream_session(spark)
    root = work_dir(spark, label)
    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(f"{root}/in")
        stream = streams.readStream.schema(part.schema).parquet(f"{root}/in")
        start(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark, f"{root}/out"


def _by_time(df: DataFrame, col: str = "ts") -> list[DataFrame]:
    early = F.col(col) < F.lit(HALF).cast("timestamp_ntz")
    return [df.filter(early), df.filter(~early)]


def _by_number(df: DataFrame, col: str) -> list[DataFrame]:
    return [df.filter(F.col(col) % 2 == 0), df.filter(F.col(col) % 2 != 0)]


@query("st_ingest", """
SELECT content_sha256, 'DISCOVERED' AS state, 'SCANNER' AS origin, count(*) AS claims FROM (SELECT DISTINCT content_sha256 FROM @v_manifest) GROUP BY 1""")
def _(v: Get) -> DataFrame:
    rows = v("v_manifest").withColumn("day", F.dayofmonth("seen_at"))
    spark, table = _arrive(_by_number(rows, "day"), "ingest", lambda s, t, c: jobs.ingest_stream(s.drop("day"), t, c))
    return jobs.ledger_rows(spark, table, rows.drop("day")).groupBy("content_sha256", "state", "origin").agg(F.count("*").alias("claims"))


SQL_FILES = """
SELECT file_no, sha256(string_agg(concat(doc_id, ',', n_chars, ',', md5(coalesce(text, ''))), chr(10) ORDER BY doc_id) || chr(10)) AS content_sha256,
 CAST(sum(length(concat(doc_id, ',', n_chars, ',', md5(coalesce(text, '')))) + 1) AS BIGINT) AS size_bytes FROM (SELECT *, CAST(floor(doc_id / 25) AS BIGINT) AS file_no FROM @documents) GROUP BY file_no"""


def _as_files(docs: DataFrame, root: str) -> None:
    """Twenty-five documents to a file, as files of an intake tree with the ending of an accepted type."""
    rows = docs.select(F.floor(F.col("doc_id") / 25).cast("long").alias("file_no"), "doc_id", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    rows = rows.repartition("file_no").sortWithinPartitions("file_no", "doc_id")
    rows.write.mode("append").partitionBy("file_no").option("extension", "pdf").csv(root)


@query("src_inbound_files", f"SELECT file_no, content_sha256, size_bytes AS source_size_bytes, 1 AS depth FROM ({SQL_FILES})")
def _(v: Get) -> DataFrame:
    """The manifest of real files, listed and read by the file source."""
    docs = v("documents")
    root = work_dir(docs.sparkSession, "files")
    _as_files(docs, root)
    found = inbound_manifest(docs.sparkSession, root)
    number = F.regexp_extract("relative_path", r"file_no=(\d+)/", 1).cast("long")
    return found.select(number.alias("file_no"), "content_sha256", "source_size_bytes", (F.size(F.split("relative_path", "/")) - 1).alias("depth"))


@query("st_ingest_files", f"SELECT content_sha256, min(size_bytes) AS size_bytes, count(DISTINCT content_sha256) AS claims FROM ({SQL_FILES}) GROUP BY 1")
def _(v: Get) -> DataFrame:
    """Real files in two instalments, the second with all files of the first under other names; the stream reads them as they come."""
    docs = v("documents")
    streams = stream_session(docs.sparkSession)
    root = work_dir(streams, "ingest-files")
    for part in (docs.filter(F.floor(F.col("doc_id") / 25) % 2 == 0), docs):
        _as_files(part, f"{root}/in")
        files = jobs.intake_files(streams, f"{root}/in")
        jobs.ingest_stream(files, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    rows = jobs.ledger_rows(docs.sparkSession, f"{root}/out", inbound_manifest(docs.sparkSession, f"{root}/in").withColumn("seen_at", F.current_timestamp().cast("timestamp_ntz")))
    return rows.groupBy("content_sha256").agg(F.min("source_size_bytes").alias("size_bytes"), F.count("*").alias("claims"))


@query("st_readiness", SQL_READY)
def _(v: Get) -> DataFrame:
    polls = v("v_event").select("event_id", "path", "ts", "size_bytes", "mtime_ms", "head_hex")
    ids = polls.select("event_id", "path", F.col("ts").cast("timestamp").alias("poll_ts"))
    spark, table = _arrive(
        _by_time(polls), "readiness",
        lambda s, t, c: jobs.readiness_stream(s.withColumnRenamed("ts", "poll_ts"), t, c),
    )
    judged = spark.read.parquet(table).select("path", "poll_ts", "readiness")
    return judged.join(ids, ["path", "poll_ts"]).select("event_id", "path", "readiness")


@query("st_ledger_state", """
SELECT content_sha256, CAST(CASE WHEN filed_at IS NOT NULL THEN before_filed ELSE fails END AS INT) AS attempts, CASE WHEN filed_at IS NOT NULL THEN 'FILED' WHEN last_kind = 'RETRY' THEN 'DISCOVERED' WHEN fails >= 3 THEN 'QUARANTINED' WHEN fails > 0 THEN 'FAILED' ELSE 'DISCOVERED' END AS state FROM (
SELECT content_sha256, min(ts) FILTER (WHERE kind = 'FILED') AS filed_at, max(last_kind) AS last_kind, max(fails) AS fails, max(before_filed) AS before_filed FROM (
 SELECT e.*, f.t AS f, last_value(CASE WHEN kind <> 'INGESTED' THEN kind END IGNORE NULLS) OVER (PARTITION BY e.content_sha256 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_kind,
  (SELECT count(*) FROM @v_event x WHERE x.content_sha256 = e.content_sha256 AND x.kind = 'FAILED' AND x.ts > coalesce((SELECT max(ts) FROM @v_event y WHERE y.content_sha256 = e.content_sha256 AND y.kind = 'RETRY'), TIMESTAMP '1970-01-01')) AS fails,
  (SELECT count(*) FROM @v_event x WHERE x.content_sha256 = e.content_sha256 AND x.kind = 'FAILED' AND x.ts < f.t AND x.ts > coalesce((SELECT max(ts) FROM @v_event y WHERE y.content_sha256 = e.content_sha256 AND y.kind = 'RETRY' AND y.ts < f.t), TIMESTAMP '1970-01-01')) AS before_filed
 FROM @v_event e LEFT JOIN (SELECT content_sha256, min(ts) AS t FROM @v_event WHERE kind = 'FILED' GROUP BY 1) f USING (content_sha256)) GROUP BY content_sha256)""")
def _(v: Get) -> DataFrame:
    ev = v("v_event").select("content_sha256", "event_id", F.col("ts").alias("at"), "kind")
    spark, table = _arrive(_by_time(ev, "at"), "ledger", lambda s, t, c: jobs.ledger_state_stream(s, t, c))
    return jobs.current_rows(spark, table, ["content_sha256"]).select("content_sha256", "attempts", "state")


@query("st_route", f"""
SELECT doc_id, category, coalesce(by_category, 'Manual-Review') AS suggested_folder, CASE WHEN coalesce(force_manual_review, false) OR coalesce(category IN ('ROI_CONSENT', 'UNKNOWN'), false) OR NOT coalesce(calibrated_confidence >= 0.9, false) THEN 'MANUAL_REVIEW' ELSE 'SUGGESTED' END AS routing_status FROM ({SQL_ROUTE})""")
def _(v: Get) -> DataFrame:
    scored = v("v_scored").select("doc_id", "category", "subtype", "sender_fax", "calibrated_confidence", "confidence_band", "force_manual_review")
    spark, table = _arrive(_by_number(scored, "doc_id"), "route", lambda s, t, c: jobs.route_stream(s, t, c))
    return spark.read.parquet(table).select("doc_id", "category", "suggested_folder", "routing_status")


@query("st_dashboard", """
SELECT state AS status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS rn FROM @v_event) WHERE rn = 1 GROUP BY state""")
def _(v: Get) -> DataFrame:
    ev = v("v_event").select("doc_id", F.col("state").alias("status"), "event_id", F.col("ts").alias("at"))
    spark, table = _arrive(_by_time(ev, "at"), "dashboard", lambda s, t, c: jobs.dashboard_stream(s, t, c))
    return jobs.dashboard_counts(spark, table)


@query("st_usage", f"""
SELECT tracking_id, stage, count(*) AS lines, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 CASE WHEN count(*) FILTER (WHERE model = 'other') = 0 THEN CAST(CAST(sum(CAST(({SQL_PRICE}) / 1000000 AS DECIMAL(24,10))) AS DECIMAL(34,10)) AS VARCHAR) END AS cost FROM @v_usage GROUP BY 1, 2""")
def _(v: Get) -> DataFrame:
    """The second instalment sends every line of the first again."""
    lines = cost.price_calls(v("v_usage"), TEST_PRICES)
    spark, table = _arrive([lines.filter("call_no % 2 = 0"), lines], "usage", lambda s, t, c: jobs.usage_stream(s, t, c))
    df = jobs.usage_totals(spark, table, lines)
    return df.select("tracking_id", "stage", "lines", "input_tokens", "output_tokens", F.col("cost_usd").cast("string").alias("cost"))


@query("st_upsert", "SELECT doc_id, seq, verdict FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY given_at DESC, seq DESC) AS rn FROM @v_feedback) WHERE rn = 1")
def _(v: Get) -> DataFrame:
    fb = v("v_feedback").select("doc_id", "seq", "verdict", "given_at")
    order = ["given_at", "seq"]
    spark, table = _arrive(_by_number(fb, "seq"), "upsert", lambda s, t, c: jobs.upsert_stream(s, t, c, "doc_id", order))
    return jobs.upserted(spark, table, "doc_id", order).select("doc_id", "seq", "verdict")


@query("st_throughput", """
SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS interval_start, count(*) FILTER (WHERE state = 'FILED') AS filed, count(*) FILTER (WHERE state = 'UNSTABLE') AS held, count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) AS events FROM @v_event GROUP BY 1""")
def _(v: Get) -> DataFrame:
    ev = v("v_event").select("event_id", "ts", "state")
    spark, table = _arrive(_by_time(ev), "throughput", lambda s, t, c: jobs.throughput_stream(s, t, c, "6 hours", "1 hour"))
    df = jobs.current_rows(spark, table, ["interval_start"])
    return df.withColumn("interval_start", F.date_format("interval_start", "yyyy-MM-dd HH:mm:ss"))
