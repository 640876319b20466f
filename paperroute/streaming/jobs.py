"""The batch jobs on streams.

Every sink is a table folder with one sub-folder per micro-batch.  Writing a batch again after a
lost executor replaces its sub-folder, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.grouping import latest_by
from ..operators.ledger import MAX_ATTEMPTS, RETRY_BASE_MS, first_sightings, readiness_rule, throughput
from ..operators.routing import filing_outcome, route
from ..session import work_dir
from ..sources.dimensions import Policy
from ..sources.files import binary_reader, manifest_rows
from .claims import LOOKUPS, claim, claimed, shuffles_dropped, sliced, slices_for, spread
from .state import DAY_MS, LastSeen, LedgerRow, StatusMoves


def _write_batch(df: DataFrame, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def run_stream(
    stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None],
    mode: str = "append", trigger: dict | None = None,
) -> StreamingQuery:
    """Start a stream that hands each micro-batch to ``each_batch``."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each_batch)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def table_exists(spark: SparkSession, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


# ------------------------------------------------------------------ intake


def intake_files(spark: SparkSession, root: str, most_per_cycle: int | None = None) -> DataFrame:
    """Files of an intake tree as they arrive; all that are there, or at most so many, per cycle."""
    shape = "path string, modificationTime timestamp, length bigint, content binary"
    reader = binary_reader(spark.readStream).schema(shape)
    if most_per_cycle is not None:
        reader = reader.option("maxFilesPerTrigger", most_per_cycle)
    files = reader.load(root)
    return manifest_rows(files, root).withColumn("seen_at", F.current_timestamp().cast("timestamp_ntz"))


def ingest_stream(manifest: DataFrame, ledger: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Claim every content hash exactly once, whatever its file is called.

    Identity lives in a table (``claims``), not in stream state, so it neither grows the state nor
    is forgotten.  Only the hashes of the current batch are looked up, and only earlier batches count,
    so a replay claims the same rows again.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spread(batch, ledger)
        seen = first_sightings(batch).persist()
        claim(seen, ledger, batch_id, state=F.lit("DISCOVERED"), origin=F.lit("SCANNER"), attempts=F.lit(0))
        seen.unpersist()

    return run_stream(manifest, checkpoint, each, trigger=trigger or None)


def ledger_rows(spark: SparkSession, ledger: str, manifest: DataFrame) -> DataFrame:
    """The rows that a stream over such a manifest has claimed."""
    shape = first_sightings(manifest).withColumns({"state": F.lit(""), "origin": F.lit(""), "attempts": F.lit(0)}).schema
    return claimed(spark, ledger, shape)


# ------------------------------------------------------------------ readiness


def readiness_stream(observations: DataFrame, table: str, checkpoint: str, min_stable_ms: int = 10_000, timers: bool = False, **trigger) -> StreamingQuery:
    """Readiness of each polled path; the poll before may lie in an earlier micro-batch.

    ``timers`` lets the state of a path not seen for a day expire; it needs a trigger that keeps
    running, because a stream with timers has no last batch.
    """
    shape = "path string, poll_ts timestamp, size_bytes bigint, mtime_ms bigint, head_hex string"
    polls = observations.select(
        "path", F.col("poll_ts").cast("timestamp").alias("poll_ts"), "size_bytes", "mtime_ms", "head_hex"
    )
    paired = polls.groupBy("path").transformWithStateInPandas(
        statefulProcessor=LastSeen(DAY_MS if timers else None),
        outputStructType=shape + ", previous_size bigint, previous_mtime bigint",
        outputMode="append", timeMode="ProcessingTime" if timers else "None",
    )
    judged = paired.withColumn("readiness", readiness_rule(min_stable_ms))
    return run_stream(judged, checkpoint, lambda df, i: _write_batch(df, table, i), trigger=trigger or None)


# ------------------------------------------------------------------ ledger lifecycle


def ledger_state_stream(events: DataFrame, table: str, checkpoint: str, timers: bool = False, **trigger) -> StreamingQuery:
    """Current ledger rows from lifecycle events (FAILED, RETRY, FILED, others).

    With ``timers`` (and a trigger that keeps running) a row is sent again once its backoff is over.
    """
    rows = events.select(
        "content_sha256", "event_id", "kind", F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms")
    )
    folded = rows.groupBy("content_sha256").transformWithStateInPandas(
        statefulProcessor=LedgerRow(RETRY_BASE_MS, MAX_ATTEMPTS, timers),
        outputStructType="content_sha256 string, " + LedgerRow.shape,
        outputMode="update", timeMode="ProcessingTime" if timers else "None",
    )
    return run_stream(folded, checkpoint, lambda df, i: _write_batch(df, table, i), "update", trigger or None)


def current_rows(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The newest row per key of a table written batch by batch."""
    return latest_by(spark.read.parquet(table), keys, ["batch_id"]).drop("batch_id")


# ------------------------------------------------------------------ routing


def route_stream(scored: DataFrame, table: str, checkpoint: str, policy: Policy = Policy(), **trigger) -> StreamingQuery:
    """Classified documents routed as they land; rules are static and joined by broadcast."""
    routed = filing_outcome(route(scored, policy=policy), policy)
    return (
        routed.writeStream.format("parquet").outputMode("append")
        .option("path", table).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


# ------------------------------------------------------------------ live counts


def dashboard_stream(events: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Counts over the latest status of each document, kept as small deltas per batch."""
    rows = events.select(
        "doc_id", "status", "event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us")
    )
    moves = rows.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=StatusMoves(), outputStructType="status string, delta bigint",
        outputMode="update", timeMode="None",
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch.groupBy("status").agg(F.sum("delta").alias("delta")), table, batch_id)

    return run_stream(moves, checkpoint, each, "update", trigger or None)


def dashboard_counts(spark: SparkSession, table: str) -> DataFrame:
    counts = spark.read.parquet(table).groupBy("status").agg(F.sum("delta").alias("n"))
    return counts.filter(F.col("n") != 0)


# ------------------------------------------------------------------ usage


USAGE = ["tracking_id", "stage", "input_tokens", "output_tokens"]


def _line_time() -> Column:
    """What the key of a line begins with."""
    return F.concat(F.coalesce(F.col("used_at").cast("string"), F.lit("")), F.lit("|"))


def _usage_rows(lines: DataFrame) -> DataFrame:
    """One row per line with its key: its time, then 128 bits of a hash of all that it says."""
    digest = F.sha2(F.to_json(F.struct(*lines.columns)), 256).substr(1, 32)
    rows = lines.select(*USAGE, "cost_usd", F.concat(_line_time(), digest).alias("line"))
    # rows of one key say the same, so any of them will do
    rows = rows.groupBy("line").agg(F.first(F.struct(*USAGE, "cost_usd")).alias("__row")).select("line", "__row.*")
    return rows.withColumn("cost_usd", F.col("cost_usd").cast("decimal(24,10)"))


def usage_stream(lines: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Every usage line once, however often it is sent: lines of an earlier batch are left out.

    Lines are claimed in a table by time and call, so no state is kept in the stream, for open or closed
    documents, and a replay years later is still known.  A large batch is claimed in slices that take turns on the disk.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        # a digest lies behind "|" and before "|g"
        rows, *span = batch.agg(F.count("*"), F.min(_line_time()), F.max(F.concat(_line_time(), F.lit("g")))).first()
        slices = spread(batch, table, rows)
        for i in range(slices):
            part = sliced(batch, USAGE, i, slices)
            claim(_usage_rows(part), table, batch_id, "line", span=tuple(span) if rows > LOOKUPS else None, by=USAGE, part=(i, slices))

    return run_stream(lines, checkpoint, each, trigger=trigger or None)


def usage_totals(spark: SparkSession, table: str, lines: DataFrame) -> DataFrame:
    """Token and cost totals per document and stage of such a stream; a null total has an unpriced call.

    Those of a large table are written to a working folder, slice by slice.
    """
    keys = ["tracking_id", "stage"]
    rows = claimed(spark, table, _usage_rows(lines).schema)

    def totals(part: DataFrame) -> DataFrame:
        sums = part.groupBy(*keys).agg(
            F.count("*").alias("lines"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
            F.sum("cost_usd").alias("__cost"), F.count_if(F.col("cost_usd").isNull()).alias("__unpriced"),
        )
        return sums.select(*keys, "lines", "input_tokens", "output_tokens", F.when(F.col("__unpriced") == 0, F.col("__cost")).alias("cost_usd"))

    slices = slices_for(rows.count())
    if slices == 1:
        return totals(rows)
    path = work_dir(spark, "usage-totals")
    with shuffles_dropped(spark):
        for i in range(slices):
            totals(sliced(rows, keys, i, slices)).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(totals(rows).schema).parquet(path)


# ------------------------------------------------------------------ upserts


def upsert_stream(updates: DataFrame, table: str, checkpoint: str, key: str, order: list[str], **trigger) -> StreamingQuery:
    """Latest row per key: each batch adds its own latest rows, reading resolves the rest."""
    def each(batch: DataFrame, batch_id: int) -> None:
        _write_batch(latest_by(batch, [key], order), table, batch_id)

    return run_stream(updates, checkpoint, each, trigger=trigger or None)


def upserted(spark: SparkSession, table: str, key: str, order: list[str]) -> DataFrame:
    rows = spark.read.parquet(table)
    return latest_by(rows, [key], [*order, "batch_id"]).drop("batch_id")


def compact(spark: SparkSession, table: str, target: str, key: str, order: list[str]) -> None:
    """Write the resolved rows to a new folder, to start the next log from."""
    upserted(spark, table, key, order).write.mode("overwrite").parquet(f"{target}/batch_id=-1")


# ------------------------------------------------------------------ throughput


def throughput_stream(
    events: DataFrame, table: str, checkpoint: str, interval: str = "15 seconds",
    watermark: str = "1 minute", **trigger,
) -> StreamingQuery:
    """Filed, held and failed per interval of event time; rows behind the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return run_stream(
        throughput(timed, interval), checkpoint, lambda df, i: _write_batch(df, table, i), "update", trigger or None
    )
