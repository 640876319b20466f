"""Exports and stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grouping import latest_by


def write_csv(df: DataFrame, path: str) -> None:
    """Ordered rows as CSV parts with a header each; the parts keep the order."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def audit_export(decisions: DataFrame, docs: DataFrame) -> DataFrame:
    """Every decision, newest first, with its document; the document id where that is gone."""
    names = docs.select(F.col("id").alias("doc_id"), "tracking_id", "original_file_name")
    return (
        decisions.join(names, "doc_id", "left")
        .orderBy(F.desc("decided_at"), F.desc("id"))
        .select(
            F.coalesce("tracking_id", F.col("doc_id").cast("string")).alias("trackingId"),
            F.coalesce("original_file_name", F.lit("")).alias("originalFileName"),
            F.col("suggested_folder").alias("suggestedFolder"), F.col("final_folder").alias("finalFolder"),
            F.col("routing_status").alias("routingStatus"), F.col("decided_by").alias("decidedBy"),
            F.col("override_reason").alias("overrideReason"), F.col("rule_matched").alias("ruleMatched"),
            F.col("decided_at").cast("string").alias("decidedAt"),
        )
    )


FEEDBACK_COLUMNS = [
    "recorded_at", "verdict", "tracking_id", "original_file_name", "ai_file_name", "ai_folder",
    "ai_category", "ai_subtype", "ai_confidence", "review_state", "summary",
]


def feedback_export(feedback: DataFrame, verdict: str | None = None) -> DataFrame:
    """Feedback, newest first, as the 11 export columns; needs ``created_at`` for the order."""
    df = feedback
    if verdict and verdict.strip():
        df = df.filter(F.col("verdict") == verdict.strip().upper())
    return (
        df.orderBy(F.desc("created_at"), F.desc("tracking_id"))
        .withColumn("recorded_at", F.col("created_at").cast("string"))
        .select(*[F.col(c).cast("string").alias(c) for c in FEEDBACK_COLUMNS])
    )


def feedback_line(df: DataFrame) -> DataFrame:
    """Each row as one CSV line: every value quoted, quotes doubled, null left empty.

    Times, ids and scores that are null are written as an empty quoted value.
    """
    always = {"recorded_at", "tracking_id", "ai_confidence"}

    def quoted(c: str):
        body = F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(body, F.lit('""' if c in always else ""))

    return df.select(F.concat_ws(",", *[quoted(c) for c in FEEDBACK_COLUMNS]).alias("line"))


def write_feedback(df: DataFrame, path: str) -> None:
    """The export as text parts in order, plus the header in a file of its own."""
    spark = df.sparkSession
    feedback_line(df).write.mode("overwrite").text(f"{path}/rows")
    spark.range(1).select(F.lit(",".join(FEEDBACK_COLUMNS)).alias("line")).write.mode("overwrite").text(
        f"{path}/header"
    )


def metadata_export(
    meta: DataFrame, docs: DataFrame, cls: DataFrame, category: str | None = None,
    date_from: str | None = None, date_to: str | None = None,
) -> DataFrame:
    """Extraction results, newest first, each with its JSON record.

    The filter looks at the classified category; the one shown comes from the stored extraction
    where it has one.
    """
    df = meta
    if date_from:
        df = df.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        df = df.filter(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    side = cls.select("doc_id", F.col("category").alias("__classified"))
    if category:
        df = df.join(side.filter(F.col("__classified") == category), "doc_id")
    else:
        df = df.join(side, "doc_id", "left")
    df = df.join(docs.select(F.col("id").alias("doc_id"), "tracking_id"), "doc_id", "left")
    shown = F.coalesce(F.get_json_object("extraction_json", "$.category"), "__classified")

    def tree(col: str):
        return F.coalesce(F.try_parse_json(F.col(col)), F.parse_json(F.lit("{}")))

    df = df.orderBy(F.desc("created_at"), F.desc("doc_id")).select(
        "doc_id", F.coalesce("tracking_id", F.lit("unknown")).alias("tracking_id"),
        F.coalesce("schema_version", F.lit("1")).alias("schema_version"), shown.alias("category"),
        tree("core_json").alias("core"), tree("category_json").alias("categoryData"),
        tree("extraction_json").alias("extraction"), "created_at",
    )
    record = F.to_json(
        F.struct(
            F.col("schema_version").alias("schemaVersion"), F.col("tracking_id").alias("trackingId"),
            "category", "core", "categoryData", "extraction",
        )
    )
    return df.withColumn("record", record)


def cost_export(per_doc: DataFrame) -> DataFrame:
    """Cost rows, dearest first; an unknown cost counts as 0."""
    return per_doc.orderBy(F.coalesce("total_usd", F.lit(0.0)).desc(), "tracking_id")


def mapping_export(mapping: DataFrame, path: str) -> None:
    """The mapping as CSV and as JSON lines."""
    ordered = mapping.orderBy("file")
    write_csv(ordered, f"{path}/csv")
    ordered.write.mode("overwrite").json(f"{path}/json")


def write_eval_run(results: DataFrame, path: str, run_id: str) -> None:
    """Store one run's results; writing a run again replaces it."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").json(path)


def _run_table(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The stored runs with their names as text; no file is opened to find a schema."""
    return spark.read.schema(f"{columns}, run_id string").json(path)


def eval_runs(spark: SparkSession, path: str) -> DataFrame:
    """The stored runs, newest name first, with their sizes."""
    return _run_table(spark, path, "file string").groupBy("run_id").agg(F.count("file").alias("files")).orderBy(F.desc("run_id"))


def newest_run(spark: SparkSession, path: str) -> str | None:
    """The greatest name, by text, among the folders of runs."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [x.getPath().getName() for x in found if x.isDirectory() and x.getPath().getName().startswith("run_id=")]
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return max((unescaped(n.split("=", 1)[1]) for n in names), default=None)


def latest_eval_run(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Results of the run with the greatest name; only its partition is listed and read."""
    return _run_table(spark, path, columns).filter(F.col("run_id") == F.lit(newest_run(spark, path)))


def upsert_latest(target: DataFrame | None, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Target rows with updates applied: the newest row per key stays, an update wins a tie."""
    updates = updates.withColumn("schema_version", F.coalesce("schema_version", F.lit("1")))
    ranked = updates.withColumn("__from", F.lit(1))
    if target is not None:
        ranked = ranked.unionByName(target.withColumn("__from", F.lit(0)))
    return latest_by(ranked, [key], [order, "__from"]).drop("__from")
