"""File sources: intake tree, recorded answers, usage ledger, filed folder tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name

# Names a sync client or browser leaves behind, and the accepted types.
IGNORED_PREFIXES = ["~$", ".~", "._"]
IGNORED_SUFFIXES = [
    ".tmp", ".temp", ".partial", ".crdownload", ".part", ".lock", ".ds_store", "thumbs.db", ".filepart",
]
SUPPORTED = [".pdf", ".tif", ".tiff", ".png", ".jpg", ".jpeg"]
NAME_PATTERN = r"(?i)\((\d{3})\)(\d{3})-(\d{4})_(\d{4}-\d{2}-\d{2})_(\d{4})(AM|PM)"
ZONE = "America/New_York"
MAX_DEPTH = 8


def _any_case_glob() -> str:
    """A listing filter for the accepted types in any letter case."""
    def both(ext: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "{" + ",".join(f"*{both(e)}" for e in SUPPORTED) + "}"


def binary_reader(reader):
    """Options for an intake tree, for ``spark.read`` and ``spark.readStream`` alike."""
    return (
        reader.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _any_case_glob())
    )


def inbound_manifest(
    spark: SparkSession, root: str, exclude: Sequence[str] = (), zone: str = ZONE
) -> DataFrame:
    """The files of an intake tree with content hash, sender and time read from the name."""
    files = binary_reader(spark.read).load(root)
    return manifest_rows(files, root, exclude, zone)


def manifest_rows(
    files: DataFrame, root: str, exclude: Sequence[str] = (), zone: str = ZONE
) -> DataFrame:
    """The same for rows of ``path, modificationTime, length, content``.

    Names are judged first; content is hashed in a later projection, so refused files are
    never read.
    """
    top = root.rstrip("/") + "/"
    inside = F.when(
        F.contains("path", F.lit(top)), F.element_at(F.split("path", F.lit(top), 2), -1)
    ).otherwise(F.col("path"))
    df = files.withColumns({"relative_path": inside, "source_file_name": base_name(F.col("path"))})
    low = F.lower("source_file_name")
    keep = F.lit(False)
    for ext in SUPPORTED:
        keep = keep | low.endswith(ext)
    for prefix in IGNORED_PREFIXES:
        keep = keep & ~low.startswith(prefix)
    for suffix in IGNORED_SUFFIXES:
        keep = keep & ~low.endswith(suffix)
    for folder in exclude:
        keep = keep & ~F.col("relative_path").startswith(folder.strip("/") + "/")
    keep = keep & (F.size(F.split("relative_path", "/")) <= MAX_DEPTH)
    return name_parts(df.filter(keep), "source_file_name", zone).select(
        F.col("path").alias("source_path"), "relative_path", "source_file_name",
        F.col("length").alias("source_size_bytes"),
        F.unix_millis(F.col("modificationTime").cast("timestamp")).alias("source_mtime_ms"),
        F.hex(F.substring("content", 1, 8)).alias("head_hex"),
        F.sha2("content", 256).alias("content_sha256"),
        "sender_fax_number", "received_at",
    )


def name_parts(df: DataFrame, col: str, zone: str = ZONE) -> DataFrame:
    """Sender number and UTC receive time from a file name.

    The name carries the wall clock of the receiving server.  An impossible time keeps the number.
    """
    name = F.coalesce(col, F.lit(""))
    matched = name.rlike(NAME_PATTERN)
    number = F.concat(F.lit("+1"), *[F.regexp_extract(name, NAME_PATTERN, i) for i in (1, 2, 3)])
    clock = F.concat(
        F.regexp_extract(name, NAME_PATTERN, 4), F.lit(" "), F.regexp_extract(name, NAME_PATTERN, 5),
        F.upper(F.regexp_extract(name, NAME_PATTERN, 6)),
    )
    local = F.when(matched, F.try_to_timestamp(clock, F.lit("yyyy-MM-dd hhmma"))).cast("timestamp_ntz")
    return df.withColumns(
        {
            "sender_fax_number": F.when(matched, number),
            "received_at": F.convert_timezone(F.lit(zone), F.lit("UTC"), local),
        }
    )


def model_responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers, one file each, keyed by the name of the document they belong to."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("file"), F.col("value").alias("raw")
    )


def replay(requested: DataFrame, recorded: DataFrame) -> DataFrame:
    """The recorded answer of each requested document; ``recorded`` is false where there is none."""
    return requested.join(recorded.withColumn("recorded", F.lit(True)), "file", "left").withColumn(
        "recorded", F.coalesce("recorded", F.lit(False))
    )


CALL_TYPE = (
    "array<struct<call:string,model:string,inputTokens:bigint,outputTokens:bigint,"
    "cacheWriteTokens:bigint,cacheReadTokens:bigint,costUsd:double,requestId:string>>"
)
USAGE_TYPE = (
    "trackingId string, stage string, fileName string, category string, model string, at string, "
    "durationMs bigint, inputTokens bigint, outputTokens bigint, cacheWriteTokens bigint, "
    f"cacheReadTokens bigint, costUsd double, costKnown boolean, calls {CALL_TYPE}"
)


def usage_lines(lines: DataFrame, since: str | None = None) -> DataFrame:
    """Usage lines as rows; a line that is no JSON object has ``malformed`` set and nothing else."""
    body = F.from_json(
        "value", USAGE_TYPE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    df = lines.filter(F.trim("value") != "").select(body.alias("u"))
    bad = F.col("u").isNull() | F.col("u._bad").isNotNull()
    df = df.select(
        bad.alias("malformed"), F.col("u.trackingId").alias("tracking_id"), F.col("u.stage").alias("stage"),
        F.col("u.fileName").alias("file_name"), F.col("u.category").alias("category"), F.col("u.at").alias("at"),
        F.coalesce("u.inputTokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("u.outputTokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("u.cacheReadTokens", F.lit(0)).alias("cache_read_tokens"),
        F.col("u.costUsd").alias("cost_usd"), F.col("u.calls").alias("calls"),
    )
    if since:
        df = df.filter(F.col("malformed") | (F.coalesce("at", F.lit("")) >= since))
    return df


def usage_ledger(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The usage ledger of a folder of JSON lines; malformed lines stay countable."""
    return usage_lines(spark.read.text(path), since)


def manual_tree(paths: DataFrame, root: str) -> DataFrame:
    """Manual labels from a filed folder tree, identified by relative path.

    ``paths`` has ``path`` and, where known, ``content_sha256``.  Below ``root`` the folder is the
    manual decision; any other top folder is the line a document arrived on.
    """
    parts = F.split("path", "/")
    depth = F.size(parts)
    under = parts[0] == root
    keep = paths.filter(F.lower("path").endswith(".pdf"))
    return keep.select(
        F.col("path").alias("file"),
        F.when(under & (depth > 2), F.get(parts, F.lit(1))).alias("manual_folder"),
        F.when(under, F.lit("reference")).when(depth > 1, F.lit("fax-line")).otherwise(F.lit("inbound-root")).alias("source"),
        F.when(~under & (depth > 1), parts[0]).alias("fax_line"),
        *([F.col("content_sha256")] if "content_sha256" in paths.columns else []),
    )
