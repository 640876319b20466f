"""Files on disk against the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, parent_path


def reconcile(files: DataFrame, decisions: DataFrame, docs: DataFrame, cls: DataFrame) -> DataFrame:
    """Each visible file with the document it belongs to; files without one are the finding.

    ``files``: ``path``, ``size_bytes``, ``modified_at``.  A file is matched by its filed path,
    else by its name.  Of several decisions for one path the last counts, for one name the
    first.  Files settled by path carry a key no name has into the second join.
    """
    known = decisions.join(docs.select(F.col("id").alias("doc_id")), "doc_id")
    by_path = (
        known.filter(F.trim(F.coalesce("final_path", F.lit(""))) != "")
        .groupBy(F.translate("final_path", "\\", "/").alias("__path"))
        .agg(F.max_by("doc_id", "id").alias("__by_path"))
    )
    by_name = (
        known.filter(F.col("final_file_name").isNotNull())
        .groupBy(F.col("final_file_name").alias("__name"))
        .agg(F.min_by("doc_id", "id").alias("__by_name"))
    )
    name = base_name(F.translate("path", "\\", "/"))
    df = files.filter(~name.startswith(".")).withColumn("__path", F.translate("path", "\\", "/"))
    df = df.join(by_path, "__path", "left")
    df = df.withColumn(
        "__name",
        F.when(F.col("__by_path").isNotNull(), F.concat(F.lit("\x00"), "__path")).otherwise(name),
    ).join(by_name, "__name", "left")
    df = df.withColumn("doc_id", F.coalesce("__by_path", "__by_name"))
    df = df.withColumn(
        "matched_by",
        F.when(F.col("__by_path").isNotNull(), F.lit("PATH"))
        .when(F.col("__by_name").isNotNull(), F.lit("NAME"))
        .otherwise(F.lit("NONE")),
    )
    lookup = docs.select(F.col("id").alias("doc_id"), "tracking_id", "original_file_name").join(
        cls.select("doc_id", "category"), "doc_id", "left"
    )
    # orphans keep a key of their own instead of one shared null
    df = df.withColumn("__doc", F.coalesce("doc_id", -F.abs(F.xxhash64("path")) - 1))
    lookup = lookup.withColumnRenamed("doc_id", "__doc")
    return df.join(lookup, "__doc", "left").select(
        *files.columns, "matched_by", "doc_id", "tracking_id", "original_file_name", "category"
    )


def orphans(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter(F.col("matched_by") == "NONE")


def folder_rollup(files: DataFrame) -> DataFrame:
    """Files and bytes of each folder, sub-folders included.

    Files are counted per folder first; only those counts are spread to the folders above.
    """
    leaf = files.groupBy(parent_path(F.col("path")).alias("leaf")).agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("b")
    )
    parts = F.split("leaf", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return (
        leaf.select(F.explode(above).alias("folder"), (F.size(parts)).alias("depth"), "leaf", "n", "b")
        .groupBy("folder")
        .agg(
            F.sum(F.when(F.col("folder") == F.col("leaf"), F.col("n")).otherwise(0)).alias("own_files"),
            F.sum("n").alias("files"), F.sum("b").alias("bytes"),
        )
    )


def folder_manifest(files: DataFrame) -> DataFrame:
    """Folder and name of every file in order; one row per file, however full a folder is."""
    return files.select(
        parent_path(F.col("path")).alias("folder"), base_name(F.col("path")).alias("name")
    ).orderBy("folder", "name")
