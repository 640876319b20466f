"""From raw documents to packed training sequences, in five stages that each work on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperroute.llm.common import saved, table
from paperroute.llm.cotraining import quality_classes
from paperroute.llm.neardup import near_duplicates
from paperroute.llm.packing import packed_documents
from paperroute.llm.quality import quality_rules
from paperroute.llm.suffixdup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble the trusted target."""
    judged = quality_rules(docs, table(spark, sf_dir, "labels"), with_row=True)
    return judged.filter("kept").select(*(F.col(f"row.{c}") for c in COLUMNS))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, co-trained on all documents, takes for good; the stage before left no bad label to learn from."""
    judged = quality_classes(docs, table(spark, sf_dir, "labels"), with_row=True, training=table(spark, sf_dir, "documents"))
    return judged.filter("kept").select(*(F.col(f"row.{c}") for c in COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    others = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that also stand in a document with a lower id."""
    cut = without_repeats(docs, with_row=True).withColumnRenamed("kept_text", "text")
    others = {c: F.col(f"row.{c}") for c in ("lang", "source")}
    return cut.select("doc_id", "text", *(x.alias(c) for c, x in others.items()), F.char_length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("packing", packing_stage),
]

# three of the stages cannot be expressed in SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
