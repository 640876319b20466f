"""What the training-data operators share: tables written between steps, model files, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperroute.session import work_dir

from .words import forget_powers

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes a step to the folder all executors share and reads it again.

    This cuts the lineage: an executor lost later costs a read and not the steps before it.  The
    shuffle files of the step are dropped once its table stands.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Removes written steps that later written steps have taken the place of."""
    for df in steps:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that carry one id with different texts; short, as many rows carry it."""
    return F.hash(F.xxhash64(text_of(text_col)), F.octet_length(text_of(text_col)))


def whole_row(docs: DataFrame, wanted: bool) -> list[Column]:
    """All columns of the input as one struct, so that no name can clash with a result's."""
    return [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if wanted else []


def row_kind(rows: DataFrame) -> str:
    return f", row {rows.schema['row'].dataType.simpleString()}" if "row" in rows.columns else ""


def rows_of(batch: pa.RecordBatch) -> list[str]:
    return ["row"] if "row" in batch.schema.names else []


def model_file(name: str) -> str:
    """A path stays as it is; a bare name is one of the public tokenizer files of this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def sentence_pieces(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file(name))


@lru_cache(maxsize=4)
def tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model_file(name))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the strings of each part hold about so many bytes; no row is divided."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def in_slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, most_bytes)
    forget_powers()
