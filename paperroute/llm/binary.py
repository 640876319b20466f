"""Token ids in fixed-width bit-packed blocks, written in document order and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CLEANUP, in_slices, text_of, tokenizer
from .encoding import word_encoder

BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = (
    "part int, block int, bits int, first bigint, n_ids bigint, doc_ids array<bigint>, doc_starts array<bigint>, payload binary"
)


def width(vocabulary: int) -> int:
    """The least bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id, lowest first, without gaps; the last byte is filled with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits % 8 == 0:  # whole bytes: the same layout by a copy
        return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    spread = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids at places ``start`` to ``stop`` of a packed block; only their bytes are looked at."""
    low, high = start * bits, stop * bits
    raw = np.frombuffer(payload, np.uint8)[low // 8 : (high + 7) // 8]
    if bits % 8 == 0:
        whole = np.zeros((stop - start, 4), np.uint8)
        whole[:, : bits // 8] = raw.reshape(-1, bits // 8)
        return whole.ravel().view("<u4")
    flat = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + high - low].reshape(-1, bits)
    padded = np.zeros((len(flat), 32), np.uint8)
    padded[:, :bits] = flat
    return np.packbits(padded.ravel(), bitorder="little").view("<u4")


def write_ids(
    docs: DataFrame, path: str, model: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the ids in ascending order of the ids of the documents.

    A file is Parquet, one row for each block: its part and number, bits for each id, ids of the part
    before it, number of ids, the documents it holds with the place of each one's first id, and the
    packed ids.  A block holds whole documents and is closed at ``BLOCK_IDS`` ids or after the last
    document, so a document is found by its block's statistics and read by two places.  Parts are in
    document order.  Spark commits the files, so a task that runs again leaves no half-written one.

    Texts are ordered by ranges before they are encoded, so the ids are never shuffled.  Null texts
    are empty and still get the end id; null ids come first; rows that repeat an id stand together,
    ordered by a hash of their texts.
    """
    bits = width(max(tokenizer(model).get_vocab_size(with_added_tokens=True), end_id + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal block, first
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {
                "part": part, "block": block, "bits": bits, "first": first, "n_ids": len(ids), "doc_ids": list(doc_ids),
                "doc_starts": (np.cumsum(lengths) - lengths).tolist(), "payload": pack(ids, bits),
            }
            block, first = block + 1, first + len(ids)
            doc_ids.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        count = 0
        for batch in in_slices(batches, "text"):
            texts = word_encoder(model).encode(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                doc_ids.append(doc_id)
                held.append(ids + end)
                count += len(ids) // 4 + 1
                if count >= BLOCK_IDS:
                    yield close()
                    count = 0
        if held:
            yield close()

    spark = docs.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        rows.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("payload", pa.binary()),
    ]
)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: the ids of all blocks before, over all parts.

    Only the sums of the parts, one row for each file task, are brought together for it.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # one row for each writing task: bounded by their number, not by the documents
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("earlier") + F.col("first")).drop("earlier")


def document_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids``."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                x = {name: batch.column(name)[b] for name in batch.schema.names}
                bits, n = x["bits"].as_py(), x["n_ids"].as_py()
                ids = unpack(x["payload"].as_buffer(), bits, 0, n)
                raw = ids.tobytes()
                starts = np.array(x["doc_starts"].as_py(), np.int64)
                stops = np.append(starts[1:], n)
                sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
                columns = [x["doc_ids"].values, pa.array(starts + x["start"].as_py()), pa.array(stops - starts), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[i:j].astype(np.int64) for i, j in zip(starts, stops, strict=True)], pa.list_(pa.int64())))
                yield pa.record_batch(columns, names=[c.split(" ")[0] for c in schema.split(", ")])

    wanted = read_ids(spark, path).select("bits", "n_ids", "start", "doc_ids", "doc_starts", "payload")
    return wanted.mapInArrow(rows, schema)
