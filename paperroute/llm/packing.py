"""Packing of token pieces into sequences: exact complements first, best fit for the rest."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, saved, text_of
from .encoding import word_encoder

CELL_ROWS = 512
Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), in the order of their places


def token_pieces(
    docs: DataFrame, capacity: int = 4096, model: str = "word_bpe_49k.json", end_id: int = 1, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The ids of each whole text and ``end_id``, cut after every ``capacity`` ids.

    One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids`` (little-endian
    unsigned 32-bit).  A null text is empty and gives one piece that holds the end id.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()
    step = capacity * 4

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            owner, pieces = [], []
            for i, ids in enumerate(word_encoder(model).encode(batch.column("text"))):
                ids += end
                for k in range(0, len(ids), step):
                    owner.append(i)
                    pieces.append((k // step, k // 4, ids[k : k + step]))
            columns = [
                batch.column("doc_id").take(pa.array(owner, pa.int64())),
                pa.array([k for k, _, _ in pieces], pa.int32()), pa.array([s for _, s, _ in pieces], pa.int64()),
                pa.array([len(x) // 4 for _, _, x in pieces], pa.int64()), pa.array([zlib.crc32(x) for _, _, x in pieces], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([x for _, _, x in pieces], pa.binary()))
            yield pa.record_batch(columns, names=[c.split(" ")[0] for c in schema.split(", ")])

    return rows.mapInArrow(cut, schema)


def _pair(there: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Two available lengths with that sum, the longer one as long as can be and at most ``most``."""
    if total < 2:
        return None
    both = there[1:total] & there[total - 1 : 0 : -1]
    low = (total + 1) // 2
    found = np.flatnonzero(both[low - 1 : min(most, total - 1)])
    return (low + int(found[-1]), total - low - int(found[-1])) if len(found) else None


def _complements(there: np.ndarray, gap: int) -> Iterator[tuple[int, ...]]:
    """Single, pairs and triples of available lengths that fill a gap, as the availability stands."""
    if there[gap]:
        yield (gap,)
    pair = _pair(there, gap, gap)
    if pair:
        yield pair
    for a in (np.flatnonzero(there[: gap - 1])[::-1] if gap > 2 else ()):
        pair = _pair(there, gap - int(a), int(a))
        if pair:
            yield (int(a), *pair)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of lengths and how many sequences follow each, for so many pieces of every length.

    Lengths from the longest: what a length leaves free is looked up among the sums of one, two and
    three available lengths, and the combination is used as often as all its counts allow.  Every
    such step uses up a length or the combinations of it, so there are a few patterns for each length
    whatever the counts.  Lengths that nothing complements go by best fit, longest first, whole runs
    of equal sequences at a time.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[Pattern, int]] = []
    if left[capacity]:
        patterns.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1  # the one that is to be complemented
            there = left > 0
            used = None
            for others in _complements(there, capacity - length):
                need: dict[int, int] = {}
                for x in (length, *others):
                    need[x] = need.get(x, 0) + 1
                left[length] += 1
                times = min(int(left[x]) // k for x, k in need.items())
                left[length] -= 1
                if times:
                    used = (need, times)
                    break
            left[length] += 1
            if used is None:
                break
            for x, k in used[0].items():
                left[x] -= k * used[1]
            patterns.append((tuple(used[0].items()), used[1]))

    free: dict[int, list[tuple[Pattern, int]]] = {}  # by the room that is left
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for room in sorted(r for r in free if r >= length):
            per = room // length
            groups, kept = free.pop(room), []
            for pattern, times in groups:
                whole = min(times, n // per)
                if whole:
                    free.setdefault(room - per * length, []).append(((*pattern, (length, per)), whole))
                    n -= whole * per
                rest = times - whole
                if rest and n:  # fewer than a full run
                    free.setdefault(room - n * length, []).append(((*pattern, (length, n)), 1))
                    rest, n = rest - 1, 0
                if rest:
                    kept.append((pattern, rest))
            if kept:
                free.setdefault(room, []).extend(kept)
            if not n:
                break
        per = capacity // length
        if n // per:
            free.setdefault(capacity - per * length, []).append((((length, per),), n // per))
        if n % per:
            free.setdefault(capacity - n % per * length, []).append((((length, n % per),), 1))
    return patterns + [x for groups in free.values() for x in groups]


def slots_of(patterns: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """For every run of equal places: which ranks of a length take it, and in which sequences."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, per in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, first + times * per, per, base, offset))
            taken[length] = first + times * per
            offset += length * per
        base += times
    names = ["length", "rank_from", "rank_to", "per", "base", "place"]
    return pd.DataFrame(rows, columns=names, dtype="int64") if rows else pd.DataFrame({n: pd.Series(dtype="int64") for n in names})


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, length, ids_crc32``.

    Only the number of pieces of each length, at most ``capacity`` numbers, reaches the driver; the
    plan made from it is a table of runs of places, also bounded by the capacity, and is broadcast.
    A piece finds its place by its rank among the pieces of its length.  Ranks are counted in cells
    of about ``CELL_ROWS`` rows, so that a length shared by a third of all pieces is many cells.

    Pieces with null ids are packed like others; rows that repeat each get a place of their own.
    ``pieces`` is read three times and should be a written table.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots_of(pack_lengths(counts, capacity))
    slots = spark.createDataFrame(table.values.tolist(), ", ".join(f"{c} bigint" for c in table.columns))
    cells = spark.createDataFrame([(length, -(-n // CELL_ROWS)) for length, n in counts.items()], "length bigint, cells bigint")
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    rows = pieces.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(key, "cells")).drop("cells")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("length", "cell").agg(F.count("*").alias("n"))
    earlier = earlier.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.join(earlier, ["length", "cell"]).withColumn("rank", F.col("earlier") + F.row_number().over(within) - 1)
    s = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    placed = ranked.join(s, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return (
        placed.withColumn("sequence_id", F.col("base") + F.expr("(rank - rank_from) div per"))
        .withColumn("offset", F.col("place") + F.pmod(nth, "per") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame, capacity: int = 4096, model: str = "word_bpe_49k.json", end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with the sequence and the place that hold them; see the two steps above."""
    return pack_pieces(saved(token_pieces(docs, capacity, model, end_id, with_ids), "pieces"), capacity)
