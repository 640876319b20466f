"""Hard negatives of anchor and positive pairs: the best rows of overlapping score windows, by disjoint slots."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCK_ROWS = 4096
ANCHOR_ROWS = 512
PENDING = 200_000  # rows a combiner holds before it keeps the best of them
LEAST, MOST = -(2**63), 2**63 - 1
BOUND = 2**56  # scores stay within, so that a hundred times a score is a long


def labelled_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v`` with v = floor(scale * x); rows with a null, or a component that is null or not finite, are left out."""
    v = F.col("v")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    )
    rows = rows.filter(v.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(v, finite))
    return rows.select("vec_id", "label", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def gathered(rows: DataFrame, size: int) -> DataFrame:
    """Rows of one vector length as blocks of at most ``size`` rows, in order of id: ids, labels, vectors and, if there, limits."""
    wide = "limits" in rows.columns
    schema = "dims int, n int, ids binary, labels binary, matrix binary" + (", limits binary, low binary" if wide else "")

    def block(dims: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        names = ["ids", "labels", "matrix", "limits", "low"][: len(columns)]
        values = {"dims": dims, "n": len(order)} | {name: x[order].tobytes() for name, x in zip(names, columns, strict=True)}
        return pa.RecordBatch.from_pylist([values], pa.schema([("dims", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in names)]))

    def matrix(batch: pa.RecordBatch, name: str, where: np.ndarray, width: int) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(batch.column(name).value_lengths().to_numpy())])[:-1]
        return batch.column(name).flatten().to_numpy(zero_copy_only=False)[starts[where][:, None] + np.arange(width)]

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
            for dims in np.unique(lengths).tolist():
                where = np.flatnonzero(lengths == dims)
                while len(where):
                    part, where = np.split(where, [size - sizes.get(dims, 0)])
                    rest = ()
                    if wide:
                        width = int(batch.column("limits").value_lengths()[0].as_py())
                        rest = (matrix(batch, "limits", part, width), batch.column("low").to_numpy()[part])
                    held.setdefault(dims, []).append((ids[part], labels[part], matrix(batch, "v", part, dims), *rest))
                    sizes[dims] = sizes.get(dims, 0) + len(part)
                    if sizes[dims] == size:
                        yield block(dims, held.pop(dims))
                        del sizes[dims]
        for dims, parts in held.items():
            yield block(dims, parts)

    return rows.select("vec_id", "label", "v", *(["limits", "low"] if wide else [])).mapInArrow(gather, schema)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exact; beyond ``BOUND`` they are the bound."""
    top = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    most = top[0] * top[1] * max(1, a.shape[1])
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    found = a.astype(kind) @ b.astype(kind).T
    return found.astype(np.int64) if most < BOUND else np.clip(found, -BOUND, BOUND).astype(np.int64)


def slot_best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, limits: np.ndarray, low: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one anchor's scores, the first k of each slot (places) and the slot of each.

    ``limits`` descend; slot j holds the scores up to limit j and above limit j + 1.  Ids ascend, so
    that a stable sort puts the smaller id first among equal scores.
    """
    where = np.flatnonzero(allowed & (scores <= limits[0]) & (scores >= low))
    where = where[np.argsort(-scores[where], kind="stable")]
    starts = np.searchsorted(-scores[where], -limits, "left")
    stops = np.minimum(starts + k, np.append(starts[1:], len(where)))
    slots = np.repeat(np.arange(len(limits)), np.maximum(stops - starts, 0))
    return np.concatenate([where[a:b] for a, b in zip(starts, stops, strict=True)]), slots


def combined(rows: list[np.ndarray], k: int) -> np.ndarray:
    """The first k rows of each anchor and slot; rows are columns anchor, slot, score, id."""
    x = np.concatenate(rows, axis=1)
    x = x[:, np.lexsort((x[3], -x[2], x[1], x[0]))]
    new = np.ones(x.shape[1], bool)
    new[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    nth = np.arange(x.shape[1]) - np.repeat(first, np.diff(np.append(first, x.shape[1])))
    return x[:, nth < k]


def slot_tops(anchors: DataFrame, index: DataFrame, k: int, same_label: bool, parts: int) -> DataFrame:
    """``anchor_id, slot, vec_id, score``: the k first rows of each slot of each anchor, over all blocks of the index.

    Index blocks are dealt over ``parts`` and stay there; the much fewer anchor blocks go to every part.
    A task gets one anchor block with all index blocks of its part in a row and combines what it
    finds; the rest is a rank over the few rows that are left.
    """
    names = ["ids", "labels", "matrix"]
    left = anchors.select("dims", "n", *names, "limits", "low", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = index.select("dims", F.col("n").alias("c_n"), *(F.col(x).alias(f"c_{x}") for x in names), F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int").alias("part"))
    pairs = left.join(right.hint("merge"), ["part", "dims"])

    def array(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
        return np.frombuffer(batch.column(name)[i].as_buffer(), np.int64)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            best = combined(held, k)
            return pa.record_batch([pa.array(best[0]), pa.array(best[1].astype(np.int32)), pa.array(best[3]), pa.array(best[2])], names=["anchor_id", "slot", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                dims, n, c_n = (batch.column(c)[i].as_py() for c in ("dims", "n", "c_n"))
                a_ids = array(batch, "ids", i)
                mark = (dims, a_ids.tobytes())
                if held and mark != current:
                    yield out()
                    held, size = [], 0
                current = mark
                ids, labels = array(batch, "c_ids", i), array(batch, "c_labels", i)
                a_labels, limits, low = array(batch, "labels", i), array(batch, "limits", i).reshape(n, -1), array(batch, "low", i)
                scores = products(array(batch, "matrix", i).reshape(n, dims), array(batch, "c_matrix", i).reshape(c_n, dims))
                for j in range(n):
                    allowed = ((labels == a_labels[j]) == same_label) & (ids != a_ids[j])
                    places, slots = slot_best(scores[j], ids, allowed, limits[j], low[j], k)
                    held.append(np.stack([np.full(len(places), a_ids[j]), slots, scores[j, places], ids[places]]))
                    size += len(places)
                if size > PENDING:
                    held = [combined(held, k)]
                    size = held[0].shape[1]
        if held:
            yield out()

    found = pairs.mapInArrow(search, "anchor_id bigint, slot int, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _share(score: str, percent: int, up: bool) -> Column:
    """percent / 100 of a score as a whole number, rounded up or down."""
    product = f"{score} * {-percent if up else percent}L"
    floor = F.expr(f"({product} - pmod({product}, 100L)) div 100L")
    return -floor if up else floor


def hard_negatives(
    vectors: DataFrame, k: int = 10, positives: int = 5, every: int = 100, scale: int = 256, low_percent: int = 30, high_percent: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Negatives that score close to a positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank``.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are the first
    ``positives`` rows of its label by integer inner product, ties by smaller id.  Of each positive, the
    first k rows of another label are returned whose score lies between ``low_percent`` and
    ``high_percent`` of the positive's.

    The windows of an anchor's positives overlap.  Their upper limits cut the scores into disjoint slots;
    each task keeps the first k rows of every slot, and so do the combined tasks.  In order of slots
    those rows descend, so a window is the first k of the rows from its own slot on, down to its
    lower limit.  One pass over all rows finds the positives, one the slots of all windows.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; only
    vectors of the anchor's length are compared.  No row with the anchor's id is its positive or
    negative.  Of anchors that repeat an id the greatest (vector, label) is used; other rows that
    repeat an id count each.  Scores beyond 2**56 count as that.  An anchor without positives, a positive
    with nothing in its window (so any negative score) and an empty table give no rows.
    """
    spark = vectors.sparkSession
    rows = labelled_vectors(vectors, scale, id_col, vector_col, label_col)
    index = saved(gathered(rows, BLOCK_ROWS).withColumn("number", F.monotonically_increasing_id()), "negative-index")
    chosen = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.max(F.struct("v", "label")).alias("x"))
    chosen = chosen.select("vec_id", "x.label", "x.v")
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    whole = chosen.withColumn("limits", F.array(F.lit(MOST))).withColumn("low", F.lit(LEAST))
    found = slot_tops(gathered(whole, ANCHOR_ROWS), index, positives, True, parts)
    found = saved(found.select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = found.withColumn("upper", _share("positive_score", high_percent, False)).withColumn("lower", _share("positive_score", low_percent, True))
    windows = windows.filter("lower <= upper")
    slots = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_set("upper"), False).alias("limits"), F.min("lower").alias("low"))
    # as many limits in every row; behind the last one stand slots without scores
    padded = F.concat("limits", F.array_repeat(F.lit(LEAST + 1), positives - F.size("limits")))
    asked = chosen.join(slots.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("limits", padded)
    best = slot_tops(gathered(asked, ANCHOR_ROWS), index, k, False, parts)

    ordered = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "vec_id"))).alias("rows"))
    own = windows.join(slots.select("anchor_id", "limits"), "anchor_id").withColumn("own", F.expr("array_position(limits, upper) - 1")).drop("limits")
    suffix = F.slice(F.filter("rows", lambda x: x["slot"] >= F.col("own")), 1, k)
    inside = F.filter(suffix, lambda x: -x["down"] >= F.col("lower"))
    out = own.join(ordered, "anchor_id").select("anchor_id", "positive_id", "positive_rank", "positive_score", F.posexplode(inside).alias("at", "x"))
    return out.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score",
        (-F.col("x.down")).alias("negative_score"), "positive_rank",
    )
