"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCK_ROWS = 4096
QUERY_ROWS = 512
FIRST_DEPTH = 64


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and floor(scale * x) of every component; vectors with a null or non-finite component are left out."""
    v = F.col("v")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: F.coalesce(good(x), F.lit(False))))
        .select("vec_id", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    )


def _matrix(batch: pa.RecordBatch, rows: np.ndarray, dims: int) -> np.ndarray:
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(batch.column("v").value_lengths().to_numpy())])[:-1]
    return values[starts[rows][:, None] + np.arange(dims)] if dims else np.zeros((len(rows), 0), np.int64)


def blocks_of(vectors: DataFrame, rows: int, sort: bool) -> DataFrame:
    """Vectors of one length gathered to blocks; with ``sort``, also the row order of every dimension, highest first."""
    schema = "dims int, n int, ids binary, matrix binary" + (", orders binary" if sort else "")

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def close(dims: int) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held[dims]])
            matrix = np.concatenate([m for _, m in held[dims]])
            by_id = np.argsort(ids, kind="stable")  # so that equal scores come by the smaller id
            ids, matrix = ids[by_id], matrix[by_id]
            held[dims], sizes[dims] = [], 0
            row = {"dims": dims, "n": len(ids), "ids": ids.tobytes(), "matrix": matrix.tobytes()}
            if sort:
                row["orders"] = np.argsort(-matrix.T, axis=1, kind="stable").astype(np.int32).tobytes()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("dims", pa.int32()), ("n", pa.int32()), *((k, pa.binary()) for k in list(row)[2:])]))

        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            ids = batch.column("vec_id").to_numpy()
            for dims in np.unique(lengths).tolist():
                where = np.flatnonzero(lengths == dims)
                for k in range(0, len(where), rows):
                    part = where[k : k + rows]
                    held.setdefault(dims, []).append((ids[part], _matrix(batch, part, dims)))
                    sizes[dims] = sizes.get(dims, 0) + len(part)
                    if sizes[dims] >= rows:
                        yield close(dims)
        for dims in [d for d, n in sizes.items() if n]:
            yield close(dims)

    return vectors.select("vec_id", "v").mapInArrow(gather, schema)


def threshold_top(query: np.ndarray, query_id: int, ids: np.ndarray, matrix: np.ndarray, orders: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best of a block for one query, and how many rows were scored.

    Rows are met by sorted access to every dimension at once, from the end that raises the score,
    and scored in full when first seen.  No row still unseen can score above the sum of query times
    the value each list has come to; once that bound is below the kth score found, here or before
    (``floor``), the search stops.  It goes on at equality, where a smaller id could still win.
    """
    dims = np.flatnonzero(query)
    n = len(ids)
    lists = np.where(query[dims, None] > 0, orders[dims], orders[dims, ::-1])
    seen = np.zeros(n, bool)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, matrix.dtype)
    depth, step, scored = 0, FIRST_DEPTH, 0
    while depth < n:
        stop = min(n, depth + step)
        if len(dims):
            fresh = np.unique(lists[:, depth:stop])
            fresh = fresh[~seen[fresh]]
        else:
            fresh, stop = np.arange(n), n
        seen[fresh] = True
        scored += len(fresh)
        own = fresh[ids[fresh] != query_id]
        best_ids, best = np.concatenate([best_ids, ids[own]]), np.concatenate([best, matrix[own] @ query])
        first = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[first], best[first]
        depth, step = stop, step * 2
        if depth >= n:
            break
        bound = query[dims] @ matrix[lists[:, depth - 1], dims]
        lowest = best[-1] if len(best) == k else None
        if floor is not None and (lowest is None or floor > lowest):
            lowest = floor
        if lowest is not None and bound < lowest:
            break
    return best_ids, best, scored


def _exact(matrix: np.ndarray, other: np.ndarray) -> type:
    """A number type in which all inner products of the two are exact: double, long, or Python's integers."""
    most = float(np.abs(matrix.astype(float)).max(initial=0)) * float(np.abs(other.astype(float)).max(initial=0)) * max(1, matrix.shape[1])
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but those with the
    query's id.  Ties go to the smaller id.  Candidates are gathered once into blocks with the sorted
    lists of all dimensions, queries into blocks of their own; every pair of blocks is one row of a
    join on the query block's number and is searched by the threshold algorithm, so neither side has
    to fit one machine.  The best of all blocks are ranked in the end.

    Rows with a null id, a null vector or a null or non-finite component take no part.  Only vectors
    of the query's length are compared.  Of queries that repeat an id with different vectors the
    greatest vector, by its components in order, is used; candidates that repeat are each returned.
    Scores beyond 64 bits are returned as the largest or the smallest long.
    """
    vectors = whole_vectors(vectors, scale, id_col, vector_col)
    index = saved(blocks_of(vectors, BLOCK_ROWS, True), "top-lists")
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    asked = saved(blocks_of(queries, QUERY_ROWS, False).withColumn("q", F.monotonically_increasing_id()), "top-queries")
    asked = asked.select("q", F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    # every candidate block is sent to every query block of its length
    numbers = asked.groupBy(F.col("q_dims").alias("dims")).agg(F.collect_list("q").alias("qs"))
    pairs = index.join(numbers, "dims").withColumn("q", F.explode("qs")).drop("qs").join(asked, "q")
    least, most = -(2**63), 2**63 - 1

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {name: batch.column(name)[i] for name in batch.schema.names}
                dims, n = x["dims"].as_py(), x["n"].as_py()
                ids = np.frombuffer(x["ids"].as_buffer(), np.int64)
                matrix = np.frombuffer(x["matrix"].as_buffer(), np.int64).reshape(n, dims)
                orders = np.frombuffer(x["orders"].as_buffer(), np.int32).reshape(dims, n)
                q_ids = np.frombuffer(x["q_ids"].as_buffer(), np.int64)
                q_matrix = np.frombuffer(x["q_matrix"].as_buffer(), np.int64).reshape(len(q_ids), dims)
                kind = _exact(matrix, q_matrix)
                matrix, q_matrix = matrix.astype(kind), q_matrix.astype(kind)
                found = [(int(q), *threshold_top(v, int(q), ids, matrix, orders, k, None)[:2]) for q, v in zip(q_ids, q_matrix, strict=True)]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat([q for q, _, _ in found], [len(a) for _, a, _ in found]).astype(np.int64)),
                        pa.array(np.concatenate([a for _, a, _ in found]).astype(np.int64)),
                        pa.array([min(max(int(s), least), most) for _, _, b in found for s in b], pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    wanted = pairs.select("dims", "n", "ids", "matrix", "orders", "q_ids", "q_matrix")
    best = wanted.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
