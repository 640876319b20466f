"""Tables in which every key is claimed once, such as content hashes: sorted runs of geometric sizes and a short tail of batches.

``tail/b<batch>`` holds what a micro-batch claimed, ``runs/<first>-<last>-<rows>`` the batches from first to
last, sorted by hash, with a Bloom filter in every file.  A run counts once its ``_SUCCESS`` file
stands; one that another covers no longer counts.  So a fold switches over with one file, a lost
writer leaves nothing that is read, and a replayed batch sees the same earlier batches again.  However many
batches there were, few folders are listed, and files are as many as the rows need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

TAIL = 16  # batches of the tail that are folded into a run
FILE_ROWS = 1_000_000  # rows of a file of a run
TASK_ROWS = 500_000  # rows of a batch or of the table for one task
SLICE_ROWS = 2_000_000  # rows of a batch or of the table up to which they are met at once
SLICES = 8  # slices at most, as each reads the batch and the table again
LOOKUPS = 1_000  # hashes of a batch up to which they reach the files as literals
KEY = "content_sha256"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Run(NamedTuple):
    first: int
    last: int
    rows: int
    path: str


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _finished(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """Names of the subfolders that stand in full, and of the others."""
    fs, path = _path(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    done = [n for n in names if fs.exists(_path(spark, f"{folder}/{n}/_SUCCESS")[1])]
    return done, [n for n in names if n not in done]


def _runs(spark: SparkSession, table: str) -> tuple[list[Run], list[str]]:
    """The runs that count, in order, and the paths of those that do not any more or never did."""
    done, broken = _finished(spark, f"{table}/runs")
    runs = sorted((Run(*map(int, n.split("-")), f"{table}/runs/{n}") for n in done), key=lambda r: (r.first, -r.last))
    active: list[Run] = []
    for r in runs:
        if not active or r.last > active[-1].last:
            active.append(r)
    return active, [r.path for r in runs if r not in active] + [f"{table}/runs/{n}" for n in broken]


def _tail(spark: SparkSession, table: str, after: int) -> tuple[dict[int, str], list[str]]:
    """Batches of the tail that no run holds, and the paths of those that one holds."""
    done, _ = _finished(spark, f"{table}/tail")
    batches = {int(n[1:]): f"{table}/tail/{n}" for n in done}
    return {b: p for b, p in batches.items() if b > after}, [p for b, p in batches.items() if b <= after]


def _read(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    full = StructType([*schema.fields]).add("batch_id", LongType()) if "batch_id" not in schema.names else schema
    return spark.read.schema(full).parquet(*paths) if paths else spark.createDataFrame([], full)


def claimed(spark: SparkSession, table: str, schema: StructType, before: int | None = None) -> DataFrame:
    """All claimed rows with their ``batch_id``; with ``before`` those of earlier batches only."""
    runs, _ = _runs(spark, table)
    tail, _ = _tail(spark, table, runs[-1].last if runs else -1)
    paths = [r.path for r in runs] + [p for b, p in sorted(tail.items()) if before is None or b < before]
    rows = _read(spark, paths, schema)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def fold(spark: SparkSession, table: str, schema: StructType, batch_id: int, key: str = KEY) -> bool:
    """Fold the tail before a batch into a run, together with runs that are not much larger.

    So sizes of runs stay geometric: there are as many as the logarithm of the rows, and a row is
    written again as often.  What the last fold took the place of is removed now, so that readers
    had the time of a whole tail to finish.
    """
    runs, old = _runs(spark, table)
    tail, held = _tail(spark, table, runs[-1].last if runs else -1)
    earlier = {b: p for b, p in tail.items() if b < batch_id}
    if len(earlier) < TAIL:
        return False
    for path in (*old, *held):
        fs, at = _path(spark, path)
        fs.delete(at, True)
    paths, first = list(earlier.values()), runs[-1].last + 1 if runs else 0
    rows = _read(spark, paths, schema).count()
    for r in reversed(runs):
        if r.rows > 2 * rows:
            break
        paths, first, rows = [r.path, *paths], r.first, rows + r.rows
    files = max(1, -(-rows // FILE_ROWS))
    merged = _read(spark, paths, schema).repartitionByRange(files, key).sortWithinPartitions(key)
    writer = merged.write.mode("overwrite").option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(FILE_ROWS))
    with shuffles_dropped(spark):
        writer.parquet(f"{table}/runs/{first}-{batch_id - 1}-{rows}")
    return True


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that wrote them ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def slices_for(rows: int) -> int:
    return min(SLICES, max(1, -(-rows // SLICE_ROWS)))


def sliced(rows: DataFrame, by: Sequence[str], i: int, slices: int) -> DataFrame:
    """One slice of some rows; rows that are equal in ``by`` share one."""
    return rows if slices == 1 else rows.filter(F.pmod(F.xxhash64(*by), F.lit(slices)) == i)


def spread(batch: DataFrame, table: str, rows: int | None = None) -> int:
    """As many tasks behind a shuffle as a batch, or the claimed rows that it meets, need at so many rows each.

    The width of a stream without state is its own in every batch.  A batch whose ``rows`` are given is claimed in
    slices, as many as it, or what it meets, needs; their number is returned.
    """
    spark = batch.sparkSession
    runs, _ = _runs(spark, table)
    tail, _ = _tail(spark, table, runs[-1].last if runs else -1)
    past = sum(r.rows for r in runs) + (spark.read.parquet(*tail.values()).count() if tail else 0)
    most = max(batch.count() if rows is None else rows, past)
    slices = slices_for(most) if rows is not None and rows > LOOKUPS else 1
    width = -(-most // (slices * TASK_ROWS))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(spark.sparkContext.defaultParallelism, width)))
    return slices


def claim(
    seen: DataFrame, table: str, batch_id: int, key: str = KEY, span: tuple[str, str] | None = None,
    by: Sequence[str] = (), part: tuple[int, int] = (0, 1), **columns,
) -> None:
    """Write the rows of a batch whose key no earlier batch has; ``seen`` has one row per key.

    Only files whose range of keys meets that of the batch are read; with keys that begin with a time these
    are the files of that time.  With ``span``, which holds all keys of a large batch, ``seen`` is gone through once
    and need not be kept.  ``part`` is the slice of the batch by ``by`` and how many there are; the slices come in
    order, and the batch counts when the last one is written.
    """
    spark = seen.sparkSession
    new = seen.withColumns(columns) if columns else seen
    at, of = part
    if at == 0:
        fold(spark, table, new.schema, batch_id, key)
    low, high = span or seen.agg(F.min(key), F.max(key)).first()
    past = sliced(claimed(spark, table, new.schema, batch_id), by, at, of).select(key).filter(F.col(key).between(low, high))
    few = [r[0] for r in seen.select(key).limit(LOOKUPS + 1).collect()] if span is None else None  # at most LOOKUPS + 1 keys
    if few is not None and len(few) <= LOOKUPS:  # sorted files and Bloom filters then leave out most of the table
        past = past.filter(F.col(key).isin(few) if few else F.lit(False))
    rows = new.join(past, key, "left_anti").withColumn("batch_id", F.lit(batch_id).cast("long"))
    writer = rows.select(*new.columns, "batch_id").write.mode("overwrite" if at == 0 else "append").option("compression", "zstd")
    writer = writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(at == of - 1).lower())
    with shuffles_dropped(spark):
        writer.parquet(f"{table}/tail/b{batch_id:09d}")
