"""Shards that each match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_of

CELL_ROWS = 20_000


def mixed_shards(
    docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Puts every row into one of ``shards`` shards whose row counts differ by one at most.

    Rows of a source are put into a seeded random order and get the fraction (rank - 1/2) / rows of
    the source.  All rows sorted by that fraction interleave the sources in proportion, so a cut
    into equal runs gives every shard the mixture of the whole table.

    Both orders are found without sorting a whole source: a source is cut into cells of the random
    order, all rows into cells of the fraction, and a row's rank is its place in its cell plus the
    rows of the cells before.  A cell holds about ``CELL_ROWS`` rows whatever the source's share.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  Null texts count as empty
    (size 8), a null source is a source of its own, null ids are rows like others, and rows that
    repeat are each placed; an empty table gives no rows.  Other columns are not read.
    """
    total = docs.count()
    cells = max(64, -(-total // CELL_ROWS))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_of(text_col)).cast("long") + 8).alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
    ).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    place = F.shiftrightunsigned("draw", 33)
    rows = saved(
        rows.withColumn("place", place).withColumn("cell", F.shiftright(F.col("place") * cells, 31).cast("int")), "shard-rows"
    )

    before = Window.partitionBy("stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy("stratum", "cell").agg(F.count("*").alias("n"))
        .withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("stratum_rows", F.sum("n").over(Window.partitionBy("stratum")))
        .drop("n")
    )
    in_cell = Window.partitionBy("stratum", "cell").orderBy("place", "draw", "doc_id", "text_crc32", "size")
    rank = F.col("earlier") + F.row_number().over(in_cell)
    ranked = (
        rows.join(counts, ["stratum", "cell"])
        .withColumn("fraction", (rank - F.lit(0.5)) / F.col("stratum_rows"))
        .withColumn("bin", F.least(F.floor(F.col("fraction") * cells), F.lit(cells - 1)).cast("int"))
        .select("doc_id", "size", "text_crc32", "stratum", "place", "draw", "fraction", "bin")
    )
    ranked = saved(ranked, "shard-ranks")

    # one row per cell: at most one for every CELL_ROWS rows of the table
    bins = ranked.groupBy("bin").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("bin", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    in_bin = Window.partitionBy("bin").orderBy("fraction", "stratum", "place", "draw", "doc_id", "text_crc32", "size")
    at = F.col("earlier") + F.row_number().over(in_bin) - 1
    shard = F.expr(f"(at * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    return (
        ranked.join(bins, "bin").withColumn("at", at).withColumn("shard", shard).withColumn("slot", F.col("at") - first)
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"),
            F.lit(None).cast("int").alias("grown_shard"), F.substring("stratum", 2, 1 << 30).alias("source"),
        )
    )
