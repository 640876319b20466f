"""Quality rules: counting rules and a hashed n-gram log-likelihood ratio against a trusted target."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, row_kind, rows_of, text_of, whole_row
from .words import Texts, grams, row_sums, run_hashes, together

BUCKETS = 1 << 15
UNIT = 1 << 20  # ratios are added as whole numbers of 1 / UNIT, so that sums do not depend on their order
SLICE = 1 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of the base rules for each row; words and lines are compared by 64-bit hashes."""
    begins, ends = texts.words()
    word = run_hashes(texts.bytes, begins, ends)
    row = texts.row_of(begins)
    n_words = np.bincount(row, minlength=texts.rows)
    inside = np.zeros(len(texts.bytes) + 1, np.int8)
    np.add.at(inside, begins, 1)
    np.add.at(inside, ends, -1)
    lead = (texts.bytes & 0xC0) != 0x80
    word_chars = texts.per_row((np.cumsum(inside[:-1]) > 0) & lead)

    line_begins, line_ends = texts.runs(texts.bytes == 0x0A)
    with_word = np.searchsorted(begins, line_ends) > np.searchsorted(begins, line_begins)
    line_begins, line_ends = line_begins[with_word], line_ends[with_word]
    line_row = texts.row_of(line_begins)
    line = together(line_row.astype(np.uint64), run_hashes(texts.bytes, line_begins, line_ends))
    first = np.unique(line, return_index=True)[1]
    n_dup = np.bincount(line_row, minlength=texts.rows) - np.bincount(line_row[first], minlength=texts.rows)

    covered = np.zeros(len(word), bool)
    if len(word) >= 3:
        window = together(row[2:].astype(np.uint64), word[:-2], word[1:-1], word[2:])
        whole = np.flatnonzero(row[:-2] == row[2:])
        _, where, times = np.unique(window[whole], return_inverse=True, return_counts=True)
        again = whole[times[where] > 1]
        for i in range(3):
            covered[again + i] = True
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": texts.per_row(SYMBOLS[texts.bytes]), "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(row[covered], minlength=texts.rows),
    }


def chosen_ids(ids: DataFrame, column: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct ids in a seeded random order; all of them if there are fewer."""
    ids = ids.filter(F.col(column).isNotNull()).select(F.col(column).cast("long").alias(column)).distinct()
    total = ids.count()
    draw = F.xxhash64(F.lit(seed), column)
    if total > 2 * most:  # the full order is only needed for about the rows that are taken
        ids = ids.filter(F.pmod(draw, F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.5 * most / total + 1000 / total)))
    return ids.orderBy(draw, column).limit(most)


def with_trust(rows: DataFrame, target_ids: DataFrame, narrow_ids: int) -> DataFrame:
    """``text, trusted`` of every row of ``doc_id, text``; trusted if the id is one of the target's, however many they are."""
    ids = target_ids.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("target_id")).distinct()
    known, marks = F.col("doc_id").isNotNull(), ids.withColumn("part", F.lit(0))
    # only the way of joining depends on the number of ids; beyond it texts are shuffled once and never sorted
    marks = F.broadcast(marks) if ids.count() <= narrow_ids else marks.hint("shuffle_hash")
    # rows without an id match nothing and are dealt out by their texts
    part = F.when(known, 0).otherwise(1 + F.pmod(F.xxhash64("text"), F.lit(1000))).cast("int")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("key"), part.alias("own_part"), "text")
    joined = rows.join(marks, (F.col("key") == F.col("target_id")) & (F.col("own_part") == F.col("part")), "left")
    return joined.select("text", F.col("target_id").isNotNull().alias("trusted"))


def gram_counts(docs: DataFrame, target_ids: DataFrame, buckets: int, id_col: str, text_col: str, narrow_ids: int) -> np.ndarray:
    """N-gram counts by bucket of all texts (row 0) and of the texts of the target (row 1)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = with_trust(rows, target_ids, narrow_ids)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, buckets), np.int64)
        for batch in in_slices(batches, "text", SLICE):
            bucket, sizes = grams(Texts(batch.column("text")), buckets)
            trusted = np.repeat(batch.column("trusted").to_numpy(zero_copy_only=False), sizes)
            found[0] += np.bincount(bucket, minlength=buckets)
            found[1] += np.bincount(bucket[trusted], minlength=buckets)
        used = np.flatnonzero(found[0])
        yield pa.record_batch(
            [pa.array(used.astype(np.int32)), pa.array(found[0][used]), pa.array(found[1][used])], names=["bucket", "raw", "trusted"]
        )

    sums = rows.mapInArrow(count, "bucket int, raw bigint, trusted bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    out = np.zeros((2, buckets), np.int64)
    for r in sums.collect():  # at most one row for each bucket
        out[0, r["bucket"]], out[1, r["bucket"]] = r["raw"], r["trusted"]
    return out


def ratios(counts: np.ndarray, prior: float) -> np.ndarray:
    """Log-likelihood ratios in units of 1 / UNIT; the target is smoothed by ``prior`` n-grams of the corpus."""
    raw, trusted = counts.astype(np.float64)
    if not trusted.sum():
        return np.zeros(counts.shape[1], np.int64)
    share = raw / raw.sum()
    target = (trusted + prior * share) / (trusted.sum() + prior)
    llr = np.log(np.divide(target, share, out=np.ones_like(share), where=share > 0))
    return np.round(llr * UNIT).astype(np.int64)


def quality_rules(
    docs: DataFrame, labels: DataFrame, threshold: float = -0.5, min_words: int = 50, max_repeat: int = 50,
    buckets: int = BUCKETS, prior: float = 10_000.0, narrow_ids: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text",
    with_row: bool = False,
) -> DataFrame:
    """Counts, the base rules and the verdict of every document.

    Two multinomials over hashed byte trigrams are compared: the raw corpus, counted over all texts,
    and a trusted target, all documents labelled ``quality = 1``.  The score ``llr`` is the mean log
    ratio of a text's trigrams.  A document is kept if no base rule fails and its score is at least
    ``threshold``, the same fixed number for every document.  Up to ``narrow_ids`` trusted ids are
    sent to the texts; more of them meet the texts in a shuffled join.

    Null texts have no words and fail the base rules; labels with null ids or of other classes are
    passed over; without any trusted label every score is 0.  Every row gives one row, also rows
    with null or repeated ids.  Columns other than the id and the text are not read, unless
    ``with_row`` asks for ``row``, a struct of all columns of the input.
    """
    trusted = labels.filter(F.col("quality") == 1).select(F.col("doc_id"))
    table = ratios(gram_counts(docs, trusted, buckets, id_col, text_col, narrow_ids), prior)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *whole_row(docs, with_row))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"doc_id {kind}, {', '.join(f'{n} bigint' for n in names)}, base_failed boolean, llr double, kept boolean" + row_kind(rows)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            texts = Texts(batch.column("text"))
            base = base_counts(texts)
            bucket, sizes = grams(texts, buckets)
            llr = row_sums(table[bucket], sizes) / np.maximum(sizes, 1) / UNIT
            failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat * base["n_words"])
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(base[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold)),
                 *(batch.column(c) for c in rows_of(batch))],
                names=["doc_id", *names, "base_failed", "llr", "kept", *rows_of(batch)],
            )

    return rows.mapInArrow(judge, schema)
