"""Quality classifier by co-training: a text view and a page-metadata view teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_slices, row_kind, rows_of, saved, text_of, whole_row
from .quality import SLICE, SYMBOLS, UNIT, chosen_ids
from .words import Texts, grams, hashes, row_sums, together

BUCKETS = 1 << 13
SOURCES, LANGUAGES = 64, 16
NUMBERS = 10
WIDTH = SOURCES + LANGUAGES + NUMBERS
STEP = 1 << 12  # layout figures are whole numbers of 1 / STEP
FINE, ROOT = 1 << 24, 1 << 16  # and so are residuals and weighted columns: sums over all rows do not depend on their order
ROWS = 1 << 13  # sums of so many rows are exact as doubles
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def page(texts: Texts, source: list[str | None], lang: list[str | None]) -> np.ndarray:
    """Places of source and language and the page's layout: size, lines, word length, repetition, shares of character kinds."""
    n = texts.rows
    out = np.zeros((n, 2 + NUMBERS), np.int16)
    for i, (values, width) in enumerate(((source, SOURCES), (lang, LANGUAGES))):
        out[:, i] = [0 if v is None else 1 + zlib.crc32(v.encode()) % (width - 1) for v in values]
    begins, ends = texts.words()
    row = texts.row_of(begins)
    words = np.bincount(row, minlength=n)
    word = together(row.astype(np.uint64), hashes(texts.sums(), begins, ends))
    different = np.bincount(row[np.unique(word, return_index=True)[1]], minlength=n)
    again = np.bincount(row[1:][word[1:] == word[:-1]], minlength=n)
    size = np.maximum(texts.sizes, 1)
    lines = texts.per_row(texts.bytes == 0x0A) + 1
    shares = [texts.per_row(flags[texts.bytes]) / size for flags in (UPPER, DIGIT, SYMBOLS)]
    for i, column in enumerate(
        [np.log1p(texts.sizes) / 10, np.log1p(lines) / 5, np.log1p(words / lines) / 5, texts.sizes / np.maximum(words, 1) / 20,
         different / np.maximum(words, 1), again / np.maximum(words, 1), *(np.sqrt(x) for x in shares), np.ones(n)]
    ):
        out[:, 2 + i] = np.rint(np.minimum(column, 5) * STEP)
    return out


def metadata(pages: np.ndarray) -> np.ndarray:
    """Columns of the page view: source and language as hashed indicators, and the layout figures."""
    rows = np.arange(len(pages))
    out = np.zeros((len(pages), WIDTH))
    out[rows, pages[:, 0]] = 1
    out[rows, SOURCES + pages[:, 1]] = 1
    out[:, SOURCES + LANGUAGES :] = pages[:, 2:] / STEP
    return out


def page_odds(meta: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Row by row in one fixed order, so that a row's score does not depend on its batch."""
    return (meta * beta).sum(1)


def newton_sums(meta: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the rows' log likelihood as whole numbers, one after the other."""
    out = np.zeros(WIDTH + WIDTH * WIDTH, np.int64)
    for i in range(0, len(y), ROWS):
        x = meta[i : i + ROWS]
        p = 1 / (1 + np.exp(-np.clip(page_odds(x, beta), -30, 30)))
        root = np.rint(x * np.sqrt(p * (1 - p))[:, None] * ROOT)
        out[:WIDTH] += ((x * STEP).T @ np.rint((y[i : i + ROWS] - p) * FINE)).astype(np.int64)
        out[WIDTH:] += (root.T @ root).astype(np.int64).ravel()
    return out


def fit_page(sums: Callable[[np.ndarray], np.ndarray], ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method on sums over all rows; the last column is the constant."""
    beta = np.zeros(WIDTH)
    penalty = np.full(WIDTH, ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        total = sums(beta).astype(float)
        slope = total[:WIDTH] / (STEP * FINE) - penalty * beta
        step = np.linalg.solve(total[WIDTH:].reshape(WIDTH, WIDTH) / (ROOT * ROOT) + np.diag(penalty), slope)
        beta += step
        if np.abs(step).max() < 1e-4:
            break
    return beta


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last column of x is the constant."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Sample:
    """Bounded labelled rows the views are first fitted on: sparse n-gram counts, metadata, labels."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
        counts = rows.column("bucket").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
        times = rows.column("times").combine_chunks() if rows.num_rows else counts
        self.lengths = counts.value_lengths().to_numpy().astype(np.int64)
        self.bucket, self.times = counts.flatten().to_numpy(), times.flatten().to_numpy()
        self.meta = metadata(np.array(rows.column("page").to_pylist(), np.int16).reshape(rows.num_rows, 2 + NUMBERS))
        self.y = rows.column("label").to_numpy().astype(np.int64)
        self.totals = np.maximum(row_sums(self.times.astype(np.int64), self.lengths), 1)

    def mean_of(self, table: np.ndarray) -> np.ndarray:
        return row_sums(table[self.bucket] * self.times, self.lengths) / self.totals / UNIT

    def text_table(self, used: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Log ratios of two smoothed multinomials, of the good and of the bad rows and texts, in units of 1 / UNIT."""
        row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        both = [np.bincount(self.bucket[m := (used & (self.y == c))[row]], self.times[m], BUCKETS) + more[c] + 1.0 for c in (0, 1)]
        return np.round((np.log(both[1] / both[1].sum()) - np.log(both[0] / both[0].sum())) * UNIT).astype(np.int64)


def calibrated(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and shift that turn scores into log odds, on rows the view was not fitted on."""
    x = np.stack([score, np.ones(len(score))], 1)
    return logistic(x, y.astype(float), np.ones(len(y)), ridge=1e-2)


def odds(score: np.ndarray, line: np.ndarray) -> np.ndarray:
    return np.clip(score * line[0] + line[1], -20, 20)


def sure(p: np.ndarray, confident: float, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The labels of before with what is sure in the rows of now on top."""
    return np.where(now & (p >= confident), 1, np.where(now & (p <= 1 - confident), 0, before))


def pseudo_labels(models: list[dict], bucket: np.ndarray, sizes: np.ndarray, meta: np.ndarray, turn: np.ndarray, confident: float) -> tuple[np.ndarray, np.ndarray]:
    """What each view was handed by the other one in the rounds so far: labels for the text view and for the page view (-1: none)."""
    for_text = for_meta = np.full(len(sizes), -1)
    for k, model in enumerate(models):
        by_text, by_page = both_odds(model, bucket, sizes, meta)
        for_meta = sure(1 / (1 + np.exp(-by_text)), confident, for_meta, turn <= k)  # the pool is opened step by step
        for_text = sure(1 / (1 + np.exp(-by_page)), confident, for_text, turn <= k)
    return for_text, for_meta


class Pool:
    """All unlabelled rows, in Spark: ``text, source, lang, turn``; only sums by bucket and by column reach the driver."""

    def __init__(self, rows: DataFrame, confident: float):
        self.rows, self.confident, self.pages = rows, confident, None

    def exchange(self, models: list[dict]) -> np.ndarray:
        """One pass over the texts: bucket counts by pseudo-label, and the pages with the labels the text view gives them."""
        confident = self.confident

        def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((2, BUCKETS), np.int64)
            names = ["page", "y", "bucket", "bad", "good"]
            for batch in in_slices(batches, "text", SLICE):
                texts = Texts(batch.column("text"))
                bucket, sizes = grams(texts, BUCKETS)
                pages = page(texts, batch.column("source").to_pylist(), batch.column("lang").to_pylist())
                for_text, for_meta = pseudo_labels(models, bucket, sizes, metadata(pages), batch.column("turn").to_numpy(), confident)
                for c in (0, 1):
                    found[c] += np.bincount(bucket[np.repeat(for_text == c, sizes)], minlength=BUCKETS)
                taken = for_meta >= 0
                n = int(taken.sum())
                ends = pa.array(np.arange(n + 1) * (2 + NUMBERS), pa.int32())
                none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
                yield pa.record_batch([pa.ListArray.from_arrays(ends, pa.array(pages[taken].ravel())), pa.array(for_meta[taken].astype(np.int32)), *none], names=names)
            used = np.flatnonzero(found.sum(0))
            n = len(used)
            yield pa.record_batch(
                [pa.nulls(n, pa.list_(pa.int16())), pa.nulls(n, pa.int32()), pa.array(used.astype(np.int32)), pa.array(found[0][used]), pa.array(found[1][used])], names=names
            )

        both = saved(self.rows.mapInArrow(label, "page array<smallint>, y int, bucket int, bad bigint, good bigint"), "exchange")
        self.close()
        self.saved, self.pages = both, both.filter("y IS NOT NULL").select("page", "y")
        out = np.zeros((2, BUCKETS), np.int64)
        for r in both.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():
            out[0, r["bucket"]], out[1, r["bucket"]] = r["bad"], r["good"]
        return out

    def newton_sums(self, beta: np.ndarray) -> np.ndarray:
        """The sums of all pages that have a label now; nothing before the first exchange."""
        total = np.zeros(WIDTH + WIDTH * WIDTH)
        if self.pages is None:
            return total

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(len(total), np.int64)
            for batch in batches:
                pages = batch.column("page").flatten().to_numpy().reshape(batch.num_rows, 2 + NUMBERS)
                for i in range(0, len(pages), ROWS):
                    found += newton_sums(metadata(pages[i : i + ROWS]), batch.column("y").to_numpy()[i : i + ROWS], beta)
            used = np.flatnonzero(found)
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(found[used])], names=["place", "x"])

        sums = self.pages.mapInArrow(add, "place int, x bigint").groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in sums.collect():  # at most one row for each column and pair of columns
            total[r["place"]] = int(r["x"])
        return total

    def close(self) -> None:
        if self.pages is not None:
            discard(self.saved)
            self.pages = None


def both_odds(model: dict, bucket: np.ndarray, sizes: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by_text = odds(row_sums(model["table"][bucket], sizes) / np.maximum(sizes, 1) / UNIT, model["text"])
    return by_text, odds(page_odds(meta, model["beta"]), model["meta"])


def co_train(sample: Sample, pool: Pool, rounds: int) -> dict | None:
    """Fits both views; None if one class has too few labels to be fitted and calibrated."""
    held = np.zeros(len(sample.y), bool)
    for c in (0, 1):  # every third row of a class calibrates
        held[np.flatnonzero(sample.y == c)[::3]] = True
    if any(((sample.y == c) & part).sum() < 2 for c in (0, 1) for part in (~held, held)):
        return None
    counts = np.zeros((2, BUCKETS), np.int64)
    models: list[dict] = []
    for k in range(rounds + 1):
        table = sample.text_table(~held, counts)
        beta = fit_page(lambda b: newton_sums(sample.meta[~held], sample.y[~held], b) + pool.newton_sums(b))
        lines = [calibrated(score[held], sample.y[held]) for score in (sample.mean_of(table), page_odds(sample.meta, beta))]
        models.append({"table": table, "beta": beta, "text": lines[0], "meta": lines[1]})
        if k < rounds:  # each view hands what it is sure of to the other one
            counts = pool.exchange(models)
    pool.close()
    return models[-1]


def quality_classes(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = 6_000, rounds: int = 3, confident: float = 0.95,
    cut: float = 0.5, seed: int = 10, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    with_row: bool = False, training: DataFrame | None = None,
) -> DataFrame:
    """Probability of good quality of every document: ``doc_id, p_text, p_page, p_good, kept``.

    The text view is a multinomial over hashed byte trigrams, the page view a logistic regression on
    source, language and layout.  Both start from the labels and, for ``rounds`` rounds, each gives
    the unlabelled rows of which it is sure (``confident``) to the other as labels.  Scores are
    calibrated on labelled rows that neither saw, the two log odds are averaged, and a document is
    kept if the result is at least ``cut``.  Every document is scored.

    Both views are fitted on ``training``, a table with the same columns, of which ``docs`` may be what
    earlier steps kept; without it on ``docs`` itself.

    The first fit takes at most ``labelled_rows`` labelled rows in a seeded order.  Every other row
    takes part in the rounds as unlabelled, however many there are; a round opens a further
    part of them, the last one all.  Their pseudo-labels stay in Spark: n-gram counts by bucket and
    the sums of a Newton step, both exact whole numbers, are what the driver sees.

    Labels with a null id or a quality other than 0 and 1 are passed over; of several labels
    of a document the lowest counts.  With too few labels of a class nothing can be fitted: all
    probabilities are null and all documents are kept.  Null texts are empty, a null source or
    language is a value of its own, rows may repeat; every row gives one row.  ``with_row`` adds ``row``,
    a struct of all columns of the input.
    """
    def columns(df: DataFrame, wanted: bool) -> DataFrame:
        return df.select(
            F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
            *whole_row(df, wanted),
        )

    rows = columns(docs, with_row)
    fitted = columns(docs if training is None else training, False)
    lowest = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("fit_id")).agg(F.min("quality").alias("label"))
    known = chosen_ids(lowest, "fit_id", labelled_rows, seed).join(lowest, "fit_id")
    marks = F.broadcast(known.select("fit_id", F.col("label").cast("int").alias("label")))  # bounded by the number of rows
    same = F.col("doc_id").cast("long") == F.col("fit_id")
    marked = fitted.join(marks, same)
    turn = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("long"), F.octet_length("text")), F.lit(max(rounds, 1))).cast("int")
    pool = Pool(fitted.join(marks, same, "left_anti").select("text", "source", "lang", turn.alias("turn")), confident)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            texts = Texts(batch.column("text"))
            bucket, sizes = grams(texts, BUCKETS)
            key, times = np.unique(np.repeat(np.arange(texts.rows), sizes) * BUCKETS + bucket, return_counts=True)
            bounds = np.searchsorted(key, np.arange(texts.rows + 1) * BUCKETS)
            pages = page(texts, batch.column("source").to_pylist(), batch.column("lang").to_pylist())
            cut_up = lambda x, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind))
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(texts.sizes), batch.column("label"), cut_up(key % BUCKETS, pa.int32()),
                 cut_up(times, pa.int32()), pa.array(list(pages), pa.list_(pa.int16()))],
                names=["doc_id", "size", "label", "bucket", "times", "page"],
            )

    fit_schema = "doc_id bigint, size bigint, label int, bucket array<int>, times array<int>, page array<smallint>"
    found = marked.select("doc_id", "text", "source", "lang", "label").mapInArrow(features, fit_schema)
    # one row for each id, so that an id that many rows repeat does not widen the sample
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("size", "label", "bucket", "times", "page"), F.struct("size", "bucket")).alias("x"))
    model = co_train(Sample(one.select("doc_id", "x.*").toArrow()), pool, rounds)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["p_text", "p_page", "p_good"]
    schema = f"doc_id {kind}, p_text double, p_page double, p_good double, kept boolean" + row_kind(rows)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            n = batch.num_rows
            if model is None:
                yield pa.record_batch([batch.column("doc_id"), *[pa.nulls(n, pa.float64())] * 3, pa.array(np.ones(n, bool)), *(batch.column(c) for c in rows_of(batch))], names=["doc_id", *names, "kept", *rows_of(batch)])
                continue
            texts = Texts(batch.column("text"))
            bucket, sizes = grams(texts, BUCKETS)
            meta = metadata(page(texts, batch.column("source").to_pylist(), batch.column("lang").to_pylist()))
            by_text, by_page = both_odds(model, bucket, sizes, meta)
            p = [1 / (1 + np.exp(-z)) for z in (by_text, by_page, (by_text + by_page) / 2)]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x) for x in p), pa.array(p[2] >= cut), *(batch.column(c) for c in rows_of(batch))], names=["doc_id", *names, "kept", *rows_of(batch)])

    return rows.mapInArrow(score, schema)
