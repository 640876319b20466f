"""Token counts of whole texts; huge ones by overlapping chunks spliced at proven boundaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, sentence_pieces, text_of

SPACE = "▁"


@lru_cache(maxsize=4)
def inner_pairs(model: str) -> frozenset[str]:
    """All pairs of neighbouring characters inside pieces.

    Every merge makes a piece of the vocabulary, so between two characters that stand side by side
    in no piece nothing is ever merged: a boundary there is a token boundary in any context.
    """
    sp = sentence_pieces(model)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))


def proven(text: str, at: int, pairs: frozenset[str]) -> bool:
    return text[at - 1 : at + 1].replace(" ", SPACE) not in pairs


def begins(model: str, text: str) -> np.ndarray:
    """Character offsets at which the tokens of the text begin, one per token, in order."""
    raw = np.frombuffer(text.encode(), np.uint8)
    spans = sentence_pieces(model).encode(text, return_type="proto").pieces
    at = np.fromiter((p.begin for p in spans), np.int64, len(spans))  # in bytes
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]


def spliced_count(model: str, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text of which only a chunk and an overlap are encoded at a time.

    A chunk runs into the next one by ``overlap`` characters.  Both are cut at the first offset in
    the part they share where both have a token boundary that is proven.  If there is none, the
    first one is encoded again with an overlap four times as wide, up to the end of the text.
    """
    pairs = inner_pairs(model)
    total, start, skip = 0, 0, 0
    while True:
        wide, cut = overlap, None
        while cut is None:
            stop = start + chunk + wide
            own = begins(model, text[start:stop])
            if stop >= len(text):
                return total + int((own >= skip).sum())
            following = begins(model, text[start + chunk : stop]) + chunk
            shared = np.intersect1d(own, following)
            cut = next((c for c in shared.tolist() if c > max(chunk, skip) and proven(text, start + c, pairs)), None)
            wide *= 4
        total += int(((own >= skip) & (own < cut)).sum())
        start, skip = start + chunk, cut - chunk


def token_counts(
    docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, chunk: int = 1 << 15, overlap: int = 1 << 10,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text under a sentencepiece BPE model: ``doc_id, n_bytes, n_tokens, over_limit``.

    Texts of at most ``chunk`` characters are encoded at once.  Longer ones are encoded in chunks
    that overlap and are spliced (``spliced_count``); the result is the same as for the whole text,
    but memory is bounded by the chunk unless a text has no proven boundary.

    A null text counts as empty and has no tokens.  Every row gives one row, also rows that repeat
    or have a null id.  Columns other than the id and the text are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentence_pieces(model)
        for batch in in_slices(batches, "text"):
            column = batch.column("text")
            texts = column.to_pylist()
            short = [t for t in texts if len(t) <= chunk]
            lengths = iter(len(ids) for ids in sp.encode(short, return_type="numpy", num_threads=1))
            tokens = np.array([next(lengths) if len(t) <= chunk else spliced_count(model, t, chunk, overlap) for t in texts], np.int64)
            sizes = pc.binary_length(column).cast(pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, schema)
