"""Fill-in-middle examples: texts cut at unit boundaries that one repeated capture finds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, text_of, whole_row

LINES = r"[^\n]*+\n|[^\n]++"
MARKERS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SLICE = 4 << 20


@lru_cache(maxsize=4)
def _repeated(unit: str) -> regex.Pattern:
    return regex.compile(f"({unit})*+")


def unit_ends(text: str, unit: str = LINES) -> list[int]:
    """Where each unit of a text ends, in code points: all repetitions of one capture of one match."""
    found = _repeated(unit).fullmatch(text)
    if found is None:
        raise ValueError(f"the text is not a sequence of units {unit}")
    return found.ends(1)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that seed and id decide; a null id has the digits of none."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearranged(
    text: str, h: list[int], unit: str = LINES, markers: tuple[str, str, str] = MARKERS, percent: int = 100, spm_percent: int = 50
) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and the example of one text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    if not text or h[2] % 100 >= percent or any(m in text for m in markers):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    pre, suf, mid = markers
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((suf, text[b:], pre, text[:a], mid, text[a:b]))
    return n, "psm", a, b - a, "".join((pre, text[:a], suf, text[b:], mid, text[a:b]))


def fill_in_middle(
    docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINES, markers: tuple[str, str, str] = MARKERS,
    id_col: str = "doc_id", text_col: str = "text", with_row: bool = False,
) -> DataFrame:
    """Texts rearranged for fill-in-middle training: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A text is a sequence of units (lines with their line feed; the last may lack it).  One full match of
    the repeated unit keeps every repetition of its capture, so the number of units and both cut places
    come from the list of ends.  Seed and id choose both cuts, whether the text is rearranged
    (``percent`` in 100) and in which form (``spm_percent`` in 100 suffix first, else prefix first).

    Null texts are empty texts.  Texts that are empty or hold a marker stay as they are: form ``plain``,
    null lengths.  Null ids draw as an id without digits.  Rows that repeat an id draw alike, each
    on its own text.  An empty table gives no rows.  With ``with_row`` all columns of the input
    follow as the struct ``row``.  Rows are independent: nothing is shuffled.  A slice holds about
    4 MB of texts or one longer text; the list of ends takes some 60 bytes for each unit, so a text of
    line feeds only is the worst case.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(f"`{text_col}`").alias("text"), *whole_row(docs, with_row))
    kinds = [("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output", "string")]
    schema = "doc_id bigint, " + ", ".join(" ".join(k) for k in kinds) + (f", row {picked.schema['row'].dataType.simpleString()}" if with_row else "")
    types = {"bigint": pa.int64(), "string": pa.string()}

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            made = [rearranged(t.as_py(), draws(seed, i), unit, markers, percent, spm_percent) for i, t in zip(ids, texts, strict=True)]
            columns = list(zip(*made, strict=True)) if made else [()] * len(kinds)
            arrays = [pa.array(c, types[kind]) for c, (_, kind) in zip(columns, kinds, strict=True)]
            names = ["doc_id", *(name for name, _ in kinds), *(["row"] if with_row else [])]
            yield pa.record_batch([batch.column("doc_id"), *arrays, *([batch.column("row")] if with_row else [])], names=names)

    return picked.mapInArrow(cut, schema)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an example was made from, by its markers alone; no part of a rearranged text holds one."""
    pattern = "|".join(f"\\Q{m}\\E" for m in markers)
    parts = F.split(output, pattern, -1)  # nothing before the first marker, then three parts
    psm, spm = (F.concat(*(F.get(parts, F.lit(k)) for k in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
