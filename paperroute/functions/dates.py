"""Printed date forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The printed forms accepted besides ISO.
ISO = r"^(\d{4})-(\d{2})-(\d{2})$"
DAY_MONTH_YEAR = r"^(\d{1,2})([A-Za-z]{3})(\d{4})$"
MONTH_DAY_YEAR = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
SLASHED = r"^(\d{2})/(\d{2})/(\d{4})$"


def _pick(col: Column, pattern: str, year: int, month: int, day: int, named_month: bool) -> Column:
    """A date from the groups of one pattern; null when the text has another form."""
    part = F.regexp_extract(col, pattern, month)
    if named_month:
        part = F.initcap(F.substring(part, 1, 3))
    text = F.concat_ws(
        "-", F.regexp_extract(col, pattern, year), part, F.regexp_extract(col, pattern, day)
    )
    return F.when(
        col.rlike(pattern), F.try_to_date(text, "yyyy-MMM-d" if named_month else "yyyy-M-d")
    )


def parse_deadline(col: Column, strict: bool = False) -> Column:
    """A printed deadline as a date; null if absent or in no known form.

    ``strict`` accepts the ISO form only.
    """
    text = strip(col)
    text = F.when(~F.lower(text).isin("null", "none", ""), text)
    iso = _pick(text, ISO, 1, 2, 3, False)
    if strict:
        return iso
    return F.coalesce(
        iso,
        _pick(text, DAY_MONTH_YEAR, 3, 2, 1, True),
        _pick(text, MONTH_DAY_YEAR, 3, 1, 2, True),
        _pick(text, SLASHED, 3, 1, 2, False),
    )
