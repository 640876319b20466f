"""String expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space, and those a file name may not contain.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ILLEGAL_IN_NAME = r'[\\/:*?"<>|\x00-\x1f]'

_NO_BLANKS = WHITESPACE.replace(" ", "")


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def collapse(col: Column) -> Column:
    """Lower case, white space runs to one blank, trimmed."""
    return F.btrim(squeeze(F.lower(col)), F.lit(" "))


def squeeze(col: Column) -> Column:
    """White space runs to one blank; case and ends untouched.

    Single characters first, then runs: most blanks stand alone and are no match.
    """
    return F.regexp_replace(F.translate(col, _NO_BLANKS, " " * len(_NO_BLANKS)), " {2,}", " ")


def digits(col: Column) -> Column:
    return F.regexp_replace(col, r"\D", "")


def phone_digits(col: Column) -> Column:
    """Digits without the leading country code of an eleven digit number."""
    d = digits(col)
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def clerk_form(col: Column) -> Column:
    """A name as a filing clerk compares it: hyphens, underscores and case do not count."""
    flat = F.translate(F.lower(col), "-_", "  ")
    return F.coalesce(F.btrim(squeeze(flat), F.lit(" ")), F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Everything before the last slash; empty for a bare name."""
    name = base_name(path)
    return F.when(F.length(path) == F.length(name), F.lit("")).otherwise(
        F.substring(path, F.lit(1), F.length(path) - F.length(name) - F.lit(1))
    )


def extension(name: Column, default: str = ".pdf") -> Column:
    """Suffix from the last dot, lower case; a leading or trailing dot starts no suffix."""
    found = F.lower(F.regexp_extract(base_name(F.coalesce(name, F.lit(""))), r"^.+(\.[^.]+)$", 1))
    return F.when(found == "", F.lit(default)).otherwise(found)


def drop_adjacent_repeats(words: Column, fold_case: bool = False) -> Column:
    """Remove array items equal to the one just before."""

    def form(c: Column) -> Column:
        return F.lower(c) if fold_case else c

    return F.filter(
        words,
        lambda w, i: (i == 0) | (form(w) != form(F.get(words, i - F.lit(1)))),
    )
