"""Document texts: choice among page readings, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

NATIVE_MIN = 30

# Identifiers replaced by tags, in this order; later patterns see earlier tags.
REDACTIONS = [
    ("SSN", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"),
    ("DOB", r"(?i)\b(DOB|Date of Birth|D\.O\.B\.?)\s*[:\-]?\s*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}"),
    ("DATE", r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b"),
    ("ID", r"(?i)\b(MRN|Member ID|Account\s*#)\s*[:\-]?\s*[A-Z0-9\-]+"),
    ("ID", r"\b\d{10,}\b"),
]


def page_text(native: DataFrame, pages: DataFrame) -> DataFrame:
    """One text per document and how it was chosen.

    ``native``: ``doc_id``, ``native_text``; ``pages``: ``doc_id``, ``page``, ``raw_text``,
    ``proc_text``.  An embedded text of 30 characters wins; otherwise each page gives the
    reading with more characters, a tie going to the preprocessed one.  A group is the pages of
    one document, which the admission gate limits to 50.
    """
    p = page_selection(pages)
    merged = p.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("__pages"),
        F.count("*").alias("pages"),
        F.count_if(F.col("selected") == "preprocessed").alias("pages_preprocessed"),
    )
    merged = merged.select(
        "doc_id", "pages", "pages_preprocessed",
        F.array_join(F.transform("__pages", lambda x: x["text"]), "\n\n").alias("__merged"),
    )
    df = native.join(merged, "doc_id", "full")
    use_native = F.length(strip(F.coalesce("native_text", F.lit("")))) >= NATIVE_MIN
    text = F.when(use_native, F.col("native_text")).otherwise(F.coalesce("__merged", F.lit("")))
    return df.select(
        "doc_id", text.alias("text"),
        F.when(use_native, F.lit("NATIVE")).otherwise(F.lit("OCR")).alias("mode"),
        F.when(use_native, F.length("native_text")).otherwise(F.length(strip(text))).alias("char_count"),
        F.coalesce("pages", F.lit(0)).alias("pages"),
        F.when(use_native, F.lit(0)).otherwise(F.coalesce("pages_preprocessed", F.lit(0))).alias("pages_preprocessed"),
    )


def page_selection(pages: DataFrame) -> DataFrame:
    """Which reading each page uses, with both character counts."""
    raw = F.length(strip(F.coalesce("raw_text", F.lit(""))))
    proc = F.length(strip(F.coalesce("proc_text", F.lit(""))))
    better = proc >= raw
    return pages.select(
        "doc_id", "page", raw.alias("raw_chars"), proc.alias("preprocessed_chars"),
        (proc - raw).alias("delta"),
        F.when(better, F.lit("preprocessed")).otherwise(F.lit("raw")).alias("selected"),
        F.coalesce(F.when(better, F.col("proc_text")).otherwise(F.col("raw_text")), F.lit("")).alias("text"),
    )


def redact(df: DataFrame, col: str = "text", out: str | None = None, counts: bool = False) -> DataFrame:
    """Replace identifiers by tags; with ``counts`` also how many of each tag were set."""
    out = out or col
    step = df.withColumn("__t", F.col(col))
    found: dict[str, list] = {}
    for i, (tag, pattern) in enumerate(REDACTIONS):
        if counts:
            step = step.withColumn(f"__n{i}", F.regexp_count("__t", F.lit(pattern)))
            found.setdefault(tag, []).append(f"__n{i}")
        step = step.withColumn("__t", F.regexp_replace("__t", pattern, f"[{tag}]"))
    keep = [c for c in df.columns if c != out]
    totals = [
        F.coalesce(sum((F.col(n) for n in names[1:]), F.col(names[0])), F.lit(0)).alias(f"n_{tag.lower()}")
        for tag, names in found.items()
    ]
    return step.select(*keep, F.col("__t").alias(out), *totals)


def redaction_report(df: DataFrame, col: str = "text") -> DataFrame:
    """Tags set over the whole corpus and in how many documents."""
    counted = redact(df, col, counts=True)
    tags = sorted({t.lower() for t, _ in REDACTIONS})
    wide = counted.agg(
        *[
            F.struct(
                F.lit(t.upper()).alias("tag"), F.sum(f"n_{t}").alias("replaced"),
                F.count_if(F.col(f"n_{t}") > 0).alias("documents"),
            ).alias(t)
            for t in tags
        ]
    )
    return wide.select(F.inline(F.array(*[F.col(t) for t in tags])))
