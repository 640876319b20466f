"""Model quotes: which are boilerplate, which stand in the document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.similarity import count_similar, fn_partial_ratio
from ..functions.text import collapse, strip

# Letter framing that explains nothing.
BOILERPLATE = [
    r"(?i)^dear (dr|doctor)\.?$",
    r"(?i)^(re|to|from|fax|phone|date|subject)\s*:?$",
    r"(?i)^thank you (again )?for",
    r"(?i)^this is an update",
    r"(?i)^the following is a summary",
    r"(?i)^please (contact|call|feel free)",
    r"(?i)^sincerely",
    r"^[A-Za-z/ ]{1,20}:$",
    r"(?i)confidential|HIPAA|privileged|intended only for",
]


def _is_boilerplate(quote: Column) -> Column:
    return reduce(lambda a, b: a | b, [quote.rlike(p) for p in BOILERPLATE], quote == "")


def filter_evidence(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Trimmed quotes without boilerplate; repeats that differ in case only keep the first."""
    trimmed = F.transform(F.filter(F.col(col), lambda q: q.isNotNull()), strip)
    df = df.withColumn("__quotes", F.filter(trimmed, lambda q: ~_is_boilerplate(q)))
    df = df.withColumn("__folded", F.transform("__quotes", lambda q: F.lower(q)))
    kept = F.filter(
        F.col("__quotes"),
        lambda q, i: F.array_position(F.col("__folded"), F.lower(q)) == i + F.lit(1),
    )
    return df.withColumn(out or col, F.coalesce(kept, F.array().cast("array<string>"))).drop(
        "__quotes", "__folded"
    )


def verify_evidence(
    cls: DataFrame, texts: DataFrame, threshold: float = 80.0, key: str = "doc_id"
) -> DataFrame:
    """Share of each document's quotes that stand in its text; no quotes score 0.5.

    ``cls`` has one row per document with ``evidence array<string>``; ``texts`` has ``text``.
    The two meet in one equi-join.  Quotes contained word for word are settled natively; the
    text crosses into Python only for documents with a quote left open.
    """
    body = texts.select(key, F.col("text").alias("__text"))
    df = cls.join(body, key, "left")
    df = df.withColumn("__text", collapse(F.coalesce("__text", F.lit(""))))
    usable = F.filter("evidence", lambda q: q.isNotNull() & (q != ""))
    df = df.withColumn("__quotes", F.transform(usable, collapse))
    df = df.withColumn(
        "__open", F.filter("__quotes", lambda q: (q == "") | ~F.contains(F.col("__text"), q))
    )
    needs = F.size("__open") > 0
    df = df.withColumn(
        "__similar",
        count_similar(
            F.when(needs, F.col("__open")),
            F.when(needs, F.col("__text")),
            F.lit(float(threshold)),
        ),
    )
    total = F.coalesce(F.size("evidence"), F.lit(0))
    verified = F.size("__quotes") - F.size("__open") + F.coalesce("__similar", F.lit(0))
    return df.withColumns(
        {
            "quotes_total": total,
            "quotes_exact": F.when(total > 0, F.size("__quotes") - F.size("__open")).otherwise(0),
            "quotes_verified": F.when(total > 0, verified).otherwise(0),
            "evidence_score": F.when(total > 0, ratio(verified, total)).otherwise(F.lit(0.5)),
        }
    ).drop("__text", "__quotes", "__open", "__similar")


def exact_evidence(cls: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """The native part alone: the share of quotes contained word for word."""
    body = texts.select(key, collapse(F.col("text")).alias("__text"))
    usable = F.filter("evidence", lambda q: q.isNotNull() & (q != ""))
    df = cls.withColumn("__quotes", F.transform(usable, collapse)).join(body, key, "left")
    # counted once: the two results below share it
    df = df.withColumn("__found", F.size(F.filter("__quotes", lambda q: F.contains(F.col("__text"), q))))
    total = F.coalesce(F.size("evidence"), F.lit(0))
    return df.withColumns(
        {
            "quotes_total": total,
            "quotes_exact": F.greatest(F.coalesce("__found", F.lit(0)), F.lit(0)),
            "evidence_score": F.when(total > 0, ratio(F.col("__found"), total)).otherwise(F.lit(0.5)),
        }
    ).drop("__text", "__quotes", "__found")


def quote_scores(quotes: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """The similarity of every single quote row with its own document, 0 to 100.

    Equal (document, quote) rows are scored once.
    """
    body = texts.select(key, collapse(F.col("text")).alias("__text"))
    pairs = quotes.select(key, collapse(F.col("quote")).alias("__quote")).distinct().join(body, key)
    exact = F.contains(F.col("__text"), F.col("__quote")) & (F.col("__quote") != "")
    scored = pairs.withColumn("__exact", exact).withColumn(
        "score",
        F.coalesce(
            fn_partial_ratio(
                F.when(~F.col("__exact"), F.col("__quote")), F.when(~F.col("__exact"), F.col("__text"))
            ),
            F.lit(100.0),
        ),
    )
    return (
        quotes.withColumn("__quote", collapse(F.col("quote")))
        .join(scored.select(key, "__quote", "score"), [key, "__quote"], "left")
        .drop("__quote")
    )
