"""Extracted fields: flatten, validate, adjust confidence, score against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, with_exact_round
from ..functions.dates import parse_deadline
from ..functions.similarity import each_has_similar, seq_ratio_from
from ..functions.text import digits, phone_digits, strip
from ..sources.dimensions import DRUG_NAMES
from .lexicon import LEXICON_CUTOFF, match_lexicon

# The rule for a field by the end of its key, first match wins.
KEY_RULES = [
    (r"(?i)fax$|phone$|phonenumber$", "NANP"),
    (r"(?i)npi$", "LUHN"),
    (r"(?i)dea$", "DEA"),
    (r"(?i)ncpdpid$|ncpdp$", "FORMAT_7"),
    (r"(?i)exclusioncodes$|icd10codes$", "ICD10"),
    (r"(?i)(requested|drug).*name$", "DRUG"),
    (r"(?i)date$|duedate$|deadline$", "DATE_RANGE"),
]
PROVIDER_PREFIX = "80840"
DEA_SHAPE = r"^[A-PR-Z][A-Z9]\d{7}$"
ICD10_SHAPE = r"^[A-Z]\d{2}(\.\w{1,4})?$"
PASS_FACTOR = 1.05
FAIL_FACTOR = 0.20
STALE_DAYS = 730
FUTURE_YEARS = 3
FUZZY_CUTOFF = 0.80


def flatten_fields(meta: DataFrame) -> DataFrame:
    """One row per extracted field, keyed by dot path.

    Needs ``doc_id``, ``core_json``, ``category_json``, ``confidences_json``, ``evidence_json``.
    Paths are ``core.x``, ``categoryData.x`` and ``categoryData.a.b``; ``value`` is text,
    ``items`` the strings of a list.  Only the fields of one document meet in one group, so
    everything stays within its row until the final explode.
    """
    def tree(col: str) -> Column:
        return F.try_parse_json(F.coalesce(col, F.lit("{}")))

    def as_map(v: Column) -> Column:
        return F.coalesce(
            F.try_variant_get(v, "$", "map<string,variant>"),
            F.from_json(F.lit("{}"), "map<string,string>").cast("map<string,variant>"),
        )

    df = meta.select(
        "doc_id",
        as_map(tree("core_json")).alias("__core"),
        as_map(tree("category_json")).alias("__cat"),
        F.from_json("confidences_json", "map<string,string>").alias("__conf"),
        F.from_json("evidence_json", "map<string,string>").alias("__quote"),
    )

    def entries(m: Column, prefix: str) -> Column:
        return F.transform(
            F.map_entries(m),
            lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("field_key"), e["value"].alias("v")),
        )

    def nested(m: Column) -> Column:
        objects = F.filter(F.map_entries(m), lambda e: F.schema_of_variant(e["value"]).startswith("OBJECT"))
        return F.flatten(
            F.transform(
                objects,
                lambda e: F.transform(
                    F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")),
                    lambda n: F.struct(
                        F.concat(F.lit("categoryData."), e["key"], F.lit("."), n["key"]).alias("field_key"),
                        n["value"].alias("v"),
                    ),
                ),
            )
        )

    rows = df.select(
        "doc_id", "__conf", "__quote",
        F.inline(
            F.concat(
                entries(F.col("__core"), "core."), entries(F.col("__cat"), "categoryData."), nested(F.col("__cat"))
            )
        ),
    )
    kind = F.schema_of_variant("v")
    is_list = kind.startswith("ARRAY")
    rows = rows.withColumns(
        {
            "value": F.when(kind.startswith("OBJECT") | is_list, F.to_json("v")).when(
                kind != "VOID", F.try_variant_get("v", "$", "string")
            ),
            "items": F.when(
                is_list,
                F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")),
            ),
            "confidence": F.try_element_at("__conf", "field_key"),
            "quote": F.try_element_at("__quote", "field_key"),
        }
    )
    return rows.select("doc_id", "field_key", "value", "items", "confidence", "quote")


def with_confidence(df: DataFrame, col: str = "confidence") -> DataFrame:
    """Replace ``col`` by a value in 0..1: percentages are scaled, anything unreadable is 0."""
    text = F.rtrim(strip(F.col(col).cast("string")), F.lit("%"))
    df = df.withColumn("__conf", F.coalesce(text.try_cast("double"), F.lit(0.0)))
    v = F.col("__conf")
    scaled = F.when(F.isnan(v), F.lit(0.0)).when(v > 1.0, v / F.lit(100.0)).otherwise(v)
    return df.withColumn(col, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("__conf")


def method_for(key: Column) -> Column:
    method = F.lit("NONE")
    for pattern, name in reversed(KEY_RULES):
        method = F.when(key.rlike(pattern), F.lit(name)).otherwise(method)
    return method


def _digit(d: Column, i: int) -> Column:
    return F.try_element_at(F.split(d, ""), F.lit(i)).cast("int")


def _reason(method: str, value: Column, items: Column, key: Column, today: Column) -> Column:
    """Why a value fails its rule; null when it passes."""
    if method == "NANP":
        d = phone_digits(value)
        return (
            F.when(F.length(d) != 10, F.concat(F.lit("expected 10 digits, got "), F.length(digits(value)).cast("string")))
            .when(F.substring(d, 1, 1).isin("0", "1"), F.lit("area code starts with 0 or 1"))
            .when(F.substring(d, 4, 1).isin("0", "1"), F.lit("exchange starts with 0 or 1"))
        )
    if method == "LUHN":
        d = digits(value)
        return F.when(
            F.length(d) != 10, F.concat(F.lit("expected 10 digits, got "), F.length(d).cast("string"))
        ).when(~F.call_function("luhn_check", F.concat(F.lit(PROVIDER_PREFIX), d)), F.lit("check digit is wrong"))
    if method == "DEA":
        s = F.upper(strip(value))
        d = F.substring(s, 3, 7)
        check = (_digit(d, 1) + _digit(d, 3) + _digit(d, 5) + 2 * (_digit(d, 2) + _digit(d, 4) + _digit(d, 6))) % 10
        return F.when(~s.rlike(DEA_SHAPE), F.lit("expected 2 letters and 7 digits")).when(
            check != _digit(d, 7), F.lit("check digit is wrong")
        )
    if method == "FORMAT_7":
        d = digits(value)
        return F.when(F.length(d) != 7, F.concat(F.lit("expected 7 digits, got "), F.length(d).cast("string")))
    if method == "ICD10":
        codes = F.coalesce(items, F.array(value))
        wrong = F.filter(codes, lambda c: ~F.coalesce(F.upper(strip(c)).rlike(ICD10_SHAPE), F.lit(False)))
        return F.when(F.size(wrong) > 0, F.concat(F.lit("not a code: "), F.array_join(wrong, ", ", "null")))
    if method == "DATE_RANGE":
        d = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd")).when(
            value.rlike(r"^\d{8}$"), F.try_to_date(value, "yyyyMMdd")
        )
        due = F.contains(F.lower(key), F.lit("deadline")) | F.contains(F.lower(key), F.lit("duedate"))
        return (
            F.when(d.isNull(), F.lit("not an ISO date"))
            .when(due & (F.datediff(today, d) > STALE_DAYS), F.lit("deadline more than 730 days ago"))
            .when(d > F.add_months(today, 12 * FUTURE_YEARS), F.lit("more than 3 years ahead"))
            .when(F.year(d) < 2000, F.lit("before 2000"))
        )
    raise ValueError(method)


def validate_fields(fields: DataFrame, today: str, lexicon: list[str] | DataFrame | None = None) -> DataFrame:
    """Apply the rule of each field and adjust its confidence.

    Needs ``field_key``, ``value`` (text), ``items`` (strings of a list, else null) and
    ``confidence``; adds ``method``, ``passed``, ``reason``, ``canonical``, ``confidence_before``
    and ``confidence_after``.
    """
    if "items" not in fields.columns:
        fields = fields.withColumn("items", F.lit(None).cast("array<string>"))
    df = with_confidence(fields).withColumnRenamed("confidence", "confidence_before")
    df = df.withColumn(
        "method", F.when(F.col("value").isNull(), F.lit("NONE")).otherwise(method_for(F.col("field_key")))
    )
    drug = F.when(F.col("method") == "DRUG", F.upper(strip(F.col("value"))))
    df = match_lexicon(df.withColumn("__drug", drug), "__drug", DRUG_NAMES if lexicon is None else lexicon, LEXICON_CUTOFF).drop("__drug", "similarity")
    day = F.lit(today).cast("date")
    fail = F.when(
        F.col("method") == "DRUG", F.when(F.col("canonical").isNull(), F.lit("not in the name list"))
    )
    for name in ("NANP", "LUHN", "DEA", "FORMAT_7", "ICD10", "DATE_RANGE"):
        fail = fail.when(
            F.col("method") == name, _reason(name, F.col("value"), F.col("items"), F.col("field_key"), day)
        )
    df = df.withColumn("__fail", fail)
    df = df.withColumns(
        {
            "passed": F.col("__fail").isNull(),
            "reason": F.coalesce(
                "__fail",
                F.when(F.col("value").isNull(), F.lit("null"))
                .when(F.col("method") == "NONE", F.lit("no rule"))
                .otherwise(F.lit("ok")),
            ),
        }
    ).drop("__fail")
    before = F.col("confidence_before")
    factor = F.when(F.col("passed"), F.lit(PASS_FACTOR)).otherwise(F.lit(FAIL_FACTOR))
    df = df.withColumn("confidence_after", before * factor)
    df = with_exact_round(df, 4, "confidence_after")
    return df.withColumn(
        "confidence_after",
        F.when((before == 0.0) | (F.col("method") == "NONE"), before).otherwise(
            F.least(F.lit(1.0), F.col("confidence_after"))
        ),
    )


def validation_block(validated: DataFrame) -> DataFrame:
    """Back to one row per document: maps of records and of adjusted confidences."""
    return validated.groupBy("doc_id").agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.struct("field_key", F.struct("passed", "method", "reason").alias("record")))
            )
        ).alias("validation"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("field_key", "confidence_after")))
        ).alias("confidences"),
    )


def extraction_quality(validated: DataFrame) -> DataFrame:
    """Passes, failures and mean confidence per rule and field, with totals per rule and overall."""
    fine = validated.groupBy("method", "field_key").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("passed") & (F.col("method") != "NONE")).alias("p"),
        F.count_if(~F.col("passed")).alias("f"),
        F.sum("confidence_before").alias("b"),
        F.sum("confidence_after").alias("a"),
    )
    df = fine.rollup("method", "field_key").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("fields"), F.sum("p").alias("passed"), F.sum("f").alias("failed"),
        (F.sum("n") - F.sum("p") - F.sum("f")).alias("unchecked"),
        (F.sum("b") / F.sum("n")).alias("mean_before"), (F.sum("a") / F.sum("n")).alias("mean_after"),
    )
    return df.withColumns({"mean_before": F.round("mean_before", 4), "mean_after": F.round("mean_after", 4)})


# ------------------------------------------------------------------ scoring against labels


def score_fields(extracted: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled fields with what was extracted and whether the two agree.

    ``labels``: ``doc_id``, ``field_key``, ``expected``, ``expected_items``, ``fuzzy``,
    ``review``; ``extracted``: ``doc_id``, ``field_key``, ``value``, ``items``, ``confidence``.
    """
    found = extracted.select(
        "doc_id", "field_key", F.col("value").alias("actual"), F.col("items").alias("actual_items"), "confidence"
    )
    df = labels.join(found, ["doc_id", "field_key"], "left")

    def norm(c: Column) -> Column:
        return F.upper(strip(c))

    have = F.transform(F.coalesce("actual_items", F.array("actual")), norm)
    df = df.withColumns({"__want": F.transform("expected_items", norm), "__have": have})
    open_items = F.filter("__want", lambda w: ~F.array_contains(F.col("__have"), w))
    df = df.withColumn("__open", F.when(F.col("expected_items").isNotNull() & F.col("actual").isNotNull(), open_items))
    want, got = norm(F.col("expected")), norm(F.col("actual"))
    we, wa = phone_digits(F.col("expected")), phone_digits(F.col("actual"))
    phone = F.col("field_key").rlike(r"(?i)fax$|phone$") & (we != "") & (wa != "")
    missing = F.col("expected").isNull() & F.col("expected_items").isNull()
    is_list = F.col("expected_items").isNotNull()
    residue = (
        F.coalesce(F.col("fuzzy"), F.lit(False)) & ~is_list & ~F.coalesce(phone, F.lit(False)) & (want != got)
        & (want != "") & (got != "")
    )
    df = df.withColumn("__ratio", seq_ratio_from(FUZZY_CUTOFF)(F.when(residue, want), F.when(residue, got)))
    plain = F.when(phone, we == wa).otherwise(
        (want == got) | F.coalesce(F.col("__ratio") >= FUZZY_CUTOFF, F.lit(False))
    )
    # list items not found literally: the items of one field stay inside their row; settled rows stay here
    needs = F.size("__open") > 0
    df = df.withColumn("__near", each_has_similar(F.when(needs, F.col("__open")), F.when(needs, F.col("__have")), F.lit(FUZZY_CUTOFF)))
    match = (
        F.when(missing, F.col("actual").isNull())
        .when(F.col("actual").isNull(), F.lit(False))
        .when(is_list, (F.size("__open") == 0) | F.col("__near"))
        .otherwise(plain)
    )
    return df.withColumn("match", match).drop("__want", "__have", "__open", "__ratio", "__near")


def field_metrics(scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Precision and recall per field and overall, and how often a sure answer was wrong."""
    labelled = F.col("expected").isNotNull() | F.col("expected_items").isNotNull()
    present = F.col("actual").isNotNull()
    sure = ~F.coalesce("review", F.lit(False)) & (F.col("confidence").cast("double") >= threshold)
    df = scored.groupBy("field_key").agg(
        F.count_if(labelled & F.col("match")).alias("tp"),
        F.count_if(~labelled & present).alias("fp"),
        F.count_if(labelled & ~F.col("match")).alias("fn"),
        F.count_if(~labelled & ~present).alias("tn"),
        F.count_if(sure & ~F.col("match")).alias("confidently_wrong"),
    )
    names = ["tp", "fp", "fn", "tn", "confidently_wrong"]
    df = df.rollup("field_key").agg(
        F.grouping("field_key").cast("int").alias("overall"), *[F.sum(n).alias(n) for n in names]
    )
    df = df.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    return with_exact_round(df, 4, "precision", "recall")


def deadline_report(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """How many deadlines were absent, read, or in a form nobody knows."""
    text = F.lower(strip(F.col(col)))
    absent = F.coalesce(text.isin("null", "none", ""), F.lit(True))
    parsed = parse_deadline(F.col(col), strict)
    state = F.when(absent, F.lit("ABSENT")).when(parsed.isNotNull(), F.lit("PARSED")).otherwise(F.lit("UNREADABLE"))
    return df.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def normalise_deadlines(df: DataFrame, col: str, strict: bool = False, out: str = "response_deadline") -> DataFrame:
    return df.withColumn(out, parse_deadline(F.col(col), strict))


def due_soon(cls: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Open deadlines by days left, from today to ``days`` ahead."""
    left = F.datediff(F.col("response_deadline"), F.lit(today).cast("date"))
    return (
        cls.filter(F.coalesce("action_required", F.lit(False)))
        .withColumn("days_left", left)
        .filter(F.col("days_left").between(0, days))
        .groupBy("days_left")
        .agg(F.count("*").alias("n"))
    )
