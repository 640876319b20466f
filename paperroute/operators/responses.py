"""Raw model answers: parse, check, split into a typed table and a quarantine table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_deadline
from ..functions.text import strip
from ..sources.dimensions import REQUIRED_RESPONSE_KEYS, TAXONOMY

# Fixed values
MAX_SPECIFICATION = 60
FAX_SOURCES = ["FILENAME", "DOCUMENT", "NONE"]
LIST_KEYS = ["evidence", "routingEvidence", "namingEvidence", "patientIdentifiersPresent"]


def _without_fences(raw: Column) -> Column:
    text = strip(F.regexp_replace(strip(raw), r"(?md)^```(?:json)?\s*", ""))
    return strip(F.regexp_replace(text, r"(?md)```\s*$", ""))


def parse_responses(raw: DataFrame, col: str = "raw") -> DataFrame:
    """Adds ``body``, the JSON text found, and ``parsed``, the variant; null when there is none.

    The cleaned text is tried whole first, then from the first brace to the last.
    """
    df = raw.withColumn("__clean", _without_fences(F.coalesce(col, F.lit(""))))
    df = df.withColumn("__whole", F.try_parse_json("__clean"))
    inner = F.regexp_extract("__clean", r"(?s)\{.*\}", 0)
    df = df.withColumn(
        "body", F.when(F.col("__whole").isNotNull(), F.col("__clean")).otherwise(F.when(inner != "", inner))
    )
    df = df.withColumn("parsed", F.coalesce("__whole", F.try_parse_json("body")))
    return df.drop("__clean", "__whole")


def _kind(path: str) -> Column:
    """JSON type of one key, null when the key is absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get("parsed", path, "variant"))


def _given(path: str) -> Column:
    return _kind(path).isNotNull() & (_kind(path) != "VOID")


def _text(path: str) -> Column:
    return F.try_variant_get("parsed", path, "string")


def missing_fields(parsed: DataFrame) -> DataFrame:
    """Required keys an answer does not have; a key holding null is not missing."""
    keys = F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>"))
    required = F.array(*[F.lit(k) for k in REQUIRED_RESPONSE_KEYS])
    return parsed.withColumn("missing", F.when(F.col("parsed").isNotNull(), F.array_except(required, keys)))


def land_responses(raw: DataFrame, col: str = "raw", dims: DataFrame | None = None) -> DataFrame:
    """Every answer with its typed fields and its list of ``errors`` (empty when usable).

    Codes and subtypes are those of the taxonomy ``dims`` (``code``, ``subtype_slugs``), or of the default.
    """
    df = missing_fields(parse_responses(raw, col))
    if dims is None:
        df = df.withColumns(
            {
                "__codes": F.array(*[F.lit(c) for c in TAXONOMY]),
                "__subtypes": F.array(*[F.lit(s) for row in TAXONOMY.values() for s in row[4]]),
            }
        )
    else:
        known = dims.agg(
            F.collect_set("code").alias("__codes"), F.flatten(F.collect_list(F.map_keys("subtype_slugs"))).alias("__subtypes"), F.lit(1).alias("__one")
        )
        # a single row: the names of the categories
        df = df.withColumn("__one", F.lit(1)).join(F.broadcast(known), "__one").drop("__one")

    def bad_code(path: str, error: str) -> Column:
        value = _text(path)
        wrong = _given(path) & (value.isNull() | ((value != "") & ~F.array_contains("__codes", value)))
        return F.when(wrong, F.lit(error))

    def bad_confidence(key: str) -> Column:
        kind, value = _kind(f"$.{key}"), F.try_variant_get("parsed", f"$.{key}", "double")
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
        fine = number & value.between(0.0, 1.0)
        return F.when(_given(f"$.{key}") & ~F.coalesce(fine, F.lit(False)), F.lit(f"BAD_CONFIDENCE:{key}"))

    def bad_list(key: str) -> Column:
        return F.when(_given(f"$.{key}") & ~_kind(f"$.{key}").startswith("ARRAY"), F.lit(f"NOT_A_LIST:{key}"))

    spec = _text("$.specification")
    bad_spec = (
        F.when(_given("$.specification") & (_kind("$.specification") != "STRING"), F.lit("SPECIFICATION_NOT_TEXT"))
        .when(F.length(spec) > MAX_SPECIFICATION, F.lit("SPECIFICATION_TOO_LONG"))
        .when(spec.rlike(r"(?i)[\\/]|\.(pdf|tif|tiff|png|jpe?g)$"), F.lit("SPECIFICATION_IS_A_PATH"))
    )
    source = _text("$.senderFaxNumberSource")
    bad_source = F.when(
        _given("$.senderFaxNumberSource") & (source.isNull() | ((source != "") & ~source.isin(*FAX_SOURCES))),
        F.lit("BAD_FAX_SOURCE"),
    )
    checks = F.array_compact(
        F.array(
            bad_code("$.documentCategory", "UNKNOWN_CATEGORY"),
            bad_code("$.runnerUpCategory", "UNKNOWN_RUNNER_UP"),
            bad_spec,
            bad_confidence("modelConfidence"),
            bad_confidence("runnerUpConfidence"),
            *[bad_list(k) for k in LIST_KEYS],
            bad_source,
        )
    )
    unusable = F.array(F.lit("UNPARSEABLE"))
    is_object = F.schema_of_variant("parsed").startswith("OBJECT")
    absent = F.transform("missing", lambda k: F.concat(F.lit("MISSING:"), k))
    df = df.withColumn(
        "errors",
        F.when(F.col("parsed").isNull(), unusable)
        .when(~is_object, F.array(F.lit("NOT_AN_OBJECT")))
        .otherwise(F.concat(absent, checks)),
    )

    def text_list(key: str) -> Column:
        items = F.try_variant_get("parsed", f"$.{key}", "array<variant>")
        strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
        trimmed = F.transform(strings, lambda v: strip(v.cast("string")))
        return F.coalesce(F.filter(trimmed, lambda s: s != ""), F.array().cast("array<string>"))

    subtype = _text("$.documentSubtype")
    return df.withColumns(
        {
            "category": _text("$.documentCategory"),
            "subtype": subtype,
            "subtype_known": F.coalesce(F.array_contains("__subtypes", subtype), F.lit(False)),
            "model_confidence": F.try_variant_get("parsed", "$.modelConfidence", "double"),
            "runner_up_confidence": F.try_variant_get("parsed", "$.runnerUpConfidence", "double"),
            "specification": spec,
            "sender_organization": _text("$.senderOrganization"),
            "sender_callback_fax": _text("$.senderCallbackFax"),
            "response_deadline": parse_deadline(_text("$.responseDeadline")),
            "evidence": text_list("evidence"),
            "routing_evidence": text_list("routingEvidence"),
            "naming_evidence": text_list("namingEvidence"),
        }
    ).drop("__codes", "__subtypes")


def split_responses(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usable answers and the quarantined ones."""
    usable = F.size("errors") == 0
    good = landed.filter(usable).drop("errors", "missing", "body", "parsed")
    return good, landed.filter(~usable)


def error_counts(landed: DataFrame) -> DataFrame:
    """How many answers carry each error code."""
    return (
        landed.select(F.explode_outer("errors").alias("code"))
        .groupBy(F.coalesce("code", F.lit("OK")).alias("code"))
        .agg(F.count("*").alias("n"))
    )


def land_extractions(raw: DataFrame, prompt_version: str, model_name: str, col: str = "raw") -> DataFrame:
    """Extraction answers with every default filled in; an unreadable one becomes an empty record.

    Needs ``tracking_id`` and ``category`` beside the raw text.  Of a repeated key the last value
    counts.  The four parts are JSON texts with their keys in order; a part that is null counts as missing.
    """
    df = parse_responses(raw, col)
    readable = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))

    def part(key: str) -> Column:
        value = F.to_json(F.try_variant_get("parsed", f"$.{key}", "variant"))
        return F.coalesce(F.when(readable & (_kind(f"$.{key}") != "VOID"), value), F.lit("{}"))

    def number_or(path: str, default: int) -> Column:
        return F.coalesce(F.when(readable, F.try_variant_get("parsed", path, "long")), F.lit(default).cast("long"))

    def text_or(path: str, default: Column) -> Column:
        return F.coalesce(F.when(readable, _text(path)), default)

    return df.withColumns(
        {
            "schema_version": text_or("$.schemaVersion", F.lit("1")),
            "tracking_id": text_or("$.trackingId", F.col("tracking_id")),
            "category": text_or("$.category", F.col("category")),
            "core_json": part("core"),
            "category_json": part("categoryData"),
            "confidences_json": part("extraction.fieldConfidences"),
            "evidence_json": part("extraction.fieldEvidence"),
            "prompt_version": text_or("$.extraction.promptVersion", F.lit(prompt_version)),
            "model_name": text_or("$.extraction.modelName", F.lit(model_name)),
            "latency_ms": number_or("$.extraction.latencyMs", 0),
            "error": F.when(~readable, F.lit("EXTRACTION_PARSE_FAILED")),
        }
    ).drop("body", "parsed", col)
