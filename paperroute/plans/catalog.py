"""Every operator as a named query over the driver tables, with its SQL counterpart for DuckDB.

A query takes a function from table or view name to DataFrame.  The SQL is written from the
meaning of the operator, not from its plan.  Queries without SQL (similarity scores, JSON repair,
the like) are checked against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import with_exact_round
from ..functions.text import base_name
from ..operators import cost, evaluation, mapping, routing
from ..session import work_dir
from ..sinks import exports
from ..sources import files as file_sources
from ..sources.dimensions import Policy

Get = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[Get], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Test prices: nested prefixes, and a model without a price.
TEST_PRICES = [
    ("model-a", 5.0, 25.0, 6.25, 0.5), ("model-a-1", 15.0, 75.0, 18.75, 1.5),
    ("model-b", 3.0, 15.0, 3.75, 0.3), ("model-b-2", 2.0, 10.0, 2.5, 0.2),
]
AUTO = Policy(mode="AUTO")
SENDERS = [{"sender_fax": "+12125550002", "folder": "Forms"}, {"sender_fax": "+12125550002", "folder": "Homecare"},
           {"sender_fax": "+12125550008", "folder": "Lab Reports"}, {"sender_fax": "+12125550014", "folder": None}]
SUBTYPES = [{"category": "LAB_REPORT", "subtype": "PATHOLOGY_REPORT", "folder": "Lab Reports/Pathology"}]


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Get], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r(expr: str, places: int) -> str:
    """Exact binary rounding in DuckDB."""
    return f"CAST(format('{{:.{places}f}}', CAST({expr} AS DOUBLE)) AS DOUBLE)"


WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '{WS}+', ' ', 'g'), ' ')"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def sql_clerk(expr: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce({expr}, '')), '-_', '  '), '{WS}+', ' ', 'g'), ' ')"


LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY decided_at DESC, id DESC) AS rn FROM @v_decision) WHERE rn = 1)"""
SQL_GATE = "(NOT coalesce(force_manual_review, false) AND confidence_band IS NOT DISTINCT FROM 'HIGH' AND coalesce(calibrated_confidence, 0) >= {t})"
SQL_FOLDER = """CASE {c} WHEN 'CONSULTATION_REPORT' THEN 'Consultation Reports' WHEN 'LAB_REPORT' THEN 'Lab Reports' WHEN 'RADIOLOGY_REPORT' THEN 'Radiology Reports' WHEN 'PROCEDURE_REPORT' THEN 'Procedure Reports' WHEN 'HOSPITAL_RECORD' THEN 'Hospital Records' WHEN 'HOMECARE' THEN 'Homecare' WHEN 'FORM' THEN 'Forms' WHEN 'ROI_CONSENT' THEN 'ROI Consent Form' WHEN 'MISCELLANEOUS' THEN 'Miscellaneous' WHEN 'UNKNOWN' THEN 'Manual-Review' END"""


# ================================================================== sources


def _binary_rows(v: Get) -> DataFrame:
    return v("v_files").select(
        "path", F.col("modified_at").alias("modificationTime"),
        F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"),
    )


@query("src_inbound_manifest", rf"""
SELECT path AS source_path, replace(path, '/intake/', '') AS relative_path, fn AS source_file_name, octet_length(encode(text)) AS source_size_bytes,
 substr(upper(hex(encode(text))), 1, 16) AS head_hex, sha256(text) AS content_sha256,
 CASE WHEN g <> '' THEN concat('+1', regexp_extract(fn, p, 1), regexp_extract(fn, p, 2), regexp_extract(fn, p, 3)) END AS sender_fax_number,
 strftime(lt + CASE WHEN lt >= TIMESTAMP '2026-03-08 03:00:00' AND lt < TIMESTAMP '2026-11-01 02:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M:%S') AS received_at
FROM (SELECT *, CASE WHEN g <> '' THEN CAST(regexp_extract(fn, p, 4) AS TIMESTAMP) + to_hours(CAST(CAST(substr(regexp_extract(fn, p, 5), 1, 2) AS INT) % 12 + CASE WHEN regexp_extract(fn, p, 6) = 'PM' THEN 12 ELSE 0 END AS INT)) + to_minutes(CAST(substr(regexp_extract(fn, p, 5), 3, 2) AS INT)) END AS lt
 FROM (SELECT *, regexp_extract(fn, p, 0) AS g FROM (SELECT *, split_part(path, '/', -1) AS fn, '\((\d{{3}})\)(\d{{3}})-(\d{{4}})_(\d{{4}}-\d{{2}}-\d{{2}})_(\d{{4}})(AM|PM)' AS p FROM @v_files))
 WHERE (fn LIKE '%.pdf' OR fn LIKE '%.png') AND fn NOT LIKE '~$%' AND path NOT LIKE '/intake/_processed/%')""")
def _(v: Get) -> DataFrame:
    df = file_sources.manifest_rows(_binary_rows(v), "/intake", exclude=["_processed", "_failed"])
    return df.drop("source_mtime_ms").withColumn("received_at", F.col("received_at").cast("string"))


@query("src_model_responses", """
SELECT v.tracking_id AS file, r.raw IS NOT NULL AS recorded, length(r.raw) AS chars
FROM @v_docs v LEFT JOIN (SELECT * FROM @v_response WHERE doc_id % 4 <> 1) r ON r.doc_id = v.id""")
def _(v: Get) -> DataFrame:
    answers = v("v_response").filter("doc_id % 4 <> 1").join(
        v("v_docs").select(F.col("id").alias("doc_id"), F.col("tracking_id").alias("file")), "doc_id"
    )
    requested = v("v_docs").select(F.col("tracking_id").alias("file"))
    found = file_sources.replay(requested, answers.select("file", "raw"))
    return found.select("file", "recorded", F.length("raw").cast("long").alias("chars"))


def usage_rows(v: Get) -> DataFrame:
    """Usage lines with nested calls, priced."""
    u = cost.price_calls(v("v_usage").withColumnRenamed("used_at", "at"), TEST_PRICES)
    u = with_exact_round(u, 6, "cost_usd")
    main = F.struct(F.col("stage").alias("call"), "model")
    repair = F.struct(F.lit("repair").alias("call"), "model")
    return u.withColumn("calls", F.when(F.col("repaired"), F.array(main, repair)).otherwise(F.array(main)))


SQL_PRICE = """CASE WHEN model LIKE 'model-a-1%' THEN (input_tokens * 15.0::DOUBLE + output_tokens * 75.0::DOUBLE + cache_read_tokens * 1.5::DOUBLE) WHEN model LIKE 'model-a%' THEN (input_tokens * 5.0::DOUBLE + output_tokens * 25.0::DOUBLE + cache_read_tokens * 0.5::DOUBLE)
 WHEN model LIKE 'model-b-2%' THEN (input_tokens * 2.0::DOUBLE + output_tokens * 10.0::DOUBLE + cache_read_tokens * 0.2::DOUBLE) WHEN model LIKE 'model-b%' THEN (input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE + cache_read_tokens * 0.3::DOUBLE) END"""
SQL_COST = r(f"({SQL_PRICE}) / 1000000", 6)


@query("src_usage_ledger", f"""
SELECT tracking_id, stage, used_at AS "at", input_tokens, output_tokens, {SQL_COST} AS cost_usd, CAST(CASE WHEN repaired THEN 2 ELSE 1 END AS INT) AS calls, false AS malformed
FROM @v_usage WHERE call_no % 5 <> 4 AND used_at >= '1996-06-01'
UNION ALL SELECT NULL, NULL, NULL, 0, 0, NULL, NULL, true FROM @v_usage WHERE call_no % 5 = 4""")
def _(v: Get) -> DataFrame:
    rows = usage_rows(v)
    line = F.to_json(
        F.struct(
            F.col("tracking_id").alias("trackingId"), "stage", "at", F.col("input_tokens").alias("inputTokens"),
            F.col("output_tokens").alias("outputTokens"), F.col("cost_usd").alias("costUsd"), "calls",
        )
    )
    broken = F.col("call_no") % 5 == 4
    folder = work_dir(rows.sparkSession, "usage")
    rows.select(
        F.explode(F.array(F.when(broken, F.lit('{"trackingId": "x", ')).otherwise(line), F.lit(""))).alias("value")
    ).write.text(folder)
    df = file_sources.usage_ledger(rows.sparkSession, folder, since="1996-06-01")
    return df.select(
        "tracking_id", "stage", "at", "input_tokens", "output_tokens", "cost_usd",
        F.size("calls").alias("calls"), "malformed",
    ).withColumn("calls", F.when(~F.col("malformed"), F.col("calls")))


@query("src_manual_tree", """
SELECT concat(folder, name) AS file, CASE WHEN folder LIKE 'By hand/_%' THEN split_part(folder, '/', 2) END AS manual_folder,
 CASE WHEN folder LIKE 'By hand/%' THEN 'reference' WHEN folder <> '' THEN 'fax-line' ELSE 'inbound-root' END AS source,
 CASE WHEN folder LIKE 'Line%' THEN split_part(folder, '/', 1) END AS fax_line, sha256(d.text) AS content_sha256
FROM @v_tree t JOIN @documents d ON d.doc_id = t.doc_id WHERE name LIKE '%.pdf'""")
def _(v: Get) -> DataFrame:
    tree = v("v_tree").join(v("documents").select("doc_id", "text"), "doc_id")
    return file_sources.manual_tree(
        tree.select(F.concat("folder", "name").alias("path"), F.sha2("text", 256).alias("content_sha256")), "By hand"
    )


# ================================================================== sinks


@query("snk_audit_export", """
SELECT coalesce(v.tracking_id, CAST(d.doc_id AS VARCHAR)) AS "trackingId", coalesce(v.original_file_name, '') AS "originalFileName", suggested_folder AS "suggestedFolder", final_folder AS "finalFolder",
 routing_status AS "routingStatus", decided_by AS "decidedBy", override_reason AS "overrideReason", rule_matched AS "ruleMatched", strftime(decided_at, '%Y-%m-%d %H:%M:%S') AS "decidedAt"
FROM @v_decision d LEFT JOIN @v_docs v ON v.id = d.doc_id""")
def _(v: Get) -> DataFrame:
    return exports.audit_export(v("v_decision"), v("v_docs"))


@query("snk_feedback_export", """
SELECT concat_ws(',', '"' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '"', '"' || verdict || '"', '"' || tracking_id || '"', '"' || original_file_name || '"', coalesce('"' || ai_file_name || '"', ''),
 '"' || ai_folder || '"', '"' || ai_category || '"', '', coalesce('"' || ai_confidence || '"', '""'), '"' || review_state || '"', coalesce('"' || replace(summary, '"', '""') || '"', '')) AS line
FROM @v_feedback_row WHERE verdict = 'DOWN'""")
def _(v: Get) -> DataFrame:
    return exports.feedback_line(exports.feedback_export(v("v_feedback_row"), verdict=" down"))


@query("snk_metadata_export", """
SELECT m.doc_id, coalesce(d.tracking_id, 'unknown') AS tracking_id, coalesce(m.schema_version, '1') AS schema_version,
 coalesce(regexp_extract(m.extraction_json, '"category":"([A-Z_]+)"', 1), '') AS stored, s.category AS classified
FROM @v_meta m LEFT JOIN @v_docs d ON d.id = m.doc_id LEFT JOIN @v_scored s ON s.doc_id = m.doc_id
WHERE m.created_at >= TIMESTAMP '2026-01-20' AND m.created_at <= TIMESTAMP '2026-03-01'""")
def _(v: Get) -> DataFrame:
    out = exports.metadata_export(
        v("v_meta"), v("v_docs"), v("v_scored"), date_from="2026-01-20", date_to="2026-03-01"
    )
    record = F.from_json("record", "trackingId string, schemaVersion string, extraction struct<category:string>")
    out = out.join(v("v_scored").select("doc_id", F.col("category").alias("classified")), "doc_id", "left")
    return out.withColumn("rec", record).select(
        "doc_id", F.col("rec.trackingId").alias("tracking_id"), F.col("rec.schemaVersion").alias("schema_version"),
        F.coalesce("rec.extraction.category", F.lit("")).alias("stored"), "classified",
    )


SQL_PER_DOC = f"""
SELECT tracking_id, coalesce(arg_min(file_name, used_at) FILTER (WHERE file_name <> ''), '') AS file_name, coalesce(arg_min(category, used_at) FILTER (WHERE category <> ''), '') AS category,
 coalesce(string_agg(DISTINCT model, ', ' ORDER BY model) FILTER (WHERE stage = 'classify'), '') AS classify_models, coalesce(string_agg(DISTINCT model, ', ' ORDER BY model) FILTER (WHERE stage = 'extract'), '') AS extract_models,
 CAST(sum(CASE WHEN repaired THEN 2 ELSE 1 END) AS BIGINT) AS calls, CAST(sum(CASE WHEN repaired THEN 1 ELSE 0 END) AS BIGINT) AS repairs,
 CAST(coalesce(sum(input_tokens) FILTER (WHERE stage = 'classify'), 0) AS BIGINT) AS classify_input, CAST(coalesce(sum(output_tokens) FILTER (WHERE stage = 'classify'), 0) AS BIGINT) AS classify_output,
 CAST(round(coalesce(sum(c) FILTER (WHERE stage = 'classify'), 0), 4) AS DOUBLE) AS classify_usd,
 CAST(coalesce(sum(input_tokens) FILTER (WHERE stage = 'extract'), 0) AS BIGINT) AS extract_input, CAST(coalesce(sum(output_tokens) FILTER (WHERE stage = 'extract'), 0) AS BIGINT) AS extract_output,
 CAST(round(coalesce(sum(c) FILTER (WHERE stage = 'extract'), 0), 4) AS DOUBLE) AS extract_usd,
 CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read, CAST(sum(input_tokens) AS BIGINT) AS total_input, CAST(sum(output_tokens) AS BIGINT) AS total_output,
 CASE WHEN NOT bool_or(c IS NULL) THEN CAST(round(sum(c), 4) AS DOUBLE) END AS total_usd
FROM (SELECT *, CAST({SQL_COST} AS DECIMAL(20,6)) AS c FROM @v_usage) GROUP BY tracking_id"""


@query("snk_cost_export", SQL_PER_DOC)
def _(v: Get) -> DataFrame:
    return exports.cost_export(cost.cost_per_doc(usage_rows(v)))


SQL_MAPPING = f"""
SELECT t.file, coalesce(t.manual_folder, '') AS manual_folder, CASE WHEN p.file IS NULL THEN 'ERROR' ELSE {SQL_FOLDER.format(c="coalesce(nullif(p.category, 'PRIOR_AUTHORIZATION'), 'UNKNOWN')")} END AS predicted_folder,
 CASE WHEN p.file IS NULL THEN 'no prediction' ELSE coalesce(p.suggested_file_name, '') END AS predicted_file_name,
 CASE WHEN p.file IS NULL OR t.manual_folder IS NULL THEN '' WHEN lower(t.manual_folder) = lower({SQL_FOLDER.format(c="coalesce(nullif(p.category, 'PRIOR_AUTHORIZATION'), 'UNKNOWN')")}) THEN 'YES' ELSE 'NO' END AS match,
 CASE WHEN p.calibrated_confidence IS NULL THEN '' ELSE concat(CAST(CAST(round(p.calibrated_confidence * 100) AS INT) AS VARCHAR), '%') END AS confidence,
 CASE WHEN coalesce(p.force_manual_review, false) THEN 'YES' ELSE '' END AS held_for_review, coalesce(t.fax_line, '') AS fax_line, coalesce(p.category, '') AS category, coalesce(p.subtype, '') AS subtype
FROM (SELECT name AS file, CASE WHEN folder LIKE 'By hand/_%' THEN split_part(folder, '/', 2) END AS manual_folder, CASE WHEN folder LIKE 'Line%' THEN split_part(folder, '/', 1) END AS fax_line FROM @v_tree WHERE name LIKE '%.pdf') t
LEFT JOIN @v_pred p ON p.file = t.file"""


def mapped(v: Get) -> DataFrame:
    manual = file_sources.manual_tree(v("v_tree").select(F.concat("folder", "name").alias("path")), "By hand")
    manual = manual.withColumn("file", base_name(F.col("file")))
    preds = routing.route(v("v_pred")).withColumn("error", F.lit(None).cast("string"))
    return mapping.manual_mapping(manual, preds)


@query("snk_mapping_export", SQL_MAPPING)
def _(v: Get) -> DataFrame:
    df = mapped(v)
    folder = work_dir(df.sparkSession, "mapping")
    exports.mapping_export(df, folder)
    return df.sparkSession.read.schema(df.schema).json(f"{folder}/json")


@query("jn_manual_mapping", SQL_MAPPING)
def _(v: Get) -> DataFrame:
    return mapped(v)


@query("ag_mapping_agreement", f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE match IN ('YES', 'NO')) AS comparable, count(*) FILTER (WHERE match = 'YES') AS agreed, count(*) FILTER (WHERE held_for_review = 'YES') AS held,
 count(*) FILTER (WHERE predicted_folder = 'ERROR') AS errors, count(*) FILTER (WHERE manual_folder = '') AS awaiting_input,
 {r("count(*) FILTER (WHERE match = 'YES') / count(*) FILTER (WHERE match IN ('YES', 'NO'))", 4)} AS agreement_rate FROM ({SQL_MAPPING})""")
def _(v: Get) -> DataFrame:
    return mapping.mapping_agreement(mapped(v))


# ================================================================== evaluation


def labels(v: Get) -> DataFrame:
    return v("v_label").withColumn("accept_specifications", F.array("also_accepted"))


def results(v: Get) -> DataFrame:
    return evaluation.evaluate(v("v_pred"), labels(v))


SQL_RESULTS = f"""
SELECT l.file, coalesce(l.block, 'unspecified') AS block, expected_category, p.category AS predicted_category, expected_folder,
 CASE WHEN p.file IS NOT NULL THEN coalesce({SQL_FOLDER.format(c='p.category')}, 'Manual-Review') END AS predicted_folder, p.calibrated_confidence, p.confidence_band, p.force_manual_review, p.latency_ms,
 CASE WHEN p.file IS NULL THEN 'no prediction' END AS error,
 p.file IS NOT NULL AND p.category IS NOT DISTINCT FROM expected_category AS category_pass, p.file IS NOT NULL AND p.subtype IS NOT DISTINCT FROM expected_subtype AS subtype_pass,
 p.file IS NOT NULL AND coalesce({SQL_FOLDER.format(c='p.category')}, 'Manual-Review') = expected_folder AS folder_pass,
 coalesce(p.specification, '') <> '' AND ({sql_clerk('p.specification')} = nullif({sql_clerk('expected_specification')}, '') OR {sql_clerk('p.specification')} = nullif({sql_clerk('also_accepted')}, '')) IS TRUE AS specification_pass,
 coalesce(p.suggested_file_name, '') <> '' AND {sql_clerk("CASE WHEN p.facility <> '' AND starts_with(p.suggested_file_name, concat(p.facility, '_')) THEN substr(p.suggested_file_name, length(p.facility) + 2) ELSE p.suggested_file_name END")} = {sql_clerk('expected_file_name')} AS filename_pass,
 coalesce(p.facility, '') <> '' AS facility_pass, coalesce(p.confidence_band IN ('HIGH', 'MEDIUM'), false) AND NOT coalesce(p.force_manual_review, false) AS auto_routable
FROM @v_label l LEFT JOIN @v_pred p ON p.file = l.file"""


@query("jn_eval_labels", SQL_RESULTS)
def _(v: Get) -> DataFrame:
    return results(v)


_M = evaluation.METRICS
_PASS = ", ".join(f"count(*) FILTER (WHERE {m}_pass) AS {m}_pass" for m in _M)
_ACC = ", ".join(f"{r(f'count(*) FILTER (WHERE {m}_pass) / count(*)', 4)} AS {m}_accuracy" for m in _M)


@query("ag_eval_summary", f"""
SELECT count(*) AS n_samples, {_PASS}, count(*) FILTER (WHERE facility_pass) AS facility_read, CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_latency_ms,
 {r('count(*) FILTER (WHERE facility_pass) / count(*)', 4)} AS facility_coverage, {_ACC} FROM ({SQL_RESULTS})""")
def _(v: Get) -> DataFrame:
    return evaluation.eval_summary(results(v))


@query("ag_eval_by_block", f"SELECT block, count(*) AS n, {_PASS}, {_ACC} FROM ({SQL_RESULTS}) GROUP BY block")
def _(v: Get) -> DataFrame:
    return evaluation.eval_by_block(results(v))


_CELLS = """count(*) FILTER (WHERE g AND category_pass) AS auto_correct, count(*) FILTER (WHERE g AND NOT category_pass) AS auto_wrong,
 count(*) FILTER (WHERE NOT g AND category_pass) AS review_correct, count(*) FILTER (WHERE NOT g AND NOT category_pass) AS review_wrong"""


@query("ag_gate_quality", " UNION ALL ".join(
    [f"SELECT 'band' AS gate, CAST(NULL AS DOUBLE) AS threshold, {_CELLS} FROM (SELECT *, auto_routable AS g FROM ({SQL_RESULTS}))"]
    + [f"SELECT 'policy', CAST({t} AS DOUBLE), {_CELLS} FROM (SELECT *, {SQL_GATE.format(t=t)} AS g FROM ({SQL_RESULTS}))" for t in (0.85, 0.9, 0.95)]
))
def _(v: Get) -> DataFrame:
    return evaluation.gate_quality(results(v), thresholds=(0.85, 0.9, 0.95))


DISABLED = ("ROI_CONSENT", "UNKNOWN")


@query("ag_gate_curve", f"""
WITH res AS ({SQL_RESULTS}), t AS (SELECT CAST(unnest(range(0, 101)) AS DOUBLE) / 100 AS threshold),
 judged AS (SELECT threshold, category_pass, {SQL_GATE.format(t='threshold')} AS p, {SQL_GATE.format(t='threshold')} AND coalesce(predicted_category, 'UNKNOWN') NOT IN ('ROI_CONSENT', 'UNKNOWN') AS e FROM res CROSS JOIN t)
SELECT 'band' AS gate, CAST(NULL AS DOUBLE) AS threshold, {_CELLS} FROM (SELECT *, auto_routable AS g FROM res)
UNION ALL SELECT 'policy', threshold, {_CELLS} FROM (SELECT *, p AS g FROM judged) GROUP BY threshold
UNION ALL SELECT 'policy_enabled', threshold, {_CELLS} FROM (SELECT *, e AS g FROM judged) GROUP BY threshold""")
def _(v: Get) -> DataFrame:
    """A hundred and one thresholds, with and without the categories that are never filed by themselves."""
    return evaluation.gate_quality(results(v), [i / 100 for i in range(101)], DISABLED)


@query("ag_confusion", f"""
WITH res AS ({SQL_RESULTS}), u AS (SELECT expected_category AS label FROM res WHERE expected_category <> '' UNION SELECT predicted_category FROM res WHERE predicted_category <> '')
SELECT a.label AS expected, b.label AS predicted, count(res.file) AS n FROM u a CROSS JOIN u b LEFT JOIN res ON res.expected_category = a.label AND res.predicted_category = b.label GROUP BY 1, 2""")
def _(v: Get) -> DataFrame:
    return evaluation.confusion(results(v))


@query("so_label_universe", f"SELECT expected_category AS label FROM ({SQL_RESULTS}) UNION SELECT predicted_category FROM ({SQL_RESULTS}) WHERE predicted_category IS NOT NULL")
def _(v: Get) -> DataFrame:
    return evaluation.label_universe(results(v))


@query("ag_repeat_stability", """
SELECT file, arg_min(coalesce(predicted_category, '-'), run) AS predicted_category, arg_min(coalesce(calibrated_confidence, -1), run) AS calibrated_confidence, arg_min(latency_ms, run) AS latency_ms, count(*) AS n_repeat,
 count(DISTINCT coalesce(predicted_category, '-')) = 1 AS deterministic, round(avg(calibrated_confidence), 4) AS mean_confidence, round(coalesce(stddev_samp(calibrated_confidence), 0), 4) AS confidence_std, CAST(floor(avg(latency_ms)) AS BIGINT) AS mean_latency_ms
FROM @v_run GROUP BY file""")
def _(v: Get) -> DataFrame:
    df = evaluation.repeat_stability(v("v_run"))
    return df.withColumns({"predicted_category": F.coalesce("predicted_category", F.lit("-")), "calibrated_confidence": F.coalesce("calibrated_confidence", F.lit(-1.0))})


def run_pair(v: Get) -> DataFrame:
    """Two runs: the second is surer, reads fewer files and names some differently."""
    second = v("v_pred").filter("doc_id % 5 <> 0").withColumns(
        {"category": F.when(F.col("doc_id") % 7 == 0, F.lit("FORM")).otherwise(F.col("category")),
         "calibrated_confidence": F.col("calibrated_confidence") * 0.95, "latency_ms": F.col("latency_ms") + 5}
    )
    a, b = results(v), evaluation.evaluate(second, labels(v).filter("doc_id % 11 <> 3"))
    return evaluation.pair_runs(a, b)


_SECOND = SQL_RESULTS.replace("LEFT JOIN @v_pred p ON", """LEFT JOIN (SELECT file, CASE WHEN doc_id % 7 = 0 THEN 'FORM' ELSE category END AS category, subtype, specification, suggested_file_name, facility, calibrated_confidence * 0.95 AS calibrated_confidence, confidence_band, force_manual_review, latency_ms + 5 AS latency_ms FROM @v_pred WHERE doc_id % 5 <> 0) p ON""") + " WHERE l.doc_id % 11 <> 3"
_PAIR = f"ra AS ({SQL_RESULTS}), rb AS ({_SECOND})"
_RUN_FIGS = (
    [("files", "all", "count(*)")] + [("passed", m, f"count(*) FILTER (WHERE {{s}}.{m}_pass)") for m in _M]
    + [("latency_sum_ms", "all", "CAST(sum(coalesce({s}.latency_ms, 0)) AS BIGINT)")]
)
for _kind, _gate in (("policy_gate", "(NOT coalesce({s}.force_manual_review, false) AND {s}.confidence_band IS NOT DISTINCT FROM 'HIGH' AND coalesce({s}.calibrated_confidence, 0) >= 0.9)"), ("band_gate", "{s}.auto_routable")):
    _RUN_FIGS += [
        (_kind, "auto_correct", f"count(*) FILTER (WHERE {_gate} AND {{s}}.category_pass)"), (_kind, "auto_wrong", f"count(*) FILTER (WHERE {_gate} AND NOT {{s}}.category_pass)"),
        (_kind, "held_correct", f"count(*) FILTER (WHERE NOT {_gate} AND {{s}}.category_pass)"), (_kind, "held_wrong", f"count(*) FILTER (WHERE NOT {_gate} AND NOT {{s}}.category_pass)"),
    ]


@query("jn_run_compare", f"WITH {_PAIR} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{k}' AS key, {e.format(s='ra')} AS a, {e.format(s='rb')} AS b FROM ra JOIN rb USING (file)" for m, k, e in _RUN_FIGS)
    + " UNION ALL SELECT 'block_files', ra.block, count(*), count(*) FROM ra JOIN rb USING (file) GROUP BY ra.block"
    + " UNION ALL SELECT 'block_passed', ra.block, count(*) FILTER (WHERE ra.category_pass), count(*) FILTER (WHERE rb.category_pass) FROM ra JOIN rb USING (file) GROUP BY ra.block")
def _(v: Get) -> DataFrame:
    return evaluation.compare_runs(run_pair(v))


@query("jn_run_differences", f"""WITH {_PAIR} SELECT file, ra.expected_category, ra.predicted_category AS predicted_a, rb.predicted_category AS predicted_b, ra.category_pass AS pass_a, rb.category_pass AS pass_b, coalesce(rb.calibrated_confidence, 0) AS confidence_b
FROM ra JOIN rb USING (file) WHERE ra.category_pass IS DISTINCT FROM rb.category_pass OR ra.predicted_category IS DISTINCT FROM rb.predicted_category""")
def _(v: Get) -> DataFrame:
    return evaluation.run_differences(run_pair(v))


@query("jn_run_misses", f"""WITH {_PAIR} SELECT file, rb.expected_category, rb.predicted_category, coalesce(rb.calibrated_confidence, 0) AS confidence,
 (NOT coalesce(rb.force_manual_review, false) AND rb.confidence_band IS NOT DISTINCT FROM 'HIGH' AND coalesce(rb.calibrated_confidence, 0) >= 0.9) AS would_file FROM ra JOIN rb USING (file) WHERE NOT rb.category_pass""")
def _(v: Get) -> DataFrame:
    return evaluation.run_misses(run_pair(v))


@query("so_common_files", """
WITH a AS (SELECT DISTINCT file FROM @v_pred WHERE doc_id % 3 <> 0), b AS (SELECT DISTINCT file FROM @v_label)
SELECT file, 'both' AS scored_by FROM a WHERE file IN (SELECT file FROM b) UNION ALL SELECT file, 'a' FROM a WHERE file NOT IN (SELECT file FROM b) UNION ALL SELECT file, 'b' FROM b WHERE file NOT IN (SELECT file FROM a)""")
def _(v: Get) -> DataFrame:
    return evaluation.run_overlap(v("v_pred").filter("doc_id % 3 <> 0"), v("v_label"))


def label_table(v: Get) -> DataFrame:
    return v("v_label").select(F.col("path").alias("file"), "content_sha256", F.col("expected_category").alias("label"))


@query("wn_unique_basename", """
SELECT basename, file, label FROM (SELECT split_part(path, '/', -1) AS basename, path AS file, expected_category AS label, count(*) OVER (PARTITION BY split_part(path, '/', -1)) AS n FROM @v_label) WHERE n = 1""")
def _(v: Get) -> DataFrame:
    return evaluation.unique_basenames(label_table(v)).drop("content_sha256")


@query("jn_label_resolution", """
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat(CAST(doc_id % 97 AS VARCHAR), '/', CAST(doc_id % 150 AS VARCHAR), '.pdf') ELSE concat('x/', CAST(doc_id % 400 AS VARCHAR), '.pdf') END AS path, sha256(text) AS sha FROM @documents),
 bp AS (SELECT path, min(expected_category) AS label FROM @v_label GROUP BY path),
 bn AS (SELECT split_part(path, '/', -1) AS bn, min(expected_category) AS label FROM @v_label GROUP BY 1 HAVING count(*) = 1),
 bh AS (SELECT content_sha256 AS sha, arg_max(expected_category, path) AS label FROM @v_label WHERE content_sha256 IS NOT NULL GROUP BY 1)
SELECT f.doc_id, coalesce(bp.label, bn.label, bh.label) AS label, CASE WHEN bp.label IS NOT NULL THEN 'PATH' WHEN bn.label IS NOT NULL THEN 'BASENAME' WHEN bh.label IS NOT NULL THEN 'CONTENT' ELSE 'NONE' END AS resolved_by
FROM f LEFT JOIN bp ON bp.path = concat('set/', f.path) LEFT JOIN bn ON bn.bn = split_part(f.path, '/', -1) LEFT JOIN bh ON bh.sha = f.sha""")
def _(v: Get) -> DataFrame:
    path = F.when(
        F.col("doc_id") % 4 == 0, F.concat((F.col("doc_id") % 97).cast("string"), F.lit("/"), (F.col("doc_id") % 150).cast("string"), F.lit(".pdf"))
    ).otherwise(F.concat(F.lit("x/"), (F.col("doc_id") % 400).cast("string"), F.lit(".pdf")))
    wanted = v("documents").select("doc_id", path.alias("path"), F.sha2("text", 256).alias("content_sha256"))
    return evaluation.resolve_labels(wanted, label_table(v), prefix="set/").select("doc_id", "label", "resolved_by")


@query("snk_eval_report", f"SELECT file, category_pass, folder_pass, 'run-2' AS run_id FROM ({_SECOND})".replace("run-2", "9"))
def _(v: Get) -> DataFrame:
    a = results(v)
    folder = work_dir(a.sparkSession, "eval")
    b = evaluation.evaluate(
        v("v_pred").filter("doc_id % 5 <> 0").withColumn("category", F.when(F.col("doc_id") % 7 == 0, F.lit("FORM")).otherwise(F.col("category"))),
        labels(v).filter("doc_id % 11 <> 3"),
    )
    exports.write_eval_run(a, folder, "10")  # names are text: "9" is the greater one
    exports.write_eval_run(b, folder, "9")
    return exports.latest_eval_run(a.sparkSession, folder, "file string, category_pass boolean, folder_pass boolean").select("file", "category_pass", "folder_pass", "run_id")


@query("snk_extraction_upsert", """
SELECT doc_id, coalesce(schema_version, '1') AS schema_version, core_json, CAST(CAST(created_at AS DATE) AS VARCHAR) AS updated_on FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, src DESC) AS rn FROM (
 SELECT doc_id, coalesce(schema_version, '0') AS schema_version, core_json, created_at, 0 AS src FROM @v_meta WHERE doc_id % 3 <> 0
 UNION ALL SELECT doc_id - doc_id % 2, schema_version, concat('new', CAST(doc_id AS VARCHAR)), created_at, 1 FROM @v_meta WHERE doc_id % 4 < 2)) WHERE rn = 1""")
def _(v: Get) -> DataFrame:
    meta = v("v_meta").select("doc_id", "schema_version", "core_json", "created_at")
    target = meta.filter("doc_id % 3 <> 0").withColumn("schema_version", F.coalesce("schema_version", F.lit("0")))
    updates = meta.filter("doc_id % 4 < 2").select(
        (F.col("doc_id") - F.col("doc_id") % 2).alias("doc_id"), "schema_version",
        F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("core_json"), "created_at",
    )
    df = exports.upsert_latest(target, updates, "doc_id", "created_at")
    return df.select("doc_id", "schema_version", "core_json", F.col("created_at").cast("date").cast("string").alias("updated_on"))
