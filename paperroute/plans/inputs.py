"""Input tables for the registered queries: views over the driver tables.

Each view is one SELECT that reads the same in Spark SQL and in DuckDB; ``@name`` refers to a
base table or another view, ``@sha(..)`` and ``@ms(..)`` to the two functions whose names differ.
The views hold no operator logic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

_CODES = [
    "CONSULTATION_REPORT", "LAB_REPORT", "RADIOLOGY_REPORT", "PROCEDURE_REPORT", "HOSPITAL_RECORD",
    "HOMECARE", "FORM", "ROI_CONSENT", "MISCELLANEOUS", "UNKNOWN", "PRIOR_AUTHORIZATION",
]
_FOLDERS = [
    "Consultation Reports", "Lab Reports", "Radiology Reports", "Procedure Reports", "Hospital Records",
    "Homecare", "Forms", "ROI Consent Form", "Miscellaneous", "Manual-Review", "Manual-Review",
]


def _choose(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def _str(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _pad(expr: str, n: int) -> str:
    return f"lpad({_str(expr)}, {n}, '0')"


def _hundredths(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE) / CAST(100 AS DOUBLE)"


_FILE_NAME = f"""CASE WHEN doc_id % 13 = 0 THEN concat('plain_document_', {_str('doc_id')}, '.pdf')
 ELSE concat('(', {_str('200 + doc_id % 700')}, ')555-', {_pad('doc_id % 10000', 4)}, '_2026-', {_pad('1 + doc_id % 12', 2)},
 '-', {_pad('1 + doc_id % 28', 2)}, '_', {_pad('1 + doc_id % 12', 2)}, {_pad('doc_id % 60', 2)},
 CASE WHEN doc_id % 2 = 0 THEN 'AM' ELSE 'PM' END,
 CASE WHEN doc_id % 11 = 0 THEN '.tmp' WHEN doc_id % 11 = 1 THEN '.png' ELSE '.pdf' END) END"""

VIEWS: dict[str, str] = {
    "v_docs": f"""
SELECT doc_id AS id, concat('t-', {_pad('doc_id', 8)}) AS tracking_id, {_FILE_NAME} AS original_file_name,
 CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '  ' ELSE concat('+1212555', {_pad('doc_id % 10000', 4)}) END AS sender_fax_number,
 CASE WHEN doc_id % 10 < 4 THEN 'ROUTED' WHEN doc_id % 10 < 7 THEN 'CLASSIFIED' WHEN doc_id % 10 = 7 THEN 'ERRORED' WHEN doc_id % 10 = 8 THEN 'OCR' ELSE 'RECEIVED' END AS processing_status,
 CASE WHEN doc_id % 10 = 7 THEN 'CLASSIFY_FAILED' END AS error_reason,
 CAST(DATE '2026-01-01' + CAST(doc_id % 200 AS INT) AS TIMESTAMP) AS created_at,
 n_chars * 997 AS size_bytes, doc_id % 61 AS pages, doc_id % 97 AS page_variance,
 CASE doc_id % 7 WHEN 0 THEN '89504E47' WHEN 1 THEN '4D5A9000' ELSE '25504446' END AS head_hex,
 doc_id % 53 <> 0 AS opens, doc_id % 59 <> 0 AS renders FROM @documents""",
    "v_files": f"""
SELECT d.doc_id, concat('/intake/', CASE WHEN d.doc_id % 17 = 0 THEN '_processed/' WHEN d.doc_id % 5 = 0 THEN concat(d.source, '/deep/') ELSE '' END,
 CASE WHEN d.doc_id % 31 = 0 THEN '~$' ELSE '' END, v.original_file_name) AS path, v.created_at AS modified_at, d.text FROM @documents d JOIN @v_docs v ON v.id = d.doc_id""",
    "v_cls": f"""
SELECT doc_id, {_choose('doc_id % 11', _CODES)} AS category,
 CASE WHEN doc_id % 23 = 0 THEN NULL ELSE {_hundredths('(doc_id * 37) % 101')} END AS model_confidence,
 {_hundredths('(doc_id * 17) % 61')} AS runner_up_confidence, n_chars AS ocr_char_count, doc_id % 9 <> 0 AS render_ok FROM @documents""",
    "v_scored": f"""
SELECT doc_id, CASE WHEN doc_id % 47 = 0 THEN NULL ELSE {_choose('doc_id % 11', _CODES)} END AS category,
 CASE WHEN doc_id % 5 = 0 THEN 'PATHOLOGY_REPORT' WHEN doc_id % 5 = 1 THEN 'XRAY_REPORT' WHEN doc_id % 5 = 2 THEN 'FMLA_CERTIFICATION' END AS subtype,
 CASE WHEN doc_id % 23 = 0 THEN NULL ELSE {_hundredths('(doc_id * 37) % 101')} END AS calibrated_confidence,
 CASE WHEN doc_id % 29 = 0 THEN NULL WHEN (doc_id * 37) % 101 >= 85 THEN 'HIGH' WHEN (doc_id * 37) % 101 >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band,
 CASE WHEN doc_id % 19 = 0 THEN NULL ELSE doc_id % 6 = 0 END AS force_manual_review,
 CASE WHEN doc_id % 3 = 0 THEN concat('Clinic ', source) WHEN doc_id % 3 = 1 THEN ' ' END AS sender_organization,
 CASE WHEN doc_id % 5 = 0 THEN concat('212555', {_pad('doc_id % 10000', 4)}) END AS sender_callback_fax,
 CASE WHEN doc_id % 6 = 2 THEN concat('+1212555', {_pad('doc_id % 300', 4)}) WHEN doc_id % 6 = 3 THEN ' ' END AS sender_fax,
 CASE WHEN doc_id % 4 <> 0 THEN concat('Report ', {_str('doc_id % 50')}, '.pdf') END AS suggested_file_name,
 concat('report_', {_str('doc_id % 50')}, '.pdf') AS alternate_file_name,
 CASE WHEN doc_id % 8 <> 0 THEN n_chars % 9000 END AS latency_ms, doc_id % 4 = 1 AS action_required,
 DATE '2026-03-01' + CAST(doc_id % 40 AS INT) AS response_deadline,
 CAST(DATE '1995-01-01' + CAST(doc_id % 900 AS INT) AS TIMESTAMP) AS classified_at FROM @documents""",
    "v_name": f"""
SELECT d.doc_id, {_choose('d.doc_id % 11', _CODES)} AS category,
 CASE d.doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'us abdomen' WHEN 2 THEN 'chest x-ray' WHEN 3 THEN 'Insurance Letter' WHEN 4 THEN 'home_care form' WHEN 5 THEN ' allergy consult. ' WHEN 6 THEN 'EGD egd pathology' WHEN 7 THEN 'follow-up visit' ELSE concat('panel ', d.source) END AS specification,
 CASE d.doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Example Eye Care, PC' WHEN 2 THEN 'North Lab / East & West, LLC' WHEN 3 THEN ' . ' WHEN 4 THEN 'A Very Long Name Of A Medical Center In Some Town Inc.' WHEN 5 THEN 'LLC' ELSE concat('Clinic ', d.source) END AS sender_organization,
 CASE WHEN d.doc_id % 5 = 0 THEN 'PATHOLOGY_REPORT' WHEN d.doc_id % 5 = 1 THEN 'INSURANCE_LETTER' WHEN d.doc_id % 5 = 2 THEN 'HOME_HEALTH_PLAN_OF_CARE' END AS subtype,
 v.original_file_name FROM @documents d JOIN @v_docs v ON v.id = d.doc_id""",
    "v_quote": """
SELECT doc_id, 0 AS pos, substr(text, 1, 30) AS quote FROM @documents
UNION ALL SELECT doc_id, 1, translate(substr(text, 5, 40), 'e', 'x') FROM @documents
UNION ALL SELECT d.doc_id, 2, substr(b.text, 1, 40) FROM @documents d JOIN @benchmark b ON b.item_id = d.doc_id % 40""",
    "v_evidence": """
SELECT doc_id, 0 AS pos, concat(' ', substr(text, 1, 25), ' ') AS quote FROM @documents
UNION ALL SELECT doc_id, 1, CASE doc_id % 5 WHEN 0 THEN 'Dear Dr.' WHEN 1 THEN 'Imp/Plan:' WHEN 2 THEN '   ' WHEN 3 THEN 'Thank you again for the visit' ELSE 'Glaucoma suspect' END FROM @documents
UNION ALL SELECT doc_id, 2, CASE doc_id % 4 WHEN 0 THEN translate(substr(text, 1, 25), 'aeinot', 'AEINOT') WHEN 1 THEN 'GLAUCOMA suspect' WHEN 2 THEN NULL ELSE 'privileged and confidential' END FROM @documents
UNION ALL SELECT doc_id, 3, lang FROM @documents""",
    "v_decision": f"""
SELECT o_orderkey AS id, o_custkey AS doc_id, o_orderdate AS decided_at,
 CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'SUGGESTED' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'MANUAL_REVIEW' ELSE 'OVERRIDDEN' END END AS routing_status,
 {_choose('o_orderkey % 11', _FOLDERS)} AS suggested_folder,
 CASE WHEN o_orderstatus = 'F' THEN {_choose('o_orderkey % 11', _FOLDERS)} WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Manual-Review' ELSE {_choose('(o_orderkey + 1) % 11', _FOLDERS)} END AS final_folder,
 CASE WHEN o_orderkey % 6 <> 0 THEN concat('Name ', {_str('o_orderkey % 40')}, '.pdf') END AS suggested_file_name,
 CASE WHEN o_orderstatus <> 'O' THEN concat('Name ', {_str('o_orderkey % 45')}, '.pdf') END AS final_file_name,
 CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 4 <> 0 THEN concat('/data', chr(92), 'Outbound/', {_str('o_orderkey % 30')}, '/Name ', {_str('o_orderkey % 45')}, '.pdf') END AS final_path,
 CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_orderkey % 5 = 0 END AS file_name_overridden, substr(o_orderpriority, 1, 1) AS decided_by,
 CASE WHEN o_orderkey % 7 = 0 THEN 'wrong, "other" folder' END AS override_reason, concat('category:', {_choose('o_orderkey % 11', _CODES)}) AS rule_matched FROM @orders""",
    "v_meta": f"""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 9 = 0 THEN 'not json' WHEN c_custkey % 9 = 1 THEN NULL ELSE concat('{{"senderOrganization":"', CASE WHEN c_custkey % 4 = 0 THEN ' ' WHEN c_custkey % 4 = 1 THEN 'null' ELSE c_name END, '","senderFax":', CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE concat('"', {_str('2125550000 + c_custkey')}, '"') END, ',"patientName":"x","destinationFax":"', {_str('c_custkey % 7')}, '"}}') END AS core_json,
 concat('{{"requested":{{"name":"', c_mktsegment, '","dose":', {_str('c_custkey % 10')}, '}},"codes":["A01","', {_str('c_custkey % 3')}, '"],"note":null}}') AS category_json,
 CASE WHEN c_custkey % 2 = 0 THEN concat('{{"category":"', {_choose('c_custkey % 11', _CODES)}, '"}}') ELSE '{{}}' END AS extraction_json,
 CASE WHEN c_custkey % 5 <> 0 THEN '2' END AS schema_version,
 CAST(DATE '2026-01-01' + CAST(c_custkey % 100 AS INT) AS TIMESTAMP) AS created_at,
 '{{"core.senderFax":0.9,"categoryData.requested.name":"80%"}}' AS confidences_json, '{{"core.senderFax":"Fax: 212"}}' AS evidence_json FROM @customer""".replace("{{", "{").replace("}}", "}"),
    "v_ledger": f"""
SELECT @sha(concat('c', {_str('o_orderkey')})) AS content_sha256, concat('/in/old_', {_str('o_orderkey')}, '.pdf') AS source_path,
 CASE o_orderkey % 9 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'AWAITING_HYDRATION' WHEN 2 THEN 'UNSTABLE' WHEN 3 THEN 'INGESTED' WHEN 4 THEN 'PROCESSING' WHEN 5 THEN 'FILED' WHEN 6 THEN 'FAILED' WHEN 7 THEN 'QUARANTINED' ELSE 'SKIPPED_DUPLICATE' END AS state,
 CASE WHEN o_orderkey % 4 = 0 THEN 'UPLOAD' ELSE 'SCANNER' END AS origin,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS next_attempt_at, o_orderdate AS first_seen_at, o_orderdate AS last_seen_at,
 CASE WHEN o_orderkey % 9 = 5 OR o_orderkey % 27 = 7 THEN {_choose('o_orderkey % 11', _FOLDERS)} END AS routed_folder,
 CASE WHEN o_orderkey % 9 = 5 THEN concat('Name ', {_str('o_orderkey % 40')}, '.pdf') END AS routed_file_name FROM @orders WHERE o_orderkey % 3 < 2""",
    "v_manifest": f"""
SELECT @sha(concat('c', {_str('l_partkey')})) AS content_sha256, concat('/in/', {_str('l_orderkey')}, '_', {_str('l_linenumber')}, '_', {_str('l_suppkey')}, '.pdf') AS source_path,
 l_shipdate AS seen_at, CAST(l_quantity AS BIGINT) * 1000 AS source_size_bytes FROM @lineitem""",
    "v_event": f"""
SELECT event_id, ts, concat('p', {_str('user_id')}) AS path, @sha(concat('u', {_str('user_id')})) AS content_sha256, user_id AS doc_id,
 CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RETRY' ELSE CASE WHEN event_id % 211 = 0 THEN 'FILED' ELSE 'INGESTED' END END AS kind,
 CASE event_type WHEN 'signup' THEN 'DISCOVERED' WHEN 'view' THEN 'INGESTED' WHEN 'click' THEN 'UNSTABLE' WHEN 'error' THEN 'FAILED' ELSE 'FILED' END AS state,
 CASE event_type WHEN 'signup' THEN 'CLAIMED' WHEN 'view' THEN 'KNOWN' WHEN 'click' THEN 'NOT_READY' WHEN 'error' THEN 'FAILED' ELSE CASE WHEN event_id % 2 = 0 THEN 'INGESTED' ELSE 'DEFERRED' END END AS outcome,
 CAST(floor(event_id / 4) AS BIGINT) AS cycle,
 CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 0 ELSE user_id % 7 * 100 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END END AS size_bytes,
 CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 6 = 0 THEN @ms(ts) - 5000 ELSE 1700000000000 END AS mtime_ms,
 CASE event_id % 10 WHEN 0 THEN '4D5A9000' WHEN 1 THEN '2550' ELSE '255044462D312E37' END AS head_hex FROM @events""",
    "v_usage": f"""
SELECT concat('o', {_str('l_orderkey')}) AS tracking_id, CAST(l_linenumber AS BIGINT) AS call_no, CASE WHEN l_returnflag = 'R' THEN 'extract' ELSE 'classify' END AS stage,
 CASE l_partkey % 5 WHEN 0 THEN 'model-a-1-20260101' WHEN 1 THEN 'model-a' WHEN 2 THEN 'model-b-2' WHEN 3 THEN 'model-b' ELSE CASE WHEN l_suppkey % 3 = 0 THEN 'other' ELSE 'model-b' END END AS model,
 CAST(l_quantity * 100 AS BIGINT) AS input_tokens, CAST(l_quantity * 10 AS BIGINT) AS output_tokens, CAST(l_suppkey % 50 AS BIGINT) AS cache_read_tokens,
 CASE WHEN l_linenumber % 2 = 0 THEN concat('f', {_str('l_orderkey')}, '.pdf') END AS file_name, CASE WHEN l_linenumber > 2 THEN 'FORM' END AS category,
 concat(CAST(CAST(l_shipdate AS DATE) AS STRING), 'T0', {_str('l_linenumber')}, ':00:00') AS used_at, l_linenumber % 3 = 0 AS repaired FROM @lineitem""",
    "v_field": f"""
SELECT concat('c', {_str('c_custkey')}) AS doc_id, 'core.senderFax' AS field_key, {_str('2125550000 + c_custkey * 7919 % 900000000')} AS value, {_str('c_custkey % 101')} AS confidence FROM @customer
UNION ALL SELECT concat('s', {_str('s_suppkey')}), 'core.prescriberNpi', {_str('1234567000 + s_suppkey')}, concat({_str('s_suppkey % 101')}, '%') FROM @supplier
UNION ALL SELECT concat('s', {_str('s_suppkey')}), 'core.prescriberDea', concat('ab', {_pad('s_suppkey * 7907 % 10000000', 7)}), '0.9' FROM @supplier
UNION ALL SELECT concat('s', {_str('s_suppkey')}), 'categoryData.ncpdpId', {_str('s_suppkey * 104729')}, CASE WHEN s_suppkey % 3 = 0 THEN 'high' WHEN s_suppkey % 3 = 1 THEN NULL ELSE '0.7' END FROM @supplier
UNION ALL SELECT concat('n', {_str('c_custkey')}), 'categoryData.icd10Codes', CASE c_custkey % 4 WHEN 0 THEN 'a01.1' WHEN 1 THEN ' B20 ' WHEN 2 THEN 'C1' ELSE NULL END, '0.55' FROM @customer
UNION ALL SELECT concat('p', {_str('p_partkey')}), 'categoryData.dueDate', concat('20', {_pad('p_partkey % 60', 2)}, '-', {_pad('1 + p_partkey % 14', 2)}, '-10'), '0.8' FROM @part
UNION ALL SELECT concat('p', {_str('p_partkey')}), 'core.documentDate', concat('19', {_pad('p_partkey % 100', 2)}, '-01-10'), '1.0' FROM @part
UNION ALL SELECT concat('p', {_str('p_partkey')}), 'categoryData.remark', p_name, '0.35' FROM @part""",
    "v_field_label": f"""
SELECT concat('c', {_str('c_custkey')}) AS doc_id, 'core.senderFax' AS field_key, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('+1 (', substr({_str('2125550000 + c_custkey * 7919 % 900000000')}, 1, 3), ') ', substr({_str('2125550000 + c_custkey * 7919 % 900000000')}, 4, 7)) ELSE {_str('2125550000 + c_custkey')} END AS expected, c_custkey % 10 = 0 AS review FROM @customer
UNION ALL SELECT concat('p', {_str('p_partkey')}), 'categoryData.remark', CASE p_partkey % 3 WHEN 0 THEN concat(' ', upper(p_name)) WHEN 1 THEN p_brand ELSE NULL END, p_partkey % 8 = 0 FROM @part
UNION ALL SELECT concat('s', {_str('s_suppkey')}), 'core.responseFax', CASE WHEN s_suppkey % 2 = 0 THEN '2125550199' END, false FROM @supplier""",
    "v_drug": f"""
SELECT p_partkey AS doc_id, CASE p_partkey % 7 WHEN 0 THEN 'ATORVASTATIN' WHEN 1 THEN 'atorvastatn' WHEN 2 THEN ' Metformin' WHEN 3 THEN 'OMEPRAZOL' WHEN 4 THEN upper(p_name) WHEN 5 THEN 'LEVOTHYROXINE SODUM' ELSE concat(upper(p_type), 'IN') END AS drug FROM @part""",
    "v_term": """
SELECT DISTINCT translate(split_part(split_part(text, ' ', 2 + CAST(item_id % 30 AS INT)), '.', 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS term FROM @benchmark
UNION SELECT DISTINCT translate(split_part(text, ' ', 4), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM @documents UNION SELECT DISTINCT translate(split_part(text, ' ', 9), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM @documents""",
    "v_misspelt": """
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN w WHEN length(w) < 5 THEN concat(w, 'E') WHEN doc_id % 6 = 1 THEN concat(substr(w, 1, k - 1), substr(w, k + 1)) WHEN doc_id % 6 = 2 THEN concat(substr(w, 1, k), 'E', substr(w, k + 1))
 WHEN doc_id % 6 = 3 THEN concat(substr(w, 1, k - 1), 'Q', substr(w, k + 1)) WHEN doc_id % 6 = 4 THEN concat(substr(w, 1, k - 1), substr(w, k + 1, 1), substr(w, k, 1), substr(w, k + 2)) WHEN doc_id % 18 = 5 THEN NULL ELSE concat(w, ' ', w) END AS word
FROM (SELECT doc_id, w, 2 + CAST(doc_id % (length(w) + 1) AS INT) % 7 AS k FROM (SELECT doc_id, translate(split_part(text, ' ', 4), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS w FROM @documents) AS a) AS b""",
    "v_extraction": f"""
SELECT doc_id, concat('t-', {_str('doc_id')}) AS tracking_id, CASE WHEN doc_id % 2 = 0 THEN 'FORM' ELSE 'LAB_REPORT' END AS category,
 CASE doc_id % 7 WHEN 0 THEN concat('{{"schemaVersion":"2","trackingId":"x', {_str('doc_id')}, '","core":{{"fax":"', {_str('n_chars')}, '"}},"categoryData":{{"n":', {_str('doc_id')}, ',"tags":["', lang, '","b"]}},"extraction":{{"promptVersion":"p9","modelName":"m2","latencyMs":', {_str('n_chars')}, ',"fieldConfidences":{{"core.fax":0.5}},"fieldEvidence":{{"core.fax":"Fax"}}}}}}')
  WHEN 1 THEN concat('```json', chr(10), '{{"schemaVersion":"1","core":{{"a":1}},"category":"HOMECARE","core":{{"b":"', source, '"}},"schemaVersion":"3"}}', chr(10), '```')
  WHEN 2 THEN substr(text, 1, 60) WHEN 3 THEN concat('Here it is: {{"categoryData":{{"x":[1,', {_str('doc_id')}, ']}},"core":null,"extraction":{{"latencyMs":7}}}} Done.')
  WHEN 4 THEN NULL WHEN 5 THEN '[1, 2]' ELSE concat('{{"extraction":{{"modelName":"', source, '"}},"extraction":{{"promptVersion":"', lang, '"}}}}') END AS raw FROM @documents""".replace("{{", "{").replace("}}", "}"),
    "v_feedback": f"""
SELECT conv_id AS doc_id, turn AS seq, CASE WHEN turn % 3 = 0 THEN ' up' WHEN turn % 3 = 1 THEN 'DOWN' WHEN conv_id % 2 = 0 THEN 'down ' ELSE 'maybe' END AS verdict,
 CASE WHEN turn % 4 = 1 THEN '  ' ELSE text END AS summary, CAST(DATE '1995-06-01' + CAST(conv_id % 300 + turn AS INT) AS TIMESTAMP) AS given_at FROM @conversations""",
    "v_feedback_row": f"""
SELECT CAST(DATE '2026-02-01' + CAST(conv_id % 50 AS INT) AS TIMESTAMP) AS created_at, CASE WHEN turn % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS verdict,
 concat('t-', {_pad('conv_id', 6)}, '-', {_str('turn')}) AS tracking_id, concat('doc ', {_str('conv_id')}, '.pdf') AS original_file_name, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'Name, 1.pdf' END AS ai_file_name,
 {_choose('conv_id % 11', _FOLDERS)} AS ai_folder, {_choose('conv_id % 11', _CODES)} AS ai_category, CAST(NULL AS STRING) AS ai_subtype,
 CASE WHEN conv_id % 4 <> 0 THEN concat('0.', {_pad('conv_id % 1000', 4)}) END AS ai_confidence, 'ROUTED' AS review_state, CASE WHEN turn % 2 = 1 THEN concat('said "', text, '", ok') END AS summary FROM @conversations""",
    "v_confirm": f"""
SELECT o_orderkey AS confirm_id, o_custkey AS doc_id, o_orderdate AS confirmed_at,
 CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE {_choose('o_orderkey % 11', _FOLDERS)} END AS folder,
 CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '..' WHEN 2 THEN 'a/b: new name' WHEN 3 THEN concat('Name ', {_str('o_orderkey % 40')}, '.pdf') ELSE ' ' END AS file_name,
 CASE WHEN o_orderkey % 4 = 0 THEN ' ' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'better' END AS override_reason, CASE WHEN o_orderkey % 3 = 0 THEN 'anna' END AS decided_by FROM @orders""",
    "v_response": f"""
SELECT doc_id, CASE doc_id % 8
 WHEN 0 THEN concat('```json', chr(10), '{{"documentCategory":"FORM","modelConfidence":0.', {_str('doc_id % 9')}, ',"runnerUpCategory":null,"runnerUpConfidence":0.1,"reason":"r","evidence":["a"," ",5],"senderFaxNumberSource":"NONE","actionRequired":true,"patientIdentifiersPresent":[],"pageCount":1,"containsFillableForm":false,"classificationMode":"OCR","ocrCharCount":5,"specification":"CBC","responseDeadline":"01SEP2026"}}', chr(10), '```')
 WHEN 1 THEN concat('Here it is: {{"documentCategory":"FORM","modelConfidence":1.5}} id ', {_str('doc_id')})
 WHEN 2 THEN '{{"documentCategory":"FORM"' WHEN 3 THEN '' WHEN 4 THEN '{{"documentCategory":"NOPE","modelConfidence":0.5,"evidence":"x","specification":"a/b"}}'
 WHEN 5 THEN 'no json here' WHEN 6 THEN '[1,2]'
 ELSE '{{"documentCategory":"LAB_REPORT","modelConfidence":0.9,"evidence":["a"],"senderFaxNumberSource":"FAX","specification":7}}' END AS raw FROM @documents""".replace("{{", "{").replace("}}", "}"),
    "v_label": f"""
SELECT concat('set/', l.doc_id % 97, '/', {_str('l.doc_id % 150')}, '.pdf') AS path, concat('f', {_str('l.doc_id')}, '.pdf') AS file, CASE WHEN l.doc_id % 37 = 0 THEN NULL ELSE d.lang END AS block,
 {_choose('CASE WHEN l.quality = 1 THEN l.doc_id % 11 ELSE (l.doc_id + 1) % 11 END', _CODES)} AS expected_category, {_choose('CASE WHEN l.quality = 1 THEN l.doc_id % 11 ELSE (l.doc_id + 1) % 11 END', _FOLDERS)} AS expected_folder,
 CASE WHEN l.doc_id % 5 = 0 THEN 'PATHOLOGY_REPORT' WHEN l.doc_id % 5 = 1 THEN 'OTHER_KIND' END AS expected_subtype,
 CASE l.doc_id % 3 WHEN 0 THEN 'Home Care Form' WHEN 1 THEN 'Lab Result' END AS expected_specification, CASE WHEN l.doc_id % 4 = 0 THEN 'lab-result' END AS also_accepted,
 concat('Report ', {_str('l.doc_id % 40')}, '.pdf') AS expected_file_name, CASE WHEN l.doc_id % 6 <> 0 THEN @sha(d.text) END AS content_sha256, l.doc_id FROM @labels l JOIN @documents d ON d.doc_id = l.doc_id""".replace("'set/', l.doc_id % 97, '/'", f"'set/', {_str('l.doc_id % 97')}, '/'"),
    "v_pred": f"""
SELECT concat('f', {_str('doc_id')}, '.pdf') AS file, {_choose('doc_id % 11', _CODES)} AS category,
 CASE WHEN doc_id % 5 = 0 THEN 'PATHOLOGY_REPORT' WHEN doc_id % 5 = 1 THEN 'XRAY_REPORT' END AS subtype, CAST(NULL AS STRING) AS sender_fax,
 CASE doc_id % 4 WHEN 0 THEN 'home-care  FORM' WHEN 1 THEN 'lab_result' WHEN 2 THEN '' END AS specification,
 CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN concat('Clinic_Report-', {_str('doc_id % 50')}, '.pdf') ELSE concat('report  ', {_str('doc_id % 40')}, '.PDF') END AS suggested_file_name,
 CASE WHEN doc_id % 2 = 0 THEN 'Clinic' WHEN doc_id % 7 = 0 THEN '' END AS facility,
 CASE WHEN doc_id % 23 = 0 THEN NULL ELSE {_hundredths('(doc_id * 37) % 101')} END AS calibrated_confidence,
 CASE WHEN (doc_id * 37) % 101 >= 85 THEN 'HIGH' WHEN (doc_id * 37) % 101 >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band,
 CASE WHEN doc_id % 19 = 0 THEN NULL ELSE doc_id % 6 = 0 END AS force_manual_review, n_chars % 9000 AS latency_ms, doc_id FROM @documents WHERE doc_id % 13 <> 0""",
    "v_run": f"""
SELECT file, 1 AS run, category AS predicted_category, calibrated_confidence, latency_ms FROM @v_pred
UNION ALL SELECT file, 2, CASE WHEN doc_id % 7 = 0 THEN 'FORM' ELSE category END, calibrated_confidence * 0.5, latency_ms + 11 FROM @v_pred
UNION ALL SELECT file, 3, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE category END, CASE WHEN doc_id % 2 = 0 THEN calibrated_confidence END, latency_ms + 20 FROM @v_pred""",
    "v_tree": f"""
SELECT CASE doc_id % 6 WHEN 0 THEN concat('By hand/', {_choose('doc_id % 11', _FOLDERS)}, '/') WHEN 1 THEN 'By hand/' WHEN 2 THEN 'Line 7/' WHEN 3 THEN 'Line 8/sub/' ELSE '' END AS folder, concat('f', {_str('doc_id')}, CASE WHEN doc_id % 10 = 9 THEN '.txt' ELSE '.pdf' END) AS name, doc_id FROM @documents""",
    "v_disk": f"""
SELECT concat('/data/Outbound/', {_str('l_orderkey % 30')}, '/', CASE WHEN l_partkey % 40 = 0 THEN '.' ELSE '' END, 'Name ', {_str('l_partkey % 60')}, '.pdf') AS path, CAST(l_quantity AS BIGINT) AS size_bytes, l_shipdate AS modified_at, l_orderkey * 10 + l_linenumber AS row_no FROM @lineitem""",
    "v_plan": f"""
SELECT o_orderkey AS id, concat('t-', {_str('o_orderkey')}) AS tracking_id, {_choose('o_orderkey % 11', _FOLDERS)} AS folder,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Lab Result.pdf' WHEN o_orderkey % 3 = 1 THEN concat('Report ', {_str('o_custkey % 20')}, '.pdf') ELSE concat('Report ', {_str('o_custkey % 20')}, ' (', {_str('2 + o_custkey % 5')}, ').pdf') END AS file_name, o_orderdate AS filed_at FROM @orders""",
    "v_taken": f"""
SELECT {_choose('c_custkey % 11', _FOLDERS)} AS folder, CASE WHEN c_custkey % 2 = 0 THEN concat('Lab Result (', {_str('c_custkey % 90')}, ').pdf') ELSE concat('Report ', {_str('c_custkey % 30')}, '.pdf') END AS file_name FROM @customer""",
    "v_page": """
SELECT CAST(floor(page_id / 4) AS BIGINT) AS doc_id, page_id % 4 AS page, html AS raw_text, CASE WHEN page_id % 3 = 0 THEN concat('read again: ', html) ELSE translate(html, 'e', '') END AS proc_text FROM @pages""",
    "v_native": """
SELECT DISTINCT CAST(floor(page_id / 4) AS BIGINT) AS doc_id, CASE CAST(floor(page_id / 4) AS BIGINT) % 3 WHEN 0 THEN '   short text  ' WHEN 1 THEN ' a native text layer with more than thirty characters ' END AS native_text FROM @pages""",
    "v_deadline": f"""
SELECT p_partkey AS doc_id, CASE p_partkey % 10 WHEN 0 THEN concat('2026-0', {_str('1 + p_partkey % 9')}, '-', {_pad('p_partkey % 32', 2)}) WHEN 1 THEN concat({_str('1 + p_partkey % 31')}, 'SEP2026') WHEN 2 THEN concat('September ', {_str('1 + p_partkey % 30')}, ', 2026') WHEN 3 THEN concat('09/', {_pad('1 + p_partkey % 30', 2)}, '/2026')
 WHEN 4 THEN ' null ' WHEN 5 THEN '' WHEN 6 THEN 'next Tuesday' WHEN 7 THEN concat(' oct ', {_str('1 + p_partkey % 31')}, ' 2026 ') WHEN 8 THEN NULL ELSE '9/1/2026' END AS printed FROM @part""",
    "v_phi": f"""
SELECT doc_id, concat(text, CASE doc_id % 6 WHEN 0 THEN concat(' SSN 123-45-', {_pad('doc_id % 10000', 4)}, ' end') WHEN 1 THEN concat(' DOB: 1/', {_str('1 + doc_id % 28')}, '/1970, seen 02/03/2024') WHEN 2 THEN concat(' MRN: AB-', {_str('doc_id')}, ' Member ID ', {_str('doc_id')}) WHEN 3 THEN ' call 212-555-0100 or 12345678901' WHEN 4 THEN ' on 3-4-26' ELSE '' END) AS text FROM @documents""",
}

_REF = re.compile(r"@(\w+)(\()?")


def _translate(sql: str, functions: dict[str, str], name_of: Callable[[str], str]) -> str:
    if "ms" not in functions:
        sql = sql.replace("@ms(ts)", "(epoch_us(ts) // 1000)")

    def swap(m: re.Match) -> str:
        if m.group(2):
            return functions[m.group(1)] + "("
        return name_of(m.group(1))

    return _REF.sub(swap, sql)


def _refs(sql: str) -> list[str]:
    return [m.group(1) for m in _REF.finditer(sql) if not m.group(2)]


def duckdb_sql(sql: str) -> str:
    """The query with the views it uses in front, for DuckDB."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for ref in _refs(text):
            if ref in VIEWS and ref not in needed:
                visit(VIEWS[ref])
                if ref not in needed:
                    needed.append(ref)

    visit(sql)
    functions = {"sha": "sha256"}
    ctes = [f"{n} AS ({_translate(VIEWS[n].strip(), functions, str)})" for n in needed]
    body = _translate(sql.strip(), functions, str)
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def spark_views(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """A function from table or view name to DataFrame for one data folder."""
    tag = f"pr{zlib.crc32(sf_dir.encode()):08x}"
    done: set[str] = set()

    def name_of(ref: str) -> str:
        if ref not in done:
            get(ref).createOrReplaceTempView(f"{tag}_{ref}")
            done.add(ref)
        return f"{tag}_{ref}"

    def get(ref: str) -> DataFrame:
        if ref in TABLES:
            return spark.read.parquet(f"{sf_dir}/{ref}.parquet")
        text = _translate(VIEWS[ref].strip(), {"sha": "sha", "ms": "ms"}, name_of)
        text = re.sub(r"\bsha\(", "paper_sha(", text)
        text = text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
        text = _inline_functions(text)
        return spark.sql(text)

    return get


def _inline_functions(text: str) -> str:
    """Spell ``paper_sha(x)`` and ``ms(x)`` with their Spark names."""
    out = text
    for name, before, after in (("paper_sha", "sha2(", ", 256)"), ("ms", "unix_millis(CAST(", " AS TIMESTAMP))")):
        while True:
            m = re.search(rf"\b{name}\(", out)
            if not m:
                break
            depth, i = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(out[i], 0)
                i += 1
            out = out[: m.start()] + before + out[m.end() : i - 1] + after + out[i:]
    return out
