"""Named queries of the daily operation: intake, decision, lists, people, costs, texts, fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_deadline
from ..functions.similarity import decompose, fn_partial_ratio, fn_seq_ratio
from ..functions.numeric import with_exact_round
from ..functions.text import clerk_form
from ..operators import (
    confidence, cost, dashboard, decisions, evidence, fields, inbox, ledger, lexicon, naming, responses,
    routing, storage, texts,
)
from ..sinks import exports
from ..sources.dimensions import DRUG_NAMES, RETIRED_CATEGORIES, TAXONOMY, Policy
from .catalog import (
    AUTO, LATEST, SENDERS, SQL_COST, SQL_FOLDER, SQL_PER_DOC, SQL_PRICE, SUBTYPES, TEST_PRICES, Get,
    query, r, results, sql_clerk, sql_collapse, sql_strip, usage_rows,
)

# ================================================================== lists


@query("wn_latest_decision", f"SELECT id, doc_id, strftime(decided_at, '%Y-%m-%d') AS decided_on, routing_status, suggested_folder, final_folder FROM {LATEST}")
def _(v: Get) -> DataFrame:
    return inbox.latest_decision(v("v_decision")).select(
        "id", "doc_id", F.date_format("decided_at", "yyyy-MM-dd").alias("decided_on"), "routing_status", "suggested_folder", "final_folder"
    )


_SENDER = """
SELECT doc_id, CASE WHEN core_json IS NULL OR core_json = 'not json' OR doc_id % 4 IN (0, 1) THEN NULL ELSE regexp_extract(core_json, '"senderOrganization":"([^"]*)"', 1) END AS extracted_organization,
 CASE WHEN core_json IS NULL OR core_json = 'not json' OR doc_id % 3 = 0 THEN NULL ELSE regexp_extract(core_json, '"senderFax":"([^"]*)"', 1) END AS extracted_fax,
 CASE WHEN core_json IS NULL OR core_json = 'not json' THEN NULL ELSE regexp_extract(core_json, '"destinationFax":"([^"]*)"', 1) END AS extracted_destination_fax FROM @v_meta"""


@query("prj_sender_whitelist", _SENDER)
def _(v: Get) -> DataFrame:
    return inbox.extracted_sender(v("v_meta"))


_INBOX = f"""
SELECT d.id AS doc_id, d.tracking_id, d.processing_status, s.category, s.confidence_band, coalesce(x.extracted_organization, nullif(trim(s.sender_organization), '')) AS sender_organization,
 CASE WHEN x.extracted_organization IS NOT NULL THEN 'EXTRACTION' WHEN trim(s.sender_organization) <> '' THEN 'DOCUMENT' ELSE 'NONE' END AS sender_organization_source,
 coalesce(x.extracted_fax, s.sender_callback_fax, nullif(trim(d.sender_fax_number), '')) AS sender_fax_number,
 CASE WHEN x.extracted_fax IS NOT NULL THEN 'EXTRACTION' WHEN s.sender_callback_fax IS NOT NULL THEN 'DOCUMENT' WHEN trim(d.sender_fax_number) <> '' THEN 'FILENAME' ELSE 'NONE' END AS sender_fax_number_source,
 x.extracted_destination_fax AS destination_fax, CASE WHEN x.extracted_destination_fax IS NOT NULL THEN 'EXTRACTION' ELSE 'NONE' END AS destination_fax_source,
 l.suggested_folder, l.routing_status, coalesce(l.suggested_file_name, s.suggested_file_name) AS suggested_file_name,
 CASE WHEN d.processing_status = 'ERRORED' OR l.routing_status = 'FAILED' THEN 'crit' WHEN coalesce(s.force_manual_review, false) OR coalesce(l.routing_status = 'MANUAL_REVIEW', false) OR coalesce(s.confidence_band = 'LOW', false) THEN 'warn'
 WHEN d.processing_status NOT IN ('CLASSIFIED', 'ROUTED', 'ERRORED') THEN 'busy' WHEN d.processing_status = 'ROUTED' THEN 'ok' ELSE '' END AS row_state
FROM @v_docs d LEFT JOIN @v_scored s ON s.doc_id = d.id LEFT JOIN {LATEST} l ON l.doc_id = d.id LEFT JOIN ({_SENDER}) x ON x.doc_id = d.id"""
_INBOX_COLS = ["doc_id", "tracking_id", "processing_status", "category", "confidence_band", "sender_organization", "sender_organization_source",
               "sender_fax_number", "sender_fax_number_source", "destination_fax", "destination_fax_source", "suggested_folder", "routing_status", "suggested_file_name", "row_state"]


def inbox_table(v: Get) -> DataFrame:
    return inbox.inbox_rows(v("v_docs"), v("v_scored"), v("v_decision"), v("v_meta")).select(*_INBOX_COLS)


@query("prj_inbox_row", _INBOX)
def _(v: Get) -> DataFrame:
    return inbox_table(v)


@query("jn_inbox", f"SELECT row_state, sender_fax_number_source, count(*) AS n, count(routing_status) AS decided, count(category) AS classified FROM ({_INBOX}) GROUP BY 1, 2")
def _(v: Get) -> DataFrame:
    return inbox_table(v).groupBy("row_state", "sender_fax_number_source").agg(
        F.count("*").alias("n"), F.count("routing_status").alias("decided"), F.count("category").alias("classified")
    )


@query("jn_inbox_page", f"""
SELECT {', '.join(_INBOX_COLS)} FROM ({_INBOX}) WHERE doc_id IN (SELECT id FROM @v_docs WHERE processing_status = 'ROUTED' AND (created_at < TIMESTAMP '2026-05-01' OR (created_at = TIMESTAMP '2026-05-01' AND id < 400)) ORDER BY created_at DESC, id DESC LIMIT 50)""")
def _(v: Get) -> DataFrame:
    """The page behind a given row: its ids first, then only their rows of the other tables."""
    page = inbox.inbox_page(v("v_docs"), v("v_scored"), v("v_decision"), v("v_meta"), 50, ("2026-05-01 00:00:00", 400), status="routed")
    return page.select(*_INBOX_COLS)


@query("flt_inbox_search", """
SELECT d.id, d.tracking_id, s.category, strftime(d.created_at, '%Y-%m-%d') AS created_on FROM @v_docs d JOIN @v_scored s ON s.doc_id = d.id
WHERE processing_status = 'ROUTED' AND s.category = 'FORM' AND lower(original_file_name) LIKE '%pm.pdf%' AND created_at >= TIMESTAMP '2026-01-10' AND created_at <= TIMESTAMP '2026-06-30'
ORDER BY d.created_at DESC, d.id DESC LIMIT 20 OFFSET 0""")
def _(v: Get) -> DataFrame:
    df = inbox.inbox_search(v("v_docs"), v("v_scored"), status="routed", category="FORM", q="PM.pdf", date_from="2026-01-10", date_to="2026-06-30")
    return df.select("id", "tracking_id", "category", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


@query("flt_review_queue", f"""
SELECT d.id AS doc_id, d.tracking_id, d.processing_status, coalesce(s.confidence_band = 'LOW', false) AS low_band, coalesce(s.force_manual_review, false) AS forced,
 coalesce(l.routing_status = 'MANUAL_REVIEW', false) AS manual_status, coalesce(l.final_folder = 'Manual-Review', false) AS sent_to_manual
FROM @v_docs d LEFT JOIN @v_scored s ON s.doc_id = d.id LEFT JOIN {LATEST} l ON l.doc_id = d.id
WHERE d.processing_status IN ('CLASSIFIED', 'ROUTED') AND (coalesce(s.confidence_band = 'LOW', false) OR coalesce(s.force_manual_review, false) OR coalesce(l.routing_status = 'MANUAL_REVIEW', false) OR coalesce(l.final_folder = 'Manual-Review', false))
 AND NOT (coalesce(l.routing_status IN ('CONFIRMED', 'OVERRIDDEN'), false) AND NOT coalesce(l.final_folder = 'Manual-Review', false))""")
def _(v: Get) -> DataFrame:
    return inbox.review_queue(v("v_docs"), v("v_scored"), v("v_decision"))


@query("flt_due_queue", """
SELECT content_sha256, source_path, state, strftime(first_seen_at, '%Y-%m-%d') AS first_seen FROM @v_ledger
WHERE origin = 'SCANNER' AND state IN ('DISCOVERED', 'FAILED', 'AWAITING_HYDRATION', 'UNSTABLE') AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '1996-01-01')
ORDER BY first_seen_at, content_sha256""")
def _(v: Get) -> DataFrame:
    return inbox.due_queue(v("v_ledger"), "1996-01-01").select(
        "content_sha256", "source_path", "state", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen")
    )


@query("topk_recent", "SELECT content_sha256, state, strftime(last_seen_at, '%Y-%m-%d') AS last_seen FROM @v_ledger ORDER BY last_seen_at DESC, content_sha256 LIMIT 25")
def _(v: Get) -> DataFrame:
    return inbox.recent(v("v_ledger")).select("content_sha256", "state", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


def disk(v: Get) -> DataFrame:
    return v("v_disk").withColumns({"folder": F.substring_index("path", "/", 4), "path": F.concat("path", F.lit("#"), F.col("row_no").cast("string"), F.lit("_"), F.col("size_bytes").cast("string"))})


@query("topk_per_folder", """
SELECT folder, path, rank, file_count, file_count > 500 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY modified_at DESC, path) AS rank, count(*) OVER (PARTITION BY folder) AS file_count FROM (
 SELECT array_to_string(str_split(path, '/')[1:4], '/') AS folder, concat(path, '#', CAST(row_no AS VARCHAR), '_', CAST(size_bytes AS VARCHAR)) AS path, modified_at FROM @v_disk)) WHERE rank <= 500""")
def _(v: Get) -> DataFrame:
    return inbox.top_files(disk(v)).select("folder", "path", F.col("rank").cast("long").alias("rank"), "file_count", "truncated")


@query("srt_counts_desc", "SELECT state AS key, count(*) AS n FROM @v_ledger GROUP BY state ORDER BY n DESC, key")
def _(v: Get) -> DataFrame:
    return dashboard.counts_descending(v("v_ledger"), "state")


# ================================================================== intake


@query("flt_document_gate", """
SELECT id, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN mime END AS mime_type, CASE WHEN reason IS NULL THEN CASE WHEN mime = 'application/pdf' THEN pages ELSE 1 END END AS page_count FROM (
 SELECT *, CASE WHEN ext NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'tif', 'tiff') THEN concat('UNSUPPORTED_EXTENSION:', ext) WHEN size_bytes > 26214400 THEN concat('FILE_TOO_LARGE:', CAST(size_bytes AS VARCHAR), '_bytes')
  WHEN mime IS NULL THEN 'UNSUPPORTED_MIME:application/octet-stream' WHEN mime <> 'application/pdf' THEN NULL WHEN NOT opens THEN 'PDF_CANNOT_OPEN' WHEN pages = 0 THEN 'PDF_NO_PAGES' WHEN pages > 50 THEN concat('PDF_TOO_MANY_PAGES:', CAST(pages AS VARCHAR))
  WHEN NOT renders THEN 'PAGE_RENDER_FAILED' WHEN page_variance < 25 THEN 'FIRST_PAGE_BLANK' END AS reason FROM (
  SELECT *, lower(split_part(original_file_name, '.', -1)) AS ext, CASE head_hex WHEN '25504446' THEN 'application/pdf' WHEN '89504E47' THEN 'image/png' END AS mime FROM @v_docs))""")
def _(v: Get) -> DataFrame:
    return ledger.document_gate(v("v_docs").withColumnRenamed("original_file_name", "file_name")).select("id", "valid", "reason", "mime_type", "page_count")


@query("ag_gate_reasons", """
SELECT CASE WHEN ext NOT IN ('pdf', 'png') THEN 'UNSUPPORTED_EXTENSION' WHEN size_bytes > 26214400 THEN 'FILE_TOO_LARGE' WHEN head_hex = '4D5A9000' THEN 'UNSUPPORTED_MIME' WHEN head_hex = '89504E47' THEN 'OK'
 WHEN NOT opens THEN 'PDF_CANNOT_OPEN' WHEN pages = 0 THEN 'PDF_NO_PAGES' WHEN pages > 50 THEN 'PDF_TOO_MANY_PAGES' WHEN NOT renders THEN 'PAGE_RENDER_FAILED' WHEN page_variance < 25 THEN 'FIRST_PAGE_BLANK' ELSE 'OK' END AS reason_code, count(*) AS n
FROM (SELECT *, lower(split_part(original_file_name, '.', -1)) AS ext FROM @v_docs) GROUP BY 1""")
def _(v: Get) -> DataFrame:
    return ledger.gate_reasons(ledger.document_gate(v("v_docs").withColumnRenamed("original_file_name", "file_name")))


_FIRST = """(SELECT content_sha256, source_path, seen_at, source_size_bytes, n - 1 AS later_sightings FROM (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY seen_at, source_path) AS rn, count(*) OVER (PARTITION BY content_sha256) AS n FROM @v_manifest) WHERE rn = 1)"""


@query("wn_first_claim", f"SELECT content_sha256, source_path, later_sightings FROM {_FIRST}")
def _(v: Get) -> DataFrame:
    return ledger.first_sightings(v("v_manifest")).select("content_sha256", "source_path", "later_sightings")


@query("jn_ledger_claim", f"SELECT content_sha256, source_path, source_size_bytes, later_sightings, CASE WHEN content_sha256 IN (SELECT content_sha256 FROM @v_ledger) THEN 'KNOWN' ELSE 'CLAIMED' END AS outcome FROM {_FIRST}")
def _(v: Get) -> DataFrame:
    return ledger.claim(v("v_manifest"), v("v_ledger")).select("content_sha256", "source_path", "source_size_bytes", "later_sightings", "outcome")


@query("jn_duplicate_report", """
SELECT m.content_sha256, min(m.source_path) AS source_path, count(*) AS files, l.state, CASE WHEN l.state IN ('FILED', 'QUARANTINED', 'SKIPPED_DUPLICATE') THEN 'DUPLICATE' ELSE 'IN_PROGRESS' END AS verdict,
 CASE WHEN l.routed_folder IS NOT NULL AND l.routed_file_name IS NOT NULL THEN concat('already filed as ', l.routed_folder, '/', l.routed_file_name) WHEN l.state IN ('FILED', 'QUARANTINED', 'SKIPPED_DUPLICATE') THEN 'already received earlier' ELSE concat('already received and currently ', l.state) END AS detail
FROM @v_manifest m JOIN @v_ledger l ON l.content_sha256 = m.content_sha256 GROUP BY m.content_sha256, l.state, l.routed_folder, l.routed_file_name""")
def _(v: Get) -> DataFrame:
    return ledger.duplicates(v("v_manifest"), v("v_ledger"))


SQL_READY = """
SELECT event_id, path, CASE WHEN size_bytes IS NULL THEN 'UNSTABLE' WHEN size_bytes = 0 THEN 'AWAITING_HYDRATION' WHEN ps IS NOT NULL AND pm IS NOT NULL AND (ps <> size_bytes OR pm <> mtime_ms) THEN 'UNSTABLE'
 WHEN (ps IS NULL OR pm IS NULL) AND @ms(ts) - mtime_ms < 10000 THEN 'UNSTABLE' WHEN length(head_hex) < 8 THEN 'AWAITING_HYDRATION' WHEN head_hex NOT LIKE '25504446%' THEN 'UNSUPPORTED' ELSE 'READY' END AS readiness
FROM (SELECT *, lag(size_bytes) OVER w AS ps, lag(mtime_ms) OVER w AS pm FROM @v_event WINDOW w AS (PARTITION BY path ORDER BY ts))"""


@query("wn_stability_probe", SQL_READY)
def _(v: Get) -> DataFrame:
    return ledger.readiness(v("v_event").withColumnRenamed("ts", "poll_ts")).select("event_id", "path", "readiness")


SQL_RETRY = """
SELECT event_id, content_sha256, CAST(fails - base AS INT) AS attempt, CASE WHEN filed = 1 THEN CASE WHEN kind = 'RETRY' THEN 'RETRY_REFUSED' ELSE 'FILED' END WHEN kind = 'FAILED' AND fails - base >= 3 THEN 'QUARANTINED' WHEN kind = 'FAILED' THEN 'FAILED' WHEN kind = 'INGESTED' THEN 'INGESTED' ELSE 'DISCOVERED' END AS state,
 CASE WHEN filed = 0 AND kind = 'FAILED' AND fails - base < 3 THEN @ms(ts) + CAST(60000 * power(2, fails - base - 1) AS BIGINT) END AS next_attempt_ms
FROM (SELECT *, max(CASE WHEN kind = 'RETRY' AND filed = 0 THEN fails ELSE 0 END) OVER w AS base FROM (
 SELECT *, sum(CASE WHEN kind = 'FAILED' THEN 1 ELSE 0 END) OVER w AS fails, max(CASE WHEN kind = 'FILED' THEN 1 ELSE 0 END) OVER w AS filed FROM @v_event
 WINDOW w AS (PARTITION BY content_sha256 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY content_sha256 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


@query("wn_retry_schedule", SQL_RETRY)
def _(v: Get) -> DataFrame:
    ev = v("v_event").select("content_sha256", "event_id", F.col("ts").alias("at"), "kind")
    return ledger.retry_schedule(ev).select("event_id", "content_sha256", "attempt", "state", "next_attempt_ms")


@query("ag_ledger_status", """
SELECT 'state' AS metric, state AS key, count(*) AS n FROM @v_ledger GROUP BY state UNION ALL SELECT 'backlog', 'all', count(*) FILTER (WHERE state NOT IN ('FILED', 'QUARANTINED', 'SKIPPED_DUPLICATE')) FROM @v_ledger
UNION ALL SELECT 'filed', 'all', count(*) FILTER (WHERE state = 'FILED') FROM @v_ledger UNION ALL SELECT 'quarantined', 'all', count(*) FILTER (WHERE state = 'QUARANTINED') FROM @v_ledger""")
def _(v: Get) -> DataFrame:
    return ledger.ledger_status(v("v_ledger"))


@query("ag_scan_cycle", """
SELECT *, CASE WHEN candidates > 0 AND claimed = 0 AND ingested = 0 THEN concat('ok: nothing new (', CAST(known AS VARCHAR), ' already known, ', CAST(not_ready AS VARCHAR), ' not ready, of ', CAST(candidates AS VARCHAR), ' seen)') ELSE 'ok' END AS note FROM (
SELECT cycle, count(*) FILTER (WHERE outcome IN ('CLAIMED', 'KNOWN', 'NOT_READY')) AS candidates, count(*) FILTER (WHERE outcome = 'CLAIMED') AS claimed, count(*) FILTER (WHERE outcome = 'KNOWN') AS known, count(*) FILTER (WHERE outcome = 'NOT_READY') AS not_ready,
 count(*) FILTER (WHERE outcome = 'INGESTED') AS ingested, count(*) FILTER (WHERE outcome = 'DEFERRED') AS deferred, count(*) FILTER (WHERE outcome = 'FAILED') AS failed FROM @v_event GROUP BY cycle)""")
def _(v: Get) -> DataFrame:
    return ledger.scan_cycles(v("v_event"))


# ================================================================== decision

_ALIAS = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in {**{c: c for c in TAXONOMY}, **RETIRED_CATEGORIES}.items())


@query("prj_category_normalise", f"""
SELECT doc_id, code, CASE upper(translate(trim(code), '- ', '__')) {_ALIAS} ELSE 'UNKNOWN' END AS category_now FROM (
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' lab-report' WHEN 1 THEN 'Follow Up' WHEN 2 THEN 'medical_report' WHEN 3 THEN category WHEN 4 THEN NULL ELSE source END AS code FROM (SELECT c.*, d.source FROM @v_cls c JOIN @documents d USING (doc_id)))""")
def _(v: Get) -> DataFrame:
    df = v("v_cls").join(v("documents").select("doc_id", "source"), "doc_id")
    m = F.col("doc_id") % 6
    code = F.when(m == 0, F.lit(" lab-report")).when(m == 1, F.lit("Follow Up")).when(m == 2, F.lit("medical_report")).when(m == 3, F.col("category")).when(m == 5, F.col("source"))
    return routing.normalise_category(df.select("doc_id", code.alias("code")), "code")


SQL_ROUTE = f"""
SELECT *, CASE sender WHEN '+12125550002' THEN 'sender:+12125550002' WHEN '+12125550008' THEN 'sender:+12125550008' ELSE CASE WHEN category = 'LAB_REPORT' AND subtype = 'PATHOLOGY_REPORT' THEN 'subtype:LAB_REPORT/PATHOLOGY_REPORT' WHEN by_category IS NOT NULL THEN concat('category:', category) ELSE 'unmapped' END END AS rule_matched,
 CASE sender WHEN '+12125550002' THEN 'Forms' WHEN '+12125550008' THEN 'Lab Reports' ELSE CASE WHEN category = 'LAB_REPORT' AND subtype = 'PATHOLOGY_REPORT' THEN 'Lab Reports/Pathology' ELSE coalesce(by_category, 'Manual-Review') END END AS suggested_folder
FROM (SELECT *, coalesce(sender_fax, '') AS sender, {SQL_FOLDER.format(c='category')} AS by_category FROM @v_scored)"""


def routed(v: Get) -> DataFrame:
    return routing.route(v("v_scored"), subtype_overrides=SUBTYPES, sender_overrides=SENDERS)


@query("jn_routing_precedence", f"SELECT doc_id, category, subtype, suggested_folder, rule_matched FROM ({SQL_ROUTE})")
def _(v: Get) -> DataFrame:
    return routed(v).select("doc_id", "category", "subtype", "suggested_folder", "rule_matched")


@query("job_filing_outcome", f"""
SELECT doc_id, meets_gate, hold_reason, CASE WHEN confident THEN 'CONFIRMED' ELSE 'MANUAL_REVIEW' END AS routing_status, CASE WHEN confident THEN suggested_folder ELSE 'Manual-Review' END AS final_folder, true AS filed,
 CASE WHEN forced OR disabled OR NOT meets_gate THEN 'MANUAL_REVIEW' ELSE 'SUGGESTED' END AS suggest_status FROM (
SELECT *, high AND meets_gate AND NOT forced AND NOT disabled AS confident, CASE WHEN forced THEN 'FORCED' WHEN disabled THEN 'CATEGORY_DISABLED' WHEN NOT meets_gate THEN 'BELOW_GATE' WHEN NOT high THEN 'NOT_HIGH_BAND' END AS hold_reason FROM (
SELECT *, coalesce(force_manual_review, false) AS forced, coalesce(category IN ('ROI_CONSENT', 'UNKNOWN'), false) AS disabled, coalesce(calibrated_confidence >= 0.9, false) AS meets_gate, coalesce(confidence_band = 'HIGH', false) AS high FROM ({SQL_ROUTE})))""")
def _(v: Get) -> DataFrame:
    auto = routing.filing_outcome(routed(v), AUTO)
    held = F.col("hold_reason").isin("FORCED", "CATEGORY_DISABLED", "BELOW_GATE")
    suggest = F.when(F.coalesce(held, F.lit(False)), F.lit("MANUAL_REVIEW")).otherwise(F.lit("SUGGESTED"))
    return auto.select("doc_id", "meets_gate", "hold_reason", "routing_status", "final_folder", "filed", suggest.alias("suggest_status"))


def evidence_arrays(v: Get, quotes: str = "v_quote") -> DataFrame:
    """Classifications with their quotes as an array, three per document."""
    text = F.col("text")
    mark = v("benchmark").select(F.col("item_id").alias("__item"), F.substring("text", 1, 40).alias("__mark"))
    docs = v("documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("__item")).join(mark, "__item", "left")
    arr = F.array(F.substring(text, 1, 30), F.translate(F.substring(text, 5, 40), "e", "x"), F.col("__mark"))
    return v("v_cls").join(docs.select("doc_id", arr.alias("evidence")), "doc_id")


def scored_documents(v: Get) -> DataFrame:
    """Classifications calibrated on exact quotes."""
    quoted = evidence_arrays(v)
    return confidence.calibrate(evidence.exact_evidence(quoted, v("documents")))


SQL_CONFIDENCE = f"""
SELECT doc_id, category, {r('cal', 3)} AS calibrated_confidence, {r('ev', 3)} AS evidence_score, {r('q', 3)} AS input_quality_score, {r('ms', 3)} AS margin_score,
 CASE WHEN cal >= 0.85 THEN 'HIGH' WHEN cal >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band, reason AS review_reason, reason IS NOT NULL AS force_manual_review FROM (
SELECT *, CASE WHEN category = 'UNKNOWN' THEN 0.0::DOUBLE WHEN model_confidence IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE * model_confidence + 0.2::DOUBLE * ms + 0.15::DOUBLE * ev + 0.1::DOUBLE * q)) END AS cal,
 CASE WHEN category = 'UNKNOWN' THEN 'UNKNOWN' WHEN margin < 0.15::DOUBLE THEN 'AMBIGUOUS' WHEN ev < 0.34::DOUBLE THEN 'UNVERIFIED_EVIDENCE' END AS reason FROM (
SELECT c.*, model_confidence - runner_up_confidence AS margin, CASE WHEN category = 'UNKNOWN' THEN 0.0::DOUBLE WHEN model_confidence IS NULL THEN NULL ELSE least(1.0::DOUBLE, (model_confidence - runner_up_confidence) / 0.4::DOUBLE) END AS ms,
 CASE WHEN category = 'UNKNOWN' THEN 0.0::DOUBLE WHEN ocr_char_count < 200 THEN 0.5::DOUBLE ELSE e.ev END AS ev,
 CASE WHEN category = 'UNKNOWN' THEN 0.0::DOUBLE ELSE greatest(0.3::DOUBLE, least(1.0::DOUBLE, CASE WHEN render_ok THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END * (0.3::DOUBLE + 0.7::DOUBLE * least(1.0::DOUBLE, CAST(ocr_char_count AS DOUBLE) / 400.0::DOUBLE)))) END AS q
FROM @v_cls c JOIN (SELECT q.doc_id, CAST(count(*) FILTER (WHERE q.quote <> '' AND contains(t.body, {sql_collapse('q.quote')})) AS DOUBLE) / 3 AS ev FROM @v_quote q JOIN (SELECT doc_id, {sql_collapse('text')} AS body FROM @documents) t ON t.doc_id = q.doc_id GROUP BY q.doc_id) e ON e.doc_id = c.doc_id))"""


@query("job_confidence", SQL_CONFIDENCE)
def _(v: Get) -> DataFrame:
    return scored_documents(v).select(
        "doc_id", "category", "calibrated_confidence", "evidence_score", "input_quality_score", "margin_score", "confidence_band", "review_reason", "force_manual_review"
    )


def flagship(v: Get) -> DataFrame:
    """Of all documents: how many file themselves, into which folder, how many go to a person, why."""
    scored = scored_documents(v).withColumns({"subtype": F.lit(None).cast("string"), "sender_fax": F.lit(None).cast("string")})
    out = routing.filing_outcome(routing.route(scored, policy=AUTO), AUTO)
    why = F.coalesce(F.when(F.col("hold_reason") == "FORCED", F.col("review_reason")), "hold_reason", F.lit("AUTO"))
    return out.groupBy(F.coalesce("final_folder", F.lit("")).alias("folder"), "routing_status", why.alias("why")).agg(
        F.count("*").alias("documents"), F.round(F.avg("calibrated_confidence"), 4).alias("mean_confidence")
    )


@query("plan_auto_filing", f"""
SELECT folder, routing_status, why, count(*) AS documents, round(avg(calibrated_confidence), 4) AS mean_confidence FROM (
SELECT calibrated_confidence, CASE WHEN hold IS NULL THEN folder0 ELSE 'Manual-Review' END AS folder, CASE WHEN hold IS NULL THEN 'CONFIRMED' ELSE 'MANUAL_REVIEW' END AS routing_status, coalesce(CASE WHEN hold = 'FORCED' THEN review_reason END, hold, 'AUTO') AS why FROM (
SELECT *, coalesce({SQL_FOLDER.format(c='category')}, 'Manual-Review') AS folder0, CASE WHEN force_manual_review THEN 'FORCED' WHEN category IN ('ROI_CONSENT', 'UNKNOWN') THEN 'CATEGORY_DISABLED' WHEN NOT coalesce(calibrated_confidence >= 0.9, false) THEN 'BELOW_GATE' WHEN confidence_band <> 'HIGH' THEN 'NOT_HIGH_BAND' END AS hold FROM ({SQL_CONFIDENCE}))) GROUP BY 1, 2, 3""")
def _(v: Get) -> DataFrame:
    return flagship(v)


@query("jn_evidence_exact", f"""
SELECT q.doc_id, CAST(3 AS INT) AS quotes_total, CAST(count(*) FILTER (WHERE q.quote <> '' AND contains(t.body, {sql_collapse('q.quote')})) AS INT) AS quotes_exact FROM @v_quote q JOIN (SELECT doc_id, {sql_collapse('text')} AS body FROM @documents) t ON t.doc_id = q.doc_id GROUP BY q.doc_id""")
def _(v: Get) -> DataFrame:
    return evidence.exact_evidence(evidence_arrays(v), v("documents")).select("doc_id", "quotes_total", "quotes_exact")


@query("jn_evidence_verify")
def _(v: Get) -> DataFrame:
    df = evidence.verify_evidence(evidence_arrays(v), v("documents"))
    return df.select("doc_id", "quotes_total", "quotes_exact", "quotes_verified", "evidence_score")


@query("fn_partial_ratio")
def _(v: Get) -> DataFrame:
    return evidence.quote_scores(v("v_quote"), v("documents")).select("doc_id", "pos", F.round("score", 6).alias("score"))


@query("flt_boilerplate", rf"""
SELECT doc_id, coalesce(string_agg(q, '|' ORDER BY pos), '') AS kept, count(q) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(q) ORDER BY pos) AS rn FROM (
SELECT doc_id, pos, CASE WHEN q = '' OR regexp_matches(q, '^dear (dr|doctor)\.?$', 'i') OR regexp_matches(q, '^(re|to|from|fax|phone|date|subject)\s*:?$', 'i') OR regexp_matches(q, '^thank you (again )?for', 'i') OR regexp_matches(q, '^this is an update', 'i')
 OR regexp_matches(q, '^the following is a summary', 'i') OR regexp_matches(q, '^please (contact|call|feel free)', 'i') OR regexp_matches(q, '^sincerely', 'i') OR regexp_matches(q, '^[A-Za-z/ ]{{1,20}}:$') OR regexp_matches(q, 'confidential|HIPAA|privileged|intended only for', 'i') THEN NULL ELSE q END AS q
FROM (SELECT doc_id, pos, {sql_strip('quote')} AS q FROM @v_evidence))) WHERE rn = 1 OR q IS NULL GROUP BY doc_id""")
def _(v: Get) -> DataFrame:
    m, t = F.col("doc_id"), F.col("text")
    framing = F.when(m % 5 == 0, F.lit("Dear Dr.")).when(m % 5 == 1, F.lit("Imp/Plan:")).when(m % 5 == 2, F.lit("   ")).when(m % 5 == 3, F.lit("Thank you again for the visit")).otherwise(F.lit("Glaucoma suspect"))
    again = F.when(m % 4 == 0, F.translate(F.substring(t, 1, 25), "aeinot", "AEINOT")).when(m % 4 == 1, F.lit("GLAUCOMA suspect")).when(m % 4 == 3, F.lit("privileged and confidential"))
    quotes = F.array(F.concat(F.lit(" "), F.substring(t, 1, 25), F.lit(" ")), framing, again, F.col("lang"))
    df = evidence.filter_evidence(v("documents").select("doc_id", quotes.alias("quotes")), "quotes")
    return df.select("doc_id", F.array_join("quotes", "|").alias("kept"), F.size("quotes").cast("long").alias("n"))


# ================================================================== names


@query("jn_taxonomy_naming", f"""
SELECT doc_id, CASE WHEN category = 'PRIOR_AUTHORIZATION' THEN 'UNKNOWN' ELSE category END AS taxonomy_code, coalesce({SQL_FOLDER.format(c='category')}, 'Manual-Review') AS taxonomy_folder,
 CASE WHEN category = 'LAB_REPORT' AND subtype = 'PATHOLOGY_REPORT' THEN 'pathology' WHEN category = 'MISCELLANEOUS' AND subtype = 'INSURANCE_LETTER' THEN 'insuranceletter' WHEN category = 'FORM' AND subtype = 'HOME_HEALTH_PLAN_OF_CARE' THEN 'homecareform'
 ELSE CASE category WHEN 'CONSULTATION_REPORT' THEN 'consult' WHEN 'LAB_REPORT' THEN 'labreport' WHEN 'RADIOLOGY_REPORT' THEN 'radiologyreport' WHEN 'PROCEDURE_REPORT' THEN 'procedurereport' WHEN 'HOSPITAL_RECORD' THEN 'hospitalrecord' WHEN 'HOMECARE' THEN 'homecare' WHEN 'FORM' THEN 'form' WHEN 'ROI_CONSENT' THEN 'roiconsent' WHEN 'MISCELLANEOUS' THEN 'misc' ELSE 'unknown' END END AS doctype_slug FROM @v_name""")
def _(v: Get) -> DataFrame:
    return naming.with_taxonomy(v("v_name")).select("doc_id", "taxonomy_code", "taxonomy_folder", "doctype_slug")


SQL_NAMES = f"""
WITH b AS (SELECT n.doc_id, n.category, d.source, CASE WHEN n.category = 'PRIOR_AUTHORIZATION' THEN 'UNKNOWN' ELSE n.category END AS code, n.specification IS NULL AS fallback, n.subtype, regexp_extract(n.original_file_name, '(\\.[a-z]+)$', 1) AS ext FROM @v_name n JOIN @documents d ON d.doc_id = n.doc_id),
 c AS (SELECT *, CASE WHEN fallback THEN CASE code WHEN 'CONSULTATION_REPORT' THEN 'Allergy' WHEN 'LAB_REPORT' THEN 'Colonoscopy Pathology' WHEN 'RADIOLOGY_REPORT' THEN 'Chest X-ray' WHEN 'PROCEDURE_REPORT' THEN 'Colonoscopy' WHEN 'HOSPITAL_RECORD' THEN 'ER Record' WHEN 'HOMECARE' THEN 'HomeCare Report' WHEN 'FORM' THEN 'Home Care Form' WHEN 'ROI_CONSENT' THEN 'ROI Consent' WHEN 'MISCELLANEOUS' THEN 'Prescription Authorization' ELSE 'Unreadable Fax' END
  ELSE CASE doc_id % 9 WHEN 1 THEN 'US Abdomen' WHEN 2 THEN 'Chest X-ray' WHEN 3 THEN 'Insurance Letter' WHEN 4 THEN 'Home Care Form' WHEN 5 THEN 'Allergy Consult' WHEN 6 THEN 'EGD EGD Pathology' WHEN 7 THEN 'Follow-up Visit' ELSE concat('Panel ', upper(source[1]), source[2:]) END END AS spec,
  CASE doc_id % 7 WHEN 1 THEN 'Example Eye Care' WHEN 2 THEN 'North Lab East West' WHEN 4 THEN 'A Very Long Name Of A Medical Center' WHEN 6 THEN concat('Clinic ', source) END AS facility,
  CASE WHEN code = 'LAB_REPORT' AND subtype = 'PATHOLOGY_REPORT' THEN 'pathology' WHEN code = 'MISCELLANEOUS' AND subtype = 'INSURANCE_LETTER' THEN 'insuranceletter' WHEN code = 'FORM' AND subtype = 'HOME_HEALTH_PLAN_OF_CARE' THEN 'homecareform' WHEN code = 'CONSULTATION_REPORT' THEN 'consult' WHEN code = 'MISCELLANEOUS' THEN 'misc' ELSE lower(replace(code, '_', '')) END AS slug FROM b),
 e AS (SELECT *, replace(spec, 'EGD EGD', 'EGD') AS house, replace(replace(replace(lower(replace(spec, 'EGD EGD', 'EGD')), 'follow-up', 'followup'), 'x-ray', 'xray'), ' ', '_') AS snake FROM c)
SELECT doc_id, category, CASE WHEN fallback THEN 'FALLBACK' ELSE 'MODEL' END AS naming_source, spec AS specification_clean, facility, slug AS doctype_slug,
 concat(coalesce(facility || '_', ''), CASE WHEN code = 'CONSULTATION_REPORT' AND house NOT LIKE '%Consult' THEN house || ' Consult' ELSE house END, ext) AS suggested_file_name,
 concat(coalesce(lower(replace(facility, ' ', '_')) || '_', ''), snake, CASE WHEN starts_with(replace(replace(lower(spec), ' ', ''), '-', ''), slug) OR ends_with(replace(replace(lower(spec), ' ', ''), '-', ''), slug) THEN '' ELSE '_' || slug END, ext) AS alternate_file_name,
 concat(coalesce(facility || '_', ''), CASE WHEN code = 'CONSULTATION_REPORT' AND house NOT LIKE '%Consult' THEN house || ' Consult' ELSE house END, ext) AS chosen_file_name FROM e""".replace("\\\\", "\\")


@query("job_suggest_names", SQL_NAMES)
def _(v: Get) -> DataFrame:
    return naming.suggest_names(v("v_name")).select(
        "doc_id", "category", "naming_source", "specification_clean", "facility", "doctype_slug", "suggested_file_name", "alternate_file_name", "chosen_file_name"
    )


@query("fn_nfkd", "SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü]', '', 'g')) AS INT) AS decomposed_chars, CAST(length(text) AS INT) AS chars FROM @documents")
def _(v: Get) -> DataFrame:
    return v("documents").select("doc_id", F.length(decompose(F.col("text"))).alias("decomposed_chars"), F.length("text").alias("chars"))


# the requests of a base, the name without numbers, one after another, with all names that are taken by then
@query("wn_collision_suffix", r"""
WITH RECURSIVE parts AS (SELECT *, regexp_extract(file_name, '(?s)^(.+?)(\.[^.]*)?$', 1) AS stem, regexp_extract(file_name, '(?s)^(.+?)(\.[^.]*)?$', 2) AS ext FROM (SELECT folder, file_name, id, tracking_id, filed_at FROM @v_plan UNION ALL SELECT DISTINCT folder, file_name, NULL, NULL, NULL FROM @v_taken)),
 based AS (SELECT *, regexp_extract(stem, '(?s)^(.+?)(?: \((?:[2-9]|[1-9][0-9]{1,2})\))*$', 1) || ext AS base FROM parts),
 asked AS (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY filed_at, id) AS i FROM based WHERE id IS NOT NULL),
 walk(folder, base, i, taken, id, final) AS (
 SELECT folder, base, 0::BIGINT, coalesce(list(file_name) FILTER (WHERE id IS NULL), []), NULL::BIGINT, NULL::VARCHAR FROM based GROUP BY folder, base
 UNION ALL SELECT folder, base, i, list_append(taken, final), id, final FROM (
  SELECT folder, base, i, taken, id, CASE WHEN free = 1 THEN file_name WHEN free <= 999 THEN concat(stem, ' (', free, ')', ext) ELSE concat(tracking_id, '__', file_name) END AS final FROM (
   SELECT w.folder, w.base, a.i, w.taken, a.id, a.tracking_id, a.file_name, a.stem, a.ext, 1 + len(list_filter(list_transform(list_sort(list_distinct(list_transform(
     list_filter(w.taken, lambda t: t = a.file_name OR (starts_with(t, a.stem || ' (') AND ends_with(t, ')' || a.ext) AND regexp_full_match(t[length(a.stem) + 3:length(t) - length(a.ext) - 1], '[2-9]|[1-9][0-9]{1,2}'))),
     lambda t: CASE WHEN t = a.file_name THEN 1 ELSE CAST(t[length(a.stem) + 3:length(t) - length(a.ext) - 1] AS INT) END))), lambda s, k: s - k), lambda d: d = 0)) AS free
   FROM walk w JOIN asked a ON a.folder = w.folder AND a.base = w.base AND a.i = w.i + 1)))
SELECT w.id, w.folder, a.file_name, w.final AS final_file_name FROM walk w JOIN asked a ON a.id = w.id""")
def _(v: Get) -> DataFrame:
    return naming.filing_plan(v("v_plan"), v("v_taken")).select("id", "folder", "file_name", "final_file_name")


@query("wn_collision_suffix_plain", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY folder, file_name ORDER BY filed_at, id) AS rk FROM (SELECT id, tracking_id, folder, regexp_replace(file_name, ' \\\\(.*\\\\)', '') AS file_name, filed_at FROM @v_plan)),
 used AS (SELECT DISTINCT folder, CASE WHEN file_name LIKE '% (%' THEN concat(split_part(file_name, ' (', 1), '.pdf') ELSE file_name END AS file_name, CASE WHEN file_name LIKE '% (%' THEN CAST(regexp_extract(file_name, '\\((\\d+)\\)', 1) AS INT) ELSE 1 END AS slot FROM @v_taken),
 free AS (SELECT k.folder, k.file_name, s.slot, row_number() OVER (PARTITION BY k.folder, k.file_name ORDER BY s.slot) AS rk FROM (SELECT DISTINCT folder, file_name FROM p) k CROSS JOIN (SELECT CAST(unnest(range(1, 1000)) AS INT) AS slot) s
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.folder = k.folder AND u.file_name = k.file_name AND u.slot = s.slot AND (u.slot = 1 OR u.slot >= 2)))
SELECT p.id, p.folder, p.file_name, CASE WHEN f.slot IS NULL THEN concat(p.tracking_id, '__', p.file_name) WHEN f.slot = 1 THEN p.file_name ELSE replace(p.file_name, '.pdf', concat(' (', CAST(f.slot AS VARCHAR), ').pdf')) END AS final_file_name
FROM p LEFT JOIN free f ON f.folder = p.folder AND f.file_name = p.file_name AND f.rk = p.rk""".replace("\\\\", "\\"))
def _(v: Get) -> DataFrame:
    """All requests by their names without numbers."""
    plain = v("v_plan").withColumn("file_name", F.regexp_replace("file_name", r" \(.*\)", ""))
    return naming.filing_plan(plain, v("v_taken")).select("id", "folder", "file_name", "final_file_name")


# ================================================================== people

_CLEAN = "CASE o.file_name WHEN '..' THEN '' WHEN 'a/b: new name' THEN concat('ab new name', regexp_extract(d.original_file_name, '(\\.[^.]*)$', 1)) ELSE o.file_name END".replace("\\\\", "\\")
SQL_CONFIRM = f"""
WITH j AS (SELECT o.*, d.original_file_name, l.id AS decision_id, l.routing_status AS rs, l.suggested_folder, coalesce(l.suggested_file_name, d.original_file_name) AS sug, CASE WHEN trim(coalesce(o.file_name, '')) <> '' THEN {_CLEAN} ELSE coalesce(l.suggested_file_name, d.original_file_name) END AS fn
 FROM @v_confirm o LEFT JOIN @v_docs d ON d.id = o.doc_id LEFT JOIN {LATEST} l ON l.doc_id = o.doc_id),
 k AS (SELECT *, folder IS DISTINCT FROM suggested_folder AS fo, fn IS DISTINCT FROM sug AS no FROM j),
 c AS (SELECT *, CASE WHEN original_file_name IS NULL THEN 404 WHEN decision_id IS NULL OR rs IN ('CONFIRMED', 'OVERRIDDEN') THEN 409 WHEN trim(coalesce(folder, '')) = '' THEN 400 WHEN fn = '' THEN 400 WHEN (fo OR no) AND trim(coalesce(override_reason, '')) = '' THEN 400 ELSE 200 END AS code FROM k),
 w AS (SELECT *, max(CASE WHEN code = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY confirmed_at, confirm_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
 z AS (SELECT *, CASE WHEN before = 1 AND code <> 404 THEN 409 ELSE code END AS status_code FROM w)
SELECT confirm_id, doc_id, status_code, CASE WHEN status_code = 200 THEN CASE WHEN fo OR no THEN 'OVERRIDDEN' ELSE 'CONFIRMED' END END AS routing_status, CASE WHEN status_code = 200 THEN folder END AS final_folder, CASE WHEN status_code = 200 THEN fn END AS final_file_name,
 CASE WHEN status_code = 200 THEN fo END AS folder_override, CASE WHEN status_code = 200 THEN no END AS name_override, CASE WHEN status_code = 200 THEN coalesce(decided_by, 'MANUAL') END AS decided_by FROM z"""


@query("job_confirm", SQL_CONFIRM)
def _(v: Get) -> DataFrame:
    return decisions.apply_confirmations(v("v_confirm"), v("v_decision"), v("v_docs")).drop("decision_id", "override_reason")


_JUDGED = """(SELECT f.doc_id, seq, given_at, upper(trim(verdict)) AS verdict, CASE WHEN upper(trim(verdict)) = 'DOWN' THEN nullif({s}, '') END AS summary,
 CASE WHEN upper(trim(verdict)) NOT IN ('UP', 'DOWN') THEN 'VERDICT' WHEN upper(trim(verdict)) = 'DOWN' AND {s} = '' THEN 'SUMMARY_REQUIRED' WHEN d.id IS NULL THEN 'NO_DOCUMENT' END AS rejected FROM @v_feedback f LEFT JOIN @v_docs d ON d.id = f.doc_id)""".replace("{s}", sql_strip("summary"))


@query("job_feedback", f"""
SELECT doc_id, seq, verdict, summary, 'CURRENT' AS status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY given_at DESC, seq DESC) AS rn FROM {_JUDGED} WHERE rejected IS NULL) WHERE rn = 1
UNION ALL SELECT doc_id, seq, verdict, summary, rejected FROM {_JUDGED} WHERE rejected IS NOT NULL""")
def _(v: Get) -> DataFrame:
    current, rejected = decisions.apply_feedback(v("v_feedback"), v("v_docs"), ["given_at", "seq"])
    return current.select("doc_id", "seq", "verdict", "summary", F.lit("CURRENT").alias("status")).unionByName(
        rejected.select("doc_id", "seq", "verdict", "summary", F.col("rejected").alias("status"))
    )


@query("ag_feedback", "SELECT count(*) FILTER (WHERE verdict = 'UP') AS total, count(*) FILTER (WHERE verdict = 'UP') AS up_count, count(*) FILTER (WHERE verdict = 'DOWN') AS down_count FROM @v_feedback_row")
def _(v: Get) -> DataFrame:
    return decisions.feedback_counts(v("v_feedback_row"), verdict="up")


@query("jn_feedback_snapshot", """
SELECT f.doc_id, f.seq, (SELECT s.category FROM @v_scored s WHERE s.doc_id = f.doc_id AND s.classified_at <= f.given_at) AS ai_category,
 (SELECT arg_max(coalesce(d.final_folder, d.suggested_folder), (d.decided_at, d.id)) FROM @v_decision d WHERE d.doc_id = f.doc_id AND d.decided_at <= f.given_at) AS ai_folder,
 (SELECT max(d.id) FILTER (WHERE d.decided_at = m.t) FROM @v_decision d WHERE d.doc_id = f.doc_id) IS NOT NULL AS decided
FROM @v_feedback f LEFT JOIN LATERAL (SELECT max(decided_at) AS t FROM @v_decision d WHERE d.doc_id = f.doc_id AND d.decided_at <= f.given_at) m ON true""")
def _(v: Get) -> DataFrame:
    df = decisions.feedback_snapshot(v("v_feedback"), v("v_scored"), v("v_decision"))
    return df.select("doc_id", "seq", "ai_category", "ai_folder", F.col("ai_folder").isNotNull().alias("decided"))


@query("jn_reclassify", f"""
WITH acc AS (SELECT d.id FROM @v_docs d LEFT JOIN {LATEST} l ON l.doc_id = d.id WHERE d.id % 3 = 0 AND NOT coalesce(l.routing_status IN ('CONFIRMED', 'OVERRIDDEN'), false))
SELECT d.id, CASE WHEN acc.id IS NOT NULL THEN 'RECEIVED' ELSE d.processing_status END AS processing_status, CASE WHEN acc.id IS NULL THEN d.error_reason END AS error_reason,
 (SELECT count(*) FROM @v_decision x WHERE x.doc_id = d.id AND (acc.id IS NULL OR x.routing_status IN ('CONFIRMED', 'OVERRIDDEN'))) AS decisions_left FROM @v_docs d LEFT JOIN acc ON acc.id = d.id""")
def _(v: Get) -> DataFrame:
    requests = v("v_docs").filter("id % 3 = 0").select(F.col("id").alias("doc_id"))
    docs, left = decisions.apply_reclassify(requests, v("v_docs"), v("v_decision"))
    n = left.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    return docs.join(n, "id", "left").select("id", "processing_status", "error_reason", F.coalesce("n", F.lit(0)).alias("decisions_left"))


@query("ag_override_signals", f"""
SELECT s.category, d.suggested_folder, CAST(grouping(s.category) AS INT) AS all_categories, CAST(grouping(d.suggested_folder) AS INT) AS all_folders, count(*) AS decided, count(*) FILTER (WHERE d.final_folder IS DISTINCT FROM d.suggested_folder) AS folder_overrides, count(*) FILTER (WHERE d.file_name_overridden) AS name_overrides,
 {r('count(*) FILTER (WHERE d.final_folder IS DISTINCT FROM d.suggested_folder) / count(*)', 4)} AS folder_override_rate, {r('count(*) FILTER (WHERE d.file_name_overridden) / count(*)', 4)} AS name_override_rate
FROM @v_decision d LEFT JOIN @v_scored s ON s.doc_id = d.doc_id WHERE d.routing_status IN ('CONFIRMED', 'OVERRIDDEN') GROUP BY CUBE (s.category, d.suggested_folder)""")
def _(v: Get) -> DataFrame:
    return decisions.override_signals(v("v_decision"), v("v_scored"))


# ================================================================== figures


@query("ag_dashboard", """
SELECT 'by_status' AS metric, processing_status AS key, CAST(count(*) AS DOUBLE) AS value FROM @v_docs GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM @v_docs
UNION ALL SELECT 'by_category', coalesce(category, 'UNKNOWN'), count(*) FROM @v_scored GROUP BY 2 UNION ALL SELECT 'by_band', coalesce(confidence_band, 'UNCLASSIFIED'), count(*) FROM @v_scored GROUP BY 2
UNION ALL SELECT 'action_due_soon', 'all', count(*) FILTER (WHERE action_required AND response_deadline BETWEEN DATE '2026-03-10' AND DATE '2026-03-17') FROM @v_scored
UNION ALL SELECT 'avg_latency_ms', 'all', floor(avg(latency_ms) + 0.5) FROM @v_scored
UNION ALL SELECT 'auto_route_rate', 'all', floor(count(*) FILTER (WHERE routing_status = 'CONFIRMED') / count(*) FILTER (WHERE routing_status IN ('CONFIRMED', 'OVERRIDDEN')) * 100 + 0.5) / 100 FROM @v_decision
UNION ALL SELECT 'override_rate', 'all', floor(count(*) FILTER (WHERE routing_status = 'OVERRIDDEN') / count(*) FILTER (WHERE routing_status IN ('CONFIRMED', 'OVERRIDDEN')) * 100 + 0.5) / 100 FROM @v_decision
UNION ALL SELECT 'total_routed', 'all', count(*) FILTER (WHERE routing_status IN ('CONFIRMED', 'OVERRIDDEN')) FROM @v_decision""")
def _(v: Get) -> DataFrame:
    return dashboard.dashboard(v("v_docs"), v("v_scored"), v("v_decision"), today="2026-03-10")


@query("ag_pipeline_strip", """
SELECT *, filed / CAST(filed + in_review + errored AS DOUBLE) AS filed_share, in_review / CAST(filed + in_review + errored AS DOUBLE) AS in_review_share, errored / CAST(filed + in_review + errored AS DOUBLE) AS errored_share FROM (
SELECT count(*) FILTER (WHERE processing_status = 'ROUTED') AS filed, count(*) FILTER (WHERE (coalesce(confidence_band = 'LOW', false) OR processing_status = 'CLASSIFIED') AND processing_status NOT IN ('ROUTED', 'ERRORED')) AS in_review,
 count(*) FILTER (WHERE processing_status = 'ERRORED') AS errored, count(*) FILTER (WHERE confidence_band = 'LOW') + count(*) FILTER (WHERE processing_status = 'CLASSIFIED') AS in_review_old FROM @v_docs d LEFT JOIN @v_scored s ON s.doc_id = d.id)""")
def _(v: Get) -> DataFrame:
    return dashboard.pipeline_strip(v("v_docs"), v("v_scored"))


# ================================================================== costs


@query("jn_price_prefix", f"""
SELECT tracking_id, call_no, model, CASE WHEN model LIKE 'model-a-1%' THEN 'model-a-1' WHEN model LIKE 'model-a%' THEN 'model-a' WHEN model LIKE 'model-b-2%' THEN 'model-b-2' WHEN model LIKE 'model-b%' THEN 'model-b' END AS price_prefix, {SQL_COST} AS cost_usd FROM @v_usage""")
def _(v: Get) -> DataFrame:
    df = with_exact_round(cost.price_calls(v("v_usage"), TEST_PRICES), 6, "cost_usd")
    return df.select("tracking_id", "call_no", "model", "price_prefix", "cost_usd")


@query("ag_usage_scope", f"""
WITH s AS (SELECT DISTINCT tracking_id, stage FROM @v_usage UNION SELECT DISTINCT tracking_id, 'classify' FROM @v_usage)
SELECT s.tracking_id, s.stage, count(u.call_no) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens,
 count(*) FILTER (WHERE u.call_no IS NOT NULL AND c IS NULL) = 0 AS cost_known, CASE WHEN count(*) FILTER (WHERE u.call_no IS NOT NULL AND c IS NULL) = 0 THEN CAST(round(coalesce(sum(c), 0), 6) AS DOUBLE) END AS cost_usd
FROM s LEFT JOIN (SELECT *, CAST(CAST({SQL_PRICE} AS DOUBLE) / 1000000 AS DECIMAL(24,10)) AS c FROM @v_usage) u ON u.tracking_id = s.tracking_id AND u.stage = s.stage GROUP BY 1, 2""")
def _(v: Get) -> DataFrame:
    calls = cost.price_calls(v("v_usage"), TEST_PRICES)
    scopes = v("v_usage").select("tracking_id", "stage").union(v("v_usage").select("tracking_id", F.lit("classify")))
    return cost.usage_scopes(calls, scopes).drop("model")


@query("ag_cost_per_doc", SQL_PER_DOC)
def _(v: Get) -> DataFrame:
    return cost.cost_per_doc(usage_rows(v))


@query("ag_cost_summary", f"""
WITH d AS ({SQL_PER_DOC}), t AS (SELECT count(*) AS n, sum(calls) AS calls, sum(total_input) AS ti, sum(total_output) AS tout, sum(total_usd) AS spend, avg(total_usd) AS mean_usd, median(total_usd) AS med, min(total_usd) AS lo, max(total_usd) AS hi, sum(classify_usd) FILTER (WHERE total_usd IS NOT NULL) AS cls, sum(repairs) AS repairs, count(*) FILTER (WHERE total_usd IS NULL) AS unpriced FROM d)
SELECT unnest(['documents', 'calls', 'calls_per_document', 'input_tokens', 'output_tokens', 'mean_input_tokens', 'mean_output_tokens', 'spend', 'mean_usd', 'median_usd', 'min_usd', 'max_usd', 'classify_share', 'repairs', 'unpriced']) AS metric,
 round(unnest([CAST(n AS DOUBLE), calls, calls / n, ti, tout, floor(ti / n), floor(tout / n), spend, mean_usd, med, lo, hi, cls / spend, repairs, unpriced]), 4) AS value FROM t""")
def _(v: Get) -> DataFrame:
    return cost.cost_summary(cost.cost_per_doc(usage_rows(v))).withColumn("value", F.round("value", 4))


# ================================================================== storage and texts


@query("jn_storage_reconcile", """
WITH f AS (SELECT row_no, size_bytes, replace(path, chr(92), '/') AS path, split_part(path, '/', -1) AS name FROM @v_disk), k AS (SELECT d.* FROM @v_decision d JOIN @v_docs x ON x.id = d.doc_id),
 bp AS (SELECT replace(final_path, chr(92), '/') AS path, arg_max(doc_id, id) AS doc_id FROM k WHERE final_path IS NOT NULL GROUP BY 1), bn AS (SELECT final_file_name AS name, arg_min(doc_id, id) AS doc_id FROM k WHERE final_file_name IS NOT NULL GROUP BY 1)
SELECT f.row_no, f.size_bytes, f.path, CASE WHEN bp.doc_id IS NOT NULL THEN 'PATH' WHEN bn.doc_id IS NOT NULL THEN 'NAME' ELSE 'NONE' END AS matched_by, coalesce(bp.doc_id, bn.doc_id) AS doc_id, s.category
FROM f LEFT JOIN bp ON bp.path = f.path LEFT JOIN bn ON bn.name = f.name LEFT JOIN @v_scored s ON s.doc_id = coalesce(bp.doc_id, bn.doc_id) WHERE f.name NOT LIKE '.%'""")
def _(v: Get) -> DataFrame:
    return storage.reconcile(v("v_disk"), v("v_decision"), v("v_docs"), v("v_scored")).select("row_no", "size_bytes", "path", "matched_by", "doc_id", "category")


@query("ag_folder_rollup", """
WITH f AS (SELECT str_split(path, '/') AS p, size_bytes FROM @v_files2), x AS (SELECT array_to_string(p[1:len(p) - 1], '/') AS leaf, array_to_string(p[1:i], '/') AS folder, size_bytes FROM (SELECT p, size_bytes, unnest(range(1, len(p))) AS i FROM f))
SELECT folder, count(*) FILTER (WHERE folder = leaf) AS own_files, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM x GROUP BY folder""".replace("@v_files2", "(SELECT path, octet_length(encode(text)) AS size_bytes FROM @v_files UNION ALL SELECT path, size_bytes FROM @v_disk)"))
def _(v: Get) -> DataFrame:
    files = v("v_files").select("path", F.octet_length("text").cast("long").alias("size_bytes")).union(v("v_disk").select("path", "size_bytes"))
    return storage.folder_rollup(files)


@query("ag_folder_manifest", "SELECT array_to_string(str_split(path, '/')[1:len(str_split(path, '/')) - 1], '/') AS folder, split_part(path, '/', -1) AS name FROM @v_disk")
def _(v: Get) -> DataFrame:
    return storage.folder_manifest(v("v_disk"))


@query("ag_page_text", f"""
WITH p AS (SELECT doc_id, page, length({sql_strip("coalesce(raw_text, '')")}) AS rc, length({sql_strip("coalesce(proc_text, '')")}) AS pc, raw_text, proc_text FROM @v_page),
 m AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE pc >= rc) AS pre, string_agg(CASE WHEN pc >= rc THEN proc_text ELSE raw_text END, chr(10) || chr(10) ORDER BY page) AS merged FROM p GROUP BY doc_id)
SELECT m.doc_id, CASE WHEN length(trim(coalesce(native_text, ''))) >= 30 THEN native_text ELSE merged END AS text, CASE WHEN length(trim(coalesce(native_text, ''))) >= 30 THEN 'NATIVE' ELSE 'OCR' END AS mode,
 CASE WHEN length(trim(coalesce(native_text, ''))) >= 30 THEN length(native_text) ELSE length({sql_strip('merged')}) END AS char_count, m.pages, CASE WHEN length(trim(coalesce(native_text, ''))) >= 30 THEN 0 ELSE pre END AS pages_preprocessed FROM m LEFT JOIN @v_native n ON n.doc_id = m.doc_id""")
def _(v: Get) -> DataFrame:
    df = texts.page_text(v("v_native"), v("v_page"))
    return df.withColumns({c: F.col(c).cast("long") for c in ("char_count", "pages", "pages_preprocessed")})


_RED = [
    (r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", "[SSN]", ""), (r"\b(DOB|Date of Birth|D\.O\.B\.?)\s*[:\-]?\s*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", "[DOB]", "i"),
    (r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", "[DATE]", ""), (r"\b(MRN|Member ID|Account\s*#)\s*[:\-]?\s*[A-Z0-9\-]+", "[ID]", "i"), (r"\b\d{10,}\b", "[ID]", ""),
]
_REDACTED = "text"
for _p, _t, _f in _RED:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '{_t}', 'g{_f}')"


@query("job_redact", f"SELECT doc_id, sha256({_REDACTED}) AS redacted_sha, length({_REDACTED}) AS chars FROM @v_phi")
def _(v: Get) -> DataFrame:
    return texts.redact(v("v_phi")).select("doc_id", F.sha2("text", 256).alias("redacted_sha"), F.length("text").cast("long").alias("chars"))


def _tags(tag: str) -> str:
    return f"len(string_split(red, '[{tag}]')) - len(string_split(text, '[{tag}]'))"


@query("ag_redaction_report", " UNION ALL ".join(f"SELECT '{t}' AS tag, CAST(sum({_tags(t)}) AS BIGINT) AS replaced, count(*) FILTER (WHERE {_tags(t)} > 0) AS documents FROM (SELECT text, {_REDACTED} AS red FROM @v_phi)" for t in ("DATE", "DOB", "ID", "SSN")))
def _(v: Get) -> DataFrame:
    return texts.redaction_report(v("v_phi"))


# ================================================================== answers and fields


@query("job_land_responses", """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN concat('BAD_CONFIDENCE:modelConfidence,', m12) WHEN 4 THEN concat('UNKNOWN_CATEGORY,SPECIFICATION_IS_A_PATH,NOT_A_LIST:evidence,', m10) WHEN 6 THEN 'NOT_AN_OBJECT' WHEN 7 THEN concat('SPECIFICATION_NOT_TEXT,BAD_FAX_SOURCE,', m9) ELSE 'UNPARSEABLE' END AS errors,
 CASE doc_id % 8 WHEN 0 THEN 'FORM' WHEN 1 THEN 'FORM' WHEN 4 THEN 'NOPE' WHEN 7 THEN 'LAB_REPORT' END AS category, CASE doc_id % 8 WHEN 0 THEN CAST(doc_id % 9 AS DOUBLE) / 10 WHEN 1 THEN 1.5 WHEN 4 THEN 0.5 WHEN 7 THEN 0.9 END AS model_confidence,
 CASE WHEN doc_id % 8 = 0 THEN '2026-09-01' END AS response_deadline, CASE doc_id % 8 WHEN 0 THEN 'a' WHEN 7 THEN 'a' ELSE '' END AS evidence FROM (SELECT *,
 'MISSING:runnerUpCategory,MISSING:runnerUpConfidence,MISSING:reason,MISSING:evidence,MISSING:senderFaxNumberSource,MISSING:actionRequired,MISSING:patientIdentifiersPresent,MISSING:pageCount,MISSING:containsFillableForm,MISSING:classificationMode,MISSING:ocrCharCount,MISSING:specification' AS m12,
 'MISSING:runnerUpCategory,MISSING:runnerUpConfidence,MISSING:reason,MISSING:senderFaxNumberSource,MISSING:actionRequired,MISSING:patientIdentifiersPresent,MISSING:pageCount,MISSING:containsFillableForm,MISSING:classificationMode,MISSING:ocrCharCount' AS m10,
 'MISSING:runnerUpCategory,MISSING:runnerUpConfidence,MISSING:reason,MISSING:actionRequired,MISSING:patientIdentifiersPresent,MISSING:pageCount,MISSING:containsFillableForm,MISSING:classificationMode,MISSING:ocrCharCount' AS m9 FROM @v_response)""")
def _(v: Get) -> DataFrame:
    landed = responses.land_responses(v("v_response"))
    absent = F.filter("errors", lambda e: e.startswith("MISSING:"))
    other = F.filter("errors", lambda e: ~e.startswith("MISSING:"))
    return landed.select(
        "doc_id", F.array_join(F.concat(other, absent), ",").alias("errors"), "category", "model_confidence",
        F.col("response_deadline").cast("string").alias("response_deadline"), F.array_join("evidence", "|").alias("evidence"),
    )


# fences off, else the part between the outer braces; of a repeated key the last value
@query("job_land_extractions", r"""
WITH c AS (SELECT *, trim(regexp_replace(regexp_replace(trim(coalesce(raw, ''), E' \n'), '^```(?:json)?\s*', '', 'g'), '```\s*$', ''), E' \n') AS clean FROM @v_extraction),
 b AS (SELECT *, CASE WHEN json_valid(clean) THEN clean WHEN json_valid(regexp_extract(clean, '(?s)\{.*\}')) THEN regexp_extract(clean, '(?s)\{.*\}') END AS body FROM c),
 o AS (SELECT doc_id, CAST(body AS JSON) AS j FROM b WHERE json_type(body) = 'OBJECT'),
 k AS (SELECT o.doc_id, e.key, max_by(CAST(e.value AS VARCHAR), e.id) AS value FROM o, LATERAL (SELECT * FROM json_each(o.j)) e GROUP BY 1, 2),
 p AS (SELECT doc_id, any_value(value) FILTER (WHERE key = 'schemaVersion') AS sv, any_value(value) FILTER (WHERE key = 'trackingId') AS ti, any_value(value) FILTER (WHERE key = 'category') AS ca,
  any_value(value) FILTER (WHERE key = 'core' AND value <> 'null') AS co, any_value(value) FILTER (WHERE key = 'categoryData' AND value <> 'null') AS cd, CAST(any_value(value) FILTER (WHERE key = 'extraction') AS JSON) AS ex FROM k GROUP BY 1)
SELECT b.doc_id, coalesce(CAST(p.sv AS JSON)->>'$', '1') AS schema_version, coalesce(CAST(p.ti AS JSON)->>'$', b.tracking_id) AS tracking_id, coalesce(CAST(p.ca AS JSON)->>'$', b.category) AS category, coalesce(p.co, '{}') AS core_json, coalesce(p.cd, '{}') AS category_json,
 coalesce(CAST(p.ex->'$.fieldConfidences' AS VARCHAR), '{}') AS confidences_json, coalesce(CAST(p.ex->'$.fieldEvidence' AS VARCHAR), '{}') AS evidence_json, coalesce(p.ex->>'$.promptVersion', 'p1') AS prompt_version, coalesce(p.ex->>'$.modelName', 'm1') AS model_name,
 coalesce(CAST(p.ex->>'$.latencyMs' AS BIGINT), 0) AS latency_ms, CASE WHEN p.doc_id IS NULL THEN 'EXTRACTION_PARSE_FAILED' END AS error
FROM b LEFT JOIN p ON p.doc_id = b.doc_id""")
def _(v: Get) -> DataFrame:
    return responses.land_extractions(v("v_extraction"), "p1", "m1").select(
        "doc_id", "schema_version", "tracking_id", "category", "core_json", "category_json", "confidences_json", "evidence_json", "prompt_version", "model_name", "latency_ms", "error"
    )


@query("so_missing_fields", "SELECT doc_id, CAST(CASE doc_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 4 THEN 11 - 1 WHEN 6 THEN 14 WHEN 7 THEN 9 END AS INT) AS missing FROM @v_response")
def _(v: Get) -> DataFrame:
    return responses.missing_fields(responses.parse_responses(v("v_response"))).select("doc_id", F.size("missing").alias("missing")).withColumn(
        "missing", F.when(F.col("missing") >= 0, F.col("missing"))
    )


@query("ag_response_errors", """
SELECT code, count(*) AS n FROM (SELECT unnest(CASE doc_id % 8 WHEN 0 THEN ['OK'] WHEN 1 THEN list_concat(['BAD_CONFIDENCE:modelConfidence', 'MISSING:evidence', 'MISSING:senderFaxNumberSource', 'MISSING:specification'], c) WHEN 4 THEN list_concat(['UNKNOWN_CATEGORY', 'SPECIFICATION_IS_A_PATH', 'NOT_A_LIST:evidence', 'MISSING:senderFaxNumberSource'], c)
 WHEN 6 THEN ['NOT_AN_OBJECT'] WHEN 7 THEN list_concat(['SPECIFICATION_NOT_TEXT', 'BAD_FAX_SOURCE'], c) ELSE ['UNPARSEABLE'] END) AS code FROM (SELECT *, ['MISSING:runnerUpCategory', 'MISSING:runnerUpConfidence', 'MISSING:reason', 'MISSING:actionRequired', 'MISSING:patientIdentifiersPresent', 'MISSING:pageCount', 'MISSING:containsFillableForm', 'MISSING:classificationMode', 'MISSING:ocrCharCount'] AS c FROM @v_response)) GROUP BY code""")
def _(v: Get) -> DataFrame:
    return responses.error_counts(responses.land_responses(v("v_response")))


@query("job_flatten_fields", """
SELECT doc_id, 'core.senderOrganization' AS field_key, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'null' ELSE concat('Customer#', lpad(CAST(doc_id AS VARCHAR), 9, '0')) END AS value, NULL AS confidence, NULL AS quote FROM @v_meta WHERE doc_id % 9 > 1
UNION ALL SELECT doc_id, 'core.senderFax', CASE WHEN doc_id % 3 <> 0 THEN CAST(2125550000 + doc_id AS VARCHAR) END, '0.9', 'Fax: 212' FROM @v_meta WHERE doc_id % 9 > 1
UNION ALL SELECT doc_id, 'core.patientName', 'x', NULL, NULL FROM @v_meta WHERE doc_id % 9 > 1 UNION ALL SELECT doc_id, 'core.destinationFax', CAST(doc_id % 7 AS VARCHAR), NULL, NULL FROM @v_meta WHERE doc_id % 9 > 1
UNION ALL SELECT doc_id, 'categoryData.note', NULL, NULL, NULL FROM @v_meta UNION ALL SELECT doc_id, 'categoryData.codes', concat('["A01","', CAST(doc_id % 3 AS VARCHAR), '"]'), NULL, NULL FROM @v_meta
UNION ALL SELECT m.doc_id, 'categoryData.requested', concat('{"dose":', CAST(m.doc_id % 10 AS VARCHAR), ',"name":"', c.c_mktsegment, '"}'), NULL, NULL FROM @v_meta m JOIN @customer c ON c.c_custkey = m.doc_id
UNION ALL SELECT m.doc_id, 'categoryData.requested.name', c.c_mktsegment, '80%', NULL FROM @v_meta m JOIN @customer c ON c.c_custkey = m.doc_id UNION ALL SELECT doc_id, 'categoryData.requested.dose', CAST(doc_id % 10 AS VARCHAR), NULL, NULL FROM @v_meta""")
def _(v: Get) -> DataFrame:
    return fields.flatten_fields(v("v_meta")).drop("items")


_LUHN = "24 + " + " + ".join(
    f"CAST(substr(d, {i}, 1) AS INT)" if i % 2 == 0 else f"(CASE WHEN CAST(substr(d, {i}, 1) AS INT) * 2 > 9 THEN CAST(substr(d, {i}, 1) AS INT) * 2 - 9 ELSE CAST(substr(d, {i}, 1) AS INT) * 2 END)" for i in range(1, 11)
)
SQL_VALIDATED = rf"""
SELECT doc_id, field_key, method, confidence_before, reason = '' AS passed, CASE WHEN confidence_before = 0 OR method = 'NONE' THEN confidence_before WHEN reason = '' THEN least(1.0::DOUBLE, {r('confidence_before * 1.05::DOUBLE', 4)}) ELSE {r('confidence_before * 0.2::DOUBLE', 4)} END AS confidence_after FROM (
SELECT *, CASE method WHEN 'NANP' THEN CASE WHEN length(nd) <> 10 THEN 'x' WHEN substr(nd, 1, 1) IN ('0', '1') THEN 'x' WHEN substr(nd, 4, 1) IN ('0', '1') THEN 'x' ELSE '' END
 WHEN 'LUHN' THEN CASE WHEN length(d) <> 10 THEN 'x' WHEN ({_LUHN}) % 10 <> 0 THEN 'x' ELSE '' END
 WHEN 'DEA' THEN CASE WHEN NOT regexp_matches(upper(trim(value)), '^[A-PR-Z][A-Z9]\d{{7}}$') THEN 'x' WHEN (CAST(substr(d, 1, 1) AS INT) + CAST(substr(d, 3, 1) AS INT) + CAST(substr(d, 5, 1) AS INT) + 2 * (CAST(substr(d, 2, 1) AS INT) + CAST(substr(d, 4, 1) AS INT) + CAST(substr(d, 6, 1) AS INT))) % 10 <> CAST(substr(d, 7, 1) AS INT) THEN 'x' ELSE '' END
 WHEN 'FORMAT_7' THEN CASE WHEN length(d) <> 7 THEN 'x' ELSE '' END WHEN 'ICD10' THEN CASE WHEN regexp_matches(upper(trim(value)), '^[A-Z]\d{{2}}(\.\w{{1,4}})?$') THEN '' ELSE 'x' END
 WHEN 'DATE_RANGE' THEN CASE WHEN TRY_CAST(value AS DATE) IS NULL THEN 'x' WHEN lower(field_key) LIKE '%duedate%' AND DATE '2026-10-01' - TRY_CAST(value AS DATE) > 730 THEN 'x' WHEN TRY_CAST(value AS DATE) > DATE '2029-10-01' THEN 'x' WHEN TRY_CAST(value AS DATE) < DATE '2000-01-01' THEN 'x' ELSE '' END ELSE '' END AS reason FROM (
SELECT *, regexp_replace(value, '\D', '', 'g') AS d, CASE WHEN length(regexp_replace(value, '\D', '', 'g')) = 11 AND regexp_replace(value, '\D', '', 'g') LIKE '1%' THEN substr(regexp_replace(value, '\D', '', 'g'), 2) ELSE regexp_replace(value, '\D', '', 'g') END AS nd,
 CASE WHEN value IS NULL THEN 'NONE' WHEN field_key LIKE '%Fax' THEN 'NANP' WHEN field_key LIKE '%Npi' THEN 'LUHN' WHEN field_key LIKE '%Dea' THEN 'DEA' WHEN field_key LIKE '%ncpdpId' THEN 'FORMAT_7' WHEN field_key LIKE '%icd10Codes' THEN 'ICD10' WHEN field_key LIKE '%Date' THEN 'DATE_RANGE' ELSE 'NONE' END AS method,
 CASE WHEN cv IS NULL THEN 0.0::DOUBLE WHEN cv > 1 THEN cv / 100.0::DOUBLE ELSE cv END AS confidence_before FROM (SELECT *, TRY_CAST(rtrim(confidence, '%') AS DOUBLE) AS cv FROM @v_field)))"""


def validated(v: Get) -> DataFrame:
    return fields.validate_fields(v("v_field"), today="2026-10-01")


@query("job_validate_fields", SQL_VALIDATED)
def _(v: Get) -> DataFrame:
    return validated(v).select("doc_id", "field_key", "method", "confidence_before", "passed", "confidence_after")


@query("ag_extraction_quality", f"""
SELECT method, field_key, CAST(grouping(method, field_key) AS INT) AS level, count(*) AS fields, count(*) FILTER (WHERE passed AND method <> 'NONE') AS passed, count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE passed AND method = 'NONE') AS unchecked,
 round(avg(confidence_before), 3) AS mean_before, round(avg(confidence_after), 3) AS mean_after FROM ({SQL_VALIDATED}) GROUP BY ROLLUP (method, field_key)""")
def _(v: Get) -> DataFrame:
    df = fields.extraction_quality(validated(v))
    return df.withColumns({c: F.round(c, 3) for c in ("mean_before", "mean_after")})


def field_labels(v: Get) -> DataFrame:
    return v("v_field_label").withColumns({"expected_items": F.lit(None).cast("array<string>"), "fuzzy": F.lit(False)})


def field_values(v: Get) -> DataFrame:
    return fields.with_confidence(v("v_field")).withColumn("items", F.lit(None).cast("array<string>"))


SQL_SCORED = r"""
SELECT l.doc_id, l.field_key, l.expected, x.value AS actual, l.review, CASE WHEN x.doc_id IS NULL THEN NULL WHEN x.cv IS NULL THEN 0.0::DOUBLE WHEN x.cv > 1 THEN x.cv / 100.0::DOUBLE ELSE x.cv END AS confidence,
 CASE WHEN l.expected IS NULL THEN x.value IS NULL WHEN x.value IS NULL THEN false WHEN l.field_key LIKE '%Fax' THEN regexp_replace(regexp_replace(l.expected, '\D', '', 'g'), '^1(\d{10})$', '\1') = regexp_replace(regexp_replace(x.value, '\D', '', 'g'), '^1(\d{10})$', '\1') ELSE upper(trim(l.expected)) = upper(trim(x.value)) END AS match
FROM @v_field_label l LEFT JOIN (SELECT *, TRY_CAST(rtrim(confidence, '%') AS DOUBLE) AS cv FROM @v_field) x ON x.doc_id = l.doc_id AND x.field_key = l.field_key"""


@query("jn_field_truth", SQL_SCORED)
def _(v: Get) -> DataFrame:
    return fields.score_fields(field_values(v), field_labels(v)).select("doc_id", "field_key", "expected", "actual", "review", "confidence", "match")


@query("jn_field_truth_fuzzy", "SELECT concat('d', CAST(doc_id AS VARCHAR)) AS doc_id, 'categoryData.drug' AS field_key, 'Atorvastatin' AS expected, drug AS actual, doc_id % 7 IN (0, 1, 5) AS match FROM @v_drug")
def _(v: Get) -> DataFrame:
    """Fuzzy scalar labels and list labels, which need the similarity ratio."""
    d = v("v_drug").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    have = d.select("doc_id", F.lit("categoryData.drug").alias("field_key"), F.col("drug").alias("value"), F.array("drug", F.lit("ASPIRIN")).alias("items"), F.lit(0.9).alias("confidence"))
    want = d.select("doc_id", F.lit("categoryData.drug").alias("field_key"), F.lit("Atorvastatin").alias("expected"),
                    F.when(F.col("drug").startswith("L"), F.array(F.lit("levothyroxine sodium"), F.lit("aspirin"))).alias("expected_items"), F.lit(True).alias("fuzzy"), F.lit(False).alias("review"))
    return fields.score_fields(have, want).select("doc_id", "field_key", "expected", "actual", "match")


@query("ag_field_pr", f"""
SELECT field_key, CAST(grouping(field_key) AS INT) AS overall, tp, fp, fn, tn, confidently_wrong, {r('tp / nullif(tp + fp, 0)', 4)} AS precision, {r('tp / nullif(tp + fn, 0)', 4)} AS recall FROM (
SELECT field_key, grouping(field_key) AS g, count(*) FILTER (WHERE expected IS NOT NULL AND match) AS tp, count(*) FILTER (WHERE expected IS NULL AND actual IS NOT NULL) AS fp, count(*) FILTER (WHERE expected IS NOT NULL AND NOT match) AS fn, count(*) FILTER (WHERE expected IS NULL AND actual IS NULL) AS tn,
 count(*) FILTER (WHERE NOT review AND confidence >= 0.85 AND NOT match) AS confidently_wrong FROM ({SQL_SCORED}) GROUP BY ROLLUP (field_key))""".replace("CAST(grouping(field_key) AS INT) AS overall, tp", "CAST(g AS INT) AS overall, tp"))
def _(v: Get) -> DataFrame:
    return fields.field_metrics(fields.score_fields(field_values(v), field_labels(v)))


def sql_closest(words: str, entries: str, cutoff: float) -> str:
    """Similarity by longest common blocks, block by block in a recursion; pairs whose letters rule out the cutoff are left out."""
    return f"""
WITH RECURSIVE lexicon AS (SELECT DISTINCT entry FROM ({entries}) WHERE entry <> ''), asked AS ({words}),
w AS (SELECT DISTINCT word FROM asked WHERE word <> '' AND word NOT IN (SELECT entry FROM lexicon)),
la AS (SELECT word, unnest(list_distinct(string_split(word, ''))) AS c FROM w), lb AS (SELECT entry, unnest(list_distinct(string_split(entry, ''))) AS c FROM lexicon),
na AS (SELECT word, c, length(word) - length(replace(word, c, '')) AS n FROM la), nb AS (SELECT entry, c, length(entry) - length(replace(entry, c, '')) AS n FROM lb),
pairs AS (SELECT word, entry FROM na JOIN nb USING (c) GROUP BY word, entry HAVING 2.0 * sum(least(na.n, nb.n)) >= {cutoff} * (length(word) + length(entry))),
seg(word, entry, alo, ahi, blo, bhi, m) AS (
 SELECT word, entry, 0::BIGINT, length(entry), 0::BIGINT, length(word), 0::BIGINT FROM pairs
 UNION ALL SELECT word, entry, unnest([alo, x.i - x.nk]), unnest([x.i, ahi]), unnest([blo, x.j - x.nk]), unnest([x.j, bhi]), unnest([-x.nk, 0])
 FROM (SELECT *, list_sort(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j:
  {{'nk': -len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda k: entry[i + 1:i + k] = word[j + 1:j + k])), 'i': i, 'j': j}}))))[1] AS x FROM seg WHERE ahi > alo AND bhi > blo) WHERE x.nk < 0),
best AS (SELECT word, max({{'r': r, 'entry': entry}}) AS x FROM (SELECT word, entry, 2.0::DOUBLE * sum(m) / (length(word) + length(entry)) AS r FROM seg GROUP BY word, entry) WHERE r >= {cutoff} GROUP BY word)
SELECT a.*, CASE WHEN l.entry IS NOT NULL THEN l.entry ELSE b.x.entry END AS canonical, round(CASE WHEN l.entry IS NOT NULL THEN 1.0::DOUBLE ELSE b.x.r END, 6) AS similarity
FROM asked a LEFT JOIN lexicon l ON a.word = l.entry LEFT JOIN best b ON a.word = b.word"""


@query("jn_drug_lexicon", "SELECT doc_id, word AS drug, canonical, similarity FROM (" + sql_closest(
    "SELECT doc_id, upper(trim(drug)) AS word FROM @v_drug", "SELECT unnest([" + ", ".join(f"'{x}'" for x in DRUG_NAMES) + "]) AS entry", 0.75) + ")")
def _(v: Get) -> DataFrame:
    df = v("v_drug").withColumn("drug", F.upper(F.trim("drug")))
    return lexicon.match_lexicon(df, "drug", DRUG_NAMES, fields.LEXICON_CUTOFF).select("doc_id", "drug", "canonical", F.round("similarity", 6).alias("similarity"))


@query("jn_term_lexicon", sql_closest("SELECT doc_id, word FROM @v_misspelt", "SELECT term AS entry FROM @v_term", 0.8))
def _(v: Get) -> DataFrame:
    """Misspelt words of all documents against a list that grows with the tables."""
    return lexicon.match_lexicon(v("v_misspelt"), "word", v("v_term"), 0.8).withColumn("similarity", F.round("similarity", 6))


@query("fn_seq_ratio")
def _(v: Get) -> DataFrame:
    p = v("part").select("p_name", "p_type").distinct()
    return p.select("p_name", "p_type", F.round(fn_seq_ratio("p_name", F.lower("p_type")), 6).alias("ratio"))


SQL_DEADLINE = """
CASE doc_id % 10 WHEN 0 THEN TRY_CAST(printed AS DATE) WHEN 1 THEN CASE WHEN CAST(regexp_extract(printed, '^(\\d+)', 1) AS INT) <= 30 THEN make_date(2026, 9, CAST(regexp_extract(printed, '^(\\d+)', 1) AS INT)) END
 WHEN 2 THEN make_date(2026, 9, CAST(regexp_extract(printed, ' (\\d+),', 1) AS INT)) WHEN 3 THEN make_date(2026, 9, CAST(substr(printed, 4, 2) AS INT)) WHEN 7 THEN make_date(2026, 10, CAST(regexp_extract(printed, 'oct (\\d+) ', 1) AS INT)) END""".replace("\\\\", "\\")


@query("job_deadlines", f"SELECT doc_id, printed, CAST({SQL_DEADLINE} AS VARCHAR) AS response_deadline, CAST(CASE WHEN doc_id % 10 = 0 THEN TRY_CAST(printed AS DATE) END AS VARCHAR) AS strict_deadline FROM @v_deadline")
def _(v: Get) -> DataFrame:
    return v("v_deadline").select(
        "doc_id", "printed", parse_deadline(F.col("printed")).cast("string").alias("response_deadline"), parse_deadline(F.col("printed"), strict=True).cast("string").alias("strict_deadline")
    )


@query("ag_deadline_report", f"SELECT CASE WHEN printed IS NULL OR trim(printed) IN ('', 'null') THEN 'ABSENT' WHEN {SQL_DEADLINE} IS NOT NULL THEN 'PARSED' ELSE 'UNREADABLE' END AS state, count(*) AS n FROM @v_deadline GROUP BY 1")
def _(v: Get) -> DataFrame:
    return fields.deadline_report(v("v_deadline"), "printed")


@query("ag_due_soon", "SELECT CAST(response_deadline - DATE '2026-03-10' AS INT) AS days_left, count(*) AS n FROM @v_scored WHERE action_required AND response_deadline BETWEEN DATE '2026-03-10' AND DATE '2026-03-17' GROUP BY 1")
def _(v: Get) -> DataFrame:
    return fields.due_soon(v("v_scored"), "2026-03-10")


@query("job_normalised_match", f"SELECT file, {sql_clerk('suggested_file_name')} AS clerk_name, {sql_clerk('specification')} AS clerk_specification FROM @v_pred")
def _(v: Get) -> DataFrame:
    return v("v_pred").select("file", clerk_form(F.col("suggested_file_name")).alias("clerk_name"), clerk_form(F.col("specification")).alias("clerk_specification"))
