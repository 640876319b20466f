import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperroute.operators import cost, decisions, evaluation, fields, mapping, responses
from paperroute.operators.inbox import extracted_sender, inbox_rows, review_queue
from paperroute.sinks import exports
from paperroute.sources.dimensions import DRUG_NAMES, REQUIRED_RESPONSE_KEYS

T0 = datetime(2026, 1, 1)
FULL = {
    "documentCategory": "FORM", "modelConfidence": 0.9, "runnerUpCategory": None, "runnerUpConfidence": 0.1, "reason": "r", "evidence": ["q"], "senderFaxNumberSource": "NONE",
    "actionRequired": True, "patientIdentifiersPresent": [], "pageCount": 1, "containsFillableForm": False, "classificationMode": "OCR", "ocrCharCount": 9, "specification": "CBC",
}


def landed(spark, *raw):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, raw string")
    return responses.land_responses(df).orderBy("id").collect()


def test_responses_parse_and_quarantine(spark):
    clean = json.dumps(FULL)
    got = landed(spark, clean, f"```json\n{clean}\n```", f"Here: {clean} bye", "", "{bad", "only prose", None, "[1]")
    assert [r.errors for r in got] == [[], [], []] + [["UNPARSEABLE"]] * 4 + [["NOT_AN_OBJECT"]]
    assert [r.category for r in got[:3]] == ["FORM"] * 3 and got[0].evidence == ["q"]


@pytest.mark.parametrize(
    "change, error",
    [
        ({"documentCategory": "NOPE"}, "UNKNOWN_CATEGORY"), ({"documentCategory": ""}, None), ({"runnerUpCategory": "X"}, "UNKNOWN_RUNNER_UP"),
        ({"modelConfidence": 1.5}, "BAD_CONFIDENCE:modelConfidence"), ({"runnerUpConfidence": -0.1}, "BAD_CONFIDENCE:runnerUpConfidence"),
        ({"modelConfidence": "0.9"}, "BAD_CONFIDENCE:modelConfidence"), ({"modelConfidence": 1}, None), ({"evidence": "x"}, "NOT_A_LIST:evidence"),
        ({"routingEvidence": {}}, "NOT_A_LIST:routingEvidence"), ({"routingEvidence": ["a", 5, " "]}, None), ({"senderFaxNumberSource": "FAX"}, "BAD_FAX_SOURCE"),
        ({"specification": "a/b"}, "SPECIFICATION_IS_A_PATH"), ({"specification": "x.PDF"}, "SPECIFICATION_IS_A_PATH"), ({"specification": "x" * 61}, "SPECIFICATION_TOO_LONG"),
        ({"specification": 5}, "SPECIFICATION_NOT_TEXT"), ({"documentSubtype": "NEW_KIND"}, None), ({"reason": None}, None),
    ],
)
def test_response_checks(spark, change, error):
    got = landed(spark, json.dumps({**FULL, **change}))[0]
    assert got.errors == ([error] if error else [])


def test_response_missing_keys(spark):
    got = landed(spark, json.dumps({"documentCategory": "FORM"}))[0]
    assert {e.split(":")[1] for e in got.errors} == set(REQUIRED_RESPONSE_KEYS) - {"documentCategory"}
    good, bad = responses.split_responses(responses.land_responses(spark.createDataFrame([(json.dumps(FULL),), ("x",)], "raw string")))
    assert good.count() == 1 and bad.count() == 1


def test_extraction_defaults(spark):
    raw = [("t1", "FORM", '{"core":{"a":1},"extraction":{"latencyMs":5}}'), ("t2", "FORM", "nothing")]
    got = responses.land_extractions(spark.createDataFrame(raw, "tracking_id string, category string, raw string"), "p1", "m1").orderBy("tracking_id").collect()
    assert (got[0].schema_version, got[0].core_json, got[0].latency_ms, got[0].error) == ("1", '{"a":1}', 5, None)
    assert (got[1].core_json, got[1].prompt_version, got[1].error) == ("{}", "p1", "EXTRACTION_PARSE_FAILED")


def test_flatten_fields(spark):
    core = {"senderFax": "x", "patientName": None}
    cat = {"med": {"name": "A", "dose": {"mg": 5}}, "codes": ["A01", None], "n": 5}
    df = spark.createDataFrame([(1, json.dumps(core), json.dumps(cat), '{"core.senderFax": 0.5}', '{"core.senderFax": "q"}'), (2, "bad", None, None, None)], "doc_id long, core_json string, category_json string, confidences_json string, evidence_json string")
    got = {r.field_key: r for r in fields.flatten_fields(df).collect()}
    assert set(got) == {"core.senderFax", "core.patientName", "categoryData.med", "categoryData.codes", "categoryData.n", "categoryData.med.name", "categoryData.med.dose"}
    assert (got["core.senderFax"].confidence, got["core.senderFax"].quote) == ("0.5", "q") and got["core.patientName"].value is None
    assert got["categoryData.codes"].items == ["A01", None] and got["categoryData.n"].value == "5"


def test_confidence_coercion(spark):
    df = spark.createDataFrame([(None,), ("0.75",), ("90%",), ("true",), ("3",), ("-1",), ("x",), ("100",)], "confidence string")
    assert [r.confidence for r in fields.with_confidence(df).collect()] == [0.0, 0.75, 0.9, 0.0, 0.03, 0.0, 0.0, 1.0]


@pytest.mark.parametrize(
    "key, value, method, passed",
    [
        ("core.senderFax", "+1 (212) 555-0100", "NANP", True), ("core.senderFax", "112-555-0100", "NANP", False), ("core.senderFax", "212-155-0100", "NANP", False), ("x.phoneNumber", "5550100", "NANP", False),
        ("core.prescriberNpi", "1234567893", "LUHN", True), ("core.prescriberNpi", "1234567890", "LUHN", False), ("core.prescriberNPI", "123", "LUHN", False),
        ("core.prescriberDea", "AB1234563", "DEA", True), ("core.prescriberDea", "ab1234563", "DEA", True), ("core.prescriberDea", "AB1234560", "DEA", False), ("core.prescriberDea", "QB1234563", "DEA", False),
        ("a.ncpdpId", "123-4567", "FORMAT_7", True), ("a.ncpdp", "123456", "FORMAT_7", False), ("a.icd10Codes", "a01.12", "ICD10", True), ("a.icd10Codes", "A1", "ICD10", False),
        ("a.requestedMedication.name", "atorvastatn", "DRUG", True), ("a.drugName", "zzzz", "DRUG", False), ("core.documentDate", "1999-12-31", "DATE_RANGE", False), ("core.documentDate", "2029-10-01", "DATE_RANGE", True),
        ("core.documentDate", "2029-10-02", "DATE_RANGE", False), ("core.responseDeadline", "2024-09-30", "DATE_RANGE", False), ("core.documentDate", "2024-09-30", "DATE_RANGE", True), ("a.date", "09/01/2026", "DATE_RANGE", False),
        ("core.x", "anything", "NONE", True), ("core.senderFax", None, "NONE", True),
    ],
)
def test_field_rules(spark, key, value, method, passed):
    df = spark.createDataFrame([(key, value, "0.9")], "field_key string, value string, confidence string")
    r = fields.validate_fields(df, today="2026-10-01").first()
    assert (r.method, r.passed) == (method, passed)
    want = 0.9 if method == "NONE" else round(0.9 * 1.05, 4) if passed else round(0.9 * 0.2, 4)
    assert r.confidence_after == want


def test_field_lists_and_blocks(spark):
    df = spark.createDataFrame([(1, "a.icd10Codes", "[..]", ["A01", "bad"], "0.5"), (1, "a.exclusionCodes", "[..]", ["A01"], "0.99")], "doc_id int, field_key string, value string, items array<string>, confidence string")
    got = fields.validate_fields(df, today="2026-10-01")
    assert {r.field_key: (r.passed, r.confidence_after) for r in got.collect()} == {"a.icd10Codes": (False, 0.1), "a.exclusionCodes": (True, 1.0)}
    block = fields.validation_block(got).first()
    assert block.validation["a.icd10Codes"].reason == "not a code: bad" and block.confidences["a.exclusionCodes"] == 1.0


def test_lexicon_equals_brute_force(spark):
    import difflib

    words = ["ATORVASTATN", "LISINOPRIL", "OMEPRAZOL", "CALCIUM", "LEVOTHYROXIN", "XX", "PRAVASTATI", "CELECOXB", "ROSUVASTATINE"]
    df = spark.createDataFrame([(w,) for w in words * 2], "w string")
    got = {r.w: r.canonical for r in fields.match_lexicon(df, "w", DRUG_NAMES).collect()}
    for w in words:
        close = [w] if w in DRUG_NAMES else difflib.get_close_matches(w, DRUG_NAMES, n=1, cutoff=0.75)
        assert got[w] == (close[0] if close else None)


def test_score_fields_and_metrics(spark):
    found = [(1, "core.senderFax", "12125550100", None, 0.9), (1, "a.list", "[]", ["Glucose", "sodium "], 0.9), (1, "a.name", "Jon Smith", None, 0.95), (1, "a.none", "x", None, 0.9), (1, "a.odd", "y", None, 0.2)]
    extracted = spark.createDataFrame(found, "doc_id int, field_key string, value string, items array<string>, confidence double")
    want = [(1, "core.senderFax", "(212) 555-0100", None, False, False), (1, "a.list", None, ["GLUCOSE", "Sodum"], False, False), (1, "a.name", "john smith", None, True, False), (1, "a.none", None, None, False, False), (1, "a.odd", "z", None, True, False), (1, "a.gone", "z", None, False, False), (1, "a.void", None, None, False, False)]
    labels = spark.createDataFrame(want, "doc_id int, field_key string, expected string, expected_items array<string>, fuzzy boolean, review boolean")
    scored = fields.score_fields(extracted, labels)
    assert {r.field_key: r.match for r in scored.collect()} == {"core.senderFax": True, "a.list": True, "a.name": True, "a.none": False, "a.odd": False, "a.gone": False, "a.void": True}
    total = fields.field_metrics(scored).filter("overall = 1").first()
    assert (total.tp, total.fp, total.fn, total.tn, total.confidently_wrong, total.precision, total.recall) == (3, 1, 2, 1, 1, 0.75, 0.6)


# ------------------------------------------------------------------ people


def people(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"in{i}.PDF", "CLASSIFIED", "err", None) for i in (1, 2, 3)], "id long, tracking_id string, original_file_name string, processing_status string, error_reason string, sender_fax_number string")
    dec = [(1, 1, T0, "SUGGESTED", "Forms", "A.pdf", None, None), (2, 2, T0, "SUGGESTED", "Forms", "A.pdf", None, None), (3, 2, T0, "CONFIRMED", "Forms", "A.pdf", "Forms", "A.pdf")]
    return docs, spark.createDataFrame(dec, "id long, doc_id long, decided_at timestamp_ntz, routing_status string, suggested_folder string, suggested_file_name string, final_folder string, final_file_name string")


def test_confirmations(spark):
    docs, dec = people(spark)
    asks = [(1, 1, " ", None, None), (2, 1, "Homecare", None, " "), (3, 1, "Forms", "..", None), (4, 1, "Forms", "b/c", "better"), (5, 1, "Forms", None, None), (6, 2, "Forms", None, None), (7, 3, "Forms", None, None), (8, 9, "Forms", None, None)]
    confirms = spark.createDataFrame([(i, d, T0 + timedelta(minutes=i), f, n, r, None) for i, d, f, n, r in asks], "confirm_id long, doc_id long, confirmed_at timestamp_ntz, folder string, file_name string, override_reason string, decided_by string")
    got = {r.confirm_id: r for r in decisions.apply_confirmations(confirms, dec, docs).collect()}
    assert {k: r.status_code for k, r in got.items()} == {1: 400, 2: 400, 3: 400, 4: 200, 5: 409, 6: 409, 7: 409, 8: 404}
    won = got[4]
    assert (won.routing_status, won.final_file_name, won.folder_override, won.name_override, won.decided_by) == ("OVERRIDDEN", "bc.pdf", False, True, "MANUAL")
    same = decisions.apply_confirmations(confirms.filter("confirm_id = 5"), dec, docs).first()
    assert (same.status_code, same.routing_status, same.final_file_name) == (200, "CONFIRMED", "A.pdf")


def test_feedback_and_reclassify(spark):
    docs, dec = people(spark)
    ev = [(1, 1, "up ", "nice"), (1, 2, "DOWN", " wrong "), (2, 3, "DOWN", " "), (2, 4, "meh", "x"), (9, 5, "UP", None), (3, 6, "DOWN", "bad"), (3, 7, "UP", "old text")]
    events = spark.createDataFrame(ev, "doc_id long, seq int, verdict string, summary string")
    now, bad = decisions.apply_feedback(events, docs, ["seq"])
    assert {r.doc_id: (r.verdict, r.summary) for r in now.collect()} == {1: ("DOWN", "wrong"), 3: ("UP", None)}
    assert {r.seq: r.rejected for r in bad.collect()} == {3: "SUMMARY_REQUIRED", 4: "VERDICT", 5: "NO_DOCUMENT"}
    again = spark.createDataFrame([(1,), (2,), (1,)], "doc_id long")
    assert {r.doc_id: r.accepted for r in decisions.judge_reclassify(again, docs, dec).collect()} == {1: True, 2: False}
    d2, x2 = decisions.apply_reclassify(again, docs, dec)
    assert {r.id: r.processing_status for r in d2.collect()} == {1: "RECEIVED", 2: "CLASSIFIED", 3: "CLASSIFIED"}
    assert sorted(r.id for r in x2.collect()) == [2, 3]


def test_inbox_and_review_queue(spark):
    docs, dec = people(spark)
    cls = spark.createDataFrame([(1, "FORM", "X", "LOW", 0.3, None, " ", "212", "S.pdf", "s.pdf"), (2, "FORM", "X", "LOW", 0.3, True, "Org", None, "S.pdf", "s.pdf")], "doc_id long, category string, subtype string, confidence_band string, calibrated_confidence double, force_manual_review boolean, sender_organization string, sender_callback_fax string, suggested_file_name string, alternate_file_name string")
    meta = spark.createDataFrame([(1, '{"senderOrganization":" null ","senderFax":"9","x":1}'), (2, "{bad")], "doc_id long, core_json string")
    assert {r.doc_id: r.extracted_fax for r in extracted_sender(meta).collect()} == {1: "9", 2: None}
    got = {r.doc_id: r for r in inbox_rows(docs.withColumn("created_at", F.lit(T0)), cls, dec, meta).collect()}
    assert (got[1].sender_fax_number, got[1].sender_fax_number_source, got[1].sender_organization_source) == ("9", "EXTRACTION", "NONE")
    assert (got[2].sender_organization, got[2].routing_status, got[1].suggested_file_name, got[3].row_state) == ("Org", "CONFIRMED", "A.pdf", "")
    assert [r.doc_id for r in review_queue(docs, cls, dec).collect()] == [1]


# ------------------------------------------------------------------ evaluation, mapping, cost, exports


def test_repeat_stability_and_confusion(spark):
    runs = [("a", 1, "X", 0.5, 10), ("a", 2, "X", 0.7, 21), ("b", 1, "X", None, 5), ("b", 2, None, 0.4, 6), ("c", 1, None, None, 1)]
    df = spark.createDataFrame(runs, "file string, run int, predicted_category string, calibrated_confidence double, latency_ms int")
    got = {r.file: r for r in evaluation.repeat_stability(df).collect()}
    assert (got["a"].deterministic, got["a"].mean_confidence, got["a"].confidence_std, got["a"].mean_latency_ms) == (True, 0.6, 0.1414, 15)
    assert (got["b"].deterministic, got["b"].confidence_std, got["c"].deterministic, got["c"].mean_confidence) == (False, 0.0, True, None)
    res = spark.createDataFrame([("A", "B"), ("A", "B"), ("C", None)], "expected_category string, predicted_category string")
    cells = {(r.expected, r.predicted): r.n for r in evaluation.confusion(res).collect()}
    assert len(cells) == 9 and cells[("A", "B")] == 2 and sum(cells.values()) == 2


def test_mapping_and_blind_rerun(spark):
    manual = spark.createDataFrame([("a", " forms", None), ("b", "Forms", None), ("c", None, "L1"), ("d", "Forms", None)], "file string, manual_folder string, fax_line string")
    preds = spark.createDataFrame([("a", "Forms", "n", 0.955, True, "FORM", None, None), ("b", "Homecare", "n", None, False, "FORM", None, None), ("c", "Forms", "n", 0.5, False, "FORM", None, None), ("d", None, None, None, None, None, None, "timeout")], "file string, suggested_folder string, suggested_file_name string, calibrated_confidence double, force_manual_review boolean, category string, subtype string, error string")
    out = mapping.manual_mapping(manual, preds)
    got = {r.file: (r.match, r.confidence, r.held_for_review, r.predicted_folder) for r in out.collect()}
    assert got["a"][0] == "YES" and got["a"][2] == "YES" and got["b"][:2] == ("NO", "") and got["c"][0] == "" and got["d"] == ("", "", "", "ERROR")
    s = mapping.mapping_agreement(out).first()
    assert (s.comparable, s.agreed, s.errors, s.awaiting_input, s.agreement_rate) == (2, 1, 1, 1, 0.5)
    want = spark.createDataFrame([("x", "Forms/Home Care.pdf"), ("y", "Forms/B.pdf")], "file string, filed_path string")
    filed = spark.createDataFrame([("x", "Forms", "home-care.PDF")], "file string, routed_folder string, routed_file_name string")
    assert mapping.blind_rerun(want, filed).first()[:] == (2, 1, 1)


def test_prices(spark):
    calls = spark.createDataFrame([("claude-opus-4-8", 7561, 869), ("claude-opus-4-20250101", 1000000, 0), ("mystery", 5, 5), (None, 5, 5)], "model string, input_tokens long, output_tokens long")
    got = [r.cost_usd for r in cost.price_calls(calls).collect()]
    assert got[0] == pytest.approx(0.05953) and got[1] == 15.0 and got[2:] == [None, None]
    cheap = cost.price_list({("claude-opus-4", "input"): 1.0})
    assert cost.price_calls(calls, cheap).collect()[1].cost_usd == 1.0
    assert cost.price_calls(calls.withColumn("local", F.lit(True))).collect()[2].cost_usd == 0.0
    scopes = spark.createDataFrame([("a", "classify"), ("b", "extract")], "tracking_id string, stage string")
    lines = cost.price_calls(spark.createDataFrame([("a", "classify", 1, "mystery", 5, 5)], "tracking_id string, stage string, call_no int, model string, input_tokens long, output_tokens long"))
    s = {r.tracking_id: (r.calls, r.cost_known, r.cost_usd) for r in cost.usage_scopes(lines, scopes).collect()}
    assert s == {"a": (1, False, None), "b": (0, True, 0.0)}


def test_exact_median(spark):
    import random
    import statistics

    rng = random.Random(4)
    for n in (1, 2, 7, 100, 101):
        values = [round(10 ** rng.uniform(-4, 3), 4) * rng.choice([0, 1, 1, 1]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert cost.exact_median(df, "v").first().median == pytest.approx(statistics.median(values))


def test_exports(spark, tmp_path):
    fb = spark.createDataFrame([(T0, "DOWN", "t1", 'a"b, c', None, "F", "C", None, None, "ROUTED", ""), (T0 + timedelta(1), "UP", "t2", "x", "y", "F", "C", None, "0.5", "ROUTED", None)], "created_at timestamp_ntz, verdict string, tracking_id string, original_file_name string, ai_file_name string, ai_folder string, ai_category string, ai_subtype string, ai_confidence string, review_state string, summary string")
    lines = [r.line for r in exports.feedback_line(exports.feedback_export(fb)).collect()]
    assert lines[1] == '"2026-01-01 00:00:00","DOWN","t1","a""b, c",,"F","C",,"","ROUTED",""' and '"t2"' in lines[0]
    exports.write_feedback(exports.feedback_export(fb, "up"), str(tmp_path / "fb"))
    assert spark.read.text(str(tmp_path / "fb/rows")).count() == 1
    run = spark.createDataFrame([("a", True)], "file string, category_pass boolean")
    for name in ("10", "9", "9", "2026-01-01"):
        exports.write_eval_run(run, str(tmp_path / "eval"), name)
    newest = exports.latest_eval_run(spark, str(tmp_path / "eval"), "file string, category_pass boolean")
    assert newest.collect() == [("a", True, "9")]
    assert "run_id#" in (plan := newest._jdf.queryExecution().executedPlan().toString()) and "PartitionFilters: [isnotnull(run_id" in plan
    assert [tuple(r) for r in exports.eval_runs(spark, str(tmp_path / "eval")).collect()] == [("9", 1), ("2026-01-01", 1), ("10", 1)]
    exports.write_csv(run, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["file", "category_pass"]


def test_due_soon_and_report(spark):
    df = spark.createDataFrame([(True, date(2026, 3, 10)), (True, date(2026, 3, 17)), (True, date(2026, 3, 18)), (None, date(2026, 3, 10))], "action_required boolean, response_deadline date")
    assert {r.days_left: r.n for r in fields.due_soon(df, "2026-03-10").collect()} == {0: 1, 7: 1}


def test_repeated_keys_keep_the_last_value(spark):
    rows = [("t1", "FORM", '{"core":{"a":1},"schemaVersion":"1","core":{"b":2},"schemaVersion":"4"}'), ("t2", "FORM", '{"core":null,"extraction":null}'), ("t3", "FORM", "")]
    got = responses.land_extractions(spark.createDataFrame(rows, "tracking_id string, category string, raw string"), "p1", "m1").orderBy("tracking_id").collect()
    assert [(r.core_json, r.schema_version, r.error) for r in got] == [('{"b":2}', "4", None), ("{}", "1", None), ("{}", "1", "EXTRACTION_PARSE_FAILED")]
    landed = responses.land_responses(spark.createDataFrame([('{"documentCategory":"FORM","documentCategory":"LAB_REPORT"}',)], "raw string")).first()
    assert landed.category == "LAB_REPORT" and "UNPARSEABLE" not in landed.errors
