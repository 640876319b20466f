import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperroute.operators.confidence import calibrate
from paperroute.operators.evidence import filter_evidence, quote_scores, verify_evidence
from paperroute.operators.naming import filing_plan, suggest_names
from paperroute.operators.routing import filing_outcome, normalise_category, route
from paperroute.sources.dimensions import Policy, complete_rules, policy_from

TEXT = "The patient was seen today.   Glaucoma suspect in the left eye. " + "Plain words follow here. " * 20


def score(spark, **over):
    base = dict(doc_id=1, category="LAB_REPORT", model_confidence=0.94, runner_up_confidence=0.05, ocr_char_count=1832, render_ok=True, evidence=["glaucoma  SUSPECT", "seen today"])
    base.update(over)
    schema = "doc_id long, category string, model_confidence double, runner_up_confidence double, ocr_char_count long, render_ok boolean, evidence array<string>"
    cls = spark.createDataFrame([tuple(base.values())], schema)
    texts = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    return calibrate(verify_evidence(cls, texts)).first()


def test_confidence_cases(spark):
    good = score(spark)
    assert (good.calibrated_confidence, good.confidence_band, good.force_manual_review) == (0.967, "HIGH", False)
    unknown = score(spark, category="UNKNOWN")
    assert (unknown.calibrated_confidence, unknown.confidence_band, unknown.review_reason) == (0.0, "LOW", "UNKNOWN")
    close = score(spark, model_confidence=0.50, runner_up_confidence=0.45)
    assert close.force_manual_review and close.review_reason == "AMBIGUOUS"
    absent = score(spark, evidence=["zzzz qqqq xxxx 12345"], ocr_char_count=500)
    assert absent.evidence_score < 0.34 and absent.review_reason == "UNVERIFIED_EVIDENCE"
    assert score(spark, ocr_char_count=50).evidence_score == 0.5
    assert score(spark, evidence=[]).evidence_score == 0.5
    assert score(spark, ocr_char_count=0).input_quality_score == 0.3
    assert score(spark, ocr_char_count=400).input_quality_score == 1.0
    retired = score(spark, category="PRESCRIPTION")
    assert retired.review_reason == "AUTO_ROUTE_DISABLED:PRESCRIPTION" and retired.confidence_band == "HIGH"


def test_evidence_counts_altered_quotes_and_blank_ones(spark):
    schema = "doc_id long, evidence array<string>"
    cls = spark.createDataFrame([(1, ["glaucomx suspect in the lexft eye", "", "nothing like it 0987"]), (2, ["x"]), (3, None)], schema)
    texts = spark.createDataFrame([(1, TEXT), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in verify_evidence(cls, texts).collect()}
    assert (got[1].quotes_total, got[1].quotes_exact, got[1].quotes_verified) == (3, 0, 1)
    assert abs(got[1].evidence_score - 1 / 3) < 1e-12 and got[2].evidence_score == 0.0 and got[3].evidence_score == 0.5


def test_quote_scores_of_contained_quote(spark):
    quotes = spark.createDataFrame([(1, "SEEN   today"), (1, "sein today")], "doc_id long, quote string")
    texts = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    scores = {r.quote: r.score for r in quote_scores(quotes, texts).collect()}
    assert scores["SEEN   today"] == 100.0 and 80 < scores["sein today"] < 100


def test_boilerplate(spark):
    df = spark.createDataFrame([(["Dear Dr.", "Imp/Plan:", "  ", None, " Glaucoma suspect ", "glaucoma suspect", "RE:", "please call us", "HIPAA notice"],), (None,)], "q array<string>")
    assert [r.q for r in filter_evidence(df, "q").collect()] == [["Glaucoma suspect"], []]


def routed(spark, category, subtype, sender, **kw):
    df = spark.createDataFrame([(category, subtype, sender)], "category string, subtype string, sender_fax string")
    r = route(df, **kw).first()
    return r.suggested_folder, r.rule_matched


def test_routing_precedence(spark):
    senders = [{"sender_fax": "+1", "folder": "A"}, {"sender_fax": "+1", "folder": "B"}, {"sender_fax": "+2", "folder": None}]
    subs = [{"category": "FORM", "subtype": "X", "folder": "S"}]
    kw = dict(sender_overrides=senders, subtype_overrides=subs)
    assert routed(spark, "FORM", "X", "+1", **kw) == ("A", "sender:+1")
    assert routed(spark, "FORM", "X", " ", **kw) == ("S", "subtype:FORM/X")
    assert routed(spark, "FORM", "Y", "+2", **kw) == ("Forms", "category:FORM")
    assert routed(spark, "NOPE", None, None, **kw) == ("Manual-Review", "unmapped")
    assert routed(spark, None, "X", None, **kw) == ("Manual-Review", "unmapped")
    table = spark.createDataFrame([(2, "FORM", "late"), (1, "FORM", "early")], "pos long, category string, folder string")
    assert routed(spark, "FORM", None, None, rules=table) == ("early", "category:FORM")


def test_policy_defaults_and_rules():
    p = policy_from({"mode": "weird", "min_confidence": 3, "collision_suffix": "-x", "file_uncertain": "no"})
    assert (p.mode, p.min_confidence, p.collision_suffix, p.file_uncertain) == ("SUGGEST", 0.9, " ({n})", True)
    assert policy_from({"mode": " auto ", "min_confidence": 0}).mode == "AUTO"
    assert complete_rules([{"category": "A", "folder": None}, {"category": "B", "folder": "x"}], ["category"]) == [{"category": "B", "folder": "x"}]


def outcome(spark, policy, confidence, band="HIGH", forced=False, category="FORM"):
    df = spark.createDataFrame([(category, confidence, band, forced, "Forms")], "category string, calibrated_confidence double, confidence_band string, force_manual_review boolean, suggested_folder string")
    r = filing_outcome(df, policy).first()
    return r.routing_status, r.final_folder, r.filed


def test_filing_outcome(spark):
    auto, suggest = Policy(mode="AUTO"), Policy()
    assert outcome(spark, suggest, 0.95) == ("SUGGESTED", None, False)
    assert outcome(spark, suggest, None) == ("MANUAL_REVIEW", None, False)
    assert outcome(spark, suggest, 0.95, forced=True)[0] == "MANUAL_REVIEW"
    assert outcome(spark, suggest, 0.95, category="ROI_CONSENT")[0] == "MANUAL_REVIEW"
    assert outcome(spark, auto, 0.90) == ("CONFIRMED", "Forms", True)
    assert outcome(spark, auto, 0.899) == ("MANUAL_REVIEW", "Manual-Review", True)
    assert outcome(spark, auto, 0.95, band="MEDIUM") == ("MANUAL_REVIEW", "Manual-Review", True)
    hold = auto._replace(file_uncertain=False)
    assert outcome(spark, hold, 0.95, band="MEDIUM") == ("SUGGESTED", None, False)
    assert outcome(spark, auto._replace(min_confidence=0.0), None, band="HIGH") == ("CONFIRMED", "Forms", True)


def test_category_normalise(spark):
    df = spark.createDataFrame([(" lab-report",), ("Follow Up",), ("medical_report",), ("x",), (None,), ("",)], "category string")
    assert [r.category_now for r in normalise_category(df).collect()] == ["LAB_REPORT", "MISCELLANEOUS", "LAB_REPORT", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def names(spark, category, spec, facility=None, subtype=None, original="in.PDF", **kw):
    df = spark.createDataFrame([(category, subtype, spec, original, facility)], "category string, subtype string, specification string, original_file_name string, sender_organization string")
    r = suggest_names(df, **kw).first()
    return r


def test_suggested_names(spark):
    r = names(spark, "CONSULTATION_REPORT", "Ophthalmology", "Example Eye Care, PC")
    assert r.suggested_file_name == "Example Eye Care_Ophthalmology Consult.pdf"
    assert r.alternate_file_name == "example_eye_care_ophthalmology_consult.pdf"
    for blank in (None, "  ", " . ", "LLC", ", PC"):
        r = names(spark, "CONSULTATION_REPORT", "allergy consult", blank)
        assert (r.suggested_file_name, r.facility) == ("Allergy Consult.pdf", None)
    assert names(spark, "RADIOLOGY_REPORT", "us abdomen").suggested_file_name == "US Abdomen.pdf"
    assert names(spark, "RADIOLOGY_REPORT", "chest x-ray").alternate_file_name == "chest_xray_radiologyreport.pdf"
    assert names(spark, "FORM", "home_care form", subtype="HOME_HEALTH_PLAN_OF_CARE").alternate_file_name == "home_care_form.pdf"
    assert names(spark, "MISCELLANEOUS", "Insurance Letter", subtype="INSURANCE_LETTER").alternate_file_name == "insurance_letter.pdf"
    r = names(spark, "LAB_REPORT", " ", original="scan")
    assert (r.suggested_file_name, r.naming_source) == ("Colonoscopy Pathology.pdf", "FALLBACK")
    assert names(spark, "NOPE", None).suggested_file_name == "Unreadable Fax.pdf"
    assert names(spark, "LAB_REPORT", "ﬁne café panel").suggested_file_name == "Fine Café Panel.pdf"
    long = names(spark, "LAB_REPORT", "w" * 90, "A Very Long Name Of A Medical Center In Some Town Inc.")
    assert long.facility == "A Very Long Name Of A Medical Center" and len(long.suggested_file_name) <= 84
    assert names(spark, "LAB_REPORT", "CBC", policy=Policy(name_style="snake")).chosen_file_name == "cbc_labreport.pdf"


def sequential_plan(decisions, existing, suffix=" ({n})"):
    """One row at a time, the way a person would."""
    taken = set(existing)
    out = {}
    for ident, tracking, folder, name, at in sorted(decisions, key=lambda d: (d[4], d[0])):
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if stem else (name, "")
        options = [name] + [f"{stem}{suffix.replace('{n}', str(n))}{ext}" for n in range(2, 1000)]
        final = next((o for o in options if (folder, o) not in taken), f"{tracking}__{name}")
        taken.add((folder, final))
        out[ident] = final
    return out


def run_plan(spark, decisions, existing):
    d = spark.createDataFrame(decisions, "id long, tracking_id string, folder string, file_name string, filed_at timestamp_ntz")
    e = spark.createDataFrame(existing, "folder string, file_name string")
    return {r.id: r.final_file_name for r in filing_plan(d, e).collect()}


T0 = datetime(2026, 1, 1)


def test_filing_plan_fixture(spark):
    rows = [(i, f"t{i}", "F", "A.pdf", T0) for i in (1, 2, 3)]
    assert run_plan(spark, rows, [("F", "A (2).pdf")]) == {1: "A.pdf", 2: "A (3).pdf", 3: "A (4).pdf"}


def test_filing_plan_equals_one_by_one(spark):
    rng = random.Random(9)
    pool = ["A.pdf", "A.pdf", "A.pdf", "A (2).pdf", "A (3).pdf", "A (2) (2).pdf", "B.tif", "B (1).tif", "noext", "noext (2)", ".x"]
    rows = [(i, f"t{i}", rng.choice("FG"), rng.choice(pool), T0 + timedelta(days=rng.randrange(5))) for i in range(120)]
    existing = [("F", "A (4).pdf"), ("F", "B.tif"), ("G", "A.pdf"), ("G", "A (7).pdf"), ("G", "noext (3)")]
    got = run_plan(spark, rows, existing)
    assert got == sequential_plan(rows, existing)
    placed = [(r[2], got[r[0]]) for r in rows] + existing
    assert len(placed) == len(set(placed))


def test_names_by_another_taxonomy(spark, tmp_path):
    """Categories, templates and words come from a file, with letters beyond ASCII."""
    import json
    import unicodedata

    from paperroute.operators.naming import with_taxonomy
    from paperroute.operators.responses import land_responses
    from paperroute.operators.routing import normalise_category
    from paperroute.sources.dimensions import aliases_from_json, taxonomy_from_json

    lines = [
        {"code": "INVOICE", "label": "Rechnung", "taxonomy_folder": "Rechnungen", "slug": "rechnung", "vocabulary": ["Stromrechnung"], "subtype_slugs": {"REMINDER": "mahnung"}},
        {"code": "UNKNOWN", "label": "Unbekannt", "taxonomy_folder": "Eingang", "slug": "offen"},
    ]
    (tmp_path / "tax.json").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "alias.json").write_text(json.dumps({"alias": "BILL", "current": "INVOICE"}))
    dims = taxonomy_from_json(spark, str(tmp_path / "tax.json"))
    rows = [(1, "INVOICE", "REMINDER", "Größe É", "a.pdf", None), (2, "INVOICE", None, None, "b.tif", "Müller"), (3, "FORM", None, "x", "c", None), (4, None, None, "y", "d", None)]
    cls = spark.createDataFrame(rows, "id int, category string, subtype string, specification string, original_file_name string, sender_organization string")
    got = {r.id: r for r in with_taxonomy(cls, dims).collect()}
    assert [got[i].taxonomy_folder for i in (1, 2, 3, 4)] == ["Rechnungen", "Rechnungen", "Eingang", "Eingang"]
    assert [got[i].doctype_slug for i in (1, 2, 3, 4)] == ["mahnung", "rechnung", "offen", "offen"]
    names = {r.id: r.suggested_file_name for r in suggest_names(cls, dims=dims).collect()}
    plain = lambda x: unicodedata.normalize("NFC", x)
    assert (plain(names[1]), plain(names[2])) == ("Größe É.pdf", "Müller_Stromrechnung.tif")
    old = spark.createDataFrame([("bill",), ("FORM",)], "category string")
    now = normalise_category(old, aliases=aliases_from_json(spark, str(tmp_path / "alias.json")))
    assert {r.category: r.category_now for r in now.collect()} == {"bill": "INVOICE", "FORM": "UNKNOWN"}
    raw = spark.createDataFrame([('{"documentCategory":"INVOICE","documentSubtype":"REMINDER"}',), ('{"documentCategory":"FORM"}',)], "raw string")
    landed = {r.category: r for r in land_responses(raw, dims=dims).collect()}
    assert "UNKNOWN_CATEGORY" in landed["FORM"].errors and "UNKNOWN_CATEGORY" not in landed["INVOICE"].errors and landed["INVOICE"].subtype_known


def test_filing_plan_of_deep_numbers(spark):
    """Eight levels of numbers are eight written tables; the plan of the last step only reads them."""
    names = ["A" + " (2)" * k + ".pdf" for k in range(9)]
    rows = [(i, f"t{i}", "F", names[(i * 7) % 9], T0 + timedelta(days=(i * 5) % 4)) for i in range(60)]
    existing = [("F", names[3]), ("F", "A (3).pdf")]
    assert run_plan(spark, rows, existing) == sequential_plan(rows, existing)
    d = spark.createDataFrame(rows, "id long, tracking_id string, folder string, file_name string, filed_at timestamp_ntz")
    e = spark.createDataFrame(existing, "folder string, file_name string")
    lines = [filing_plan(x, e)._jdf.queryExecution().optimizedPlan().toString().count("\n") for x in (d.limit(1), d)]
    assert lines[1] - lines[0] < 9 * 6


def test_filing_plan_late_literal_names(spark):
    """A numbered name asked for before, between and after the shorter name comes to its slot; dots and blanks at odd places."""
    rng = random.Random(3)
    pool = ["A.pdf"] * 6 + [f"A ({k}).pdf" for k in (2, 3, 5, 5, 8)] + ["A (5) (2).pdf", "x. (2)", "x.", "x.", "y.tar (2).gz", "y.tar.gz", " (2).pdf", "A (1000).pdf", "A (02).pdf"]
    for n in (40, 400):
        rows = [(i, f"t{i}", "F", rng.choice(pool), T0 + timedelta(days=rng.randrange(30))) for i in range(n)]
        existing = [("F", "A (3).pdf"), ("F", "x (2)."), ("F", "A (5) (3).pdf")]
        assert run_plan(spark, rows, existing) == sequential_plan(rows, existing)


def test_filing_plan_has_no_python(spark):
    d = spark.createDataFrame([(1, "t", "F", "A (2).pdf", T0)], "id long, tracking_id string, folder string, file_name string, filed_at timestamp_ntz")
    plan = filing_plan(d, spark.createDataFrame([], "folder string, file_name string"))._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_long_words_stay_whole(spark):
    from pyspark.sql import functions as F

    from paperroute.operators.naming import _title

    word = "x" * 10_050
    assert spark.range(1).select(_title(F.lit(word)).alias("t")).first().t == "X" + word[1:]


def test_filing_plan_runs_out_of_numbers(spark):
    rows = [(i, f"t{i}", "F", "A.pdf", T0) for i in range(1, 1011)]
    got = run_plan(spark, rows, [("F", "A (5).pdf")])
    assert got == sequential_plan(rows, [("F", "A (5).pdf")]) and got[1010] == "t1010__A.pdf"
