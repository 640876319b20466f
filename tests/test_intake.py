from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperroute.operators.inbox import due_queue, recent, top_files
from paperroute.operators.ledger import (
    claim, document_gate, duplicates, gate_reasons, ledger_status, new_claims, readiness, retry_schedule, scan_cycles,
)
from paperroute.operators.storage import folder_manifest, folder_rollup, orphans, reconcile
from paperroute.operators.texts import page_selection, page_text, redact, redaction_report
from paperroute.sources.files import (
    inbound_manifest, manual_tree, model_responses, name_parts, replay, usage_ledger,
)

T0 = datetime(2026, 1, 1)


def test_name_parts(spark):
    names = [
        "(212)555-0100_2026-08-18_0943PM.pdf", "x_(212)555-0100_2026-08-18_0943pm.PDF", "(212)555-0100_2026-08-18_1343AM.pdf",
        None, "", "plain_document.pdf", "2026-08-18_0943PM.pdf", "12345678_2026-08-18_0943PM.pdf", "(212)555-0100_2026-01-18_0943PM.pdf",
    ]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [(r.sender_fax_number, r.received_at) for r in name_parts(df, "n").collect()]
    assert got[0] == got[1] == ("+12125550100", datetime(2026, 8, 19, 1, 43))
    assert got[2] == ("+12125550100", None)
    assert got[3:8] == [(None, None)] * 5
    assert got[8] == ("+12125550100", datetime(2026, 1, 19, 2, 43))


def test_inbound_manifest_reads_a_tree(spark, tmp_path):
    for rel, body in {
        "a.pdf": b"%PDF-1.7 one", "sub/B.PDF": b"%PDF-1.7 one", "~$a.pdf": b"x", "c.pdf.tmp": b"x", "note.txt": b"x",
        "_processed/old.pdf": b"%PDF", "1/2/3/4/5/6/7/deep.pdf": b"%PDF", "1/2/3/4/5/6/7/8/deeper.pdf": b"%PDF",
    }.items():
        path = tmp_path / "in" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    df = inbound_manifest(spark, str(tmp_path / "in"), exclude=["_processed", "_failed"])
    got = {r.relative_path: r for r in df.collect()}
    assert set(got) == {"a.pdf", "sub/B.PDF", "1/2/3/4/5/6/7/deep.pdf"}
    assert got["a.pdf"].content_sha256 == got["sub/B.PDF"].content_sha256 and got["a.pdf"].head_hex == "255044462D312E37"


def test_model_responses_replay(spark, tmp_path):
    (tmp_path / "x.pdf.json").write_text('{"a":\n1}')
    got = replay(spark.createDataFrame([("x.pdf",), ("y.pdf",)], "file string"), model_responses(spark, str(tmp_path)))
    assert {(r.file, r.recorded, r.raw) for r in got.collect()} == {("x.pdf", True, '{"a":\n1}'), ("y.pdf", False, None)}


def test_usage_ledger_counts_malformed_lines(spark, tmp_path):
    lines = ['{"trackingId":"a","at":"2026-09-21T00:00:00","inputTokens":5,"costUsd":null,"calls":[{"call":"classify","model":"m"}]}', "", "   ", "{broken", '{"trackingId":"b","at":"2026-09-20"}', '{"trackingId":"c"}']
    (tmp_path / "u.jsonl").write_text("\n".join(lines))
    rows = usage_ledger(spark, str(tmp_path), since="2026-09-21").collect()
    assert sorted((r.tracking_id or "", r.malformed) for r in rows) == [("", True), ("a", False)]
    assert len(usage_ledger(spark, str(tmp_path)).collect()) == 4


def test_manual_tree(spark):
    paths = ["Ref/Forms/a.pdf", "Ref/loose.pdf", "Line 1/b.pdf", "c.pdf", "d.txt"]
    df = manual_tree(spark.createDataFrame([(p,) for p in paths], "path string"), "Ref")
    got = {r.file: (r.manual_folder, r.source, r.fax_line) for r in df.collect()}
    assert got == {
        "Ref/Forms/a.pdf": ("Forms", "reference", None), "Ref/loose.pdf": (None, "reference", None),
        "Line 1/b.pdf": (None, "fax-line", "Line 1"), "c.pdf": (None, "inbound-root", None),
    }


def test_document_gate_order(spark):
    schema = "file_name string, size_bytes long, head_hex string, pages int, page_variance double, opens boolean, renders boolean"
    pdf, big = "25504446", 26 * 1024 * 1024
    cases = [
        (("a.txt", big, pdf, 1, 99.0, True, True), "UNSUPPORTED_EXTENSION:txt"), (("noext", 1, pdf, 1, 99.0, True, True), "UNSUPPORTED_EXTENSION:"),
        (("a.PDF", big, "00", 1, 99.0, True, True), f"FILE_TOO_LARGE:{big}_bytes"), (("a.pdf", 1, "4D5A9000", 1, 99.0, True, True), "UNSUPPORTED_MIME:application/octet-stream"),
        (("a.pdf", 1, pdf, 0, 1.0, False, True), "PDF_CANNOT_OPEN"), (("a.pdf", 1, pdf, 0, 1.0, True, True), "PDF_NO_PAGES"),
        (("a.pdf", 1, pdf, 51, 1.0, True, False), "PDF_TOO_MANY_PAGES:51"), (("a.pdf", 1, pdf, 50, 1.0, True, False), "PAGE_RENDER_FAILED"),
        (("a.pdf", 1, pdf, 50, 24.9, True, True), "FIRST_PAGE_BLANK"), (("a.pdf", 1, pdf, 50, 25.0, True, True), None),
        (("a.pdf", 1, "ffd8ffe0", 99, 0.0, None, None), None), (("a.tif", 1, "4D4D002A", 3, 0.0, None, None), None),
    ]
    got = document_gate(spark.createDataFrame([c[0] for c in cases], schema)).collect()
    assert [r.reason for r in got] == [c[1] for c in cases]
    assert [r.page_count for r in got[-3:]] == [50, 1, 1] and got[-2].mime_type == "image/jpeg"
    counts = {r.reason_code: r.n for r in gate_reasons(spark.createDataFrame([(r.reason,) for r in got], "reason string")).collect()}
    assert counts["OK"] == 3 and counts["UNSUPPORTED_EXTENSION"] == 2


def test_readiness_cases(spark):
    now, old = T0 + timedelta(hours=5), 1_700_000_000_000
    fresh = int((now - datetime(1970, 1, 1)).total_seconds() * 1000) - 500
    good, schema = "255044462D", "path string, poll_ts timestamp_ntz, size_bytes long, mtime_ms long, head_hex string"
    first = [("zero", 0, old, good), ("short", 9, old, "2550"), ("magic", 9, old, "4D5A9000"), ("good", 9, old, good), ("fresh", 9, fresh, good), ("gone", None, None, None)]
    rows = [(p, now, s, m, h) for p, s, m, h in first]
    rows += [("good", now + timedelta(hours=30), 9, old, good), ("good", now + timedelta(hours=31), 10, old, good), ("fresh", now + timedelta(seconds=2), 9, fresh, good)]
    got = {(r.path, r.poll_ts): r.readiness for r in readiness(spark.createDataFrame(rows, schema)).collect()}
    assert [got[(p, now)] for p, *_ in first] == ["AWAITING_HYDRATION", "AWAITING_HYDRATION", "UNSUPPORTED", "READY", "UNSTABLE", "UNSTABLE"]
    assert got[("good", now + timedelta(hours=30))] == "READY" and got[("good", now + timedelta(hours=31))] == "UNSTABLE"
    assert got[("fresh", now + timedelta(seconds=2))] == "READY"


def ledger_table(spark):
    rows = [("h1", "FILED", "Forms", "x.pdf"), ("h2", "INGESTED", None, None), ("h3", "QUARANTINED", None, None)]
    return spark.createDataFrame(rows, "content_sha256 string, state string, routed_folder string, routed_file_name string")


def test_one_claim_per_content(spark):
    files = [(h, f"/{i}.pdf", T0 + timedelta(minutes=-i)) for i, h in enumerate(["h1", "n1", "n1", "n2", "h2", "n1", "h3", "h1"])]
    manifest = spark.createDataFrame(files, "content_sha256 string, source_path string, seen_at timestamp_ntz")
    got = {r.content_sha256: (r.outcome, r.source_path, r.later_sightings) for r in claim(manifest, ledger_table(spark)).collect()}
    assert got == {"h1": ("KNOWN", "/7.pdf", 1), "h2": ("KNOWN", "/4.pdf", 0), "h3": ("KNOWN", "/6.pdf", 0), "n1": ("CLAIMED", "/5.pdf", 2), "n2": ("CLAIMED", "/3.pdf", 0)}
    assert {r.content_sha256 for r in new_claims(manifest, ledger_table(spark)).collect()} == {"n1", "n2"}
    found = {r.content_sha256: (r.verdict, r.detail) for r in duplicates(manifest, ledger_table(spark)).collect()}
    assert found == {"h1": ("DUPLICATE", "already filed as Forms/x.pdf"), "h2": ("IN_PROGRESS", "already received and currently INGESTED"), "h3": ("DUPLICATE", "already received earlier")}


def test_retry_schedule(spark):
    kinds = ["FAILED", "FAILED", "RETRY", "FAILED", "FAILED", "FAILED", "RETRY", "FILED", "RETRY"]
    ingested = spark.createDataFrame([("g", 1, T0, "INGESTED")], "content_sha256 string, event_id int, at timestamp_ntz, kind string")
    assert retry_schedule(ingested).first().state == "INGESTED"
    rows = [("h", i, T0 + timedelta(hours=20 * i), k) for i, k in enumerate(kinds)]
    got = retry_schedule(spark.createDataFrame(rows, "content_sha256 string, event_id int, at timestamp_ntz, kind string")).orderBy("event_id").collect()
    assert [r.attempt for r in got][:6] == [1, 2, 0, 1, 2, 3]
    assert [r.state for r in got] == ["FAILED", "FAILED", "DISCOVERED", "FAILED", "FAILED", "QUARANTINED", "DISCOVERED", "FILED", "RETRY_REFUSED"]
    base = int((rows[1][2] - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert got[1].next_attempt_ms == base + 120_000 and got[5].next_attempt_ms is None


def test_due_recent_status_cycles(spark):
    schema = "content_sha256 string, state string, origin string, next_attempt_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
    rows = [("a", "FAILED", "SCANNER", T0, T0, T0), ("b", "FAILED", "SCANNER", T0 + timedelta(days=2), T0, T0 + timedelta(days=1)), ("c", "DISCOVERED", "UPLOAD", None, T0, T0), ("d", "INGESTED", "SCANNER", None, T0, T0), ("e", "UNSTABLE", "SCANNER", None, T0 - timedelta(days=1), T0), ("f", "FILED", "SCANNER", None, T0, T0)]
    ledger = spark.createDataFrame(rows, schema)
    assert [r.content_sha256 for r in due_queue(ledger, "2026-01-02").collect()] == ["e", "a"]
    assert recent(ledger, k=1).first().content_sha256 == "b" and [r.content_sha256 for r in recent(ledger, state="failed").collect()] == ["a", "b"]
    status = {(r.metric, r.key): r.n for r in ledger_status(ledger).collect()}
    assert status[("backlog", "all")] == 5 and status[("filed", "all")] == 1 and status[("quarantined", "all")] == 0
    cycles = spark.createDataFrame([(1, "KNOWN"), (1, "NOT_READY"), (2, "CLAIMED"), (2, "INGESTED"), (3, "FAILED")], "cycle int, outcome string")
    notes = {r.cycle: r.note for r in scan_cycles(cycles).collect()}
    assert notes == {1: "ok: nothing new (1 already known, 1 not ready, of 2 seen)", 2: "ok", 3: "ok"}


def test_storage(spark):
    files = spark.createDataFrame([("/o/F/a.pdf", 5, T0), ("/o/F/b.pdf", 6, T0), ("/o/F/G/zz.pdf", 7, T0), ("/o/F/.hid", 1, T0)], "path string, size_bytes long, modified_at timestamp_ntz")
    decisions = spark.createDataFrame([(1, 1, "\\o\\F\\a.pdf", "a.pdf"), (2, 2, "/o/F/a.pdf", "b.pdf"), (3, 3, None, "b.pdf"), (4, 99, "/o/F/G/zz.pdf", "zz.pdf")], "id long, doc_id long, final_path string, final_file_name string")
    docs = spark.createDataFrame([(i, f"t{i}", f"in{i}.pdf") for i in (1, 2, 3)], "id long, tracking_id string, original_file_name string")
    cls = spark.createDataFrame([(2, "FORM")], "doc_id long, category string")
    out = reconcile(files, decisions, docs, cls)
    got = {r.path: (r.matched_by, r.doc_id, r.category) for r in out.collect()}
    assert got == {"/o/F/a.pdf": ("PATH", 2, "FORM"), "/o/F/b.pdf": ("NAME", 2, "FORM"), "/o/F/G/zz.pdf": ("NONE", None, None)}
    assert [r.path for r in orphans(out).collect()] == ["/o/F/G/zz.pdf"]
    roll = {r.folder: (r.own_files, r.files, r.bytes) for r in folder_rollup(files).collect()}
    assert roll["/o/F"] == (3, 4, 19) and roll["/o"] == (0, 4, 19) and roll["/o/F/G"] == (1, 1, 7)
    assert [r.name for r in folder_manifest(files).filter("folder = '/o/F'").collect()] == [".hid", "a.pdf", "b.pdf"]
    top = top_files(files.withColumn("folder", F.lit("x")), k=2).collect()
    assert len(top) == 2 and all(r.truncated and r.file_count == 4 for r in top)


def test_page_text(spark):
    native = spark.createDataFrame([(1, "n" * 30), (2, "  short "), (3, None)], "doc_id long, native_text string")
    pages = spark.createDataFrame([(1, 0, "raw", "proc"), (2, 1, "longer raw", "p"), (2, 0, "same", "SAME  "), (4, 0, None, "only")], "doc_id long, page int, raw_text string, proc_text string")
    got = {r.doc_id: r for r in page_text(native, pages).collect()}
    assert (got[1].mode, got[1].char_count) == ("NATIVE", 30)
    assert got[2].text == "SAME  \n\nlonger raw" and got[2].pages_preprocessed == 1
    assert got[3].text == "" and got[4].text == "only"
    assert {(r.doc_id, r.page): r.selected for r in page_selection(pages).collect()}[(2, 1)] == "raw"


def test_redaction_order_and_counts(spark):
    text = "SSN 123-45-6789 DOB: 1/2/1970 on 03-04-2024 MRN: A-77 member id 12 acct 12345678901 ok"
    df = spark.createDataFrame([(text,), (None,)], "text string")
    row = redact(df, counts=True).first()
    assert row.text == "SSN [SSN] [DOB] on [DATE] [ID] [ID] acct [ID] ok"
    assert (row.n_ssn, row.n_dob, row.n_date, row.n_id) == (1, 1, 1, 3)
    assert {r.tag: (r.replaced, r.documents) for r in redaction_report(df).collect()} == {"SSN": (1, 1), "DOB": (1, 1), "DATE": (1, 1), "ID": (3, 1)}
