"""Pages of the inbox and the gate curve."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperroute.operators.evaluation import gate_quality
from paperroute.operators.inbox import inbox_page, inbox_rows

T0 = datetime(2026, 1, 1)


def tables(spark, folder=None):
    docs = spark.createDataFrame([(i, f"t{i}", f"{i}.pdf", None, "ROUTED" if i % 3 else "OCR", T0 + timedelta(days=i % 7)) for i in range(60)], "id long, tracking_id string, original_file_name string, sender_fax_number string, processing_status string, created_at timestamp_ntz")
    cls = docs.select(F.col("id").alias("doc_id"), F.lit("FORM").alias("category"), *(F.lit(None).cast("string").alias(c) for c in ("subtype", "confidence_band", "sender_organization", "sender_callback_fax", "suggested_file_name", "alternate_file_name")), F.lit(0.5).alias("calibrated_confidence"), F.lit(False).alias("force_manual_review"))
    decisions = docs.select((F.col("id") * 2).alias("id"), F.col("id").alias("doc_id"), F.col("created_at").alias("decided_at"), F.lit("SUGGESTED").alias("routing_status"), F.lit("Forms").alias("suggested_folder"), F.lit("a.pdf").alias("suggested_file_name"))
    meta = docs.select(F.col("id").alias("doc_id"), F.lit('{"senderFax":"1"}').alias("core_json"))
    out = [docs, cls, decisions, meta]
    if folder is not None:
        for k, df in enumerate(out):
            df.write.parquet(f"{folder}/{k}")
        out = [spark.read.parquet(f"{folder}/{k}") for k in range(4)]
    return out


def test_pages_follow_each_other(spark):
    """Page by page the whole inbox comes out once, in order, whatever the size of a page."""
    given = tables(spark)
    want = [r.doc_id for r in inbox_rows(*given).filter("processing_status = 'ROUTED'").orderBy(F.desc("created_at"), F.desc("doc_id")).collect()]
    for size in (1, 17, 100):
        got, after = [], None
        while page := inbox_page(*given, size, after, status="routed").collect():
            got += [r.doc_id for r in page]
            after = (str(page[-1].created_at), page[-1].doc_id)
            if size == 1 and len(got) == 5:
                break
        assert got == (want[:5] if size == 1 else want)


def test_ids_of_the_page_reach_all_scans(spark, tmp_path):
    given = tables(spark, str(tmp_path))
    plan = inbox_page(*given, 3)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 4 and all("PushedFilters: [In(" in line or ", In(" in line for line in scans)


def test_gate_curve(spark):
    rows = [("HIGH", False, 0.9, True, True, "A"), ("HIGH", False, 0.95, False, True, "UNKNOWN"), ("HIGH", None, None, True, True, None), ("LOW", False, 0.99, True, False, "A"), ("HIGH", True, 0.99, True, False, "A"), (None, None, 0.5, None, None, "B")]
    df = spark.createDataFrame(rows, "confidence_band string, force_manual_review boolean, calibrated_confidence double, category_pass boolean, auto_routable boolean, predicted_category string")
    thresholds = [0.0, 0.5, 0.9, 0.95, 1.0]
    got = {(r.gate, r.threshold): tuple(r)[2:] for r in gate_quality(df, thresholds, ("UNKNOWN",)).collect()}
    for t in thresholds:
        for kind in ("policy", "policy_enabled"):
            auto = [b == "HIGH" and not f and (c or 0) >= t and (kind == "policy" or (p or "UNKNOWN") != "UNKNOWN") for b, f, c, _, _, p in rows]
            ok = [bool(r[3]) for r in rows]
            assert got[kind, t] == tuple(sum(a == x and o == y for a, o in zip(auto, ok)) for x, y in ((True, True), (True, False), (False, True), (False, False)))
    assert got["band", None] == (2, 1, 2, 1) and len(got) == 11
    assert {(r.gate, r.threshold): tuple(r)[2:] for r in gate_quality(df.limit(0), [0.9]).collect()} == {("band", None): (0, 0, 0, 0), ("policy", 0.9): (0, 0, 0, 0)}
    plan = gate_quality(df, [i / 1000 for i in range(1000)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2
