import os
from datetime import datetime

from pyspark.sql import functions as F

from paperroute.streaming import claims, jobs


def test_intake_claims_content_once_across_batches(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()

    def drop(name, body):
        (root / name).write_bytes(body)

    def run():
        jobs.ingest_stream(jobs.intake_files(spark, str(root)), str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination()
        rows = jobs.ledger_rows(spark, str(tmp_path / "ledger"), jobs.intake_files(spark, str(root)))
        return sorted(r.source_file_name for r in rows.collect())

    drop("a.pdf", b"%PDF one")
    drop("copy of a.pdf", b"%PDF one")
    drop("b.pdf", b"%PDF two")
    first = run()
    assert len(first) == 2 and "b.pdf" in first
    drop("renamed.pdf", b"%PDF one")
    drop("c.PDF", b"%PDF three")
    assert run() == sorted([*first, "c.PDF"])


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, datetime(2026, 1, 1))], "doc_id long, seq int, given_at timestamp_ntz")
    for _ in range(2):
        jobs._write_batch(rows, str(tmp_path / "t"), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    newer = rows.withColumns({"seq": rows.seq + 1})
    jobs._write_batch(newer, str(tmp_path / "t"), 1)
    assert jobs.upserted(spark, str(tmp_path / "t"), "doc_id", ["given_at", "seq"]).first().seq == 2
    jobs.compact(spark, str(tmp_path / "t"), str(tmp_path / "t2"), "doc_id", ["given_at", "seq"])
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 1


def hashes(spark, ids):
    return spark.createDataFrame([(f"{i * 7919 % 100003:064x}", i) for i in ids], "content_sha256 string, n long")


def test_claims_over_many_batches(spark, tmp_path, monkeypatch):
    """Fifty batches: few folders and files, every hash once, the same rows on replay, nothing read of a broken run."""
    monkeypatch.setattr(claims, "TAIL", 4)
    table = str(tmp_path / "t")
    shape = hashes(spark, [0]).withColumn("state", F.lit("x")).schema
    files = []
    for b in range(50):
        claims.claim(hashes(spark, range(5 * b, 5 * b + 10)).coalesce(1), table, b, state=F.lit("D"))  # half are new
        files.append(len(claims.claimed(spark, table, shape).inputFiles()))
    assert max(files[25:]) <= max(files[:25]) + 2 and max(files) <= 10
    assert len(list((tmp_path / "t" / "tail").iterdir())) <= 2 * 4 + 1
    rows = claims.claimed(spark, table, shape)
    assert rows.count() == rows.select("content_sha256").distinct().count() == 49 * 5 + 10
    before = sorted(map(tuple, rows.collect()))
    (tmp_path / "t" / "runs" / "0-99-5").mkdir()  # a writer was lost before the end of this one
    claims.claim(hashes(spark, range(245, 255)).coalesce(1), table, 49, state=F.lit("D"))
    assert sorted(map(tuple, claims.claimed(spark, table, shape).collect())) == before
    runs = claims._runs(spark, table)[0]
    assert [r.first for r in runs[1:]] == [r.last + 1 for r in runs[:-1]] and len(runs) <= 5


def test_lookups_reach_the_files(spark, tmp_path, monkeypatch):
    """Few hashes are pushed down to sorted files with Bloom filters; many are joined."""
    monkeypatch.setattr(claims, "TAIL", 1)
    table = str(tmp_path / "t")
    claims.claim(hashes(spark, range(2000)), table, 0, state=F.lit("D"))
    claims.claim(hashes(spark, range(1990, 2003)), table, 1, state=F.lit("D"))
    claims.claim(hashes(spark, range(0, 3500)), table, 2, state=F.lit("D"))
    shape = hashes(spark, [0]).withColumn("state", F.lit("x")).schema
    got = claims.claimed(spark, table, shape)
    assert {(r.n, r.batch_id) for r in got.collect()} == {(i, 0 if i < 2000 else 1 if i < 2003 else 2) for i in range(3500)}
    plan = claims.claimed(spark, table, shape, 9).filter(F.col("content_sha256").isin(["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "In(content_sha256, [a,b])" in plan


def test_usage_lines_count_once(spark, tmp_path):
    """Lines sent twice in one batch, in the next and much later count once; no state is kept in the stream."""
    def lines(days):
        return spark.createDataFrame([(f"2026-01-{d:02d}T00:00:00", f"t{d % 3}", "classify", d, 10, 1, 0.5 if d != 4 else None) for d in days],
                                     "used_at string, tracking_id string, stage string, call_no long, input_tokens long, output_tokens long, cost_usd double")

    for part in ([1, 1, 2], [2, 3, 4], [20], [1, 2, 3, 4, 5, 20]):
        lines(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(lines([1]).schema).parquet(str(tmp_path / "in"))
        jobs.usage_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    got = {r.tracking_id: (r.lines, r.input_tokens, r.cost_usd) for r in jobs.usage_totals(spark, str(tmp_path / "t"), lines([1])).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"t0": (1, 10), "t1": (2, 20), "t2": (3, 30)}
    assert got["t1"][2] is None and float(got["t2"][2]) == 1.5
    assert not (tmp_path / "cp" / "state").exists()


def test_tasks_of_a_claim_grow_with_the_batch(spark, tmp_path, monkeypatch):
    """A batch of many lines, or a table of many, is dealt over more tasks than the stream has cores, and counts the same."""
    monkeypatch.setattr(claims, "TASK_ROWS", 100)
    widths = []
    kept = jobs.claim
    monkeypatch.setattr(jobs, "claim", lambda rows, *a, **k: (widths.append(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), kept(rows, *a, **k)))

    def lines(low, high):
        used = F.concat(F.lit("2026-01-01T"), F.lpad(F.col("id").cast("string"), 8, "0"))
        return spark.range(low, high).select(used.alias("used_at"), F.lit("t").alias("tracking_id"), F.lit("classify").alias("stage"), F.col("id").alias("call_no"),
                                             F.lit(10).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(0.5).alias("cost_usd"))

    for low, high in ((0, 3000), (2990, 3010)):
        lines(low, high).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(lines(0, 1).schema).parquet(str(tmp_path / "in"))
        jobs.usage_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert widths == [30, 30]
    total = jobs.usage_totals(spark, str(tmp_path / "t"), lines(0, 1)).first()
    assert (total.lines, total.input_tokens) == (3010, 30100)


def usage_lines(spark, ids):
    """Two lines of each id; some values are null, and a third of the lines belong to one document."""
    n = F.col("id")
    used = F.concat(F.lit("2026-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00"))
    return ids.select(
        F.when(n % 11 != 0, used).alias("used_at"), F.when(n % 3 != 0, F.concat(F.lit("t"), (n / 4).cast("long"))).alias("tracking_id"),
        F.when(n % 7 != 0, "classify").alias("stage"), n.alias("call_no"), F.when(n % 5 != 0, n % 50).alias("input_tokens"),
        (n % 9).alias("output_tokens"), F.when(n % 1000 != 1, n / 8).alias("cost_usd"),
    ).withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return sum(os.path.getsize(f) for f in files if "/shuffle_" in f and os.path.exists(f))


def test_usage_needs_little_disk_beside_its_table(spark, tmp_path, monkeypatch):
    """Large batches are claimed slice by slice: no shuffle of one outlasts it, keys are short, totals are those of all lines."""
    monkeypatch.setattr(claims, "SLICE_ROWS", 10_000, raising=False)
    before, held, parts, kept = shuffle_bytes(spark), [], [], jobs.claim

    def watched(*a, **k):
        kept(*a, **k)
        held.append(shuffle_bytes(spark) - before)
        parts.append(k.get("part"))

    monkeypatch.setattr(jobs, "claim", watched)
    shape = usage_lines(spark, spark.range(1)).schema
    for low, high in ((0, 30_000), (0, 40_000), (39_000, 40_010), (5, 9)):
        usage_lines(spark, spark.range(low, high)).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        jobs.usage_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert max(held) < 40_010 * 5
    assert parts == [(i, n) for n in (6, 8, 4, 1) for i in range(n)]
    stored = sum(f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet"))
    assert stored < 40_010 * 50
    got = jobs.usage_totals(spark, str(tmp_path / "t"), usage_lines(spark, spark.range(1)))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = usage_lines(spark, spark.range(40_010)).distinct().withColumn("cost_usd", F.col("cost_usd").cast("decimal(24,10)")).groupBy("tracking_id", "stage").agg(
        F.count("*").alias("lines"), F.sum("input_tokens"), F.sum("output_tokens"), F.when(F.count("cost_usd") == F.count("*"), F.sum("cost_usd")))
    assert sorted(map(str, got.collect())) == sorted(map(str, (got.sparkSession.createDataFrame(want.rdd, got.schema)).collect()))


def test_a_batch_counts_when_its_last_slice_is_written(spark, tmp_path):
    """What a lost writer left of a batch is not read, and goes when the batch comes again in other slices."""
    rows, table = hashes(spark, range(100)), str(tmp_path / "t")

    def claim(batch_id, i, n):
        claims.claim(claims.sliced(rows, ["n"], i, n), table, batch_id, by=["n"], part=(i, n))

    for i in (0, 1):
        claim(0, i, 3)
    assert claims.claimed(spark, table, rows.schema).count() == 0
    for i in (0, 1):
        claim(0, i, 2)
    for i in range(4):
        claim(1, i, 4)
    got = claims.claimed(spark, table, rows.schema)
    assert sorted((r.n, r.batch_id) for r in got.collect()) == [(i, 0) for i in range(100)]


def test_the_span_of_a_batch_holds_its_keys(spark, tmp_path):
    """Times of any text, also ones that begin another, lie in the range that the table is read in."""
    times = ["2026", "2026-01", "a", "a|b", "a|", "", None, "|g", "ä", "z" * 40]
    lines = spark.createDataFrame([(t, f"t{i}", "classify", i, 10, 1, 0.5) for i in range(110) for t in times],
                                  "used_at string, tracking_id string, stage string, call_no long, input_tokens long, output_tokens long, cost_usd double").coalesce(2)
    for _ in range(3):
        lines.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
        jobs.usage_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    # a line without a time says something else than one with an empty time
    assert jobs.usage_totals(spark, str(tmp_path / "t"), lines).agg(F.sum("lines")).first()[0] == 1100
