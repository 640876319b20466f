import datetime
import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from paperroute.functions import similarity, text
from paperroute.functions.dates import parse_deadline
from paperroute.functions.grouping import as_of, top_per_group, with_previous, with_running
from paperroute.functions.numeric import with_exact_round
from paperroute.functions.similarity import fn_nfkd, partial_ratio_of, reach_floor, seq_ratio_of
from paperroute.functions.text import clerk_form, collapse, extension, phone_digits, strip


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_partial_ratio(a, b):
    if not a or not b:
        return 100.0 if len(a) == len(b) else 0.0
    if len(a) > len(b):
        a, b = b, a
    best = 0.0
    for x, y in {(a, b), (b, a)} if len(a) == len(b) else {(a, b)}:
        m, n = len(x), len(y)
        windows = [y[max(0, s) : min(n, s + m)] for s in range(-m + 1, n)]
        best = max(best, *(200.0 * lcs(x, w) / (m + len(w)) for w in windows))
    return best


def test_partial_ratio_equals_brute_force():
    rng = random.Random(7)
    for _ in range(250):
        text = "".join(rng.choice("abcd e") for _ in range(rng.randint(0, 60)))
        quote = "".join(rng.choice("abcd e") for _ in range(rng.randint(0, 25)))
        if text and rng.random() < 0.6:
            start = rng.randrange(len(text))
            quote = "".join(c if rng.random() < 0.8 else "z" for c in text[start : start + rng.randint(1, 25)])
        assert partial_ratio_of(quote, text) == pytest.approx(brute_partial_ratio(quote, text), abs=1e-9)


def test_partial_ratio_long_needles_and_pruning():
    rng = random.Random(11)
    for _ in range(25):
        text = "".join(rng.choice("abcdefgh ") for _ in range(700))
        start = rng.randrange(500)
        quote = "".join(c if rng.random() < rng.choice([0.75, 0.85, 0.95]) else "z" for c in text[start : start + rng.randint(60, 140)])
        whole = brute_partial_ratio(quote, text)
        assert partial_ratio_of(quote, text) == pytest.approx(whole, abs=1e-9)
        assert bool(reach_floor([quote], [text], 80.0)[0]) == (whole >= 80.0)


def test_pruned_seq_ratio_keeps_every_match():
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abcde") for _ in range(rng.randint(0, 12)))
        true = difflib.SequenceMatcher(None, a, b).ratio()
        assert (seq_ratio_of(a, b, 0.75) >= 0.75) == (true >= 0.75)


def test_exact_round_equals_python(spark):
    rng = random.Random(5)
    values = [0.0625, 0.0005, 0.8995, 0.2035, 1.0005, -0.0625, 0.5, 0.0, 1.0, 2.675, 0.1234565]
    values += [round(rng.random(), rng.randint(3, 5)) for _ in range(3000)] + [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(v, v) for v in values], "v double, r double")
    for places in (3, 4, 6):
        for row in with_exact_round(df, places, "r").collect():
            assert row.r == round(row.v, places), row
    assert with_exact_round(spark.createDataFrame([(None,)], "r double"), 3, "r").first().r is None


@pytest.mark.parametrize(
    "text", ["2026-09-01", "01SEP2026", "1SEP2026", "September 1, 2026", "Sep 1, 2026", "09/01/2026", " 2026-09-01 "]
)
def test_deadline_forms(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(parse_deadline(F.col("t")).alias("d")).first().d
    assert got == datetime.date(2026, 9, 1)


def test_deadline_rejects(spark):
    bad = ["null", "None", "", None, "next Tuesday", "2026-02-30", "31SEP2026", "Foo 1, 2026", "9/1/2026"]
    df = spark.createDataFrame([(b,) for b in bad], "t string").select(parse_deadline(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == [None] * len(bad)
    strict = spark.createDataFrame([("01SEP2026",)], "t string").select(parse_deadline(F.col("t"), strict=True).alias("d"))
    assert strict.first().d is None


def test_text_helpers(spark):
    df = spark.createDataFrame([("\t Home-Care_Form.PDF  ", "+1 (212) 555-0100")], "a string, p string")
    row = df.select(
        strip(F.col("a")).alias("s"), clerk_form(F.col("a")).alias("c"), collapse(F.col("a")).alias("k"),
        extension(F.col("a")).alias("e"), phone_digits(F.col("p")).alias("p"),
        extension(F.lit(".hidden")).alias("h"), extension(F.lit("x.tar.GZ")).alias("g"),
    ).first()
    assert row.s == "Home-Care_Form.PDF" and row.c == "home care form.pdf" and row.k == "home-care_form.pdf"
    assert row.p == "2125550100" and row.h == ".pdf" and row.g == ".gz"


def test_nfkd(spark):
    df = spark.createDataFrame([("①ﬁé",), (None,)], "t string").select(fn_nfkd("t").alias("n"))
    assert [r.n for r in df.collect()] == ["1fié", None]


def ordered_events(spark, n=400, seed=1):
    """One key holds most rows, times are spread over several slices."""
    rng = random.Random(seed)
    base = datetime.datetime(2026, 1, 1)
    data = [
        ("hot" if rng.random() < 0.7 else rng.choice("abc"), base + datetime.timedelta(minutes=rng.randrange(6000)), i, rng.randrange(9))
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, "k string, ts timestamp_ntz, id int, v int")


def test_sliced_windows_equal_plain_ones(spark):
    data, df = ordered_events(spark)
    slices = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    lagged = {r.id: r.p for r in with_previous(df, ["k"], slices, ["ts", "id"], {"p": "v"}).collect()}
    run = {r.id: (r.s, r.m) for r in with_running(df, ["k"], slices, ["ts", "id"], totals={"s": F.col("v")}, maxima={"m": F.col("v")}).collect()}
    last, total, top = {}, {}, {}
    for k, _, i, v in sorted(data, key=lambda d: (d[1], d[2])):
        assert lagged[i] == last.get(k)
        last[k], total[k], top[k] = v, total.get(k, 0) + v, max(top.get(k, 0), v)
        assert run[i] == (total[k], top[k])


def test_as_of_takes_the_last_earlier_row(spark):
    data, right = ordered_events(spark, 300, 2)
    asks, left = ordered_events(spark, 200, 3)
    left = left.withColumnRenamed("ts", "asked").withColumnRenamed("v", "w")
    right = right.withColumnRenamed("id", "rid")
    got = {r.id: r.as_of for r in as_of(left, right, ["k"], "asked", "ts", ["rid"]).collect()}
    assert len(got) == 200
    for k, t, i, _ in asks:
        before = [(ts, rid, v) for kk, ts, rid, v in data if kk == k and ts <= t]
        want = max(before) if before else None
        assert (got[i] is None) if want is None else (got[i].rid, got[i].v) == want[1:]


def test_top_per_group_is_exact_under_skew(spark):
    data, df = ordered_events(spark, 500, 4)
    got = top_per_group(df, ["k"], [F.desc("ts"), F.col("id")], 20, F.col("id"), slices=4).collect()
    for key in {d[0] for d in data}:
        want = sorted((d for d in data if d[0] == key), key=lambda d: (-d[1].timestamp(), d[2]))[:20]
        assert [r.id for r in sorted((r for r in got if r.k == key), key=lambda r: r.rank)] == [d[2] for d in want]


def test_batched_threshold_equals_brute_force():
    rng = random.Random(13)
    quotes, texts = [], []
    for i in range(140):
        size = rng.choice([0, 3, 30, 150, 250])
        text = "".join(rng.choice("abcdefg ") for _ in range(size))
        width = rng.choice([1, 5, 20, 64, 65, 130])
        start = rng.randrange(len(text)) if text else 0
        base = text[start : start + width] if rng.random() < 0.8 else "".join(rng.choice("abcdefg ") for _ in range(width))
        keep = rng.choice([0.7, 0.8, 0.9])
        quotes.append("".join(c if rng.random() < keep else rng.choice("xyz") for c in base))
        texts.append(text)
    got = reach_floor(quotes, texts, 80.0)
    want = [brute_partial_ratio(q, t) >= 80.0 for q, t in zip(quotes, texts)]
    assert list(got) == want and 20 < sum(want) < 130


def test_partial_ratios_of_many_pairs_at_once(spark):
    """A batch of pairs of all lengths gives what each pair gives alone, and its documents cost no pass of their own each."""
    rng = random.Random(5)
    pick = lambda k, kinds: "".join(rng.choice(kinds) for _ in range(k))
    pairs = [(pick(rng.randrange(90), kinds), pick(rng.randrange(120), kinds)) for kinds in ("abcd e", "aé漢🙂 ") for _ in range(60)] + [("same", "same"), ("abcd", "bcde"), ("", "x"), ("", "")]
    got = similarity.partial_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert list(got) == pytest.approx([brute_partial_ratio(a, b) if a and b else 100.0 * (a == b) for a, b in pairs], abs=1e-9)
    df = spark.createDataFrame([("ab", None), (None, "ab"), ("ab", "xaby"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(similarity.fn_partial_ratio("a", "b")).collect()] == [None, None, 100.0, 0.0]
    quotes = [pick(40, "abcdefgh ") for _ in range(500)]
    steps = []
    kept, similarity._lcs_spans = similarity._lcs_spans, lambda *a: steps.append(1) or kept(*a)
    try:
        similarity.partial_ratios(quotes, [pick(400, "abcdefgh ") for _ in quotes])
    finally:
        similarity._lcs_spans = kept
    assert len(steps) < 50


def test_squeeze_leaves_no_other_white_space(spark):
    """Runs of any white space, alone or mixed, become one blank; characters that are none stay."""
    ws = [*text.WHITESPACE, "  ", "\t ", " \n", "   ", "　\n\n", "\xa0\xa0"]
    values = ["", " ", "a b", *(f"{w}a{w}b{w}c d{w}" for w in ws), *(f"漢{w}b {w}" for w in ws), "a​b"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(text.squeeze(F.col("s"))).collect()]
    assert got == [re.sub(f"[{text.WHITESPACE}]+", " ", v) for v in values]
