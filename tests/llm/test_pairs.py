"""Fill-in-middle, hard negatives and the n-gram join against plain versions."""

import hashlib
import itertools
import math
import random
import re

import pytest
from cases import EDGES, complements, documents, edge_docs, no_docs, plain_counts, plain_near_duplicates, shingle_set
from pyspark.sql import functions as F

from paperroute.llm import common, components, groupjoin, hardnegatives
from paperroute.llm.groupjoin import jaccard_components
from paperroute.llm.hardnegatives import hard_negatives
from paperroute.llm.infilling import fill_in_middle, restored, unit_ends
from paperroute.llm.neardup import near_duplicates
from paperroute.llm.quality import quality_rules


def plain_infilling(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    first = h[3] % 100 < spm
    return len(units), "spm" if first else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if first else f"<P>{pre}<S>{suf}<M>{mid}"


def test_infilling_edges(spark):
    odd = ["\n", "\n\n\n", "a\nb", "a\nb\n", "x<P>y\nz", "<M>", "<<\nS>\n<", "no marker <p> here\n" * 5, "é漢🙂\r\n second\x0bhalf\n" * 7, "<\n<S\n", "|.*\\E\n$1"]
    docs = edge_docs(spark).select("doc_id", "text", "kept", "n", "row").unionByName(
        spark.createDataFrame([(100 + i, t, "c", "c", "c") for i, t in enumerate(odd)], "doc_id long, text string, kept string, n string, row string")
    )
    plain = sorted([(i, *plain_infilling(i, t)) for i, t in [(e[0], e[1]) for e in EDGES] + [(100 + i, t) for i, t in enumerate(odd)]], key=str)
    got = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).join(docs.select("doc_id", "text").distinct(), "doc_id", "left")
    rows = fill_in_middle(docs).collect()
    assert sorted(map(tuple, rows), key=str) == plain
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    known = {t or "" for _, t, *_ in EDGES} | set(odd)
    assert all(r.back in known and r.back == (r.text or "") for r in got.filter("doc_id <> 11 AND doc_id IS NOT NULL").collect())
    assert fill_in_middle(no_docs(spark)).collect() == []
    held = fill_in_middle(docs, with_row=True).filter("doc_id = 101").first()
    assert held.row.row == "c" and held.row.text == "\n\n\n"


def test_infilling_parameters(spark):
    docs = spark.range(400).select(F.col("id").alias("key"), F.expr("repeat(concat('line ', id, '\n'), cast(id % 7 as int))").alias("body"))
    given = {r.key: r.body for r in docs.collect()}
    got = fill_in_middle(docs, seed=3, percent=60, spm_percent=20, id_col="key", text_col="body").collect()
    assert sorted(map(tuple, got)) == [(i, *plain_infilling(i, t, 3, 60, 20)) for i, t in sorted(given.items())]
    words = fill_in_middle(docs, unit=r"\S*\s|\S+", markers=("[a]", "[b]", "[c]"), id_col="key", text_col="body")
    back = words.select("doc_id", restored(F.col("output"), F.col("form"), ("[a]", "[b]", "[c]")).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == given
    with pytest.raises(ValueError):
        unit_ends("a b", r"\w")


def test_infilling_very_long(spark):
    text = "".join(f"line {i} of a long text\n" for i in range(800_000)) + "end"  # 20 MB
    got = fill_in_middle(spark.createDataFrame([(5, text), (6, "x" * 20_000_000)], "doc_id long, text string")).select("doc_id", "n", "form", F.sha2("output", 256).alias("d")).collect()
    for r in got:
        n, form, _, _, out = plain_infilling(r.doc_id, text if r.doc_id == 5 else "x" * 20_000_000)
        assert (r.n, r.form, r.d) == (n, form, hashlib.sha256(out.encode()).hexdigest())


def test_infilling_random():
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choice("ab\n\r é<") for _ in range(rng.randrange(30)))
        ends = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
        assert unit_ends(text) == ends


def plain_negatives(rows, k=10, positives=5, every=100, scale=256, low=30, high=90):
    """Every window on its own, over all rows."""
    good = [(i, lab, tuple(math.floor(scale * x) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in good:
        if i % every == 0:
            anchors[i] = max(anchors.get(i, ((), 0)), (v, lab)) if i in anchors else (v, lab)
    out = []
    for a, (v, lab) in anchors.items():
        scored = sorted((-max(-(2**56), min(2**56, sum(x * y for x, y in zip(v, w, strict=True)))), i, m == lab) for i, m, w in good if i != a and len(w) == len(v))
        for nth, (p, i, _) in enumerate([x for x in scored if x[2]][:positives], 1):
            window = [x for x in scored if not x[2] and low * -p <= 100 * -x[0] <= high * -p][:k]
            out += [(a, i, r, x[1], -p, -x[0], nth) for r, x in enumerate(window, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.25], 2), (0, [1.0, 0.25], 2), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, [0.5, 0.25], 2), (4, [0.5, 0.25], 3),
        (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 2), (9, [0.5, 0.5], None), (None, [0.5, 0.5], 1), (10, [], 1),
        (11, [0.5], 2), (100, [-1.0, -1.0], 1), (101, [0.0, 0.0], 4), (200, [0.0, 0.0], 4), (201, [0.0, 0.0], 4), (300, [], 2), (301, [], 2), (302, [], 3),
        (400, [3e38, 3e38], 5), (401, [3e38, 3e38], 5), (402, [1e38, -1e38], 6), (-100, [1.0, 0.5], 1), (3, [0.5, 0.25], 2),
    ]
    docs = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'clash' AS slot", "1 AS part", "2 AS n", "3 AS rank")
    saturated = [(i, v if v is None else [x if x is None or not math.isfinite(x) else max(-(2.0**63) / 256, min((2.0**63 - 1024) / 256, x)) for x in v], lab) for i, v, lab in rows]
    assert sorted(map(tuple, hard_negatives(docs).collect())) == plain_negatives(saturated)
    assert hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives_random(spark, seed, monkeypatch):
    monkeypatch.setattr(hardnegatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hardnegatives, "ANCHOR_ROWS", 5)
    rng = random.Random(seed)
    hot = lambda: 0 if rng.random() < 0.4 else rng.randrange(4)
    values = [[rng.randrange(-4, 9) / 8 for _ in range(4)] if seed else [0.5] * 4 for _ in range(400)]  # few values: many ties
    rows = [(i, v, hot()) for i, v in enumerate(values)]
    got = hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(5), k=3 + seed, positives=2 + seed, every=20, low_percent=20 + 5 * seed, high_percent=95)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 3 + seed, 2 + seed, 20, 256, 20 + 5 * seed, 95)


def components_of(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string") if isinstance(docs, list) else docs
    return {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_components(df, **how).collect()}


def plain_components(docs, k=4, percent=85):
    whole = plain_near_duplicates([(i, t) for i, t in docs if i is not None], k, percent)
    return {(i, len(shingle_set(t, k))): whole.get(i) for i, t in docs}


def test_group_join_edges(spark):
    assert components_of(spark, edge_docs(spark)) == plain_components([(i, t) for i, t, *_ in EDGES])
    assert jaccard_components(edge_docs(spark)).count() == len(EDGES)
    assert jaccard_components(no_docs(spark)).collect() == []


def test_group_join_documents(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    assert components_of(spark, docs) == plain_components(docs)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_group_join_random(spark, seed, monkeypatch):
    """Near copies of a few texts at similarities around the threshold, exact copies, and lists that need several rounds."""
    monkeypatch.setattr(groupjoin, "WORK", 0 if seed % 2 else 8)
    monkeypatch.setattr(groupjoin, "HUB", 3)
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 12, 40, 90]))] for _ in range(6)]
    docs = []
    for i in range(220):
        words = list(rng.choice(bases[:1 + rng.randrange(6)]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1])] = [f"e{rng.randrange(40)}"]
        docs.append((rng.randrange(200), " ".join(words)))
    percent = rng.choice([85, 85, 70, 95])
    bits = 3 if seed == 3 else 18  # a poor order must give the same links
    assert components_of(spark, docs, percent=percent, bits=bits) == plain_components(docs, percent=percent)


def test_group_join_same_prefix(spark):
    """Sets of one size whose rare shingles are the same and whose frequent ones are not: one group, several units."""
    common = [[f"{x}{i}" for i in range(30)] for x in "pqrst"]
    filler = [(1000 + 10 * g + j, " ".join(c)) for g, c in enumerate(common) for j in range(9)]
    rare = [f"rare{i}" for i in range(12)]
    docs = filler + [(g * 3 + j, " ".join(rare + c[: 29 - j] + [f"z{j}"] * (j + 1))) for g, c in enumerate(common) for j in range(3)]
    assert components_of(spark, docs) == plain_components(docs)


def pairs_verified(spark, docs, monkeypatch):
    """How many pairs of sets are fetched in all, and the components."""
    seen = []
    keep = groupjoin.with_both_sets

    def counted(pairs, sets):
        pairs = groupjoin.saved(pairs.select("a", "b").distinct(), "counted")
        seen.append(0 if "n" in sets.columns else pairs.count())  # prefixes do not count
        return keep(pairs, sets)

    monkeypatch.setattr(groupjoin, "with_both_sets", counted)
    got = components_of(spark, docs)
    monkeypatch.setattr(groupjoin, "with_both_sets", keep)
    return sum(seen), got


@pytest.mark.parametrize("own", [150, 12, 3])
def test_group_join_work_grows_in_proportion(spark, own, monkeypatch):
    """Documents of one template and words of their own, far from each other or nearly linked, are not all compared."""
    def made(n):
        rng = random.Random(own)
        docs = []
        for i in range(n):
            words = [f"t{i}" for i in range(240)]
            for k in rng.sample(range(240), own):
                words[k] = f"own{rng.randrange(10**9)}"
            docs.append((i, " ".join(words)))
        return docs

    small, _ = pairs_verified(spark, made(100), monkeypatch)
    large, got = pairs_verified(spark, docs := made(400), monkeypatch)
    if own == 3:  # edits of several documents at one place of the template do meet
        assert large < 400 * 399 / 2 / 5
        assert got == plain_components(docs)
    else:
        assert large <= 5 * small + 100


def test_complements_are_told_apart(spark):
    """Words and lines with equal polynomial hashes are different words and lines."""
    a, b = complements(11)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a}\n{b}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3}
    assert components_of(spark, [(1, a), (2, b)]) == {(1, 1): 1, (2, 1): 2}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.n_dup_lines for r in quality_rules(docs, labels).collect()}
    assert got == {1: 0, 2: 0, 3: plain_counts(f"{a}\n{b}")[3]}


def test_group_join_keeps_no_steps_and_sends_few_sets(spark, tmp_path, monkeypatch):
    """Only rows that pairs ask for pass, all of them; steps that later ones stand for are gone in the end."""
    rows = spark.range(-3000, 3000).select(F.col("id").alias("node"), F.array("id").alias("shingles")).unionByName(spark.createDataFrame([(None, None)], "node long, shingles array<long>"))
    for wanted in ([], [5], list(range(-2000, 2000, 7)), list(range(-3000, 3000))):
        asked = spark.createDataFrame([(x,) for x in wanted], "a long")
        got = [r.node for r in groupjoin.among(rows, "node", asked, "a", len(wanted)).collect()]
        assert set(wanted) <= set(got) and len(got) == len(set(got)) <= len(wanted) + 0.05 * 6000
    near = [" ".join(f"w{i % 50 if i != k else 1000 + k}" for i in range(200)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(near + near)), "doc_id long, text string")
    number = itertools.count()
    monkeypatch.setattr(common, "work_dir", lambda _, label: f"{tmp_path}/{label}-{next(number)}")
    jaccard_components(docs).collect()
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert not left & {"buckets", "prefixes", "wanted", "entries", "placed", "open-lists", "large-lists", "centres", "around", "stars", "differences", "met"}


def test_group_join_of_sizes_apart_needs_no_centres(spark, monkeypatch):
    """Documents that share a shingle and differ in size are never held against a centre; links of stars take no round."""
    entries, steps = [], []
    keep, save = groupjoin.large_lists, common.saved
    monkeypatch.setattr(groupjoin, "large_lists", lambda rows, *how: entries.append(rows.count()) or keep(rows, *how))
    for module in (groupjoin, components):
        monkeypatch.setattr(module, "saved", lambda df, label: steps.append(label) or save(df, label))
    docs = [(i, " ".join(["a b c d", *(f"w{i}x{k}" for k in range(round(4 * 1.3**i)))])) for i in range(20)]
    assert components_of(spark, docs) == plain_components(docs)
    assert entries == [0]
    assert len(steps) < 45
    links = spark.createDataFrame([(5, 1), (3, 1), (1, 4), (7, 6)], "a long, b long")
    steps.clear()
    assert {(r.node, r.component) for r in components.connected_components(links).collect()} == {(5, 1), (3, 1), (4, 1), (7, 6)}
    assert steps == ["links"]
