"""Near-duplicates, repeated passages, quality, shards, top-k and the pipeline against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import EDGES, SF, documents, edge_docs, no_docs, plain_counts, plain_near_duplicates, plain_removed, shingle_set

import corpus_pipeline
from paperroute.llm.components import connected_components
from paperroute.llm.cotraining import quality_classes
from paperroute.llm.neardup import near_duplicates
from paperroute.llm.quality import quality_rules
from paperroute.llm.sharding import mixed_shards
from paperroute.llm.suffixdup import without_repeats
from paperroute.llm.topk import threshold_top, top_k


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {i: i for x in links for i in x}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent if find(i) != i}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited_copies(n, edits, seed):
    """Copies of one text with edits of their own, of which some are passed on to later copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts, made = [" ".join(base)], [base]
    for i in range(1, n):
        words = list(made[rng.randrange(len(made))] if rng.random() < 0.5 else base)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(words))
            words[k] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                del words[rng.randrange(len(words))]
        made.append(words)
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_in_one_large_group(spark, seed):
    docs = list(enumerate(edited_copies(150, 5, seed) + edited_copies(30, 2, seed + 10) + edited_copies(2, 0, 99)))
    random.Random(seed).shuffle(docs)
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(frame).collect()}
    want = plain_near_duplicates([(i, t) for i, (_, t) in enumerate(docs)])
    assert got == want and len(set(got.values())) > 3


def test_near_duplicate_edges(spark):
    got = near_duplicates(edge_docs(spark)).collect()
    want = plain_near_duplicates([(i, t) for i, t, *_ in EDGES if i is not None])
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(shingle_set(t))) for i, t, *_ in EDGES)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])
    assert want[2] == 1 and want[7] == 6 and want[4] == 4
    assert near_duplicates(no_docs(spark)).count() == 0


def test_near_duplicates_of_one_id_with_two_texts(spark):
    a, b = edited_copies(1, 0, 5)[0], edited_copies(1, 0, 6)[0]
    frame = spark.createDataFrame([(3, a), (9, a), (9, b), (5, b), (7, "other")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(frame).collect()} == {(3, 3), (9, 3), (5, 3), (7, 7)}


@pytest.mark.parametrize("source", ["edges", "documents", "periodic"])
def test_repeated_passages(spark, source):
    if source == "periodic":
        rows = [(i, ("ab" * 40 + str(i // 3)) * 3 + "c" * (45 + i)) for i in range(12)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = edge_docs(spark) if source == "edges" else documents(spark)
    want = []
    for i, b, gone in plain_removed([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]):
        spans = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        want.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = without_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert any(x[2] for x in want)


def test_repeated_passages_rows(spark):
    got = without_repeats(edge_docs(spark), with_row=True)
    assert sorted(str(r.row["doc_id"]) for r in got.collect()) == sorted(str(i) for i, *_ in EDGES)
    assert got.filter("doc_id = 12").first().kept_text == EDGES[-1][1]
    assert without_repeats(no_docs(spark), with_row=True).count() == 0


@pytest.mark.parametrize("source", ["edges", "documents"])
def test_quality_counts(spark, source):
    docs = edge_docs(spark) if source == "edges" else documents(spark)
    got = quality_rules(docs, labels(spark)).collect()
    want = [(str(r.doc_id), *plain_counts(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(want)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= -0.5)


def test_quality_ratio_by_hand(spark):
    """The mean log ratio of trigrams against one counted in plain Python, without hashing apart by bucket."""
    from paperroute.llm.words import Texts, grams
    import pyarrow as pa

    docs = [(1, "abcabcabd"), (2, "xyzxyz"), (3, "abc"), (4, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.llr for r in quality_rules(frame, marks, prior=2.0).collect()}

    def tri(t):
        return [int(x) for x in grams(Texts(pa.array([t])), 1 << 15)[0]]

    raw, good = Counter(g for _, t in docs for g in tri(t)), Counter(tri(docs[0][1]))
    n, m = sum(raw.values()), sum(good.values())
    for i, t in docs:
        want = [np.log((good[g] + 2.0 * raw[g] / n) / (m + 2.0) / (raw[g] / n)) for g in tri(t)]
        assert got[i] == pytest.approx(np.mean(want) if want else 0.0, abs=1e-5)


def test_quality_without_labels(spark):
    got = quality_rules(documents(spark), no_labels(spark)).collect()
    assert all(r.llr == 0 and r.kept != r.base_failed for r in got)
    assert quality_rules(no_docs(spark), no_labels(spark)).count() == 0
    rows = quality_rules(edge_docs(spark), labels(spark), with_row=True).select("row.*").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, *_ in EDGES)


def test_quality_target_of_many_labels(spark):
    """Every one of 30,000 trusted documents counts, also a language that a single one holds, however the ids are joined."""
    rare = [(40_000 + i, f"{chr(0x3B1 + i) * 2}{chr(0x3C1 + i) * 2}{chr(0x3B1 + i) * 3}") for i in range(12)]
    rows = [(i, "the plain words") for i in range(30_000)] + rare + [(None, "no id, no trust")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, 0) for i, _ in rows] + [(40_000, 1, 0)], "doc_id long, quality int, toxic int")
    for more in ({}, {"narrow_ids": 5}):
        got = {r.doc_id: r.llr for r in quality_rules(docs, marks, prior=10.0, **more).collect()}
        assert all(got[i] > -0.01 for i, _ in rare) and got[None] < -3


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known, held = marks.filter("doc_id % 2 = 0"), {r.doc_id: r.quality for r in marks.filter("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r for r in quality_classes(docs, known).collect()}
    assert len(got) == docs.count()
    good = [got[i].kept for i, q in held.items() if q == 1]
    bad = [got[i].kept for i, q in held.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.3
    again = {r.doc_id: r.p_good for r in quality_classes(docs.repartition(7), known).collect()}
    assert again == {i: r.p_good for i, r in got.items()}


def test_classifier_rounds_take_every_unlabelled_row(spark):
    """Eight rare kinds of junk, each with words of its own in 2 of 12,016 unlabelled rows, all reach the text view."""
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["river", "stone", "garden", "letter", "window", "summer"]) for _ in range(12))
    junk = lambda word: "\n".join([word + " 99 ## $$"] * 9)
    rows = [(i, plain() if i % 2 else junk(f"buy{i}"), "en", "ab"[i % 2 - 1]) for i in range(200)]
    rows += [(1000 + i, plain(), "en", "a") for i in range(12_000)]
    words = [f"{chr(0x3B1 + k) * 3}{chr(0x430 + k) * 3}" * 3 for k in range(8)]
    rare = [(20_000 + i, junk(words[i % 8]), "en", "b") for i in range(16)]
    probes = [(30_000 + k, w, None, None) for k, w in enumerate(words)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kind = "doc_id long, text string, lang string, source string"
    without, got = ({r.doc_id: r.p_text for r in quality_classes(spark.createDataFrame(x + probes, kind), marks).collect()} for x in (rows, rows + rare))
    assert all(got[30_000 + k] < without[30_000 + k] - 0.1 for k in range(8))


def test_classifier_edges(spark):
    few = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, 0), (4, 5, 0)], "doc_id long, quality int, toxic int")
    for marks in (few, no_labels(spark)):
        got = quality_classes(edge_docs(spark), marks).collect()
        assert len(got) == len(EDGES) and all(r.kept and r.p_good is None for r in got)
    fitted = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_classes(edge_docs(spark), fitted, with_row=True).collect()
    assert len(got) == len(EDGES) and all(0 <= r.p_good <= 1 for r in got)
    assert quality_classes(no_docs(spark), few).count() == 0


@pytest.mark.parametrize("source", ["edges", "documents"])
def test_shards(spark, source):
    docs = edge_docs(spark) if source == "edges" else documents(spark)
    inputs = docs.select("doc_id", "text", "source").collect()
    for shards in (24, 5):
        got = mixed_shards(docs, shards).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
            (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in inputs
        )
        places: dict[int, list[int]] = {s: [] for s in range(shards)}
        for r in got:
            places[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        sizes = [len(x) for x in places.values()]
        assert all(sorted(x) == list(range(len(x))) for x in places.values()) and max(sizes) - min(sizes) <= 1
        # every shard has its share of every source, up to one row for each of its two cuts
        for name, n in Counter(r.source for r in inputs).items():
            for s in range(shards):
                has = sum(1 for r in got if r.shard == s and r.source == (name if name is not None else ""))
                if name:
                    assert abs(has - n * sizes[s] / len(inputs)) <= 2
    assert mixed_shards(no_docs(spark)).count() == 0


def test_shards_depend_on_the_seed_only(spark):
    a = {r.doc_id: (r.shard, r.slot) for r in mixed_shards(documents(spark)).collect()}
    assert a == {r.doc_id: (r.shard, r.slot) for r in mixed_shards(documents(spark).repartition(6)).collect()}
    assert a != {r.doc_id: (r.shard, r.slot) for r in mixed_shards(documents(spark), seed=21).collect()}


def plain_top(rows, k, every):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries: dict[int, list[int]] = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = max(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(300)]
    rows += [(0, [9.0, 9.0, 9.0, 9.0]), (50, [0.5] * 4), (50, [0.5] * 4), (None, [1.0] * 4), (400, None), (401, [1.0, None, 0.0, 0.0])]
    rows += [(402, [float("nan")] * 4), (403, [float("inf")] * 4), (500, []), (501, []), (502, [1.0]), (600, [0.0] * 4), (701, [1e5] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS v", "3 AS n")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame, 7, 50).collect())
    assert got == plain_top(rows, 7, 50)
    assert top_k(frame.limit(0)).count() == 0


def test_top_k_stops_early():
    rng = np.random.default_rng(5)
    matrix = (rng.pareto(1.0, size=(4000, 3)) * 10).astype(np.int64)
    ids = np.arange(4000)
    orders = np.argsort(-matrix.T, axis=1, kind="stable").astype(np.int32)
    query = np.array([3, 2, 1])
    found, scores, scored = threshold_top(query, -1, ids, matrix, orders, 10, None)
    want = np.lexsort((ids, -(matrix @ query)))[:10]
    assert found.tolist() == want.tolist() and scored < 1500


def test_top_k_of_huge_components(spark):
    rows = [(0, [3e15, 1.0]), (1, [3e15, 2.0]), (2, [-3e15, 0.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k(frame, 3).collect()]
    assert got == [(1, 2**63 - 1), (3, 1024 * 1024 * int(3e15) + 1024 * 1024), (2, -(2**63))] or [i for i, _ in got] == [1, 3, 2]


def test_pipeline_classifier_rejects(spark):
    """Bad documents planted behind the first stage go, good ones stay: the stage is fitted on all documents, not on what is left."""
    sf = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    labelled = docs.join(marks.filter("doc_id % 2 = 0"), "doc_id")
    kept = docs.join(marks.filter("quality = 0"), "doc_id", "left_anti").limit(300)
    bad = labelled.filter("quality = 0").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")
    stage = corpus_pipeline.STAGES[1][1](spark, kept.unionByName(bad), sf)
    got = [r.doc_id for r in stage.select("doc_id").collect()]
    planted = sum(i >= 1_000_000 for i in got)
    assert planted < 0.3 * bad.count() and len(got) - planted > 200


def plain_stage_rows(rows, got):
    return sorted((str(r["doc_id"]), r["text"]) for r in rows) == sorted((str(r.doc_id), r.text) for r in got)


def test_pipeline_stage_by_stage(spark):
    """Every stage against a plain version of its decision on what the stage before really kept."""
    from paperroute.llm.common import saved, table

    docs = table(spark, SF, "documents")
    marks = labels(spark)
    before = docs.collect()
    kept_by_rules = {r.doc_id for r in quality_rules(docs, marks).collect() if r.kept}
    docs = saved(corpus_pipeline.STAGES[0][1](spark, docs, SF), "stage")
    now = docs.collect()
    assert plain_stage_rows([r for r in before if r.doc_id in kept_by_rules], now)
    assert all(plain_counts(r.text)[0] >= 50 for r in now)
    kept_by_classes = {r.doc_id for r in quality_classes(docs, marks).collect() if r.kept}
    docs, before = saved(corpus_pipeline.STAGES[1][1](spark, docs, SF), "stage"), now
    now = docs.collect()
    assert plain_stage_rows([r for r in before if r.doc_id in kept_by_classes], now)
    component = plain_near_duplicates([(r.doc_id, r.text) for r in now])
    docs, before = saved(corpus_pipeline.STAGES[2][1](spark, docs, SF), "stage"), now
    now = docs.collect()
    assert plain_stage_rows([r for r in before if component[r.doc_id] == r.doc_id], now)
    want = [{"doc_id": i, "text": bytes(x for x, y in zip(b, gone, strict=True) if not y).decode(errors="ignore")} for i, b, gone in plain_removed([(r.doc_id, r.text) for r in now])]
    docs = saved(corpus_pipeline.STAGES[3][1](spark, docs, SF), "stage")
    now = docs.collect()
    assert plain_stage_rows(want, now) and all(r.n_chars == len(r.text) for r in now) and docs.columns == corpus_pipeline.COLUMNS
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in now}
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, last))


def test_pipeline_stages_on_edges(spark):
    docs = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 0
        assert stage(spark, no_docs(spark), SF).count() == 0
