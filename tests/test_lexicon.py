"""Word lists against brute force, and how few pairs are compared."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from paperroute.functions.similarity import seq_ratio_of
from paperroute.operators.lexicon import best_entries, match_lexicon, similar_pairs


def misspelt(rng, word):
    letters = list(word)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(letters) + 1)
        letters[k : k + rng.randrange(2)] = rng.choice([[], ["A"], ["E"], ["é"], ["ST"]])
    return "".join(letters)


@pytest.mark.parametrize("cutoff", [0.6, 0.75, 0.9])
def test_best_entry_is_that_of_all_pairs(spark, cutoff):
    rng = random.Random(round(100 * cutoff))
    entries = sorted({"".join(rng.choice("AEIOSTRLN") for _ in range(rng.randrange(1, 16))) for _ in range(80)} | {"AAAAAAAAAA", "AAAAAAAAAAAA", "Ä漢🙂X", "OYSTER SHELL CALCIUM W/D"})
    words = [misspelt(rng, rng.choice(entries)) for _ in range(90)] + [None, "", None, "A", "AAAAAAAAAAA", "é" * 4000, "Ä漢🙂Y", entries[3], entries[3]]
    want = []
    for w in words:
        best = max(((seq_ratio_of(e, w), e) for e in entries), default=None) if w else None
        want.append((w, best[1], best[0]) if best and best[0] >= cutoff else (w, None, None))
    df = spark.createDataFrame([(w, "clash") for w in words], "drug string, entry string")
    for lexicon in (entries, spark.createDataFrame([(e,) for e in entries] + [(None,), ("",), (entries[0],)], "name string")):
        got = [(r.drug, r.canonical, r.similarity) for r in match_lexicon(df, "drug", lexicon, cutoff).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    none = match_lexicon(df, "drug", spark.createDataFrame([], "name string"), cutoff)
    assert none.filter("canonical IS NOT NULL").count() == 0 and none.count() == len(words)
    assert match_lexicon(df.limit(0), "drug", entries, cutoff).collect() == []


def test_long_list_is_not_compared_in_full(spark):
    """A list of 100,000 names: under one pair in a hundred is compared, and every planted name is found."""
    syllables = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "qui", "ro", "su", "ta", "ve", "wi", "xo", "zu"]
    pick = lambda k: F.element_at(F.array(*map(F.lit, syllables)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(20)) + 1).cast("int"))
    names = spark.range(140_000).select(F.upper(F.concat(*(pick(k) for k in range(5)))).alias("entry")).distinct().limit(100_000).repartition(8).cache()
    words = names.filter(F.xxhash64("entry") % 500 == 0).select(F.concat(F.expr("substr(entry, 1, 4)"), F.lit("Y"), F.expr("substr(entry, 6)")).alias("word"), "entry").cache()
    n = words.count()
    assert names.count() == 100_000 and n > 100
    pairs = similar_pairs(words.select("word").distinct(), names, 0.85).cache()
    assert pairs.join(words, ["word", "entry"]).count() == n
    assert pairs.count() < 0.01 * n * 100_000
    names.unpersist(), words.unpersist(), pairs.unpersist()


def test_pairs_are_scored_in_many_tasks(spark, monkeypatch):
    """Pairs are few bytes but much work: they are not gathered in as few tasks as their bytes would need, and few are matched block by block."""
    rng = random.Random(2)
    entries = sorted({"".join(rng.choice("AEIOST") for _ in range(8)) for _ in range(400)})
    frame = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    best = best_entries(frame("word", [e[:3] + "Q" + e[4:] for e in entries]), frame("entry", entries), 0.8)
    assert best.rdd.getNumPartitions() >= 1 and "REPARTITION_BY_NUM" in best._jdf.queryExecution().executedPlan().toString()
    matched = []
    whole = difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a: matched.append(a) or whole(*a))
    assert seq_ratio_of("ABCDEFGH", "HGFEDCBA", 0.8) == 0.0 and not matched
    assert seq_ratio_of("ABCDEFGH", "ABCDXFGH", 0.8) == 0.875 and matched


def test_null_values_are_dealt_out(spark):
    """No key of the join stands for all rows without a value."""
    df = spark.range(5000).select(F.lit(None).cast("string").alias("drug"))
    out = match_lexicon(df, "drug", ["ASPIRIN"], 0.8)
    assert out.filter("canonical IS NULL AND drug IS NULL").count() == 5000
    assert "__own" not in out.columns and "monotonically_increasing_id" in out._jdf.queryExecution().toString()
