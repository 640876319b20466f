"""Words against a word list: the most similar entry of each, by a prefix-filtered q-gram join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import seq_ratio_from

GRAM_LENGTHS = (3, 2, 1)
LEXICON_CUTOFF = 0.75  # fixed value
TASKS = 16  # tasks for each core that pairs are scored in


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _letters(name: str) -> Column:
    """The letters of a word as bits, up to four of each of 32 kinds, and how many more there are."""
    shift = lambda one, by: F.call_function("shiftleft", one, by)
    none = F.lit(0).cast("long")

    def add(acc: Column, kind: Column) -> Column:
        def with_bits(x: Column) -> Column:  # the next of the four bits, beyond them a fifth, which is cut off
            bit = shift(F.call_function("shiftrightunsigned", x, kind % 16 * 4).bitwiseAND(F.lit(15).cast("long")) + 1, kind % 16 * 4)
            return F.when(F.bit_count(x.bitwiseAND(shift(F.lit(15).cast("long"), kind % 16 * 4))) < 4, x.bitwiseOR(bit)).otherwise(x)

        held = F.when(kind < 16, acc["low"]).otherwise(acc["high"])
        return _bound(
            F.struct(held.alias("held"), with_bits(held).alias("now")),
            lambda x: F.struct(
                F.when(kind < 16, x["now"]).otherwise(acc["low"]).alias("low"), F.when(kind < 16, acc["high"]).otherwise(x["now"]).alias("high"),
                (acc["more"] + (x["now"] == x["held"]).cast("int")).alias("more"),
            ),
        )

    kinds = F.transform(F.split(F.col(name), ""), lambda c: F.pmod(F.ascii(c), F.lit(32)))
    return F.aggregate(kinds, F.struct(none.alias("low"), none.alias("high"), F.lit(0).alias("more")), add)


KEPT = ["word", "size", "low", "high", "more"]


def _grams(words: DataFrame, *more: str) -> DataFrame:
    """``word, size, low, high, more, q, g, nth``: the letters of each word and its grams of all lengths."""

    def cut(q: int) -> Column:
        places = F.sequence(F.lit(1), F.col("size") - (q - 1))
        grams = F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(q)))
        nth = lambda all_, x, i: F.size(F.filter(F.slice(all_, 1, i), lambda h: h == x))
        numbered = _bound(grams, lambda all_: F.transform(all_, lambda x, i: F.struct(F.lit(q).alias("q"), x.alias("g"), nth(all_, x, i).alias("nth"))))
        return F.when(F.col("size") >= q, numbered).otherwise(F.array().cast("array<struct<q:int,g:string,nth:int>>"))

    sized = words.select("word", F.length("word").alias("size"), _letters("word").alias("x"), *more)
    return sized.select("word", "size", "x.low", "x.high", "x.more", *more, F.inline(F.concat(*(cut(q) for q in GRAM_LENGTHS))))


def _by_rarity(grams: DataFrame, counts: DataFrame, *more: str) -> DataFrame:
    """The grams of each word and length, ``ordered`` from rare to frequent in the list; unknown ones first."""
    known = grams.join(counts, ["q", "g", "nth"], "left")
    return known.groupBy(*KEPT, *more, "q").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "g", "nth"))).alias("ordered"))


def _matched_least(total: Column, cutoff: float) -> Column:
    return F.ceil(total * F.lit(cutoff / 2) - F.lit(1e-9))


def _shared_least(total: Column, q: Column | int, cutoff: float) -> Column:
    """So many q-grams are shared by two strings of ``total`` characters whose ratio reaches the cutoff.

    The ratio is 2 M / total with M characters matched in order.  Each of the total - 2 M others takes
    at most q grams from its own string or q - 1 from the other.
    """
    return (2 * F.lit(q) - 1) * _matched_least(total, cutoff) - (F.lit(q) - 1) * (total + 1)


def similar_pairs(words: DataFrame, entries: DataFrame, cutoff: float) -> DataFrame:
    """``word, entry``: the pairs whose similarity may reach the cutoff; none that does is missing.

    A word looks at the lengths of entries that the cutoff allows and that the list has.  For each it
    takes the longest gram length of which two similar strings must share some, and meets the entries
    in one equi-join on its rarest grams: among so many that a shared one must be there.  How often
    a gram stands in the list decides what is rare.  Places in that order bound what can follow, and the
    letters of both bound what can match at all; both are plain arithmetic in the condition of the join.
    """
    grams = _grams(entries.select(F.col("entry").alias("word")))
    counts = grams.groupBy("q", "g", "nth").agg(F.count("*").alias("times"))
    posted = _by_rarity(grams, counts).select(*KEPT, "q", F.posexplode("ordered").alias("at", "x"))
    posted = posted.select(F.col("word").alias("entry"), "q", F.col("size").alias("other"), *(F.col(c).alias(f"e_{c}") for c in KEPT[2:]), F.col("at").alias("e_at"), "x.g", "x.nth")

    lengths = entries.select(F.length("entry").alias("other")).distinct()
    n = F.length("word")
    span = F.sequence(F.ceil(n * cutoff / (2 - cutoff) - 1e-9).cast("int"), F.floor(n * (2 - cutoff) / cutoff + 1e-9).cast("int"))
    fitting = words.select("word", F.explode(span).alias("other")).join(lengths, "other").groupBy("word").agg(F.sort_array(F.collect_list("other")).alias("others"))
    n = F.col("size")
    total = n + F.col("other")
    choice = F.lit(1)
    for q in reversed(GRAM_LENGTHS[:-1]):  # the longest wins
        choice = F.when((_shared_least(total, q, cutoff) >= 1) & (F.least(n, F.col("other")) >= q), F.lit(q)).otherwise(choice)
    asked = _by_rarity(_grams(fitting, "others"), counts, "others").withColumn("other", F.explode("others")).filter(F.col("q") == choice)
    asked = asked.withColumn("least", _shared_least(total, F.col("q"), cutoff)).filter(F.col("least") <= F.least(n, F.col("other")) - F.col("q") + 1)
    upto = (n - F.col("q") + 2 - F.col("least")).cast("int")
    asked = asked.select(*KEPT, "q", "other", "least", F.posexplode(F.slice("ordered", F.lit(1), upto)).alias("at", "x"))
    asked = asked.select(*KEPT, "q", "other", "least", "at", "x.g", "x.nth")
    behind = F.least(n - F.col("q") - F.col("at"), F.col("other") - F.col("q") - F.col("e_at"))
    alike = F.bit_count(F.col("low").bitwiseAND(F.col("e_low"))) + F.bit_count(F.col("high").bitwiseAND(F.col("e_high"))) + F.least("more", "e_more")
    near = (1 + behind >= F.col("least")) & (alike >= _matched_least(total, cutoff))
    return asked.join(posted, ["other", "q", "g", "nth"]).filter(near).select("word", "entry").distinct()


def best_entries(words: DataFrame, entries: DataFrame, cutoff: float) -> DataFrame:
    """``word, entry, ratio``: the most similar entry of each word at or above the cutoff; of equals the greatest."""
    # short rows that take long: Spark would put them in few tasks by their bytes
    tasks = TASKS * words.sparkSession.sparkContext.defaultParallelism
    pairs = similar_pairs(words, entries, cutoff).repartition(tasks, "word", "entry")
    scored = pairs.withColumn("ratio", seq_ratio_from(cutoff)("entry", "word"))
    best = scored.filter(F.col("ratio") >= cutoff).groupBy("word").agg(F.max(F.struct("ratio", "entry")).alias("x"))
    return best.select("word", "x.entry", "x.ratio")


def match_lexicon(df: DataFrame, col: str, lexicon: list[str] | DataFrame, cutoff: float = LEXICON_CUTOFF) -> DataFrame:
    """Best entry of a word list for each value: exact, else the most similar above the cutoff.

    Adds ``canonical`` and ``similarity``.  ``lexicon`` is a list or a DataFrame whose first column holds the
    entries.  Each distinct value is looked up once; values equal to an entry are not compared at
    all.  Null values are dealt out and match nothing.
    """
    if isinstance(lexicon, list):
        entries = df.sparkSession.createDataFrame([(x,) for x in sorted(set(lexicon))], "entry string")
    else:
        entries = lexicon.select(lexicon[lexicon.columns[0]].alias("entry")).filter("entry IS NOT NULL AND entry <> ''").distinct()
    words = df.select(F.col(col).alias("word")).filter("word IS NOT NULL").distinct()
    exact = words.join(entries, F.col("word") == F.col("entry")).select("word", "entry", F.lit(1.0).alias("ratio"))
    pending = words.join(entries, F.col("word") == F.col("entry"), "left_anti").filter("word <> ''")
    found = exact.unionByName(best_entries(pending, entries, cutoff))
    found = found.select(F.col("word").alias("__word"), F.col("entry").alias("canonical"), F.col("ratio").alias("similarity"), F.lit(-1).alias("__part"))
    part = F.when(F.col(col).isNotNull(), F.lit(-1)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int"))
    dealt = df.withColumn("__own", part).withColumn("__key", F.coalesce(col, F.lit("")))
    met = (F.col("__key") == F.col("__word")) & (F.col("__own") == F.col("__part"))
    return dealt.join(found, met, "left").select(*df.columns, "canonical", "similarity")
