"""Exact n-gram Jaccard join: documents of one prefix and size are one group, and groups are joined by their prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_slices, saved, text_of
from .components import connected_components
from .neardup import distinct_by_row, raw_shingles
from .words import Texts, mixed

SLICE = 1 << 20
HUB = 512  # pairs of one document that one task verifies
SHORT = 32  # groups of a list whose pairs are looked through before their sets are fetched
WORK = 8  # pairs for each posting of a list that need no further centres
STEPS = 16  # steps for each doubling in which the sizes of a list are counted
CORE = 50  # percent of similarity at which a document is close to a centre
BITS = 1 << 15  # bits of a bitmap of Spark
MAPS = 2048  # bitmaps sent to the rows at most, 8 MB
MARKS = mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def bucket_ranks(rows: DataFrame, words: int, bits: int) -> np.ndarray:
    """The rank of each of 2**bits buckets of shingles, least frequent first, from the counts of all documents."""
    size = 1 << bits

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in in_slices(batches, "text", SLICE):
            value, _ = raw_shingles(Texts(batch.column("text")), words)
            found += np.bincount((value & np.uint64(size - 1)).astype(np.int64), minlength=size)
        used = np.flatnonzero(found)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(found[used])], names=["bucket", "times"])

    counts = saved(rows.select("text").mapInArrow(count, "bucket int, times bigint").groupBy("bucket").agg(F.sum("times").alias("times")), "buckets")
    sums = counts.toArrow()
    discard(counts)
    total = np.zeros(size, np.int64)
    total[sums.column("bucket").to_numpy()] = sums.column("times").to_numpy()
    rank = np.empty(size, np.int32)
    rank[np.argsort(total, kind="stable")] = np.arange(size, dtype=np.int32)
    return rank


def ordered_sets(texts: Texts, words: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of each row as numbers that ascend from rare to frequent shingles, and the sizes.

    A number is the rank of the shingle's bucket followed by the rest of its hash, so it stands for the
    same hash in every document, and one order holds for all of them.
    """
    value, of = raw_shingles(texts, words)
    bits = len(rank).bit_length() - 1
    bucket = (value & np.uint64(len(rank) - 1)).astype(np.int64)
    value = (rank[bucket].astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits))
    return distinct_by_row(value, of, texts.rows)


def prefix_lengths(sizes: np.ndarray, percent: int) -> np.ndarray:
    """So many first shingles of a set hold one of every set that it can be linked with."""
    return np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)


def _marks(value: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> list[pa.Array]:
    """Two 64-bit fingerprints of runs of distinct values, one run per row."""
    full, out = counts > 0, []
    for key in keys:
        found = np.zeros(len(counts), np.uint64)
        if full.any():
            found[full] = np.add.reduceat(mixed(value ^ key), (np.cumsum(counts) - counts)[full])
        out.append(pa.array(found.view(np.int64)))
    return out


def _lists(value: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(value.view(np.int64)))


def prefix_rows(rows: DataFrame, words: int, percent: int, rank: np.ndarray) -> DataFrame:
    """``doc_id, n, f0, f1, p0, p1, prefix``: size, fingerprints of the set and of its prefix, and the prefix."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            value, counts = ordered_sets(Texts(batch.column("text")), words, rank)
            taken = prefix_lengths(counts, percent)
            nth = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)
            prefix = value[nth < np.repeat(taken, counts)]
            columns = [batch.column("doc_id"), pa.array(counts.astype(np.int64)), *_marks(value, counts, MARKS[:2]), *_marks(prefix, taken, MARKS[2:])]
            yield pa.record_batch([*columns, _lists(prefix, taken)], names=["doc_id", "n", "f0", "f1", "p0", "p1", "prefix"])

    return rows.mapInArrow(cut, "doc_id bigint, n bigint, f0 bigint, f1 bigint, p0 bigint, p1 bigint, prefix array<bigint>")


def set_rows(rows: DataFrame, words: int) -> DataFrame:
    """``node, shingles``: whole sets."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            value, counts = distinct_by_row(*raw_shingles(texts := Texts(batch.column("text")), words), texts.rows)
            yield pa.record_batch([batch.column("doc_id"), _lists(value, counts)], names=["node", "shingles"])

    return rows.mapInArrow(cut, "node bigint, shingles array<bigint>")


def can_link(x: str, y: str, percent: int) -> Column:
    """Whether two entries of a list can be linked with this shingle as the first they share, by sizes and places."""
    nx, ny, px, py = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
    sizes = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return sizes & ((100 + percent) * (1 + F.least(nx - px, ny - py)) >= percent * (nx + ny))


class Sets(NamedTuple):
    """What is known of documents by id: ``node, shingles`` with whole sets, and ``node, shingles, n`` with prefixes."""

    whole: DataFrame
    prefix: DataFrame


def among(rows: DataFrame, node: str, wanted: DataFrame, column: str, count: int) -> DataFrame:
    """The rows whose ``node`` is one of the ``count`` wanted ones, and a few others.

    Bitmaps of the hashes of the wanted ones go to the rows, so that these are not shuffled; their size is bounded.
    """
    maps = min(MAPS, 1 << (32 * count // BITS).bit_length())
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(maps * BITS).cast("long"))
    at = wanted.select(place(column).alias("at")).select(F.floor(F.col("at") / BITS).alias("__map"), (F.col("at") % BITS).alias("at")).repartition("__map")
    bitmaps = at.groupBy("__map").agg(F.bitmap_construct_agg("at").alias("__bits"))
    placed = rows.withColumn("__at", place(node)).withColumn("__map", F.floor(F.col("__at") / BITS)).join(F.broadcast(bitmaps), "__map")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(F.col("__at") % BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col("__at") % 8).cast("int")).bitwiseAND(F.lit(1))
    return placed.filter(bit == 1).select(*rows.columns)


def _with_sets(rows: DataFrame, pairs: DataFrame, count: int, sets: DataFrame, side: str) -> DataFrame:
    """Rows of pairs with the set of one side; the set of a document of many pairs is repeated, so that its pairs part."""
    hubs = pairs.groupBy(side).agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).filter("parts > 1")
    size = [F.col("n").alias(f"n{side}")] if "n" in sets.columns else []
    own = among(sets, "node", pairs, side, count).select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"), *size)
    own = own.join(hubs, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dealt = rows.join(hubs, side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int"))
    return dealt.drop("parts").join(own, [side, "part"]).drop("part")


def with_both_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    count = pairs.count()
    return _with_sets(_with_sets(pairs, pairs, count, sets, "a"), pairs, count, sets, "b")


def promising(pairs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The pairs whose prefixes have so much in common that their sets can be similar enough.

    What two sets share behind the prefix that ends first is no more than what that set has there.
    """
    both = with_both_sets(pairs, sets.prefix)
    common = F.size(F.array_intersect("sa", "sb")) + F.greatest(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    return both.filter((100 + percent) * common >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def verified(pairs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough; prefixes, a seventh of them, rule out most others."""
    common, sizes = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    both = with_both_sets(promising(pairs, sets, percent), sets.whole)
    return both.filter((100 + percent) * common >= percent * sizes).select("a", "b")


def with_partner(posts: DataFrame, percent: int) -> DataFrame:
    """The groups that another one of a list can be linked with, and all of long lists; others need no sets."""
    lists = posts.groupBy("key").agg(F.count("*").alias("k"))
    short, long = (posts.join(lists.filter(f), "key").select("key", "gid", "n", "pos") for f in (f"k <= {SHORT}", f"k > {SHORT}"))
    pairs = short.alias("x").join(short.alias("y"), "key").filter((F.col("x.gid") < F.col("y.gid")) & can_link("x", "y", percent))
    return pairs.select(F.explode(F.array("x.gid", "y.gid")).alias("node")).union(long.select("gid"))


def components_by(links: list[DataFrame], node: str, name: str) -> DataFrame:
    return connected_components(_union(links)).select(F.col("node").alias(node), F.col("component").alias(name))


def open_lists(entries: DataFrame, links: list[DataFrame]) -> DataFrame:
    """Entries of lists that hold more than one component: ``c``, the list's largest one ``main``, its size ``k`` and ``o``, how many are outside ``main``."""
    entries = entries.join(components_by(links, "unit", "c"), "unit", "left").withColumn("c", F.coalesce("c", "unit"))
    entries = saved(entries.select("key", "unit", "n", "pos", "c"), "placed")
    sizes = entries.groupBy("key", "c").agg(F.count("*").alias("times"))
    lists = sizes.groupBy("key").agg(F.max(F.struct("times", (-F.col("c")).alias("c"))).alias("x"), F.sum("times").alias("k"))
    lists = lists.filter("k > x.times").select("key", (-F.col("x.c")).alias("main"), "k", (F.col("k") - F.col("x.times")).alias("o"))
    now = saved(entries.join(lists, "key"), "open-lists")
    discard(entries)
    return now


def crowded_lists(now: DataFrame, percent: int) -> DataFrame:
    """Keys of the open lists in which more than ``WORK`` pairs for each posting might be linked by sizes and places.

    By ``can_link`` each of two entries has a largest size of the other.  Entries are counted by the steps of
    their own and of that size, so what a list gathers is bounded however long it is; two counts pair
    if the steps allow it.  Of two units in different components one is outside ``main``.
    """
    upto = F.floor((100 + percent) * (1 + F.col("n") - F.col("pos")) / percent) - F.col("n")
    step = lambda size: F.floor(STEPS * F.log2(size)).cast("int")
    some = now.filter(F.col("o") > WORK).withColumn("upto", upto).filter("upto > 0")
    cells = some.groupBy("key", "k", step(F.col("n")).alias("own"), step(F.col("upto")).alias("upto"))
    cells = cells.agg(F.count("*").alias("times"), F.count(F.when(F.col("c") != F.col("main"), 1)).alias("outs"))
    lists = cells.groupBy("key", "k").agg(F.collect_list(F.struct("own", "upto", "times", "outs")).alias("cells"))
    pairs = F.expr("""aggregate(filter(cells, x -> x.outs > 0), 0L, (sum, x) -> sum + x.outs *
        aggregate(filter(cells, y -> y.own <= x.upto AND x.own <= y.upto), 0L, (n, y) -> n + y.times))""")
    return lists.filter(pairs > WORK * F.col("k")).select("key")


def _compared(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of a list, of different components, that can be linked."""
    pairs = x.alias("x").join(y.alias("y"), "key").filter((F.col("x.c") != F.col("y.c")) & can_link("x", "y", percent))
    return pairs.select(F.least("x.unit", "y.unit").alias("a"), F.greatest("x.unit", "y.unit").alias("b")).distinct()


def differences_join(stars: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """A written step, to be discarded in the end, and the pairs ``a, b`` of members of one star that can be linked though one is not in the component of the centre.

    ``stars``: member ``a``, centre ``b``, their components ``ca, cb``, the member's size ``n`` and ``own``, the shingles
    that only one of member and centre has.  The difference of two members is the difference of
    their differences, so two linked members share at least (d1 + d2 - allowed) / 2 of these,
    and one at least, as one of them differs too much from the centre.  With the least d and
    the largest size around the centre this bounds the prefix in which they meet; shingles that few members
    differ in stand first.  Those found in both prefixes are counted, and a pair goes where
    these and all that may follow are too few.  So edits of single members do not make them meet, however many they are.
    """
    p, q = 100 - percent, 100 + percent
    stars = stars.withColumn("d", F.size("own").cast("long"))
    stars = stars.withColumn("all", F.sum("d").over(Window.partitionBy("a", "b")))
    bounds = stars.groupBy("b").agg(F.min("d").alias("any_d"), F.min(F.expr("CASE WHEN ca <> cb THEN d END")).alias("out_d"), F.max("n").alias("most"))
    bounds = bounds.filter("out_d IS NOT NULL")
    rows = stars.join(bounds, "b").withColumn("allowed", F.col("n") + F.least(F.col("most"), F.floor(F.col("n") * 100 / percent)))
    for name, least in (("x_upto", "any_d"), ("y_upto", "out_d")):
        shared = F.ceil((q * (F.col("d") + F.col(least)) - p * F.col("allowed")) / (2 * q))
        rows = rows.withColumn(name, F.col("d") - F.greatest(F.lit(1), shared) + 1)
    rows = saved(rows.select("a", "b", "ca", "cb", "n", "d", "all", "x_upto", "y_upto", F.explode("own").alias("e")), "differences")
    met = rows.withColumn("f", F.count("*").over(Window.partitionBy("b", "e"))).filter("f > 1")
    # what one member alone differs in only takes a place: it stands before all others
    own = Window.partitionBy("a", "b")
    met = met.withColumn("nth", F.row_number().over(own.orderBy("f", "e")))
    met = met.withColumn("before", F.col("all") - F.count("*").over(own))
    met = met.withColumn("i", F.col("nth") + F.col("before")).filter(F.col("i") <= F.greatest("x_upto", "y_upto"))
    met = saved(met.select("a", "b", "ca", "cb", "n", "d", "x_upto", "y_upto", "e", "i", (F.col("all") - F.col("i")).alias("behind")), "met")
    discard(rows)
    x, y = met.filter("ca <> cb AND i <= x_upto").alias("x"), met.filter("i <= y_upto").alias("y")
    # what two members share stands at this place or before, or behind it
    upto = F.least("x.i", "y.i") + F.least("x.behind", "y.behind")
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    near = sizes & (q * (F.col("x.d") + F.col("y.d") - 2 * upto) <= p * (F.col("x.n") + F.col("y.n")))
    pairs = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.ca") != F.col("y.ca")) & near)
    names = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("a", "n", "d")]
    rest = F.greatest(F.col("x.d") - F.col("x.x_upto"), F.col("y.d") - F.col("y.y_upto")).alias("rest")
    pairs = pairs.groupBy(F.col("x.b"), *names, rest).agg(F.count("*").alias("both"))
    # what is not counted lies behind the end of one prefix or the other
    pairs = pairs.filter(q * (F.col("x_d") + F.col("y_d") - 2 * (F.col("both") + F.col("rest"))) <= p * (F.col("x_n") + F.col("y_n")))
    return met, pairs.select(F.least("x_a", "y_a").alias("a"), F.greatest("x_a", "y_a").alias("b")).distinct()


def large_lists(entries: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Pairs ``a, b`` to verify in lists with many units in several components; ``entries``: ``key, unit, n, pos, c``.

    Round by round, the least document of a list that no centre is close to becomes its centre, and all
    others are held against it.  Those at least ``CORE`` percent similar are close; as
    similarity obeys the triangle inequality, what is linked with one of them is not far
    either, and ``differences_join`` finds those pairs.  What is close to no centre
    after the last round is compared in its list.  Rounds end when little is left or a round brings little.
    """
    halo = max(0, CORE - (100 - percent))
    own, found, before = entries.select("key", "unit", "n", "c"), [], None
    loose, total = entries, entries.count()
    while True:
        work = loose.groupBy("key").agg(F.count("*").alias("o")).agg(F.sum(F.col("o") * F.col("o"))).first()[0] or 0
        if work <= WORK * total or before is not None and work > 0.7 * before:
            break
        before = work
        centre = saved(loose.groupBy("key").agg(F.min(F.struct("unit", "n", "c")).alias("m")).select("key", F.col("m.unit").alias("b"), F.col("m.n").alias("bn"), F.col("m.c").alias("cb")), "centres")
        around = own.join(centre, "key").filter(100 * F.least("n", "bn") >= halo * F.greatest("n", "bn"))
        around = saved(around.filter("unit <> b").select(F.col("unit").alias("a"), "b", F.col("c").alias("ca"), "cb").distinct(), "around")
        common, sizes = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        stars = with_both_sets(around, sets.whole).withColumn("common", common).withColumn("sizes", sizes).filter((100 + halo) * F.col("common") >= halo * F.col("sizes"))
        stars = stars.select("a", "b", F.size("sa").cast("long").alias("n"), ((100 + CORE) * F.col("common") >= CORE * F.col("sizes")).alias("core"),
                             F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("own"))
        stars = saved(stars.join(around, ["a", "b"]), "stars")
        met, pairs = differences_join(stars.drop("core"), percent)
        found.append(saved(pairs, "met-pairs"))
        discard(met)
        close = stars.filter("core").select(F.col("a").alias("unit"), "b").distinct()
        settled = loose.join(centre, "key").join(close, ["unit", "b"]).select("key", "unit").union(centre.select("key", F.col("b").alias("unit")))
        left = saved(loose.join(settled.distinct(), ["key", "unit"], "left_anti"), "loose")
        discard(centre, around, stars, *([loose] if loose is not entries else []))
        loose = left
    return _union([*found, _compared(loose, loose, percent)])


def linked_in_lists(entries: DataFrame, members: DataFrame, sets: Sets, percent: int) -> list[DataFrame]:
    """Links from which the components of all linked pairs of units that share a list follow.

    ``entries``: ``key, unit, n, pos``, a unit posted in a list at a place of its prefix; ``members``:
    ``unit, node``.  First the least unit of each list is its centre and
    is verified with all others that it can be linked with, by one member each.  Lists that are one component
    then close.  In the others the units outside the largest component are compared with those of other
    components, member by member: of two units in different components one is outside.  Lists with more
    than ``WORK`` pairs for each posting go to ``large_lists``.
    """
    entries = saved(entries, "entries")
    first = entries.groupBy("key").agg(F.min(F.struct("unit", "n", "pos")).alias("m")).select("key", "m.*")
    pairs = entries.alias("x").join(first.alias("y"), "key").filter((F.col("x.unit") != F.col("y.unit")) & can_link("x", "y", percent))
    links = [saved(verified(pairs.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b")), sets, percent), "links")]

    now = open_lists(entries, links)
    discard(entries)
    crowded = saved(crowded_lists(now, percent), "crowded")
    small = now.join(crowded, "key", "left_anti")
    pairs = _compared(small.filter("c <> main"), small, percent)
    for side in ("a", "b"):
        of = members.select(F.col("unit").alias(side), "node")
        pairs = pairs.join(of, side).drop(side).withColumnRenamed("node", side)
    large = now.join(crowded, "key").join(members, "unit")
    large = saved(large.select("key", F.col("node").alias("unit"), "n", "pos", "c"), "large-lists")
    pairs = pairs.select("a", "b").unionByName(large_lists(large, sets, percent))
    # two pairs of each document first; what they connect need not be verified pair by pair
    pairs = saved(pairs.distinct(), "open-pairs")
    discard(now, crowded, large)
    some = pairs.groupBy("a").agg(F.min("b").alias("b")).unionByName(pairs.groupBy("b").agg(F.min("a").alias("a")))
    links.append(saved(verified(some, sets, percent), "links"))
    found = components_by(links, "node", "c")
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("c").alias(f"c{side}")), side, "left")
    rest = pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    return [*links, saved(verified(rest, sets, percent), "links")]


def _union(links: list[DataFrame]) -> DataFrame | None:
    out = None
    for x in links:
        out = x if out is None else out.unionByName(x)
    return out


def jaccard_components(docs: DataFrame, percent: int = 85, words: int = 4, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked when their sets of ``words``-word shingles have a Jaccard similarity of ``percent`` / 100 or more; exact.

    1. All shingles are counted in 2**bits buckets; sets are ordered from rare to frequent.  The first shingles
       of a set, its prefix, hold one of every set it can be linked with.  Equal sets are one class.
    2. Classes with the same prefix and size are one group.  Its members are compared with the least of them,
       and those linked with it are one unit; each other member is a unit.
    3. Groups are posted under the shingles of their prefix; shingles of one group only go.  Units of one group have a list
       of their own.  Units that share a list pass if their sizes and the places of the shingle allow a link.  Pairs of units
       are expanded to members and verified on whole sets, centres first (``linked_in_lists``), so a
       large group of near copies is never paired with itself.
    4. Components of the links.

    Returns one row per input row: ``doc_id, n_shingles, component_id``.  Null, empty and blank texts have
    an empty set and are linked with nothing.  Rows that repeat an id count as one document, linked by
    any of its texts.  Rows with a null id take no part and have a null component.  An empty
    table gives no rows.  A slice of texts holds about 1 MB or one longer text, which takes some 100
    bytes for each of its words.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    rank = bucket_ranks(rows, words, bits)
    signed = saved(prefix_rows(rows, words, percent, rank), "prefixes")
    linked = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("f0", "f1", "n", "p0", "p1").agg(F.min("doc_id").alias("node"))
    classes = saved(classes, "classes")
    # a group is named by the least document with its prefix and size
    groups = saved(classes.groupBy("p0", "p1", "n").agg(F.min("node").alias("gid"), F.count("*").alias("m")), "groups")
    heads = groups.select(F.col("gid").alias("doc_id"), "p0", "p1", "n")
    posted = linked.join(heads, ["doc_id", "p0", "p1", "n"]).select(F.col("doc_id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "key"))
    posted = posted.withColumn("pos", F.col("pos") + 1)
    posted = posted.withColumn("k", F.count("*").over(Window.partitionBy("key")))
    posts = saved(posted.filter("k > 1").select("key", "gid", "n", "pos"), "posts")
    of = saved(linked.join(classes.select("f0", "f1", "n", "node"), ["f0", "f1", "n"]).select("doc_id", "node"), "classes-of")
    narrow = saved(signed.select("doc_id", "n", "f0", "f1"), "sizes")

    several = saved(classes.join(groups.filter("m > 1"), ["p0", "p1", "n"]).select("gid", "node", "n"), "members")
    wanted = saved(several.select("node").union(with_partner(posts, percent)).distinct().select(F.col("node").alias("doc_id")), "wanted")
    count = wanted.count()
    prefixes = among(linked, "doc_id", wanted, "doc_id", count).select(F.col("doc_id").alias("node"), F.col("prefix").alias("shingles"), "n").distinct()
    prefixes = saved(prefixes, "prefix-sets")
    discard(signed)
    sets = Sets(saved(set_rows(among(rows, "doc_id", wanted, "doc_id", count), words), "sets"), prefixes)
    discard(wanted)

    others = several.filter("node <> gid").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    inside = saved(verified(others, sets, percent).distinct(), "links")
    units = several.join(inside.select(F.col("a").alias("gid"), F.col("b").alias("node"), F.col("a").alias("unit")), ["gid", "node"], "left")
    units = saved(units.select("gid", "node", "n", F.coalesce("unit", "node").alias("unit")), "units")
    alone = posts.join(units.select("gid").distinct(), "gid", "left_anti").withColumn("unit", F.col("gid"))
    split = posts.join(units.select("gid", "unit").distinct(), "gid")
    # a group's prefix may be in no other one, so its units have a list of their own under the number of the group
    parted = units.join(units.filter("unit <> gid").select("gid").distinct(), "gid")
    parted = parted.select(F.col("gid").alias("key"), "unit", "n", F.lit(1).alias("pos")).distinct()
    entries = alone.unionByName(split).select("key", "unit", "n", "pos").unionByName(parted)
    members = units.select("unit", "node").unionByName(alone.select("unit", F.col("unit").alias("node")).distinct())
    across = linked_in_lists(entries, members, sets, percent)

    # an id whose rows are in several classes joins them
    repeated = of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
    repeated = of.join(repeated, "doc_id").select("a", F.col("node").alias("b"))
    found = connected_components(_union([inside, *across, repeated]))
    named = classes.join(found, "node", "left").select("f0", "f1", "n", F.coalesce("component", "node").alias("component"))
    out = narrow.join(named, ["f0", "f1", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
