"""File names: suggestion from a specification, choice by style, collision-free filing plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import top_per_group
from ..functions.similarity import decompose
from ..functions.text import (
    ILLEGAL_IN_NAME, blank_to_null, drop_adjacent_repeats, extension, squeeze, strip,
)
from ..session import work_dir
from ..sources.dimensions import CASING, LEGAL_SUFFIXES, SNAKE_WORDS, Policy, taxonomy

# Fixed values
FALLBACK_SPECIFICATION = "Unclassified Fax"
MAX_STEM = 80
MAX_FACILITY = 38
LAST_SUFFIX = 999  # the bare name and numbers 2 to 999


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _title(spec: Column) -> Column:
    """Every word with a capital; words of the casing table in their own spelling."""
    table = _lookup(CASING)
    words = F.transform(
        F.split(spec, " "),
        lambda w: F.coalesce(
            F.try_element_at(table, F.btrim(F.lower(w), F.lit(".,"))),
            F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))),
        ),
    )
    return F.array_join(words, " ")


def _snake(value: Column) -> Column:
    """Lower case with underscores; a few hyphenated words stay whole."""
    table = _lookup(SNAKE_WORDS)
    words = F.transform(
        F.split(F.btrim(squeeze(F.lower(value)), F.lit(" ")), " "),
        lambda w: F.coalesce(F.try_element_at(table, F.btrim(w, F.lit(".,"))), w),
    )
    flat = F.btrim(F.regexp_replace(F.array_join(words, " "), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(flat == "", F.lit("unclassified")).otherwise(flat)


def _fill(template: Column, spec: Column, doctype: Column) -> Column:
    return F.replace(
        F.replace(template, F.lit("{specification}"), spec), F.lit("{doctype}"), doctype
    )


def _safe_stem(stem: Column) -> Column:
    s = F.btrim(squeeze(F.regexp_replace(stem, ILLEGAL_IN_NAME, "")), F.lit(" ."))
    s = F.when(
        F.length(s) > MAX_STEM, F.rtrim(F.substring(s, 1, MAX_STEM), F.lit(" _-"))
    ).otherwise(s)
    return F.when(s == "", F.lit(FALLBACK_SPECIFICATION)).otherwise(s)


def _facility(df: DataFrame, col: str) -> DataFrame:
    """A sender name fit for a prefix; empty when nothing usable is left."""
    text = F.regexp_replace(decompose(F.coalesce(F.col(col), F.lit(""))), ILLEGAL_IN_NAME, " ")
    text = F.btrim(squeeze(F.regexp_replace(text, "[,&]+", " ")), F.lit(" .-/"))
    df = df.withColumn("__fac", text)
    legal = "|".join(LEGAL_SUFFIXES)
    without = F.regexp_replace("__fac", rf"(?i)(?:(?:^| )\.*(?:{legal})\.*)+$", "")
    df = df.withColumn("__fac", without)
    cut = F.substring("__fac", 1, MAX_FACILITY)
    whole = F.rtrim(F.regexp_replace(cut, r"^(.*) [^ ]*$", "$1"), F.lit(" .-"))
    return df.withColumn(
        "facility",
        F.when(
            F.length("__fac") > MAX_FACILITY, F.when(whole == "", cut).otherwise(whole)
        ).otherwise(F.col("__fac")),
    ).drop("__fac")


def with_taxonomy(cls: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """Attach the taxonomy row; codes it does not know get its UNKNOWN row.

    ``dims`` has the columns of ``sources.dimensions.taxonomy``, which is the default; one row per code.
    """
    dim = taxonomy(cls.sparkSession) if dims is None else dims
    known = [r for r in dim.columns if r != "code"]
    table = dim.select(F.col("code").alias("__code"), *(F.col(c).alias(f"__known_{c}") for c in known))
    other = dim.filter("code = 'UNKNOWN'").select(F.lit(True).alias("__lost"), *(F.col(c).alias(f"__other_{c}") for c in known)).limit(1)
    joined = cls.join(table, F.col("category") == F.col("__code"), "left")
    joined = joined.withColumn("__lost", F.col("__code").isNull()).join(F.broadcast(other), "__lost", "left")
    found = F.col("__code").isNotNull()
    return (
        joined.select(
            *cls.columns, F.coalesce("__code", F.lit("UNKNOWN")).alias("taxonomy_code"),
            *(F.when(found, F.col(f"__known_{c}")).otherwise(F.col(f"__other_{c}")).alias(c) for c in known),
        )
        .withColumn(
            "doctype_slug",
            F.coalesce(
                F.try_element_at(F.col("subtype_slugs"), F.coalesce("subtype", F.lit(""))),
                F.col("slug"),
            ),
        )
    )


def suggest_names(cls: DataFrame, policy: Policy = Policy(), dims: DataFrame | None = None) -> DataFrame:
    """House style and underscore style names for each classified document.

    Needs ``category``, ``subtype``, ``specification``, ``original_file_name`` and
    ``sender_organization``; ``dims`` is the taxonomy, as for ``with_taxonomy``.
    """
    keep = cls.columns
    df = with_taxonomy(cls, dims)
    given = blank_to_null(F.col("specification"))
    df = df.withColumns(
        {
            "naming_source": F.when(given.isNotNull(), F.lit("MODEL")).otherwise(F.lit("FALLBACK")),
            "__spec": decompose(strip(F.coalesce(given, F.col("default_specification")))),
        }
    )
    df = df.withColumn(
        "__spec", F.btrim(squeeze(F.regexp_replace("__spec", "_+", " ")), F.lit(" .-"))
    )
    df = df.withColumn(
        "specification_clean",
        F.when(F.col("__spec") == "", F.lit(FALLBACK_SPECIFICATION)).otherwise(_title(F.col("__spec"))),
    )
    df = _facility(df, "sender_organization")
    df = df.withColumns(
        {"__snake": _snake(F.col("specification_clean")), "__fac_snake": _snake(F.col("facility"))}
    )
    df = df.withColumn("__flat", F.replace(F.col("__snake"), F.lit("_"), F.lit("")))
    stutter = (
        F.col("__flat").startswith(F.col("doctype_slug")) | F.col("__flat").endswith(F.col("doctype_slug"))
    )
    df = df.withColumn("__type", F.when(stutter, F.lit("")).otherwise(F.col("doctype_slug")))
    house = _fill(F.col("primary_template"), F.col("specification_clean"), F.col("doctype_slug"))
    snake = _fill(F.col("alternate_template"), F.col("__snake"), F.col("__type"))
    df = df.withColumns(
        {
            "__house": F.array_join(
                drop_adjacent_repeats(F.split(F.btrim(squeeze(house), F.lit(" ")), " "), True), " "
            ),
            "__under": F.array_join(
                drop_adjacent_repeats(F.filter(F.split(snake, "_"), lambda p: p != "")), "_"
            ),
        }
    )
    has = F.col("facility") != ""
    df = df.withColumns(
        {
            "__house": F.when(has, F.concat_ws("_", "facility", "__house")).otherwise(F.col("__house")),
            "__under": F.when(has, F.concat_ws("_", "__fac_snake", "__under")).otherwise(F.col("__under")),
            "__ext": extension(F.col("original_file_name")),
        }
    )
    df = df.withColumns(
        {
            "suggested_file_name": F.concat(_safe_stem(F.col("__house")), "__ext"),
            "alternate_file_name": F.concat(_safe_stem(F.col("__under")), "__ext"),
            "facility": F.when(has, F.col("facility")),
        }
    )
    df = df.withColumn(
        "chosen_file_name",
        choose_file_name(
            F.col("suggested_file_name"), F.col("alternate_file_name"), F.col("original_file_name"), policy
        ),
    )
    return df.select(
        *keep, "naming_source", "specification_clean", "facility", "doctype_slug",
        "taxonomy_folder", "suggested_file_name", "alternate_file_name", "chosen_file_name",
    )


def choose_file_name(house: Column, snake: Column, original: Column, policy: Policy) -> Column:
    """The name in the preferred style, else the other one, else the original."""
    first, second = (snake, house) if policy.name_style.upper() == "SNAKE" else (house, snake)
    return F.coalesce(blank_to_null(first), blank_to_null(second), original)


# ------------------------------------------------------------------ collision-free filing plan


def _stem(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1)


def _ext(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)


def _numbered(name: Column, n: Column, suffix: str) -> Column:
    before, after = suffix.split("{n}", 1)
    return F.concat(_stem(name), F.lit(before), n.cast("string"), F.lit(after), _ext(name))


def _suffix_pattern(suffix: str) -> str:
    before, after = (re.escape(p) for p in suffix.split("{n}", 1))
    return rf"{before}([2-9]|[1-9][0-9]{{1,2}}){after}"


def _parent(name: Column, suffix: str) -> tuple[Column, Column]:
    """The name a numbered name derives from, and its number; null when it is not numbered."""
    pattern = rf"(?s)^(.+){_suffix_pattern(suffix)}$"
    numbered = _stem(name).rlike(pattern)
    parent = F.concat(F.regexp_extract(_stem(name), pattern, 1), _ext(name))
    return F.when(numbered, parent), F.when(numbered, F.regexp_extract(_stem(name), pattern, 2).cast("int"))


def _depth(name: Column, suffix: str) -> Column:
    """How many numbers a name ends in."""
    tail = F.regexp_extract(_stem(name), rf"(?s)^.+?((?:{_suffix_pattern(suffix)})*)$", 1)
    return F.regexp_count(tail, F.lit(_suffix_pattern(suffix))).cast("int")


def filing_plan(decisions: DataFrame, existing: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A destination name for each row that no other file in the folder has.

    ``decisions``: ``id`` (unique number), ``tracking_id``, ``folder``, ``file_name``, ``filed_at``;
    ``existing``: ``folder``, ``file_name`` of the files already there.  Rows are served in
    ``filed_at``, ``id`` order: the bare name, then numbers 2 to 999, then the tracking id as a
    prefix.  Result: ``final_file_name``.

    Only the first 999 requests of a name can get a slot, so only those are ranked, however often a
    name is requested.  A name requested literally in numbered form contests that slot of the name it derives
    from.  Its first request either takes the slot or finds it taken, so from that time on the slot
    is gone for the shorter name, whoever has it: a name depends on the first requests of its numbered
    forms only, and those depend on what the shorter name took.  So names are solved by the number
    of their suffixes, each level in one aggregate over all names and, if there are several, one written
    table: at most 999 requests and 999 slots that are gone at some time meet in a row, and runs of free
    slots between these follow from ranks.
    """
    suffix = policy.collision_suffix
    key = ["folder", "file_name"]
    depth = _depth(F.col("file_name"), suffix)
    deepest = decisions.select(F.max(depth)).first()[0] or 0
    requests = decisions.select(
        F.col("id").cast("long").alias("at_id"), *key, depth.alias("depth"), F.unix_micros(F.col("filed_at").cast("timestamp")).alias("at_us")
    )
    served = top_per_group(requests, [*key, "depth"], [F.col("at_us"), F.col("at_id")], LAST_SUFFIX, F.col("at_id"))
    parent, number = _parent(F.col("file_name"), suffix)
    always = [F.lit(-(2**63)).alias("at_us"), F.lit(-(2**63)).alias("at_id")]
    # an existing file takes its own name and, when it is numbered, that slot of the name it derives from
    gone = existing.select(*key, F.lit(1).alias("slot"), *always).unionByName(
        existing.select("folder", parent.alias("file_name"), number.alias("slot"), *always).dropna(subset=["file_name"])
    ).distinct()
    firsts = requests.filter("depth > 0").groupBy(*key).agg(F.min(F.struct("at_us", "at_id")).alias("first"))
    gone = gone.unionByName(firsts.select("folder", parent.alias("file_name"), number.alias("slot"), "first.at_us", "first.at_id"))
    solved, taken = None, None
    for level in range(deepest + 1):
        slots = _slots(served.filter(F.col("depth") == level), gone if taken is None else gone.unionByName(taken))
        slots = _written(slots) if deepest else slots
        numbered = _numbered(F.col("file_name"), F.col("slot"), suffix).alias("file_name")
        taken = slots.filter("slot > 1").select("folder", numbered, F.lit(1).alias("slot"), "at_us", "at_id")
        out = slots.select(F.col("at_id").alias("id"), "slot")
        solved = out if solved is None else solved.unionByName(out)
    chosen = (
        F.when(F.col("slot") == 1, F.col("file_name"))
        .when(F.col("slot").isNotNull(), _numbered(F.col("file_name"), F.col("slot"), suffix))
        .otherwise(F.concat_ws("__", "tracking_id", "file_name"))
    )
    return decisions.join(solved, "id", "left").withColumn("final_file_name", chosen).drop("slot")


def _written(df: DataFrame) -> DataFrame:
    path = work_dir(df.sparkSession, "slots")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slots(requests: DataFrame, gone: DataFrame) -> DataFrame:
    """The slot of each ranked request: ``folder, file_name, at_us, at_id, slot``; null when none is left.

    ``gone``: slots of a name and the time from which on they cannot be had.  In order of slots, the i-th
    request comes to a slot when i - 1 slots before it were had; it has to skip the slot if that was gone by then.
    The other requests take the free slots between in order.
    """
    key = ["folder", "file_name"]
    at = F.struct("at_us", "at_id")
    names = requests.select(*key).distinct()
    events = requests.select(*key, at.alias("asked")).unionByName(
        gone.join(names, key, "left_semi").groupBy(*key, "slot").agg(F.min(at).alias("since")), allowMissingColumns=True
    )
    rows = events.groupBy(*key).agg(
        F.array_sort(F.collect_list("asked")).alias("asked"),
        F.array_sort(F.collect_list(F.when(F.col("since").isNotNull(), F.struct("slot", "since")))).alias("gone"),
    )

    def skip(acc: Column, x: Column) -> Column:
        nth = x["slot"] - F.size(acc)
        late = (nth > F.size("asked")) | (F.get(F.col("asked"), nth - 1) > x["since"])
        return F.when(late, F.concat(acc, F.array(x["slot"]))).otherwise(acc)

    rows = rows.filter(F.size("asked") > 0).withColumn("skipped", F.aggregate("gone", F.array().cast("array<int>"), skip))
    before = F.transform("skipped", lambda t, i: t - i - F.lit(1))  # free slots before each
    rows = rows.withColumn("before", before).select(*key, "before", F.posexplode("asked").alias("nth", "at"))
    slot = F.col("nth") + 1 + F.size(F.filter("before", lambda free: free <= F.col("nth")))
    return rows.select(*key, "at.at_us", "at.at_id", F.when(slot <= LAST_SUFFIX, slot).cast("int").alias("slot"))
