"""Measuring the filing against hand labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import earliest_by
from ..functions.numeric import ratio, with_exact_round
from ..functions.text import base_name, clerk_form
from ..sources.dimensions import Policy
from .routing import route

GATE = 0.90
METRICS = ["category", "subtype", "folder", "specification", "filename"]


def evaluate(
    preds: DataFrame, labels: DataFrame, policy: Policy = Policy(),
    rules: Sequence[Mapping[str, object]] | None = None,
) -> DataFrame:
    """One row per label with pass flags; a file without a prediction fails every metric.

    ``labels``: ``file``, ``block``, ``expected_category``, ``expected_subtype``,
    ``expected_folder``, ``expected_specification``, ``accept_specifications``,
    ``expected_file_name``.  ``preds``: ``file``, ``category``, ``subtype``, ``sender_fax``,
    ``specification``, ``suggested_file_name``, ``facility``, ``calibrated_confidence``,
    ``confidence_band``, ``force_manual_review``, ``latency_ms``.
    """
    routed = route(preds, rules=rules, policy=policy).select(
        "file", F.col("category").alias("predicted_category"), F.col("subtype").alias("predicted_subtype"),
        F.col("suggested_folder").alias("predicted_folder"), "rule_matched",
        F.col("specification").alias("predicted_specification"),
        F.col("suggested_file_name").alias("predicted_file_name"), F.col("facility").alias("predicted_facility"),
        "calibrated_confidence", "confidence_band", "force_manual_review", "latency_ms",
        F.lit(True).alias("__found"),
    )
    df = labels.join(routed, "file", "left")
    found = F.coalesce("__found", F.lit(False))

    def same(a: str, b: str) -> Column:
        return found & F.col(a).eqNullSafe(F.col(b))

    prefix = F.concat(F.col("predicted_facility"), F.lit("_"))
    name = F.coalesce("predicted_file_name", F.lit(""))
    stem = F.when(
        (F.coalesce("predicted_facility", F.lit("")) != "") & name.startswith(prefix),
        F.substring(name, F.length(prefix) + 1, F.length(name)),
    ).otherwise(name)
    accepted = F.filter(
        F.concat(F.array("expected_specification"), F.coalesce("accept_specifications", F.array().cast("array<string>"))),
        lambda a: a.isNotNull() & (a != ""),
    )
    df = df.withColumns({"__stem": stem, "__accepted": F.transform(accepted, clerk_form)})
    band_gate = F.coalesce(F.col("confidence_band").isin("HIGH", "MEDIUM"), F.lit(False))
    return df.select(
        "file", F.coalesce("block", F.lit("unspecified")).alias("block"),
        "expected_category", "predicted_category", "expected_folder", "predicted_folder",
        "calibrated_confidence", "confidence_band", "force_manual_review", "latency_ms",
        F.when(~found, F.lit("no prediction")).alias("error"),
        same("predicted_category", "expected_category").alias("category_pass"),
        same("predicted_subtype", "expected_subtype").alias("subtype_pass"),
        same("predicted_folder", "expected_folder").alias("folder_pass"),
        (
            (F.coalesce("predicted_specification", F.lit("")) != "")
            & F.array_contains("__accepted", clerk_form(F.col("predicted_specification")))
        ).alias("specification_pass"),
        (
            (F.col("__stem") != "")
            & (F.coalesce("expected_file_name", F.lit("")) != "")
            & (clerk_form(F.col("__stem")) == clerk_form(F.col("expected_file_name")))
        ).alias("filename_pass"),
        (F.coalesce("predicted_facility", F.lit("")) != "").alias("facility_pass"),
        (band_gate & ~F.coalesce("force_manual_review", F.lit(False))).alias("auto_routable"),
    )


def _passes() -> list[Column]:
    return [F.count_if(F.col(f"{m}_pass")).alias(f"{m}_pass") for m in METRICS]


def _accuracies(df: DataFrame, n: str, extra: Sequence[str] = ()) -> DataFrame:
    df = df.withColumns(
        {f"{m}_accuracy": F.coalesce(ratio(F.col(f"{m}_pass"), F.col(n)), F.lit(0.0)) for m in METRICS}
    )
    return with_exact_round(df, 4, *[f"{m}_accuracy" for m in METRICS], *extra)


def eval_summary(results: DataFrame) -> DataFrame:
    """Accuracies of a run, letterhead coverage, mean latency in whole milliseconds."""
    df = results.agg(
        F.count("*").alias("n_samples"), *_passes(), F.count_if("facility_pass").alias("facility_read"),
        F.floor(F.avg("latency_ms")).cast("long").alias("avg_latency_ms"),
    )
    df = df.withColumn(
        "facility_coverage", F.coalesce(ratio(F.col("facility_read"), F.col("n_samples")), F.lit(0.0))
    )
    return _accuracies(df, "n_samples", ["facility_coverage"])


def eval_by_block(results: DataFrame) -> DataFrame:
    """The same counts and accuracies per block."""
    df = results.groupBy(F.coalesce("block", F.lit("unspecified")).alias("block")).agg(
        F.count("*").alias("n"), *_passes()
    )
    return _accuracies(df, "n")


def policy_gate(threshold: Column | float) -> Column:
    """High band, not forced, confidence at or above the threshold."""
    return (
        F.col("confidence_band").eqNullSafe("HIGH")
        & ~F.coalesce("force_manual_review", F.lit(False))
        & (F.coalesce("calibrated_confidence", F.lit(0.0)) >= threshold)
    )


def gate_quality(results: DataFrame, thresholds: Sequence[float] = (GATE,), disabled: Sequence[str] = ()) -> DataFrame:
    """Filed or held against right or wrong, for the band gate and each policy threshold.

    With ``disabled`` categories the policy gates come twice: ``policy`` for the scores alone and
    ``policy_enabled`` with predictions of those categories held back (no prediction counts as
    UNKNOWN).  One pass counts the results by how many thresholds their score reaches; every
    gate follows from that histogram, whose size depends on the number of thresholds only.
    """
    steps = sorted({float(t) for t in thresholds})
    levels = F.array(*[F.lit(t) for t in steps]).cast("array<double>")
    score = F.coalesce(F.col("calibrated_confidence").cast("double"), F.lit(0.0))
    reached = F.size(F.filter(levels, lambda t: t <= score))
    eligible = F.col("confidence_band").eqNullSafe("HIGH") & ~F.coalesce("force_manual_review", F.lit(False))
    shape = {
        "step": F.when(eligible, reached).otherwise(0), "band": F.coalesce("auto_routable", F.lit(False)),
        "open": ~F.coalesce("predicted_category", F.lit("UNKNOWN")).isin(*disabled) if disabled else F.lit(True),
        "ok": F.coalesce("category_pass", F.lit(False)),
    }
    counted = results.groupBy(*[c.alias(n) for n, c in shape.items()]).agg(F.count("*").alias("n"))
    none = results.sparkSession.range(1).selectExpr("0 AS step", "false AS band", "true AS open", "true AS ok", "0L AS n")

    def gates(kind: str, also: Column) -> Column:
        at = F.sequence(F.lit(1), F.lit(len(steps)))
        return F.transform(at, lambda i: F.struct(F.lit(kind).alias("gate"), F.element_at(levels, i).alias("threshold"), ((F.col("step") >= i) & also).alias("auto")))

    band = F.array(F.struct(F.lit("band").alias("gate"), F.lit(None).cast("double").alias("threshold"), F.col("band").alias("auto")))
    parts = [band, *([gates("policy", F.lit(True))] if steps else []), *([gates("policy_enabled", F.col("open"))] if steps and disabled else [])]
    wide = counted.unionByName(none).select("ok", "n", F.inline(F.concat(*parts)))

    def cell(auto: bool, ok: bool) -> Column:
        return F.sum(F.when((F.col("auto") == auto) & (F.col("ok") == ok), F.col("n")).otherwise(0))

    return wide.groupBy("gate", "threshold").agg(
        cell(True, True).alias("auto_correct"), cell(True, False).alias("auto_wrong"),
        cell(False, True).alias("review_correct"), cell(False, False).alias("review_wrong"),
    )


def label_universe(results: DataFrame) -> DataFrame:
    """Every label that was expected or predicted."""
    return (
        results.select(F.explode(F.array("expected_category", "predicted_category")).alias("label"))
        .filter((F.col("label") != ""))
        .distinct()
    )


def confusion(results: DataFrame, dense: bool = True) -> DataFrame:
    """Expected against predicted, zero-filled over all labels seen when ``dense``.

    The results shrink to label pairs at once; the dense form pairs the labels with each other, as
    the matrix asks, and joins the counts to the pairs.
    """
    pairs = results.groupBy("expected_category", "predicted_category").agg(F.count("*").alias("n"))
    scored = (F.col("expected_category") != "") & (F.col("predicted_category") != "")
    if not dense:
        return pairs.filter(scored).select(
            F.col("expected_category").alias("expected"), F.col("predicted_category").alias("predicted"), "n"
        )
    seen = pairs.filter(scored).select(
        F.col("expected_category").alias("expected"), F.col("predicted_category").alias("predicted"), "n"
    )
    labels = label_universe(pairs)
    # the label list once beside each label: as many rows as the dense matrix has
    cells = labels.agg(F.collect_list("label").alias("labels")).select(F.explode("labels").alias("expected"), "labels")
    cells = cells.select("expected", F.explode("labels").alias("predicted"))
    return cells.join(seen, ["expected", "predicted"], "left").select(
        "expected", "predicted", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def repeat_stability(runs: DataFrame) -> DataFrame:
    """Per file over repeated runs: is the category always the same, how far does confidence move.

    Needs ``file`` and ``run``; the other columns of the first run are kept.
    """
    rest = [c for c in runs.columns if c not in ("file", "run")]
    label = F.coalesce(F.concat(F.lit("="), "predicted_category"), F.lit("null"))
    df = runs.groupBy("file").agg(
        F.min_by(F.struct(*rest), "run").alias("__first"),
        F.count("*").alias("n_repeat"),
        (F.min(label) == F.max(label)).alias("deterministic"),
        F.avg("calibrated_confidence").alias("mean_confidence"),
        F.coalesce(F.stddev_samp("calibrated_confidence"), F.lit(0.0)).alias("confidence_std"),
        F.floor(F.avg("latency_ms")).cast("long").alias("mean_latency_ms"),
    )
    df = df.select("file", "__first.*", "n_repeat", "deterministic", "mean_confidence", "confidence_std", "mean_latency_ms")
    return df.withColumns({c: F.round(c, 4) for c in ("mean_confidence", "confidence_std")})


# ------------------------------------------------------------------ two runs side by side

_RUN_COLUMNS = [
    "expected_category", "predicted_category", "confidence_band", "force_manual_review",
    "calibrated_confidence", "auto_routable", "latency_ms", *[f"{m}_pass" for m in METRICS],
]


def pair_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files both runs scored, with either run's columns as a struct."""
    left = a.select("file", "block", F.struct(*_RUN_COLUMNS).alias("a"))
    right = b.select("file", F.struct(*_RUN_COLUMNS).alias("b"))
    return left.join(right, "file")


def compare_runs(paired: DataFrame, threshold: float = GATE) -> DataFrame:
    """Every figure of two runs on their common files, as (metric, key, a, b)."""
    def gate(side: str) -> Column:
        c = F.col(side)
        return (
            c["confidence_band"].eqNullSafe("HIGH")
            & ~F.coalesce(c["force_manual_review"], F.lit(False))
            & (F.coalesce(c["calibrated_confidence"], F.lit(0.0)) >= threshold)
        )

    def figures(side: str) -> list[Column]:
        c = F.col(side)
        ok = F.coalesce(c["category_pass"], F.lit(False))
        g, band = gate(side), F.coalesce(c["auto_routable"], F.lit(False))
        out = [F.count("*")]
        out += [F.count_if(c[f"{m}_pass"]) for m in METRICS]
        out.append(F.sum(F.coalesce(c["latency_ms"], F.lit(0))))
        for h in (g, band):
            out += [F.count_if(h & ok), F.count_if(h & ~ok), F.count_if(~h & ok), F.count_if(~h & ~ok)]
        return out

    cells = ["auto_correct", "auto_wrong", "held_correct", "held_wrong"]
    names = (
        [("files", "all")] + [("passed", m) for m in METRICS] + [("latency_sum_ms", "all")]
        + [("policy_gate", c) for c in cells] + [("band_gate", c) for c in cells]
    )
    pairs = list(zip(names, figures("a"), figures("b")))
    per_block = paired.groupBy(F.coalesce("block", F.lit("?")).alias("block")).agg(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(k).alias("key"), x.cast("long").alias("a"), y.cast("long").alias("b")).alias(f"f{i}")
            for i, ((m, k), x, y) in enumerate(pairs)
        ]
    )
    rows = per_block.select("block", F.inline(F.array(*[F.col(f"f{i}") for i in range(len(pairs))])))
    blocks = rows.filter(((F.col("metric") == "passed") & (F.col("key") == "category")) | (F.col("metric") == "files"))
    blocks = blocks.select(F.concat(F.lit("block_"), "metric").alias("metric"), F.col("block").alias("key"), "a", "b")
    overall = rows.groupBy("metric", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return overall.unionByName(blocks)


def run_differences(paired: DataFrame) -> DataFrame:
    """Files the two runs judge differently."""
    a, b = F.col("a"), F.col("b")
    differs = ~a["category_pass"].eqNullSafe(b["category_pass"]) | ~a["predicted_category"].eqNullSafe(
        b["predicted_category"]
    )
    return paired.filter(differs).select(
        "file", a["expected_category"].alias("expected_category"),
        a["predicted_category"].alias("predicted_a"), b["predicted_category"].alias("predicted_b"),
        a["category_pass"].alias("pass_a"), b["category_pass"].alias("pass_b"),
        F.coalesce(b["calibrated_confidence"], F.lit(0.0)).alias("confidence_b"),
    )


def run_misses(paired: DataFrame, threshold: float = GATE) -> DataFrame:
    """Every file the second run got wrong, and whether the policy gate would have filed it."""
    b = paired.filter(~F.coalesce(F.col("b.category_pass"), F.lit(False))).select("file", "b.*")
    return b.select(
        "file", "expected_category", "predicted_category",
        F.coalesce("calibrated_confidence", F.lit(0.0)).alias("confidence"),
        policy_gate(threshold).alias("would_file"),
    )


def run_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files scored by both runs or by one of them only."""
    left, right = a.select("file").distinct(), b.select("file").distinct()
    both = left.intersect(right).withColumn("scored_by", F.lit("both"))
    only_a = left.exceptAll(right).withColumn("scored_by", F.lit("a"))
    only_b = right.exceptAll(left).withColumn("scored_by", F.lit("b"))
    return both.unionByName(only_a).unionByName(only_b)


# ------------------------------------------------------------------ labels for files


def unique_basenames(labels: DataFrame, path: str = "file") -> DataFrame:
    """Labels whose bare file name occurs once, keyed by it."""
    rest = list(labels.columns)
    return (
        labels.groupBy(base_name(F.col(path)).alias("basename"))
        .agg(F.count("*").alias("__n"), F.min_by(F.struct(*rest), path).alias("__label"))
        .filter(F.col("__n") == 1)
        .select("basename", "__label.*")
    )


def resolve_labels(files: DataFrame, labels: DataFrame, prefix: str = "") -> DataFrame:
    """The label of each file: by path, else by unambiguous bare name, else by content.

    ``files``: ``path``, ``content_sha256``; ``labels``: ``file``, ``content_sha256``, ``label``.
    Files settled by one step carry a key no label has into the next, so they neither match
    again nor pile up as nulls.
    """
    by_path = labels.select(F.translate("file", "\\", "/").alias("__key"), F.col("label").alias("__path_label"))
    by_path = by_path.groupBy("__key").agg(F.min("__path_label").alias("__path_label"))
    by_name = unique_basenames(labels).select(F.col("basename").alias("__key"), F.col("label").alias("__name_label"))
    by_hash = labels.dropna(subset=["content_sha256"]).groupBy(F.col("content_sha256").alias("__key")).agg(
        F.max_by("label", "file").alias("__hash_label")
    )
    df = files.withColumn("__key", F.concat(F.lit(prefix), "path")).join(by_path, "__key", "left").drop("__key")
    if prefix:
        plain = by_path.withColumnRenamed("__path_label", "__plain_label")
        df = df.withColumn("__key", F.col("path")).join(plain, "__key", "left").drop("__key")
        df = df.withColumn("__path_label", F.coalesce("__path_label", "__plain_label")).drop("__plain_label")
    settled = F.concat(F.lit("\x00"), "path")
    df = df.withColumn(
        "__key", F.when(F.col("__path_label").isNotNull(), settled).otherwise(base_name(F.col("path")))
    ).join(by_name, "__key", "left").drop("__key")
    df = df.withColumn("__so_far", F.coalesce("__path_label", "__name_label"))
    df = df.withColumn(
        "__key", F.when(F.col("__so_far").isNotNull(), settled).otherwise(F.coalesce("content_sha256", settled))
    ).join(by_hash, "__key", "left").drop("__key")
    return df.select(
        *files.columns,
        F.coalesce("__so_far", "__hash_label").alias("label"),
        F.when(F.col("__path_label").isNotNull(), F.lit("PATH"))
        .when(F.col("__name_label").isNotNull(), F.lit("BASENAME"))
        .when(F.col("__hash_label").isNotNull(), F.lit("CONTENT"))
        .otherwise(F.lit("NONE"))
        .alias("resolved_by"),
    )
