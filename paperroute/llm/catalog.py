"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperroute.session import work_dir

from .binary import document_ids, write_ids
from .common import table
from .cotraining import quality_classes
from .counting import token_counts
from .dropout import encoded_documents
from .groupjoin import jaccard_components
from .hardnegatives import hard_negatives
from .infilling import fill_in_middle, restored
from .neardup import near_duplicates
from .packing import packed_documents
from .quality import quality_rules
from .sharding import mixed_shards
from .suffixdup import without_repeats
from .topk import top_k

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))


@query
def op2_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# every pair that shares a shingle is compared; components by spreading the least id
ORACLE["op2_minhash_join"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM w
), classes AS (
    SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS node FROM s WHERE len(s) > 0 GROUP BY 1, 2
), e AS (SELECT node, n, unnest(s) AS x FROM classes), pairs AS (
    SELECT a.node AS a, b.node AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.node < b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach(node, c) AS (
    SELECT node, node FROM classes
    UNION SELECT p.b, r.c FROM reach AS r JOIN both_ways AS p ON p.a = r.node WHERE p.b > r.c
), named AS (SELECT node, min(c) AS c FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(named.c, s.doc_id) AS component_id,
       s.doc_id = coalesce(named.c, s.doc_id) AS kept
FROM s LEFT JOIN classes ON list_sort(s.s) = classes.s LEFT JOIN named ON classes.node = named.node
"""


@query
def op3_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


@query
def op4_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


@query
def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "packed-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return document_ids(spark, path)


@query
def op6_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


# the whole inner products; the search itself must find the same rows without scoring them all
ORACLE["op6_threshold_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_mixed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_shards(table(spark, sf_dir, "documents"))


@query
def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


# lines as the text split at line feeds, without the empty rest behind the last one
ORACLE["op11_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), parts AS (SELECT *, string_split(text, chr(10)) AS p FROM t
), lines AS (
    SELECT doc_id, text, h, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p, p[len(p)] = '' AS closed FROM parts
), units AS (
    SELECT doc_id, text, h, len(p) AS n, list_transform(p, lambda x, i: x || CASE WHEN i < len(p) OR closed THEN chr(10) ELSE '' END) AS u
    FROM lines
), drawn AS (
    SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
           CAST('0x' || h[17:24] AS BIGINT) % 100 AS d3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d4
    FROM units
), cut AS (
    SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 100 THEN 'plain'
                   WHEN d4 < 50 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(u[1:least(c1, c2)], '') AS pre, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
           array_to_string(u[greatest(c1, c2) + 1:n], '') AS suf
    FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                        ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    found = hard_negatives(noisy)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# every window ranked on its own
ORACLE["op12_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v AS a JOIN v AS c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id,
       p.positive_score, n.score AS negative_score
FROM positives AS p JOIN scored AS n
  ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 10
"""


@query
def op13_group_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


# every pair that shares a shingle is compared; components by spreading the least id
ORACLE["op13_group_prefix_join"] = (
    ORACLE["op2_minhash_join"].replace("len(w) < 5", "len(w) < 4").replace("len(w) - 3", "len(w) - 2").replace("i + 4", "i + 3")
    .replace(" AS component_id,\n       s.doc_id = coalesce(named.c, s.doc_id) AS kept", " AS component_id")
)
