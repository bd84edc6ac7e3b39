"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import (
    bytenet,
    language,
    lines,
    minhash,
    mixing,
    negatives,
    packing,
    periodic,
    repeats,
    robust,
    tokens,
    topk,
    wrapper,
)
from verdance.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


ORACLE["op1_line_dedup"] = lines.ORACLE


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


#: All products of queries and rows.
ORACLE["op3_exact_top_k"] = f"""
WITH usable AS (
    SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)
SELECT a.vec_id AS query_id,
       CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS INTEGER) AS rank,
       b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
WHERE a.vec_id % {topk.EVERY} = 0
QUALIFY rank <= {topk.K}
"""


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.judged(table(spark, sf_dir, "documents"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"), text=True)
    # the bytes that are left; a character cut in two shows as a replacement character
    return left.select("*", F.make_valid_utf8(F.col("kept").cast("string")).alias("text")).drop("kept")


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = bytenet.trained(docs, table(spark, sf_dir, "labels"))
    scored = bytenet.scored(docs, net, ["doc_id"])
    return scored.select("doc_id", bytenet.held_out().alias("held_out"), "score", "predicted")


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


@query
def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Near(words=3, percent=85))


#: Links by counting common shingles, groups by following links.
ORACLE["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS k FROM split WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), reached(a, b) AS (
    SELECT doc_id, doc_id FROM split
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), groups AS (
    SELECT a, min(b) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM split d JOIN groups g ON g.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""


@query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, language.trained(docs)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(negatives.labelled(table(spark, sf_dir, "embeddings"), moved))


ORACLE["op12_hard_negatives"] = negatives.ORACLE


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.planted(table(spark, sf_dir, "documents")))
