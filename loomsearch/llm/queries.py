"""Queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.llm import boilerplate, entities, lookalike, mixing, neardup, sitelines, tokens
from loomsearch.plans.runtime import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(read(spark, sf_dir, "web_document"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(read(spark, sf_dir, "web_document"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.linked_pairs(read(spark, sf_dir, "entities"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve(read(spark, sf_dir, "entities"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.repeated_lines(read(spark, sf_dir, "web_document"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.without_repeated(read(spark, sf_dir, "web_document"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.article(read(spark, sf_dir, "web_document"))


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.article_text(read(spark, sf_dir, "web_document"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(read(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[1]


def p7_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[2]
    return out.select("margin", "value", *[F.round(c, 6).alias(c) for c in ("goal_share", "raked_share", "actual_share")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(read(spark, sf_dir, "documents"))


def p8_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical(read(spark, sf_dir, "documents")).select("doc_id", "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_clusters, p4_found, p4_clean, p5_found, p5_text, p6_ids, p7_mix, p7_shares, p7_margins, p8_found, p8_text)}


P4_FOUND = r"""
    WITH l AS (SELECT doc_id, domain, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1))::INT AS line_no FROM web_document WHERE domain IS NOT NULL AND body <> ''),
    x AS (SELECT doc_id, domain, line_no, regexp_replace(trim(regexp_replace(lower(line), '[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS t FROM l),
    g AS (SELECT domain, t FROM x WHERE t <> '' GROUP BY domain, t HAVING count(DISTINCT doc_id) >= 8)
    SELECT doc_id, line_no FROM x JOIN g USING (domain, t)"""

P4_CLEAN = f"""
    WITH c AS (SELECT doc_id, list(DISTINCT line_no) AS cut FROM ({P4_FOUND}) GROUP BY doc_id)
    SELECT w.doc_id, array_to_string(list_filter(string_split(body, chr(10)), lambda x, i: NOT list_contains(coalesce(cut, []), i::INT)), chr(10)) AS text, coalesce(len(cut), 0) AS removed FROM web_document w LEFT JOIN c USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p4_clean": P4_CLEAN}
