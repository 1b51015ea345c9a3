"""Queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.operators import shred
from loomsearch.plans import evidence, serving  # noqa: F401  (they add their queries to the catalogue)
from loomsearch.plans.catalog import CATALOG
from loomsearch.plans.runtime import read


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = shred.shred_levels(read(spark, sf_dir, "web_document"), "doc_id", "jsonld")
    return shred.objects(levels).select(F.col("id").alias("doc_id"), "node_path", "parent_path")


def p3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = shred.shred_levels(read(spark, sf_dir, "web_document"), "doc_id", "jsonld", with_values=True)
    return shred.fields(levels).withColumnRenamed("id", "doc_id")


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = shred.shred_levels(read(spark, sf_dir, "web_document"), "doc_id", "jsonld")
    return shred.objects(levels).groupBy("table_path").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_docs"))


def p3_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat table: the authors, linked to the object they belong to."""
    levels = shred.shred_levels(read(spark, sf_dir, "web_document"), "doc_id", "jsonld", with_values=True)
    table = shred.wide_table(shred.fields(levels), shred.objects(levels), "$/author", ["@type", "name", "url"])
    return table.select(F.col("id").alias("doc_id"), "node_path", "parent_path", F.col("`@type`").alias("type"), "name", "url")


#: Objects and scalars of every valid record, walked down with SQL's own JSON functions, whose
#: test of validity lets commas before a closing bracket pass.
WALK = r"""
    WITH RECURSIVE n AS (
      SELECT doc_id, '$' AS node_path, '$' AS table_path, '' AS parent_path, '' AS parent_table, jsonld::JSON AS v FROM web_document WHERE json_valid(jsonld) AND NOT regexp_matches(jsonld, ',\s*[}\]]')
      UNION ALL
      SELECT n.doc_id, n.node_path || '/' || e.key, n.table_path || '/' || CASE WHEN json_type(n.v) = 'ARRAY' THEN '*' ELSE e.key END,
        CASE WHEN json_type(n.v) = 'OBJECT' THEN n.node_path ELSE n.parent_path END, CASE WHEN json_type(n.v) = 'OBJECT' THEN n.table_path ELSE n.parent_table END, e.value
      FROM n, LATERAL (SELECT * FROM json_each(n.v)) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY'))"""
SQL = {
    "p3_found": f"{WALK} SELECT doc_id, node_path, parent_path FROM n WHERE json_type(v) = 'OBJECT'",
    "p3_tables": f"{WALK} SELECT table_path, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM n WHERE json_type(v) = 'OBJECT' GROUP BY table_path",
    "p3_fields": f"""{WALK} SELECT doc_id, parent_table AS table_path, parent_path AS node_path, ltrim(substr(node_path, length(parent_path) + 1), '/') AS field, coalesce(v ->> '$', 'null') AS value
      FROM n WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')""",
    "p3_authors": f"""{WALK} SELECT doc_id, node_path, parent_path, v ->> '@type' AS type, CASE WHEN json_type(v, '$.name') NOT IN ('OBJECT', 'ARRAY') THEN v ->> 'name' END AS name, v ->> 'url' AS url
      FROM n WHERE table_path = '$/author' AND json_type(v) = 'OBJECT'""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in CATALOG.items()} | {f.__name__: f for f in (p3_found, p3_fields, p3_tables, p3_authors)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items()} | SQL
