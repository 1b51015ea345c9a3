"""Queries of understanding, confidence, merging, reordering, replies and relational breadth, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions import replies, understanding
from loomsearch.operators import analytics, ranking, text
from loomsearch.plans.catalog import AS_OF, BM25, LOG, asked, log_once, page_text, query, ranking_metrics, CATALOG
from loomsearch.plans.runtime import read, stage

HOST_LOW = "lower(trim(normalized_query))"
LABELS = f"string_split(split_part(regexp_replace({HOST_LOW}, '^https?://', ''), '/', 1), '.')"
HOST_SQL = rf"""CASE WHEN len({LABELS}) > 1 AND len(list_filter({LABELS}, lambda x: NOT regexp_matches(x, '^[a-z0-9-]+$') OR starts_with(x, '-') OR ends_with(x, '-'))) = 0 AND regexp_matches({LABELS}[-1], '^[a-z][a-z]+$')
    AND NOT regexp_matches({HOST_LOW}, '\s') AND NOT regexp_matches({HOST_LOW}, '[.](js|ts|py|rb|go|rs|java|c|cpp|h|json|md|txt|sh|yml|yaml|toml|css|html|jsx|tsx|php)$') THEN array_to_string({LABELS}, '.') END"""
STOPS = "'the', 'a', 'an', 'of', 'in', 'on', 'at', 'to', 'for', 'and', 'or', 'is', 'are', 'was', 'were', 'be', 'been', 'how', 'what', 'why', 'when', 'where', 'who', 'which', 'did', 'do', 'does', 'many', 'much'"


@query(f"""
    WITH h AS (SELECT normalized_query AS query, {HOST_SQL} AS host, count(*) AS searches FROM (SELECT DISTINCT * FROM query_log) GROUP BY 1, 2)
    SELECT query, host, searches, (s.domain IS NOT NULL)::int AS known FROM h LEFT JOIN sites s ON s.domain = h.host WHERE host IS NOT NULL""")
def typed_hosts(spark: SparkSession, d: str) -> DataFrame:
    hosts = log_once(spark, d).groupBy(F.col("normalized_query").alias("query")).agg(F.count("*").alias("searches")).withColumn("host", understanding.typed_host(F.col("query"))).where("host is not null")
    known = read(spark, d, "sites").select(F.col("domain").alias("host"), F.lit(1).alias("k"))
    return hosts.join(known, "host", "left").select("query", "host", "searches", F.coalesce("k", F.lit(0)).alias("known"))


TERMS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN (" + STOPS + ")))"


@query(rf"""
    WITH t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'User:')) AS turns FROM documents WHERE source = 'chat_turn'),
    u AS (SELECT doc_id, unnest(range(1, len(turns) + 1)) AS turn_no, unnest(turns) AS line, turns FROM t),
    x AS (SELECT doc_id, turn_no, trim(substr(line, 6)) AS turn, CASE WHEN turn_no > 1 THEN trim(substr(turns[turn_no - 1], 6)) END AS prev FROM u),
    s AS (SELECT *, regexp_matches(lower(turn), '\b(it|its|it''s|they|them|their|there|he|him|his|she|her|hers|this|that|these|those|one|ones)\b') AS p, regexp_matches(lower(turn), '^\s*(and|but|so|what about|how about|why|when|where|who|how)\b') AS e,
      len(string_split_regex(trim(turn), '\s+')) <= 5 AS sh, {TERMS.format("turn")} AS a, {TERMS.format("coalesce(prev, '')")} AS b,
      len(list_filter(list_distinct(regexp_extract_all(prev, ' ([A-Z][a-z][a-z]+)', 1)), lambda n: list_contains(string_split_regex(lower(turn), '[^a-z0-9_]+'), lower(n)))) AS shared FROM x),
    j AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) ELSE 0 END AS sim FROM s)
    SELECT doc_id, turn_no, p AS pronoun, e AS elliptical, sh AS short, coalesce(shared, 0) AS shared, round(sim, 6) AS similarity,
      prev IS NOT NULL AND (((p OR e) AND sh) OR coalesce(shared, 0) > 0 OR ((p OR e) AND sim >= 0.2)) AS follows FROM j""")
def follow_ups(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a chat; a turn's names are its words with a capital letter that do not begin it. The texts hold no times."""
    said = lambda c: F.trim(F.substring(c, 6, 1 << 30))
    turns = read(spark, d, "documents").where("source = 'chat_turn' and text is not null").select("doc_id", F.filter(F.split("text", "\n", -1), lambda x: x.startswith("User:")).alias("turns"))
    u = turns.select("doc_id", "turns", F.posexplode("turns").alias("at", "line"))
    pair = u.select("doc_id", (F.col("at") + 1).cast("long").alias("turn_no"), said(F.col("line")).alias("turn"), F.when(F.col("at") > 0, said(F.get("turns", F.col("at") - 1))).alias("prev"))
    names = F.regexp_extract_all("prev", F.lit(" ([A-Z][a-z][a-z]+)"), F.lit(1))
    signs = understanding.follow_up(F.col("turn"), F.col("prev"), names)
    shape = {"similarity": lambda c: F.round(c, 6), "shared": lambda c: c.cast("long")}
    return pair.select("doc_id", "turn_no", *[shape.get(n, lambda c: c)(c).alias(n) for n, c in signs.items()])


def lexical_top(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return text.best_lexical(read(spark, d, "web_document"), asked(spark, d), "doc_id", [page_text()], k)


@query(f"""
    WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s), t AS (SELECT query_id, count(*) AS n, max(score) AS top FROM r WHERE rank <= 10 GROUP BY 1)
    SELECT query_id, n, round(top / (top + 12) * (0.5::double + 0.5::double * least(1.0::double, n / 6)), 5) AS confidence FROM t""")
def index_confidence(spark: SparkSession, d: str) -> DataFrame:
    t = lexical_top(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    return t.select("query_id", "n", F.round(ranking.index_confidence(F.col("n"), ranking.saturate(F.col("top")), F.lit(0.0)), 5).alias("confidence"))


@query(f"""
    WITH {BM25}, {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s), t AS (SELECT * FROM r WHERE rank <= 10),
    c AS (SELECT query_id, max(score / (score + 12)) * (0.5::double + 0.5::double * least(1.0::double, count(*) / 6)) AS confidence FROM t GROUP BY 1),
    i AS (SELECT query_id, domain, min(rank) AS rank FROM t JOIN web_document w ON w.doc_id = t.id WHERE domain IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT normalized_query AS query_id, unnest(result_domains) AS domain, unnest(range(1, len(result_domains) + 1)) AS rank FROM l WHERE normalized_query IN (SELECT query_id FROM q) AND served_from = 'external'),
    e AS (SELECT query_id, domain, min(rank) AS rank FROM x GROUP BY 1, 2),
    u AS (SELECT query_id, domain, rank, 'index' AS origin FROM i UNION ALL SELECT query_id, domain, rank, 'external' FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.query_id = e.query_id AND i.domain = e.domain))
    SELECT query_id, domain, origin, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN (coalesce(confidence, 0) >= 0.35) = (origin = 'index') THEN 0 ELSE 1 END, rank, domain) AS place FROM u LEFT JOIN c USING (query_id)""")
def merged_domains(spark: SparkSession, d: str) -> DataFrame:
    top = stage(lexical_top(spark, d))
    trust = top.groupBy("query_id").agg(ranking.index_confidence(F.count("*"), ranking.saturate(F.max("score")), F.lit(0.0)).alias("confidence"))
    pages = read(spark, d, "web_document").where("domain is not null").select(F.col("doc_id").alias("id"), "domain")
    index = top.join(pages, "id").groupBy("query_id", "domain").agg(F.min("rank").alias("rank"))
    log = log_once(spark, d).where("served_from = 'external'").withColumnRenamed("normalized_query", "query_id").join(asked(spark, d).select("query_id").distinct(), "query_id", "left_semi")
    external = log.select("query_id", F.posexplode("result_domains").alias("at", "domain")).groupBy("query_id", "domain").agg((F.min("at") + 1).alias("rank"))
    return ranking.merge(index, external, trust, "query_id", "domain", least=0.35)


OFFICIAL = "official_domain IS NOT NULL AND official_domain <> ''"
ON_HOST = "(regexp_replace(lower(domain), '^www\\.', '') = regexp_replace(lower(official_domain), '^www\\.', '') OR ends_with(regexp_replace(lower(domain), '^www\\.', ''), '.' || regexp_replace(lower(official_domain), '^www\\.', '')))"
GENERAL = "coalesce(regexp_matches(lower(domain), '(^|[.]){0}$'), false)"
PLACED = f"""
    m AS (SELECT entity_id, doc_id, max(coalesce(confidence, 0))::double AS c FROM mentions GROUP BY 1, 2),
    p AS (SELECT m.entity_id, doc_id, official_domain, domain, path, row_number() OVER (PARTITION BY m.entity_id ORDER BY c DESC, doc_id) AS pos FROM m JOIN (SELECT * FROM entities WHERE {OFFICIAL}) e USING (entity_id) JOIN web_document USING (doc_id)),
    r AS (SELECT *, coalesce({ON_HOST}, false) AS own FROM p)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every page that mentions an entity with an official domain, with its surest mention."""
    m = read(spark, d, "mentions").groupBy("entity_id", "doc_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).cast("double").alias("c"))
    e = read(spark, d, "entities").where(OFFICIAL).select("entity_id", "official_domain")
    return m.join(e, "entity_id").join(read(spark, d, "web_document").select("doc_id", "domain", "path"), "doc_id")


@query(f"""
    WITH {PLACED}, z AS (SELECT *, len(list_filter(string_split(coalesce(path, ''), '/'), lambda x: x <> '')) AS depth, greatest(0.0::double, 1 - 0.05::double * (pos - 1)) AS base FROM r),
    s AS (SELECT *, CASE WHEN own THEN 2 + [1.0::double, 0.6, 0.3, 0.1][least(depth, 3) + 1] + 0.05::double * base ELSE base - CASE WHEN {GENERAL.format("wikipedia.org")} THEN 0.15::double WHEN {GENERAL.format("github.com")} THEN 0.10::double WHEN {GENERAL.format("reddit.com")} THEN 0.10::double
      WHEN {GENERAL.format("stackoverflow.com")} THEN 0.05::double WHEN {GENERAL.format("medium.com")} THEN 0.05::double WHEN {GENERAL.format("quora.com")} THEN 0.05::double ELSE 0 END END AS score FROM z)
    SELECT entity_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY entity_id ORDER BY round(score, 6) DESC, pos) AS place FROM s""")
def official_first(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(ranking.official_score(F.col("pos"), F.col("domain"), F.col("path"), F.col("official_domain")), 6)
    placed = candidates(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("c").desc(), "doc_id")))
    scored = placed.withColumn("score", score)
    return scored.select("entity_id", "doc_id", "score", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("score").desc(), "pos")).alias("place"))


@query(f"WITH {PLACED} SELECT entity_id, any_value(official_domain) AS official_domain, count(*) AS pages FROM r GROUP BY entity_id HAVING NOT bool_or(own)")
def missing_official(spark: SparkSession, d: str) -> DataFrame:
    own = ranking.on_host(F.col("domain"), F.col("official_domain"))
    return candidates(spark, d).groupBy("entity_id").agg(F.first("official_domain").alias("official_domain"), F.count("*").alias("pages"), F.bool_or(own).alias("own")).where("not own").drop("own")


@query("""
    WITH e AS (SELECT entity_id, trim(name) AS text, 1.0::double AS weight FROM entities WHERE name IS NOT NULL UNION ALL SELECT entity_id, trim(unnest(aliases)), 0.8::double FROM entities
      UNION ALL SELECT source_id, trim(t.name), 0.7::double FROM edges JOIN entities t ON t.entity_id = target_id),
    o AS (SELECT entity_id, lower(text) AS low, max(weight) AS weight FROM e WHERE text <> '' AND len(text) <= 200 GROUP BY 1, 2),
    x AS (SELECT o.entity_id, low, o.weight, min(text) AS text FROM o JOIN e ON e.entity_id = o.entity_id AND lower(e.text) = low AND e.weight = o.weight GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, low) AS place FROM x) SELECT entity_id, place, text, weight FROM r WHERE place <= 4""")
def query_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "entities")
    names = e.where("name is not null").select("entity_id", F.col("name").alias("text"), F.lit(1.0).alias("weight"))
    aliases = e.select("entity_id", F.explode("aliases").alias("text"), F.lit(0.8).alias("weight"))
    linked = read(spark, d, "edges").join(e.select(F.col("entity_id").alias("target_id"), "name"), "target_id").select(F.col("source_id").alias("entity_id"), F.col("name").alias("text"), F.lit(0.7).alias("weight"))
    return analytics.hypotheses(names.union(aliases).union(linked), "entity_id")


DAY_MICROS = 86_400_000_000


@query(f"""
    WITH {LOG}, x AS (SELECT id, intent, epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (PARTITION BY normalized_query ORDER BY epoch_us(occurred_at), id) AS gap FROM l WHERE normalized_query IS NOT NULL AND occurred_at IS NOT NULL),
    h AS (SELECT intent, coalesce(gap <= {DAY_MICROS}, false) AS hit FROM x)
    SELECT coalesce(intent, 'none') AS intent, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round((count(*) FILTER (WHERE hit))::double / count(*), 6) AS rate FROM h GROUP BY 1""")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    # An intent goes with its row's key: each row has one id but rows may repeat, so the log comes once.
    log = log_once(spark, d).withColumn("key", F.struct("id", F.coalesce("intent", F.lit("none")).alias("intent")))
    hits = analytics.repeats_within(log, "normalized_query", "occurred_at", "key")
    return analytics.hit_rate(hits.select(F.col("key.intent").alias("intent"), "hit"), "intent")


@query(f"""
    WITH m AS ({CATALOG["ranking_metrics"][1]}), u AS (SELECT 'precision5' AS metric, id, precision5 AS v FROM m UNION ALL SELECT 'reciprocal_rank', id, reciprocal_rank FROM m UNION ALL SELECT 'ndcg10', id, ndcg10 FROM m)
    SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, array_to_string(list(id ORDER BY v, id)[1:3], ' ') AS worst FROM u GROUP BY metric""")
def metric_report(spark: SparkSession, d: str) -> DataFrame:
    report = analytics.metric_report(stage(ranking_metrics(spark, d)), "id", ("precision5", "reciprocal_rank", "ndcg10"))
    return report.select("metric", "n", F.round("mean", 6).alias("mean"), F.array_join(F.col("worst").cast("array<string>"), " ").alias("worst"))


@query(r"""
    WITH a AS (SELECT doc_id, trim(regexp_extract(text, '(?s)(?:^|\n)ANSWER:(.*?)(?:\n(?:SUGGESTIONS|COMPARE|ROW):|\z)', 1), ' ') AS answer,
      list_filter(list_transform(string_split(regexp_extract(text, '(?:^|\n)SUGGESTIONS:([^\n]*)', 1), '|'), lambda s: trim(s, ' ')), lambda s: s <> '')[1:3] AS sg FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(answer) AS answer_chars, sha256(answer) AS answer_hash, len(sg) AS n_suggestions, array_to_string(sg, '|') AS suggestions FROM a WHERE answer <> ''""")
def reply_answers(spark: SparkSession, d: str) -> DataFrame:
    a = replies.answers(read(spark, d, "documents"), "doc_id", "text")
    return a.select("doc_id", F.length("answer").cast("long").alias("answer_chars"), F.sha2("answer", 256).alias("answer_hash"), F.size("suggestions").cast("long").alias("n_suggestions"), F.array_join("suggestions", "|").alias("suggestions"))


KINDS = "'Person', 'Organization', 'Product', 'Place', 'Technology', 'Event', 'Capability'"
STATED = f"CASE WHEN regexp_matches(c[{{0}}], '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$') THEN least(0.6::double, greatest(0::double, c[{{0}}]::double)) ELSE 0.3::double END"
EXTRACTED = f"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, n, trim(line, ' ') AS line, CASE WHEN upper(regexp_replace(line, '[^A-Za-z]', '', 'g')) IN ('ENTITIES', 'EDGES') THEN upper(regexp_replace(line, '[^A-Za-z]', '', 'g')) END AS head FROM l),
    s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h),
    c AS (SELECT doc_id, section, list_transform(string_split(line, '|'), lambda x: trim(x, ' ')) AS c FROM s),
    k AS (SELECT * FROM c WHERE NOT list_contains(c, '')),
    e AS (SELECT doc_id, c[1] AS name, c[2] AS node_type, max({STATED.format(3)}) AS confidence FROM k
          WHERE section = 'ENTITIES' AND len(c) = 3 AND c[2] IN ({KINDS}) AND len(c[1]) <= 200 GROUP BY ALL)"""


@query(f"WITH {EXTRACTED} SELECT doc_id, name, node_type, round(confidence, 6) AS confidence FROM e")
def extracted_entities(spark: SparkSession, d: str) -> DataFrame:
    return replies.extracted(read(spark, d, "documents"), "doc_id", "text")[0].withColumnRenamed("id", "doc_id").withColumn("confidence", F.round("confidence", 6))


@query(f"""
    WITH {EXTRACTED} SELECT doc_id, c[1] AS source, c[2] AS relation, c[3] AS target, round(max({STATED.format(4)}), 6) AS confidence FROM k
    WHERE section = 'EDGES' AND len(c) = 4 AND lower(c[1]) <> lower(c[3]) AND EXISTS (SELECT 1 FROM e WHERE e.doc_id = k.doc_id AND lower(e.name) = lower(c[1])) AND EXISTS (SELECT 1 FROM e WHERE e.doc_id = k.doc_id AND lower(e.name) = lower(c[3])) GROUP BY ALL""")
def extracted_edges(spark: SparkSession, d: str) -> DataFrame:
    return replies.extracted(read(spark, d, "documents"), "doc_id", "text")[1].withColumnRenamed("id", "doc_id").withColumn("confidence", F.round("confidence", 6))


@query(f"""
    WITH o AS (SELECT doc_id, json_extract_string(text, '$.title') AS title, json_extract_string(text, '$.provider') AS provider, coalesce(nullif(json_extract_string(text, '$.effects'), ''), 'unknown') AS effects FROM documents
      WHERE source = 'capability' AND json_valid(text) AND json_type(text) = 'OBJECT')
    SELECT provider, effects, count(*) AS capabilities, min(doc_id) AS first_id FROM o WHERE title IS NOT NULL AND provider IS NOT NULL GROUP BY 1, 2""")
def manifest_effects(spark: SparkSession, d: str) -> DataFrame:
    # The reader stops after a text's first value; within brackets, text after it makes the whole invalid.
    v = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<struct<title:string,provider:string,effects:string>>")
    one = read(spark, d, "documents").where("source = 'capability'").select("doc_id", v.alias("v")).where("size(v) = 1")
    o = one.select("doc_id", F.get("v", F.lit(0)).alias("m")).select("doc_id", "m.*").where("title is not null and provider is not null")
    return o.groupBy("provider", F.coalesce(F.nullif("effects", F.lit("")), F.lit("unknown")).alias("effects")).agg(F.count("*").alias("capabilities"), F.min("doc_id").alias("first_id"))


@query(f"SELECT domain, state, epoch(next_probe_at)::BIGINT AS due FROM sites WHERE next_probe_at <= TIMESTAMPTZ '{AS_OF}+00' ORDER BY next_probe_at, domain LIMIT 100")
def frontier_due(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "sites").where(F.col("next_probe_at") <= F.expr(f"timestamp '{AS_OF}'")).orderBy("next_probe_at", "domain").limit(100).select("domain", "state", F.unix_timestamp("next_probe_at").alias("due"))


@query("""
    SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'P' GROUP BY ROLLUP (r_name, n_name)""")
def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    place = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = read(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    sold = read(spark, d, "orders").where("o_orderstatus <> 'P'").join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name", "r_name")
    lines = read(spark, d, "lineitem").join(sold, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.rollup("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
    WITH t AS (SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, c_custkey) AS rank FROM t)
    SELECT c_nationkey, c_custkey, spent, rank FROM r WHERE rank <= 3""")
def best_customers(spark: SparkSession, d: str) -> DataFrame:
    spent = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return ranking.best_of(spent.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), ["c_nationkey"], [F.col("spent").desc(), F.col("c_custkey")], 3)


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def returned_by_priority(spark: SparkSession, d: str) -> DataFrame:
    back = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(back, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type, date_trunc('day', ts)), (event_type), ())")
def event_sets(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return e.groupingSets([["event_type", "day"], ["event_type"], []], "event_type", "day").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
