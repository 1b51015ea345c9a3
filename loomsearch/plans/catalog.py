"""The core operators over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions import replies, units, urls
from loomsearch.operators import analytics, graph, ranking, text
from loomsearch.plans.runtime import read

#: The fixed clock of all queries.
AS_OF, AS_OF_SECONDS = "2025-11-01 00:00:00", 1_761_955_200

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        CATALOG[f.__name__] = f, sql
        return f

    return add


def page_text():
    return F.concat_ws(" ", "title", "description", "body")


WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
PAGE = "concat_ws(' ', title, description, body)"


@query(f"""
    SELECT doc_id, len(w) AS n_words, len(list_distinct(list_filter(w, lambda x: len(x) > 2))) AS n_terms
    FROM (SELECT doc_id, {WORDS.format("body")} AS w FROM web_document WHERE body IS NOT NULL)""")
def page_terms(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "web_document").where("body is not null").select("doc_id", text.words("body").alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct(F.filter("w", lambda x: F.length(x) > 2))).alias("n_terms"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of the log's queries whose row id is divisible by 20."""
    log = read(spark, d, "query_log").where("id % 20 = 0 and normalized_query is not null")
    return log.select(F.col("normalized_query").alias("query_id"), F.explode(F.array_distinct(text.words("normalized_query"))).alias("term")).distinct()


def bm25_sql(queries: str, docs: str) -> str:
    """Parts of a WITH that end in s (query_id, id, score), from the SQL of (query_id, term) and (id, field f, words w)."""
    return f"""
    q AS ({queries}), d AS ({docs}),
    p AS (SELECT id, f, len(w) AS len, unnest(w) AS term FROM d),
    tf AS (SELECT id, f, term, count(*) AS tf, any_value(len) AS len FROM p WHERE term IN (SELECT term FROM q) GROUP BY id, f, term),
    st AS (SELECT f, count(*) AS n_docs, avg(len(w)) AS avg_len FROM d GROUP BY f),
    df AS (SELECT f, term, count(*) AS df FROM tf GROUP BY f, term),
    wt AS (SELECT term, id, ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / avg_len)) AS weight
           FROM tf JOIN df USING (f, term) JOIN st USING (f)),
    s AS (SELECT query_id, id, sum(weight) AS score FROM wt JOIN q USING (term) GROUP BY query_id, id)"""


ASKED = f"SELECT DISTINCT normalized_query AS query_id, unnest({WORDS.format('normalized_query')}) AS term FROM query_log WHERE id % 20 = 0 AND normalized_query IS NOT NULL"
BM25 = bm25_sql(ASKED, f"SELECT doc_id AS id, 0 AS f, {WORDS.format(PAGE)} AS w FROM web_document")
#: The six fields of a page, each with its own lengths and frequencies.
FIELDS = ("title", "description", "headings", "breadcrumbs", "body", "chunks")
SIX = f"""SELECT id, f, {WORDS.format("t")} AS w FROM (SELECT doc_id AS id, unnest(range(6)) AS f, unnest([coalesce(title, ''), coalesce(description, ''), coalesce(array_to_string(headings, ' '), ''),
    coalesce(array_to_string(breadcrumbs, ' '), ''), coalesce(body, ''), coalesce(array_to_string(chunks, ' '), '')]) AS t FROM web_document)"""


def page_fields() -> list:
    return [F.array_join(f, " ") if f in ("headings", "breadcrumbs", "chunks") else F.col(f) for f in FIELDS]


@query(f"""
    WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s)
    SELECT query_id, id AS doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 10""")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    best = text.best_lexical(read(spark, d, "web_document"), asked(spark, d), "doc_id", [page_text()], 10)
    return best.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 4).alias("score"))


FRESH = f"CASE WHEN coalesce(published_at, 0) <= 0 THEN 0.5::double ELSE pow(0.5::double, greatest({AS_OF_SECONDS} - published_at, 0)::double / {{0}}) END"


@query(f"""
    WITH {bm25_sql(ASKED, SIX)}, m AS (SELECT doc_id, least(1.0::double, sum(c)) AS boost FROM (SELECT doc_id, entity_id, max(confidence)::double AS c FROM mentions GROUP BY doc_id, entity_id) GROUP BY doc_id),
    f AS (SELECT query_id, s.id, s.score / (s.score + 12) + coalesce(authority, 0.5)::double + {FRESH.format(365 * 86400)} + coalesce(m.boost, 0) + coalesce(graph_importance, 0)::double AS total
          FROM s JOIN web_document w ON w.doc_id = s.id LEFT JOIN m ON m.doc_id = s.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, id) AS rank FROM f)
    SELECT query_id, id AS doc_id, rank, round(total, 4) AS total FROM r WHERE rank <= 10""")
def first_phase_top10(spark: SparkSession, d: str) -> DataFrame:
    boost = read(spark, d, "mentions").groupBy("doc_id", "entity_id").agg(F.max("confidence").cast("double").alias("c")).groupBy("doc_id").agg(F.least(F.lit(1.0), F.sum("c")).alias("boost"))
    pages = read(spark, d, "web_document").join(boost, "doc_id", "left")
    static = (F.coalesce("authority", F.lit(0.5)).cast("double") + ranking.freshness(F.col("published_at"), AS_OF_SECONDS, F.lit(365 * 86400))
              + F.coalesce("graph_importance", F.lit(0)).cast("double") + F.coalesce("boost", F.lit(0.0)))
    best = text.best_lexical(pages, asked(spark, d), "doc_id", page_fields(), 10, static)
    return best.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 4).alias("total"))


SEARCHES = "SELECT doc_id AS query_id, unnest({0}) AS term FROM documents WHERE source = 'search_query' AND doc_id % 20 = 0"
CLOSE = "1 / (1 + acos(greatest(-1, least(1, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double))))))"


@query(f"""
    WITH {bm25_sql("SELECT DISTINCT * FROM (" + SEARCHES.format(WORDS.format("text")) + ")", f"SELECT doc_id AS id, 0 AS f, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 0, [] FROM documents WHERE text IS NULL")},
    n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {CLOSE} AS c FROM embeddings a JOIN documents ON doc_id = a.vec_id AND source = 'search_query' AND doc_id % 20 = 0, embeddings b WHERE a.vec_id <> b.vec_id),
    v AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, id) <= 100),
    t AS (SELECT query_id, id, coalesce(score / (score + 12), 0) AS lexical, coalesce(c, 0) AS semantic FROM (SELECT * FROM s WHERE query_id <> id) FULL JOIN v USING (query_id, id)),
    z AS (SELECT query_id, id, lexical, semantic, lexical + semantic + CASE WHEN fetched_at IS NULL THEN 0.5::double ELSE pow(0.5::double, greatest({AS_OF_SECONDS} - floor(epoch(fetched_at)), 0) / 31536000) END AS total FROM t JOIN documents ON doc_id = id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, id) AS rank FROM z)
    SELECT query_id, id AS doc_id, rank, round(lexical, 4) AS lexical, round(semantic, 4) AS semantic, round(total, 4) AS total FROM r WHERE rank <= 10""")
def hybrid_top10(spark: SparkSession, d: str) -> DataFrame:
    """Words or vectors: a document that either finds is a candidate, for searches whose id is divisible by 20."""
    docs, vectors = read(spark, d, "documents"), read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    searches = docs.where("source = 'search_query' and doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    lexical = text.bm25(docs, searches.select("query_id", F.explode(text.words("text")).alias("term")).distinct(), "doc_id", F.col("text"))
    close = ranking.nearest(vectors, searches.join(vectors, F.col("query_id") == F.col("id")).select("query_id", "vector"), 101)
    near = text.top_per_query(close.where("query_id <> id").drop("rank"), 100, "closeness")
    static = docs.select(F.col("doc_id").alias("id"), ranking.freshness(F.unix_timestamp("fetched_at"), AS_OF_SECONDS, F.lit(365 * 86400)).alias("static"))
    found = ranking.hybrid(lexical.where("query_id <> id"), near, static)
    return text.top_per_query(found, 10, "total").select("query_id", F.col("id").alias("doc_id"), "rank", *[F.round(x, 4).alias(x) for x in ("lexical", "semantic", "total")])


@query("""
    WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, 1 / (1 + acos(greatest(-1, least(1, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::double * z[2]::double)))))) AS closeness
               FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(closeness, 6) DESC, id) AS rank FROM p)
    SELECT query_id, id AS vec_id, rank, round(closeness, 5) AS closeness FROM r WHERE rank <= 10""")
def knn_top10(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = ranking.nearest(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10)
    return found.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("closeness", 5).alias("closeness"))


@query(f"""
    SELECT doc_id, round({FRESH.format(2 * 86400)}, 6) AS news, round({FRESH.format(90 * 86400)}, 6) AS event, round({FRESH.format(365 * 86400)}, 6) AS other FROM web_document""")
def freshness_by_intent(spark: SparkSession, d: str) -> DataFrame:
    f = lambda i: F.round(ranking.freshness(F.col("published_at"), AS_OF_SECONDS, ranking.half_life(F.lit(i))), 6)
    return read(spark, d, "web_document").select("doc_id", f("news").alias("news"), f("event").alias("event"), f("information").alias("other"))


@query("""
    WITH m AS (SELECT doc_id, entity_id, max(confidence)::double AS confidence FROM mentions GROUP BY doc_id, entity_id)
    SELECT doc_id, count(*) AS n_entities, round(least(1.0::double, coalesce(sum(confidence), 0)), 6) AS boost FROM m GROUP BY doc_id""")
def entity_boost(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "mentions").groupBy("doc_id", "entity_id").agg(F.max("confidence").cast("double").alias("confidence"))
    return m.groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.round(F.least(F.lit(1.0), F.coalesce(F.sum("confidence"), F.lit(0.0))), 6).alias("boost"))


def log_once(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "query_log").distinct()


LOG = "l AS (SELECT DISTINCT * FROM query_log)"


@query(f"""
    WITH {LOG}, x AS (SELECT normalized_query, id AS list_id, unnest(result_domains) AS domain, unnest(range(1, len(result_domains) + 1)) AS rank FROM l WHERE normalized_query IS NOT NULL),
    o AS (SELECT normalized_query, list_id, domain, min(rank) AS rank FROM x GROUP BY ALL)
    SELECT normalized_query, domain, round(sum(1::double / (60 + rank)), 6) AS score, count(*) AS agreement, min(rank) AS best_rank FROM o GROUP BY normalized_query, domain""")
def rrf_domains(spark: SparkSession, d: str) -> DataFrame:
    lists = log_once(spark, d).where("normalized_query is not null").select("normalized_query", F.col("id").alias("list_id"), F.posexplode("result_domains").alias("pos", "domain"))
    lists = lists.select("normalized_query", "list_id", "domain", (F.col("pos") + 1).cast("long").alias("rank"), F.lit(1.0).alias("weight"))
    return ranking.fuse(lists, ["normalized_query"], "domain").withColumn("score", F.round("score", 6))


@query(f"""
    WITH {LOG}, r AS (SELECT * FROM l WHERE intent IS NOT NULL AND occurred_at > TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAY)
    SELECT intent, count(*) AS searches, count(*) FILTER (WHERE served_from = 'index') AS from_index, count(*) FILTER (WHERE served_from = 'external') AS from_external,
      count(*) FILTER (WHERE served_from = 'mixed') AS mixed, count(DISTINCT normalized_query) AS distinct_queries, floor(epoch(max(occurred_at)))::BIGINT AS last_seen_at,
      round((count(*) FILTER (WHERE served_from IN ('external', 'mixed')))::double / nullif(count(served_from), 0), 4) AS external_share
    FROM r GROUP BY intent""")
def intent_coverage(spark: SparkSession, d: str) -> DataFrame:
    return analytics.coverage(log_once(spark, d), AS_OF).withColumn("last_seen_at", F.unix_timestamp("last_seen_at"))


@query(f"WITH {LOG}, x AS (SELECT unnest(result_domains) AS domain FROM l) SELECT domain, count(*) AS searches, round(least(1.0::double, ln(1 + count(*)::double) / 10), 6) AS demand FROM x WHERE domain IS NOT NULL GROUP BY domain")
def demand_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return analytics.demand(log_once(spark, d), "result_domains", "domain").withColumn("demand", F.round("demand", 6))


@query(f"""
    WITH {LOG}, x AS (SELECT normalized_query, unnest(CASE WHEN len(result_domains) > 0 THEN result_domains ELSE [NULL] END) AS domain FROM l WHERE normalized_query IS NOT NULL),
    c AS (SELECT normalized_query, count(*) AS frequency, max(occurred_at) AS t FROM l WHERE normalized_query IS NOT NULL GROUP BY 1)
    SELECT c.normalized_query, any_value(frequency) AS frequency, floor(epoch(any_value(t)))::BIGINT AS last_seen_at, coalesce(string_agg(DISTINCT domain, ',' ORDER BY domain), '') AS domains,
      substr(sha256(c.normalized_query), 1, 24) AS memory_id FROM c LEFT JOIN x USING (normalized_query) GROUP BY c.normalized_query""")
def query_memory(spark: SparkSession, d: str) -> DataFrame:
    m = analytics.query_memory(log_once(spark, d))
    return m.select("normalized_query", "frequency", F.unix_timestamp("last_seen_at").alias("last_seen_at"), F.array_join("domains", ",").alias("domains"), "memory_id")


@query("""
    WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x)
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS session_start, floor(epoch(max(ts)))::BIGINT + 1800 AS session_end, count(*) AS n FROM y GROUP BY user_id, s""")
def sessionize(spark: SparkSession, d: str) -> DataFrame:
    s = analytics.sessions(read(spark, d, "events"), "user_id", "ts")
    return s.select("user_id", F.unix_timestamp("session_start").alias("session_start"), F.unix_timestamp("session_end").alias("session_end"), "n")


@query("SELECT user_id, (floor(epoch(ts))::BIGINT // 3600) * 3600 AS window_start, count(*) AS n, greatest(count(*) - 2, 0) AS over FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2")
def request_windows(spark: SparkSession, d: str) -> DataFrame:
    return analytics.windows_over(read(spark, d, "events"), "user_id", "ts", 3600, 2).withColumn("window_start", F.unix_timestamp("window_start"))


@query("SELECT event_id, user_id, event_type, lag(event_type) OVER w AS previous_event_type, floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER w))::BIGINT AS seconds_since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def previous_event(spark: SparkSession, d: str) -> DataFrame:
    return analytics.previous(read(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


@query("""
    WITH l AS (SELECT DISTINCT * FROM search_documents)
    SELECT domain, count(*) AS fetches, count(*) FILTER (WHERE http_status BETWEEN 200 AND 299) AS extracted, count(*) FILTER (WHERE http_status IN (401, 403, 429)) AS refused,
      count(*) FILTER (WHERE http_status >= 500) AS failed, count(*) FILTER (WHERE http_status IS NULL) AS unknown, floor(epoch(max(fetched_at)))::BIGINT AS last_fetched_at FROM l GROUP BY domain""")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return analytics.fetch_outcomes(read(spark, d, "search_documents")).withColumn("last_fetched_at", F.unix_timestamp("last_fetched_at"))


LATEST = """n AS (SELECT doc_id, coalesce(content_hash, '') AS content_hash, coalesce(http_status, -1) AS http_status, fetched_at FROM search_documents),
    latest AS (SELECT DISTINCT ON (doc_id) * FROM n ORDER BY doc_id, fetched_at DESC NULLS LAST, http_status DESC, content_hash DESC)"""


def latest_fetch(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "search_documents").select("doc_id", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce("http_status", F.lit(-1)).alias("http_status"), "fetched_at")
    best = F.max(F.struct(F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))).alias("at"), "http_status", "content_hash", "fetched_at")).alias("r")
    return rows.groupBy("doc_id").agg(best).select("doc_id", "r.content_hash", "r.http_status", "r.fetched_at")


@query(f"WITH {LATEST} SELECT doc_id, content_hash, http_status, floor(epoch(fetched_at))::BIGINT AS fetched_at FROM latest")
def ledger_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_fetch(spark, d).withColumn("fetched_at", F.unix_timestamp("fetched_at"))


@query(f"""
    WITH {LATEST} SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN w.doc_id IS NULL THEN 'gone' WHEN l.content_hash IS NOT DISTINCT FROM w.content_hash THEN 'same' ELSE 'changed' END AS change
    FROM latest l FULL JOIN web_document w USING (doc_id)""")
def content_changes(spark: SparkSession, d: str) -> DataFrame:
    return analytics.changes(latest_fetch(spark, d), read(spark, d, "web_document"), "doc_id", "content_hash")


@query("""
    WITH e AS (SELECT *, greatest(0::double, least(1::double, coalesce(confidence::double, 0))) AS x, row_number() OVER (PARTITION BY source_id, relation, target_id ORDER BY created_at NULLS FIRST, id) AS n FROM edges)
    SELECT source_id, relation, target_id, count(*) AS observations, round(1 - (1 - max(CASE WHEN n = 1 THEN x END)) * exp(sum(ln(1 - x / 2)) - ln(1 - max(CASE WHEN n = 1 THEN x END) / 2)), 6) AS confidence
    FROM e GROUP BY source_id, relation, target_id""")
def edge_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return graph.accumulate_edges(read(spark, d, "edges")).withColumn("confidence", F.round("confidence", 6))


@query("""
    WITH e AS (SELECT DISTINCT source_id, relation, target_id, confidence, id FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC NULLS LAST, id, relation, target_id) AS rank FROM e)
    SELECT source_id, rank, relation, target_id, name AS target_name, round(confidence::double, 6) AS confidence FROM r JOIN entities ON entity_id = target_id WHERE rank <= 50""")
def edge_neighbours(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "edges").select("source_id", "relation", "target_id", "confidence", F.struct("id", "relation", "target_id").alias("id")).distinct()
    return graph.neighbours(edges, read(spark, d, "entities")).withColumn("confidence", F.round(F.col("confidence").cast("double"), 6))


@query("""
    WITH e AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS name_key, coalesce(description, '') AS d, row_number() OVER (PARTITION BY node_type, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) ORDER BY first_seen_at NULLS FIRST, entity_id) AS n
               FROM entities WHERE name IS NOT NULL),
    a AS (SELECT node_type, name_key, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM (SELECT node_type, name_key, unnest(aliases) AS a FROM e) GROUP BY ALL)
    SELECT node_type, name_key, max(CASE WHEN n = 1 THEN entity_id END) AS entity_id, coalesce(any_value(a.aliases), '') AS aliases, (max({'n': length(d), 'd': d})).d AS description,
      round(least(1::double, max(CASE WHEN n = 1 THEN popularity::double END) + 0.01::double * (count(*) - 1)), 6) AS popularity, count(*) AS observations
    FROM e LEFT JOIN a USING (node_type, name_key) GROUP BY node_type, name_key""")
def entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    return graph.upsert(read(spark, d, "entities")).withColumn("aliases", F.array_join("aliases", "|")).withColumn("popularity", F.round("popularity", 6))


SURFACES = """x AS (SELECT entity_id, popularity, unnest(list_distinct(list_concat([name], coalesce(aliases, [])))) AS s FROM entities),
    f AS (SELECT DISTINCT trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) AS surface, entity_id, popularity FROM x), g AS (SELECT * FROM f WHERE surface <> ''),
    reg AS (SELECT surface, max_by(entity_id, {'p': coalesce(popularity, 0), 'e': entity_id}) AS entity_id, count(*) AS claims FROM g GROUP BY surface)"""


@query(f"WITH {SURFACES} SELECT * FROM reg")
def registry_contest(spark: SparkSession, d: str) -> DataFrame:
    return graph.registry(read(spark, d, "entities"))


@query(f"""
    WITH {SURFACES}, q AS (SELECT DISTINCT normalized_query AS query, string_split(trim(regexp_replace(lower(normalized_query), '\\s+', ' ', 'g')), ' ') AS w FROM query_log WHERE normalized_query IS NOT NULL),
    t AS (SELECT query, array_to_string(w[1:n], ' ') AS surface FROM q, (SELECT unnest([1, 2, 3]) AS n) WHERE n <= len(w))
    SELECT query, arg_max(surface, length(surface)) AS surface, arg_max(entity_id, length(surface)) AS entity_id FROM t JOIN reg USING (surface) GROUP BY query""")
def registry_prefix(spark: SparkSession, d: str) -> DataFrame:
    asked_for = read(spark, d, "query_log").select(F.col("normalized_query").alias("query"))
    return graph.longest_prefix(asked_for, graph.registry(read(spark, d, "entities")))


@query("""
    WITH q AS (SELECT DISTINCT name FROM (SELECT unnest(entities) AS name FROM web_document) WHERE name IS NOT NULL),
    m AS (SELECT q.name, entity_id, popularity FROM q JOIN entities e ON lower(e.name) = lower(q.name) UNION SELECT q.name, entity_id, popularity FROM q JOIN (SELECT entity_id, popularity, unnest(aliases) AS a FROM entities) ON a = q.name),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY popularity DESC NULLS LAST, entity_id) AS rank FROM m)
    SELECT name, entity_id, rank FROM r WHERE rank <= 12""")
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_names(read(spark, d, "web_document").select(F.explode("entities").alias("name")), read(spark, d, "entities"))


@query("""
    WITH o AS (SELECT DISTINCT source_id, relation, target_id FROM edges), x AS (SELECT source_id AS entity_id FROM o UNION ALL SELECT target_id FROM o), g AS (SELECT entity_id, count(*) AS degree FROM x GROUP BY 1)
    SELECT entity_id, degree, round(degree::double / max(degree) OVER (), 6) AS importance FROM g""")
def graph_importance(spark: SparkSession, d: str) -> DataFrame:
    return graph.importance(read(spark, d, "edges")).withColumn("importance", F.round("importance", 6))


@query("SELECT doc_id, entity_id, count(*) AS n, round(max(confidence)::double, 6) AS confidence FROM mentions GROUP BY doc_id, entity_id")
def mention_max(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "mentions").groupBy("doc_id", "entity_id").agg(F.count("*").alias("n"), F.round(F.max("confidence").cast("double"), 6).alias("confidence"))


@query("""
    WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(lower(body), '\\s+', ' ', 'g'))) AS h FROM web_document WHERE length(body) > 0), g AS (SELECT h, min(doc_id) AS first_id, count(*) AS copies FROM h GROUP BY h)
    SELECT doc_id, first_id, copies FROM h JOIN g USING (h)""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "web_document").where("length(body) > 0").select("doc_id", F.sha2(F.trim(F.regexp_replace(F.lower("body"), "\\s+", " ")), 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "h").select("doc_id", "first_id", "copies")


@query(f"""
    WITH c AS (SELECT doc_id, list_filter({WORDS.format("coalesce(title, '')")}, lambda x: length(x) > 2) AS q, unnest(chunks) AS c, unnest(range(0, len(chunks))) AS pos FROM web_document),
    s AS (SELECT doc_id, pos, len(list_filter(string_split_regex(lower(coalesce(c, '')), '[^a-z0-9]+'), lambda w: list_contains(q, w))) / sqrt(len(string_split_regex(lower(coalesce(c, '')), '[^a-z0-9]+'))::double) AS score FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS n FROM s)
    SELECT doc_id, pos, round(score, 6) AS score FROM r WHERE n <= 3""")
def passages_top3(spark: SparkSession, d: str) -> DataFrame:
    found = text.passages(read(spark, d, "web_document"), "doc_id", F.coalesce("title", F.lit("")), F.col("chunks"))
    return found.select(F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"))


@query(f"""
    WITH w AS (SELECT doc_id, {WORDS.format("body")} AS w FROM web_document WHERE body IS NOT NULL), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 1 - 80, 0) + 1, 320)) AS start FROM w WHERE len(w) > 0)
    SELECT doc_id, start // 320 AS chunk_no, len(w[start + 1:start + 400]) AS n_words, w[start + 1] AS first_word, w[least(start + 400, len(w))] AS last_word FROM s""")
def overlapping_chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.overlapping_chunks(read(spark, d, "web_document").where("body is not null"), "doc_id", F.col("body")).withColumnRenamed("id", "doc_id")


@query("""
    SELECT doc_id, substr(sha256(url), 1, 16) AS id, coalesce(nullif(title, ''), domain) AS title, coalesce(CASE WHEN len(chunks) > 0 THEN chunks[1] END, substr(body, 1, 300)) AS snippet,
      round(coalesce(freshness, 0.5)::double, 5) AS freshness, nullif(published_at, 0) AS published_at, CASE WHEN len(headings) > 0 THEN array_to_string(headings[1:12], '|') END AS headings FROM web_document""")
def result_projection(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "web_document")
    return w.select(
        "doc_id", F.substring(F.sha2("url", 256), 1, 16).alias("id"), F.coalesce(F.nullif("title", F.lit("")), "domain").alias("title"),
        F.coalesce(F.get("chunks", F.lit(0)), F.substring("body", 1, 300)).alias("snippet"), F.round(F.coalesce("freshness", F.lit(0.5)).cast("double"), 5).alias("freshness"),
        F.nullif("published_at", F.lit(0)).alias("published_at"), F.when(F.size("headings") > 0, F.array_join(F.slice("headings", 1, 12), "|")).alias("headings"),
    )


@query("""
    WITH s AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL)
    SELECT source, percent, n_chars AS value FROM s, (SELECT unnest([50, 90, 95, 99]) AS percent) WHERE i = least(n - 1, floor(percent / 100::double * n))""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.percentile_at(read(spark, d, "documents"), "source", "n_chars", (50, 90, 95, 99))


@query(f"""
    WITH {LOG} SELECT coalesce(intent, 'all') AS intent, coalesce(served_from, 'all') AS served_from, grouping(intent) AS g_intent, grouping(served_from) AS g_served, count(*) AS n
    FROM l GROUP BY CUBE (intent, served_from)""")
def served_cube(spark: SparkSession, d: str) -> DataFrame:
    cube = log_once(spark, d).cube("intent", "served_from").agg(F.grouping("intent").cast("long").alias("g_intent"), F.grouping("served_from").cast("long").alias("g_served"), F.count("*").alias("n"))
    return cube.withColumn("intent", F.coalesce("intent", F.lit("all"))).withColumn("served_from", F.coalesce("served_from", F.lit("all")))


@query(f"""
    WITH {LOG}, dem AS (SELECT domain, least(1.0::double, ln(1 + count(*)::double) / 10) AS demand FROM (SELECT unnest(result_domains) AS domain FROM l) GROUP BY domain),
    w AS (SELECT domain, avg(authority::double) AS a, avg({FRESH.format(365 * 86400)}) AS f, avg(graph_importance::double) AS g FROM web_document WHERE domain IS NOT NULL GROUP BY domain)
    SELECT s.domain, round(0.35::double * coalesce(demand, 0) + 0.30::double * coalesce(a, 0) + 0.20::double * coalesce(f, 0) + 0.15::double * coalesce(g, 0), 6) AS priority
    FROM sites s LEFT JOIN dem USING (domain) LEFT JOIN w USING (domain)""")
def crawl_priority(spark: SparkSession, d: str) -> DataFrame:
    want = analytics.demand(log_once(spark, d), "result_domains", "domain").select("domain", "demand")
    pages = read(spark, d, "web_document").where("domain is not null").groupBy("domain").agg(
        F.avg(F.col("authority").cast("double")).alias("a"), F.avg(ranking.freshness(F.col("published_at"), AS_OF_SECONDS, F.lit(365 * 86400))).alias("f"), F.avg(F.col("graph_importance").cast("double")).alias("g"))
    c = lambda n: F.coalesce(n, F.lit(0.0))
    both = read(spark, d, "sites").select("domain").join(want, "domain", "left").join(pages, "domain", "left")
    return both.select("domain", F.round(0.35 * c("demand") + 0.30 * c("a") + 0.20 * c("f") + 0.15 * c("g"), 6).alias("priority"))


@query(f"WITH c AS (SELECT doc_id, {urls.CANONICAL_SQL} AS canonical FROM web_document WHERE url IS NOT NULL), g AS (SELECT canonical, count(*) AS variants, min(doc_id) AS first_id FROM c GROUP BY canonical) SELECT doc_id, canonical, variants, first_id FROM c JOIN g USING (canonical)")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "web_document").where("url is not null").select("doc_id", urls.canonical(F.col("url")).alias("canonical"))
    return c.join(c.groupBy("canonical").agg(F.count("*").alias("variants"), F.min("doc_id").alias("first_id")), "canonical")


@query(f"""
    WITH {LOG}, good AS (SELECT domain FROM web_document WHERE domain IS NOT NULL GROUP BY domain HAVING avg(authority::double) >= 0.5),
    x AS (SELECT id, unnest(result_domains) AS domain, unnest(range(1, len(result_domains) + 1)) AS rank FROM l), y AS (SELECT x.id, rank, (good.domain IS NOT NULL)::int AS gain FROM x LEFT JOIN good USING (domain)),
    z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, rank) AS ideal FROM y)
    SELECT id, round(sum(CASE WHEN rank <= 5 THEN gain ELSE 0 END) / 5::double, 6) AS precision5, round(coalesce(max(CASE WHEN gain = 1 THEN 1::double / rank END), 0), 6) AS reciprocal_rank,
      round(coalesce(sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 10 THEN gain / log2(ideal + 1) ELSE 0 END), 0), 0), 6) AS ndcg10 FROM z GROUP BY id""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    good = read(spark, d, "web_document").where("domain is not null").groupBy("domain").agg(F.avg(F.col("authority").cast("double")).alias("a")).where("a >= 0.5").select("domain", F.lit(1).alias("gain"))
    lists = log_once(spark, d).select("id", F.posexplode("result_domains").alias("pos", "domain")).join(good, "domain", "left").select("id", (F.col("pos") + 1).alias("rank"), F.coalesce("gain", F.lit(0)).alias("gain"))
    ideal = F.row_number().over(Window.partitionBy("id").orderBy(F.col("gain").desc(), "rank"))
    dcg = lambda at: F.sum(F.when(F.col(at) <= 10, F.col("gain") / F.log2(F.col(at) + 1)).otherwise(0.0))
    return lists.withColumn("ideal", ideal).groupBy("id").agg(
        F.round(F.sum(F.when(F.col("rank") <= 5, F.col("gain")).otherwise(0)) / 5, 6).alias("precision5"),
        F.round(F.coalesce(F.max(F.when(F.col("gain") == 1, 1 / F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(dcg("rank") / F.nullif(dcg("ideal"), F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg10"),
    )


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13)) AS line, CASE upper(regexp_replace(line, '[^A-Za-z]', '', 'g')) WHEN 'ENTITIES' THEN 'ENTITIES' WHEN 'EDGES' THEN 'EDGES' END AS head FROM l),
    s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h)
    SELECT doc_id, section, count(*) FILTER (WHERE head IS NULL AND line LIKE '%|%') AS n_rows FROM s WHERE section IS NOT NULL GROUP BY doc_id, section""")
def extraction_sections(spark: SparkSession, d: str) -> DataFrame:
    return replies.sections(read(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, len(c) AS n_citations, len(list_distinct(c)) AS n_sources FROM (SELECT doc_id, regexp_extract_all(text, '\\[([0-9]{1,2})\\]', 1) AS c FROM documents WHERE text IS NOT NULL) WHERE len(c) > 0")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return replies.citations(read(spark, d, "documents"), "doc_id", "text")


#: The unit table once more, by itself, so that a wrong value in either place shows.
UNIT_SQL = """VALUES ('bytes', 'data', 1::double, 'b byte bytes'), ('kilobytes', 'data', 1000, 'kb kilobyte kilobytes'), ('megabytes', 'data', 1000000, 'mb megabyte megabytes'), ('gigabytes', 'data', 1e9, 'gb gigabyte gigabytes'),
    ('terabytes', 'data', 1e12, 'tb terabyte terabytes'), ('petabytes', 'data', 1e15, 'pb petabyte petabytes'), ('kibibytes', 'data', 1024, 'kib kibibyte kibibytes'), ('mebibytes', 'data', 1048576, 'mib mebibyte mebibytes'),
    ('gibibytes', 'data', 1073741824, 'gib gibibyte gibibytes'), ('tebibytes', 'data', 1099511627776, 'tib tebibyte tebibytes'), ('millimetres', 'length', 0.001, 'mm millimetre millimetres millimeter millimeters'),
    ('centimetres', 'length', 0.01, 'cm centimetre centimetres centimeter centimeters'), ('metres', 'length', 1, 'm metre metres meter meters'), ('kilometres', 'length', 1000, 'km kilometre kilometres kilometer kilometers'),
    ('inches', 'length', 0.0254, 'in inch inches'), ('feet', 'length', 0.3048, 'ft foot feet'), ('yards', 'length', 0.9144, 'yd yard yards'), ('miles', 'length', 1609.344, 'mi mile miles'), ('grams', 'mass', 1, 'g gram grams'),
    ('kilograms', 'mass', 1000, 'kg kilo kilos kilogram kilograms'), ('tonnes', 'mass', 1000000, 't tonne tonnes'), ('ounces', 'mass', 28.349523125, 'oz ounce ounces'), ('pounds', 'mass', 453.59237, 'lb lbs pound pounds'),
    ('stone', 'mass', 6350.29318, 'st stone stones'), ('milliseconds', 'time', 0.001, 'ms millisecond milliseconds'), ('seconds', 'time', 1, 's sec secs second seconds'), ('minutes', 'time', 60, 'min mins minute minutes'),
    ('hours', 'time', 3600, 'h hr hrs hour hours'), ('days', 'time', 86400, 'd day days'), ('weeks', 'time', 604800, 'wk week weeks'), ('Celsius', 'temperature', 1, 'c °c celsius centigrade'), ('Fahrenheit', 'temperature', 1, 'f °f fahrenheit'),
    ('Kelvin', 'temperature', 1, 'k kelvin')"""
NUMBER_SQL = "CASE WHEN {0} = 0 THEN '0' WHEN abs({0}) < 1 THEN regexp_replace(format('{{:,.6f}}', round({0}, 6)), '[.]?0+$', '') WHEN abs({0}) < 1000 THEN regexp_replace(format('{{:,.4f}}', round({0}, 4)), '[.]?0+$', '') ELSE regexp_replace(format('{{:,.2f}}', round({0}, 2)), '[.]?0+$', '') END"
NUMBER_SQL = f"replace(replace('<' || ({NUMBER_SQL}) || '>', '<-0>', '<0>'), '<>', '<0>')[2:-2]"
UNIT_NAME = "CASE WHEN abs({0}) = 1 THEN regexp_replace({1}, 's$', '') ELSE {1} END"


@query(rf"""
    WITH u AS (SELECT unit, dimension, factor, unnest(string_split(names, ' ')) AS name FROM ({UNIT_SQL}) x(unit, dimension, factor, names)),
    q AS (SELECT query, string_split_regex(trim(query), '\s+(to|in|as|into)\s+') AS p FROM (SELECT DISTINCT normalized_query AS query FROM query_log WHERE regexp_matches(normalized_query, '^\s*[0-9.,-]+\s*[A-Za-z°]+\s+(to|in|as|into)\s+[A-Za-z°]+\s*$'))),
    n AS (SELECT query, try_cast(replace(regexp_extract(p[1], '^[0-9.,-]+'), ',', '') AS double) AS amount, lower(trim(regexp_replace(p[1], '^[0-9.,-]+', ''))) AS a, lower(p[2]) AS b FROM q),
    j AS (SELECT query, amount, x.unit AS unit_from, y.unit AS unit_to, x.dimension, x.factor AS fa, y.factor AS fb FROM n JOIN u x ON x.name = a JOIN u y ON y.name = b AND y.dimension = x.dimension AND y.unit <> x.unit WHERE amount IS NOT NULL),
    k AS (SELECT *, CASE unit_from WHEN 'Fahrenheit' THEN (amount - 32) * 5 / 9 WHEN 'Kelvin' THEN amount - 273.15::double ELSE amount END AS t FROM j),
    c AS (SELECT query, amount, unit_from, unit_to, CASE WHEN dimension <> 'temperature' THEN amount * fa / fb WHEN unit_to = 'Fahrenheit' THEN t * 9 / 5 + 32 WHEN unit_to = 'Kelvin' THEN t + 273.15::double ELSE t END AS converted FROM k)
    SELECT query, amount, unit_from, unit_to, round(converted, 6) AS converted,
      {NUMBER_SQL.format("amount")} || ' ' || {UNIT_NAME.format("amount", "unit_from")} || ' is ' || {NUMBER_SQL.format("converted")} || ' ' || {UNIT_NAME.format("converted", "unit_to")} || '.' AS answer FROM c""")
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    asked_for = read(spark, d, "query_log").select(F.col("normalized_query").alias("query")).distinct()
    return units.convert(asked_for, "query", "query").withColumn("converted", F.round("converted", 6))


@query("""
    WITH x AS (SELECT entity_id, name, unnest(aliases) AS alias FROM entities), y AS (SELECT DISTINCT entity_id, alias FROM x WHERE alias <> '' AND lower(alias) <> lower(name)),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY alias) AS n FROM y) SELECT entity_id, alias, n FROM r WHERE n <= 4""")
def alias_expand(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "entities").select("entity_id", "name", F.explode("aliases").alias("alias")).where("alias <> '' and lower(alias) <> lower(name)").select("entity_id", "alias").distinct()
    return x.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("alias"))).where("n <= 4")


@query("""
    WITH m AS (SELECT s.domain, count(*) AS pages FROM sites s JOIN web_document w USING (domain) GROUP BY 1), f AS (SELECT domain, count(DISTINCT doc_id) AS fetched FROM search_documents WHERE domain IS NOT NULL GROUP BY 1)
    SELECT s.domain, s.state, coalesce(pages, 0) AS pages, coalesce(fetched, 0) AS fetched, (last_probed_at IS NULL)::int AS never_probed FROM sites s LEFT JOIN m USING (domain) LEFT JOIN f USING (domain)""")
def site_report(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "web_document").where("domain is not null").groupBy("domain").agg(F.count("*").alias("pages"))
    fetched = read(spark, d, "search_documents").where("domain is not null").groupBy("domain").agg(F.count_distinct("doc_id").alias("fetched"))
    s = read(spark, d, "sites").join(pages, "domain", "left").join(fetched, "domain", "left")
    return s.select("domain", "state", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("fetched", F.lit(0)).alias("fetched"), F.col("last_probed_at").isNull().cast("int").alias("never_probed"))


@query("SELECT * FROM (SELECT e.entity_id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.entity_id = e.entity_id)) INTERSECT SELECT target_id FROM edges")
def linked_but_unmentioned(spark: SparkSession, d: str) -> DataFrame:
    quiet = read(spark, d, "entities").join(read(spark, d, "mentions"), "entity_id", "left_anti").select("entity_id")
    return quiet.intersect(read(spark, d, "edges").select(F.col("target_id").alias("entity_id")))


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
