"""Queries of citations, evaluation, the other collections' first phase, gates and ids, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions import replies, urls
from loomsearch.operators import analytics, ranking, text
from loomsearch.plans.catalog import ASKED, LOG, PAGE, WORDS, asked, bm25_sql, log_once, page_text, query
from loomsearch.plans.runtime import read, stage

ANSWERED = f"SELECT DISTINCT doc_id::varchar AS query_id, unnest({WORDS.format('text')}) AS term FROM documents WHERE source = 'answer' AND doc_id % 20 = 0 AND text IS NOT NULL"
RESOLVED = rf"""
    {bm25_sql(ANSWERED, f"SELECT doc_id AS id, 0 AS f, {WORDS.format(PAGE)} AS w FROM web_document")},
    top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s QUALIFY rank <= 5),
    a AS (SELECT doc_id::varchar AS query_id, text, (SELECT count(*) FROM top WHERE top.query_id = doc_id::varchar) AS n FROM documents WHERE source = 'answer' AND doc_id % 20 = 0 AND text IS NOT NULL),
    m AS (SELECT *, string_split_regex(text, '\[([0-9]+(?:\s*,\s*[0-9]+)*)\]') AS p, list_transform(regexp_extract_all(text, '\[([0-9]+(?:\s*,\s*[0-9]+)*)\]', 1), lambda g: list_transform(string_split(g, ','), lambda x: try_cast(trim(x) AS int))) AS g FROM a),
    k AS (SELECT *, list_transform(g, lambda y: list_filter(y, lambda x: x >= 1 AND x <= n)) AS k FROM m),
    v AS (SELECT query_id, regexp_replace(regexp_replace(array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(k) AND len(k[i]) > 0 THEN '[' || array_to_string(k[i], ',') || ']' ELSE '' END), ''), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text,
      list_sort(list_distinct(flatten(k))) AS cited, list_distinct(flatten(g)) AS named, n FROM k)"""


def answered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Answers whose id is divisible by 20 and the five pages that each is matched with."""
    a = read(spark, d, "documents").where("source = 'answer' and doc_id % 20 = 0 and text is not null").select(F.col("doc_id").cast("string").alias("query_id"), "text")
    terms = a.select("query_id", F.explode(text.words("text")).alias("term"))
    return a, stage(text.best_lexical(read(spark, d, "web_document"), terms, "doc_id", [page_text()], 5).select("query_id", F.col("id").alias("doc_id"), "rank"))


@query(f"WITH {RESOLVED} SELECT query_id, sha256(text) AS text_hash, length(text) AS chars, array_to_string(cited, ',') AS cited, len(named) AS named FROM v")
def cited_answers(spark: SparkSession, d: str) -> DataFrame:
    out = replies.resolve(*answered(spark, d), "query_id", "text")
    return out.select("query_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("chars"), F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), F.size("named").cast("long").alias("named"))


@query(f"WITH {RESOLVED} SELECT query_id, id AS doc_id, rank, coalesce(list_contains(cited, rank::int), false) AS cited FROM top JOIN v USING (query_id)")
def cited_pages(spark: SparkSession, d: str) -> DataFrame:
    a, results = answered(spark, d)
    marks = replies.resolve(a, results, "query_id", "text").select("query_id", F.col("cited").alias("places"))
    return results.join(marks, "query_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.array_contains("places", F.col("rank")).alias("cited"))


@query(rf"""
    WITH {RESOLVED}, h AS (SELECT query_id, string_agg({PAGE}, ' ' ORDER BY rank) AS hay, max(CASE WHEN rank = 1 THEN title END) AS title FROM top JOIN web_document w ON w.doc_id = top.id GROUP BY 1),
    x AS (SELECT query_id, text, cited, named, hay, list_distinct(regexp_extract_all(text, ' ([A-Z][a-z][a-z][a-z]+)', 1)) AS wanted, list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda w: len(w) >= 5)) AS said FROM v LEFT JOIN h USING (query_id))
    SELECT query_id, CASE WHEN text <> '' THEN CASE WHEN len(named) > 0 THEN round(len(cited)::double / len(named), 6) ELSE 0 END END AS integrity,
      CASE WHEN len(wanted) > 0 THEN round(len(list_filter(wanted, lambda n: contains(lower(coalesce(hay, '')), lower(n))))::double / len(wanted), 6) END AS recall,
      CASE WHEN len(said) > 0 THEN round(len(list_filter(said, lambda n: contains(lower(text), lower(n))))::double / len(said), 6) END AS coverage FROM x""")
def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Names of an answer that its pages hold, words of the first page's title that the answer says, citations that resolve."""
    a, results = answered(spark, d)
    pages = results.join(read(spark, d, "web_document").select("doc_id", "title", page_text().alias("page")), "doc_id")
    hay = pages.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"]), " ").alias("hay"), F.max(F.when(F.col("rank") == 1, F.col("title"))).alias("title"))
    x = replies.resolve(a, results, "query_id", "text").join(hay, "query_id", "left")
    wanted = F.array_distinct(F.regexp_extract_all("text", F.lit(" ([A-Z][a-z][a-z][a-z]+)"), F.lit(1)))
    said = F.array_distinct(F.filter(text.words(F.coalesce("title", F.lit(""))), lambda w: F.length(w) >= 5))
    return x.select("query_id", F.round(analytics.integrity(F.col("text"), F.col("named"), F.col("cited")), 6).alias("integrity"), F.round(analytics.share_held(wanted, F.col("hay")), 6).alias("recall"), F.round(analytics.share_held(said, F.col("text")), 6).alias("coverage"))


@query(f"""
    WITH {LOG}, c AS (SELECT normalized_query, intent, count(*) AS n FROM l WHERE intent IS NOT NULL GROUP BY 1, 2), t AS (SELECT normalized_query, intent FROM c QUALIFY n = max(n) OVER (PARTITION BY normalized_query)),
    e AS (SELECT normalized_query, 2 * count(*) FILTER (WHERE coalesce(len(result_domains), 0) = 0) > count(*) AS expected FROM l GROUP BY 1),
    r AS (SELECT l.served_from, CASE WHEN l.normalized_query IN (SELECT normalized_query FROM t) THEN (EXISTS (SELECT 1 FROM t WHERE t.normalized_query = l.normalized_query AND t.intent = l.intent))::int END AS a, ((coalesce(len(result_domains), 0) = 0) = expected)::int AS h FROM l JOIN e USING (normalized_query))
    SELECT coalesce(served_from, 'none') AS served_from, count(a) AS labelled, round(avg(a), 6) AS intent_accuracy, round(avg(h), 6) AS empty_handled FROM r GROUP BY 1""")
def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the log with itself: a query's commonest intents, and whether most of its lists are empty, are its labels."""
    log = log_once(spark, d).where("normalized_query is not null")
    votes = log.where("intent is not null").groupBy("normalized_query", "intent").agg(F.count("*").alias("n"))
    most = votes.withColumn("most", F.max("n").over(Window.partitionBy("normalized_query"))).where("n = most").groupBy("normalized_query").agg(F.collect_list("intent").alias("accepted"))
    expected = log.groupBy("normalized_query").agg((2 * F.count_if(F.coalesce(F.size("result_domains"), F.lit(0)) <= 0) > F.count("*")).alias("expected"))
    rows = log.join(expected, "normalized_query").join(most, "normalized_query", "left")
    scored = rows.select(F.coalesce("served_from", F.lit("none")).alias("served_from"), analytics.accuracy(F.col("intent"), F.col("accepted")).alias("a"),
                         analytics.empty_handled(F.greatest(F.size("result_domains"), F.lit(0)), F.lit(None).cast("string"), F.col("expected")).alias("h"))
    return scored.groupBy("served_from").agg(F.count("a").alias("labelled"), F.round(F.avg("a"), 6).alias("intent_accuracy"), F.round(F.avg("h"), 6).alias("empty_handled"))


@query(r"""
    WITH b AS (SELECT doc_id, domain, coalesce(chunks[1], description, '') AS said, substr(array_to_string(list_filter([title, chunks[1], chunks[2], chunks[3], description], lambda p: p IS NOT NULL AND p <> ''), chr(10)), 1, 1500) AS body FROM web_document)
    SELECT doc_id, sha256('<source n="1" domain="' || coalesce(domain, '') || '">' || chr(10) || body || chr(10) || '</source>') AS block, sha256(CASE WHEN said <> '' THEN substr(said, 1, 400) || ' [1]' ELSE '' END) AS answer FROM b""")
def source_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A page as a fenced source, and the answer quoted from it where no model is at hand."""
    passage = [F.get("chunks", F.lit(n)) for n in range(3)]
    block = replies.source_block(F.lit(1), F.col("domain"), [F.col("title"), *passage, F.col("description")])
    return read(spark, d, "web_document").select("doc_id", F.sha2(block, 256).alias("block"), F.sha2(replies.extractive(passage[0], F.col("description")), 256).alias("answer"))


def first_phase(spark: SparkSession, d: str, docs: DataFrame, id_col: str, fields: list, static, k: int) -> DataFrame:
    best = text.best_lexical(docs, asked(spark, d), id_col, fields, k, static)
    return best.select("query_id", "id", "rank", F.round("score", 4).alias("total"))


@query(f"""
    WITH {bm25_sql(ASKED, f"SELECT id, f, {WORDS.format('t')} AS w FROM (SELECT entity_id AS id, unnest(range(3)) AS f, unnest([coalesce(name, ''), coalesce(array_to_string(aliases, ' '), ''), coalesce(description, '')]) AS t FROM entities)")},
    z AS (SELECT query_id, id, score / (score + 12) + coalesce(popularity, 0)::double + coalesce(graph_importance, 0)::double AS total FROM s JOIN entities ON entity_id = id)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, id) AS rank, round(total, 4) AS total FROM z QUALIFY rank <= 3""")
def entity_first_phase(spark: SparkSession, d: str) -> DataFrame:
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    return first_phase(spark, d, read(spark, d, "entities"), "entity_id", [F.col("name"), F.array_join("aliases", " "), F.col("description")], c("popularity") + c("graph_importance"), 3)


@query(f"""
    WITH {LOG}, k AS (SELECT normalized_query AS id, count(*) AS frequency FROM l WHERE normalized_query IS NOT NULL GROUP BY 1), {bm25_sql(ASKED, f"SELECT id, 0 AS f, {WORDS.format('id')} AS w FROM k")},
    z AS (SELECT query_id, id, score / (score + 12) + least(1.0::double, ln(1 + frequency::double) / 10) AS total FROM s JOIN k USING (id))
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, id) AS rank, round(total, 4) AS total FROM z QUALIFY rank <= 2""")
def memory_first_phase(spark: SparkSession, d: str) -> DataFrame:
    memory = analytics.demand(log_once(spark, d), "normalized_query", "id")
    return first_phase(spark, d, memory, "id", [F.col("id")], F.col("demand"), 2)


MANIFESTS = """o AS (SELECT doc_id, json_extract_string(text, '$.title') AS title, json_extract_string(text, '$.provider') AS provider, json_extract_string(text, '$.description') AS description FROM documents WHERE source = 'capability' AND json_valid(text) AND json_type(text) = 'OBJECT'),
    k AS (SELECT min(doc_id) AS id, title, provider, max(description) AS description FROM o WHERE title IS NOT NULL AND provider IS NOT NULL GROUP BY title, provider)"""


@query(f"""
    WITH {MANIFESTS}, {bm25_sql(ASKED, f"SELECT id, 0 AS f, {WORDS.format('concat_ws(' + repr(' ') + ', title, provider, description)')} AS w FROM k")},
    z AS (SELECT query_id, id, score / (score + 12) + 0.5::double AS total FROM s)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, id) AS rank, round(total, 4) AS total FROM z QUALIFY rank <= 5""")
def capability_first_phase(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities, one for each title and provider."""
    v = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<struct<title:string,provider:string,description:string>>")
    o = read(spark, d, "documents").where("source = 'capability'").select("doc_id", v.alias("v")).where("size(v) = 1").select("doc_id", F.get("v", F.lit(0)).alias("m")).select("doc_id", "m.*")
    once = o.where("title is not null and provider is not null").groupBy("title", "provider").agg(F.min("doc_id").alias("id"), F.max("description").alias("description"))
    return first_phase(spark, d, once, "id", [F.concat_ws(" ", "title", "provider", "description")], F.lit(0.5), 5)


@query(f"""
    WITH {LOG} SELECT id, coalesce(intent, 'none') AS intent, CASE WHEN intent IN ('action', 'utility') THEN 0.7::double ELSE 1 END AS document, CASE WHEN intent IN ('action', 'utility') THEN 2.5::double WHEN intent IN ('shopping', 'travel') THEN 1.4::double ELSE 0.8::double END AS capability,
      length(trim(normalized_query)) BETWEEN 1 AND 400 AS asked, len(string_split_regex(trim(normalized_query), '\\s+')) <= 6 AND coalesce(intent, '') <> 'navigation' AS expand FROM l WHERE normalized_query IS NOT NULL""")
def query_gates(spark: SparkSession, d: str) -> DataFrame:
    """What a request's form and intent allow: whether it is one, whether it is expanded, and the boost of each collection."""
    log, i, q = log_once(spark, d).where("normalized_query is not null"), F.col("intent"), F.trim("normalized_query")
    expand = (F.size(F.split(q, r"\s+")) <= 6) & (F.coalesce(i, F.lit("")) != "navigation")
    return log.select("id", F.coalesce(i, F.lit("none")).alias("intent"), ranking.intent_boost(i, "document").alias("document"), ranking.intent_boost(i, "capability").alias("capability"), F.length(q).between(1, 400).alias("asked"), expand.alias("expand"))


@query(r"""
    SELECT entity_id, sha256(node_type || '|' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))) AS stable_id, trim(regexp_replace(lower(nfc_normalize(name)), '\s+', ' ', 'g')) AS name_key FROM entities WHERE name IS NOT NULL AND node_type IS NOT NULL""")
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "entities").where("name is not null and node_type is not null")
    return e.select("entity_id", F.sha2(F.concat("node_type", F.lit("|"), F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))), 256).alias("stable_id"), F.trim(F.regexp_replace(F.lower("name"), r"\s+", " ")).alias("name_key"))


@query("""
    SELECT domain, abs(((list_reduce(list_prepend(0::BIGINT, list_transform(string_split(domain, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) + 2147483648) % 4294967296) - 2147483648) % 360 AS hue FROM sites WHERE domain <> ''""")
def site_hues(spark: SparkSession, d: str) -> DataFrame:
    """The hue of a site: a 32-bit rolling hash of its name on the circle of colours."""
    wrap = 1 << 32
    h = F.aggregate(F.split("domain", ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise(F.pmod(h * 31 + F.ascii(c), F.lit(wrap))))
    signed = F.when(h >= wrap // 2, h - wrap).otherwise(h)
    return read(spark, d, "sites").where("domain <> ''").select("domain", (F.abs(signed) % 360).alias("hue"))


@query("""
    WITH h AS (SELECT domain, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS host FROM web_document WHERE url IS NOT NULL), c AS (SELECT nullif(host, '') AS host, domain FROM h)
    SELECT host, count(*) AS pages, count(DISTINCT domain) AS domains FROM c WHERE host IS NOT NULL GROUP BY host""")
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    hosts = read(spark, d, "web_document").select(urls.host(F.col("url")).alias("host"), "domain").where("host is not null")
    return hosts.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("domain").alias("domains"))
