"""Ranking expressions, vector search, fusion and reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400
#: Days in which a page's freshness halves, by intent; others take a year.
HALF_LIFE_DAYS = {
    "news": 2, "sports": 7, "finance": 7, "event": 90, "shopping": 90, "travel": 90, "local": 90,
    "documentation": 1095, "coding": 1095, "education": 1095, "research": 1095,
}


def saturate(x: Column) -> Column:
    """A raw lexical score on 0..1."""
    return x / (x + 12)


def half_life(intent: Column) -> Column:
    """Seconds in which freshness halves for an intent."""
    out = F.when(F.lit(False), F.lit(0))
    for name, days in HALF_LIFE_DAYS.items():
        out = out.when(intent == name, days * DAY)
    return out.otherwise(365 * DAY)


def intent_boost(intent: Column, kind: str) -> Column:
    """How much an intent favours a collection, ``document`` or ``capability``; fixed values."""
    doing = F.coalesce(intent.isin("action", "utility"), F.lit(False))
    if kind == "document":
        return F.when(doing, 0.7).otherwise(1.0)
    return F.when(doing, 2.5).when(intent.isin("shopping", "travel"), 1.4).otherwise(0.8)


def freshness(published: Column, as_of: int, life: Column) -> Column:
    """Half-life decay of a page's age; 0.5 where the time is unknown (null, 0 or negative)."""
    age = F.greatest(F.lit(as_of) - published, F.lit(0))
    return F.when(F.coalesce(published, F.lit(0)) <= 0, 0.5).otherwise(F.pow(F.lit(0.5), age / life))


def closeness(cosine: Column) -> Column:
    """1 / (1 + angle) of two unit vectors."""
    return 1 / (1 + F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 512) -> DataFrame:
    """(query_id, id, closeness, rank): exact k nearest vectors of a stated set of queries.

    Queries go to all rows in blocks of about ``block_rows``: each row meets each block once,
    the best k of each of 64 parts of the rows are kept for a query, and only these are
    ranked together. Vectors that are null give nothing.
    """
    q = queries.where("vector is not null").select("query_id", F.col("vector").alias("q"))
    blocks = max(1, -(-q.count() // block_rows))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    blocked = q.groupBy("block").agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    v = vectors.where("vector is not null").select("id", F.col("vector").alias("v")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    pairs = v.join(blocked, "block").select("id", "v", F.explode("qs").alias("x")).select(F.col("x.query_id").alias("query_id"), "id", closeness(dot(F.col("x.q"), F.col("v"))).alias("closeness"))
    part = Window.partitionBy("query_id", "slot").orderBy(F.round("closeness", 6).desc(), "id")
    best = pairs.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(part)).where(F.col("n") <= k).drop("n", "slot")
    w = Window.partitionBy("query_id").orderBy(F.round("closeness", 6).desc(), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(lexical: DataFrame, near: DataFrame, static: DataFrame) -> DataFrame:
    """(query_id, id, lexical, semantic, total): candidates that words or vectors find, each scored by both and by itself.

    ``lexical`` holds raw scores, ``near`` closeness, ``static`` one score a document. A side that
    did not find a document counts 0; documents without a static score are no candidates.
    """
    both = lexical.select("query_id", "id", saturate(F.col("score")).alias("lexical")).join(near.select("query_id", "id", F.col("closeness").alias("semantic")), ["query_id", "id"], "full_outer")
    given = both.select("query_id", "id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lexical", "semantic")]).join(static, "id")
    return given.select("query_id", "id", "lexical", "semantic", (F.col("lexical") + F.col("semantic") + F.col("static")).alias("total"))


def fuse(lists: DataFrame, keys: list[str], item: str, k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists.

    ``lists`` holds ``keys``, ``list_id``, the item, its 1-based ``rank`` and a ``weight``. An
    item given twice in one list counts at its better rank. Out: score, in how many lists the
    item is (``agreement``) and its best rank.
    """
    once = lists.groupBy(*keys, "list_id", item).agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    return once.groupBy(*keys, item).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.count("*").alias("agreement"), F.min("rank").alias("best_rank"))


def base_score(pos: Column) -> Column:
    """Score of a result by its place in its list: 1, 0.95, 0.9 and so on, not below 0."""
    return F.greatest(F.lit(0.0), 1 - 0.05 * (pos - 1))


def best_of(rows: DataFrame, keys: list[str], order: list[Column], k: int, parts: int = 64) -> DataFrame:
    """The k first rows of each key by ``order``, ranked: first within each of ``parts`` parts of a key, then among these.

    A key that holds a third of all rows is thus sorted in parts, and only k rows of each meet.
    """
    slot = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(parts))
    first = rows.withColumn("_slot", slot).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order))).where(F.col("_n") <= k)
    return first.drop("_slot", "_n").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def index_confidence(n: Column, top_lexical: Column, top_semantic: Column) -> Column:
    """How far an index's own results can be trusted: the better of its two best scores, damped where fewer than six came."""
    depth = F.least(F.lit(1.0), n / 6)
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(top_lexical, top_semantic)) * (0.5 + 0.5 * depth)).otherwise(0.0)


def merge(index: DataFrame, external: DataFrame, trust: DataFrame, key: str, item: str, least: float = 0.75) -> DataFrame:
    """(key, place, item, origin): the index's results and those from outside it as one list.

    ``index`` and ``external`` hold key, item and ``rank``, ``trust`` holds key and ``confidence``. Outside
    results that the index has too stay out. Where confidence reaches ``least`` the index
    goes first, else the outside; keys without confidence count as 0.
    """
    outside = external.join(index.select(key, item), [key, item], "left_anti").select(key, item, "rank", F.lit("external").alias("origin"))
    both = index.select(key, item, "rank", F.lit("index").alias("origin")).union(outside).join(trust.select(key, "confidence"), key, "left")
    trusted = F.coalesce(F.col("confidence"), F.lit(0.0)) >= least
    bucket = F.when(trusted == (F.col("origin") == "index"), 0).otherwise(1)
    return both.select(key, item, "origin", F.row_number().over(Window.partitionBy(key).orderBy(bucket, "rank", item)).alias("place"))


#: What a page on an official host gains by its path's depth, and what general sites lose.
HOMEPAGE_BOOST = (1.0, 0.6, 0.3, 0.1)
GENERAL_SITES = {"wikipedia.org": 0.15, "github.com": 0.10, "reddit.com": 0.10, "stackoverflow.com": 0.05, "medium.com": 0.05, "quora.com": 0.05}


def on_host(domain: Column, official: Column) -> Column:
    """The domain is the official one or below it, ``www.`` aside; names that merely end alike are not."""
    d, o = (F.regexp_replace(F.lower(c), r"^www\.", "") for c in (domain, official))
    return F.coalesce((d == o) | d.endswith(F.concat(F.lit("."), o)), F.lit(False))


def official_score(pos: Column, domain: Column, path: Column, official: Column) -> Column:
    """Score of a result where the query's official host is known: its pages first, by how near they are to its front page."""
    base = base_score(pos)
    depth = F.least(F.size(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")), F.lit(len(HOMEPAGE_BOOST) - 1))
    home = F.element_at(F.array(*map(F.lit, HOMEPAGE_BOOST)), depth + 1)
    loss = F.lit(0.0)
    for site, x in GENERAL_SITES.items():
        loss = F.when(on_host(domain, F.lit(site)), x).otherwise(loss)
    return F.when(on_host(domain, official), 2 + home + 0.05 * base).otherwise(base - loss)
