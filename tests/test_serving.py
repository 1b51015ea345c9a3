"""Understanding, merging, reordering, replies and reports: small cases and edge cases."""

import pytest
from pyspark.sql import functions as F

from loomsearch.functions import replies, understanding
from loomsearch.operators import analytics, ranking
from loomsearch.plans import serving


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_typed_hosts(spark):
    got = col(spark, ["redis.io", "https://Docs.Redis.io/a?b", "node.js", "redis io", " a.example ", "", None, "v1.2"], understanding.typed_host)
    assert got == ["redis.io", "docs.redis.io", None, None, "a.example", None, None, None]


def test_follow_up(spark):
    rows = [("how many died?", "Australian wildfire"), ("capital of France", "Australian wildfire"), ("is it large?", None), ("it spread across the burning Australian wildfire area today", "Australian wildfire"), (None, "x"), ("", "")]
    s = understanding.follow_up(F.col("t"), F.col("p"))
    got = [r[0] for r in spark.createDataFrame(rows, "t string, p string").select(s["follows"]).collect()]
    assert got == [True, False, False, True, False, False]
    rows = [("compare Redis with the longest other store", "Redis", ["Redis"], 60), ("compare Redis with the longest other store", "Redis", ["Redis"], 9999), ("applesauce made at home in winter", "apple", ["Apple"], 5), ("c++ for old and new hands", "x", ["C++", None, ""], 5), ("why?", "x", None, None)]
    s = understanding.follow_up(F.col("t"), F.col("p"), F.col("n"), F.col("s"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string, p string, n array<string>, s int").select(s["shared"], s["follows"]).collect()]
    assert got[:3] == [(1, True), (1, False), (0, False)] and got[4] == (0, False)
    assert col(spark, ["the fires of 2020 the fires", "", None], understanding.terms) == [["fires", "2020"], [], None]


def test_merge_and_confidence(spark):
    index = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "a", 1)], "k string, d string, rank int")
    outside = spark.createDataFrame([("q", "b", 1), ("q", "c", 2), ("r", "z", 1), ("s", "y", 1)], "k string, d string, rank int")
    trust = spark.createDataFrame([("q", 0.9), ("r", 0.1)], "k string, confidence double")
    got = sorted(tuple(r) for r in ranking.merge(index, outside, trust, "k", "d").select("k", "place", "d", "origin").collect())
    assert got == [("q", 1, "a", "index"), ("q", 2, "b", "index"), ("q", 3, "c", "external"), ("r", 1, "z", "external"), ("r", 2, "a", "index"), ("s", 1, "y", "external")]
    assert ranking.merge(index.limit(0), outside.limit(0), trust, "k", "d").count() == 0
    f = lambda n: ranking.index_confidence(n, F.lit(0.5), F.lit(0.8))
    assert col(spark, [0, 3, 6, 60], f, "int") == pytest.approx([0.0, 0.6, 0.8, 0.8])


def test_official_pages_lead(spark):
    rows = [(1, "en.wikipedia.org", "/wiki/Redis"), (2, "docs.redis.io", "/a/b"), (3, "notredis.io", "/"), (4, "WWW.redis.io", "/"), (5, None, None)]
    df = spark.createDataFrame(rows, "pos int, domain string, path string")
    got = [r[0] for r in df.orderBy(ranking.official_score(F.col("pos"), F.col("domain"), F.col("path"), F.lit("redis.io")).desc()).select("pos").collect()]
    assert got == [4, 2, 3, 1, 5]


def test_best_of_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") % 7).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id")]
    got = {(r.k, r.id, r["rank"]) for r in ranking.best_of(df, ["k"], order, 4).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append((-r.v, r.id))
    assert got == {(k, i, n) for k, g in groups.items() for n, (_, i) in enumerate(sorted(g)[:4], 1)}


REPLY = "ANSWER: One [1].\nTwo | more.\nSUGGESTIONS: a | b || c | d\nCOMPARE: Redis | Valkey\nROW: Speed | fast * | slow\nROW: Price | free | free"


def test_replies(spark):
    docs = spark.createDataFrame([(1, REPLY), (2, None), (3, ""), (4, "ANSWER:"), (5, "ANSWER: x"), (6, "COMPARE: A | B\nROW: only | one")], "id int, text string").withColumn("answer", F.lit(1))
    assert sorted(tuple(r) for r in replies.answers(docs, "id", "text").collect()) == [(1, "One [1].\nTwo | more.", ["a", "b", "c"]), (5, "x", [])]
    assert [tuple(r) for r in replies.comparisons(docs, "id", "text").collect()] == [(1, ["Redis", "Valkey"], [["Speed", "fast *", "slow"], ["Price", "free", "free"]], [0, -1])]


def test_extracted(spark):
    text = "note | x | 1\nENTITIES\nname | type | confidence\nRedis | Product | 0.9\nLondon | Place | nan?\nRedis | Product | 0.2\nBad | Sort | 0.5\n | Place | 1\n## Edges:\nredis | located_in | LONDON | -3\nRedis | x | Paris | 0.4\nRedis | x | redis | 0.4\nRedis | x | London"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "EDGES\nRedis | located_in | London | 0.5")], "id int, text string")
    entities, edges = replies.extracted(docs, "id", "text")
    assert sorted(tuple(r) for r in entities.collect()) == [(1, "London", "Place", 0.3), (1, "Redis", "Product", 0.6)]
    assert [tuple(r) for r in edges.collect()] == [(1, "redis", "located_in", "LONDON", 0.0)]


def test_repeats_within(spark):
    at = lambda h: f"2025-01-0{1 + h // 24} {h % 24:02d}:00:00"
    rows = [(1, "a", at(23)), (2, "a", at(25)), (3, "a", at(50)), (4, "b", at(1)), (5, "a", at(72)), (6, None, at(1)), (7, "b", None), (8, "b", at(1))]
    df = spark.createDataFrame(rows, "id int, q string, s string").select("id", "q", F.col("s").cast("timestamp").alias("t"))
    hits = analytics.repeats_within(df, "q", "t", "id")
    assert {r.id: r.hit for r in hits.collect()} == {1: False, 2: True, 3: False, 4: False, 5: True, 8: True}
    assert [tuple(r) for r in analytics.hit_rate(hits, "q").orderBy("q").collect()] == [("a", 2, 2, 0.5), ("b", 1, 1, 0.5)]


def test_metric_report(spark):
    df = spark.createDataFrame([("a", 0.5, None), ("b", 0.1, None), ("c", 0.1, None), ("d", None, None), ("e", 0.9, None)], "id string, m double, empty double")
    got = {r.metric: (r.n, r["mean"], r.worst) for r in analytics.metric_report(df, "id", ("m", "empty")).collect()}
    assert got["m"] == (4, pytest.approx(0.4), ["b", "c", "a"]) and got["empty"] == (0, None, None)


def test_hypotheses(spark):
    rows = [("q", "Redis", 1.0), ("q", "redis ", 0.8), ("q", "cache", 0.8), ("q", "", 0.9), ("q", None, 0.9), ("q", "x" * 201, 0.9), ("q", "store", 0.7), ("q", "db", 0.7), ("q", "kv", 0.7)]
    got = analytics.hypotheses(spark.createDataFrame(rows, "k string, text string, weight double"), "k").orderBy("place").collect()
    assert [(r.text, r.weight) for r in got] == [("Redis", 1.0), ("cache", 0.8), ("db", 0.7), ("kv", 0.7)]


def test_official_page_after_many_others(spark, tmp_path):
    pages = [(f"{e}{n:02d}", "redis.io" if (e, n) == ("a", 59) else "other.example", "/") for e in "ab" for n in range(60)]
    spark.createDataFrame(pages, "doc_id string, domain string, path string").write.parquet(f"{tmp_path}/web_document.parquet")
    spark.createDataFrame([(i[0], i, 1 - int(i[1:]) / 100) for i, _, _ in pages], "entity_id string, doc_id string, confidence double").write.parquet(f"{tmp_path}/mentions.parquet")
    spark.createDataFrame([("a", "redis.io"), ("b", "b.example"), ("c", None)], "entity_id string, official_domain string").write.parquet(f"{tmp_path}/entities.parquet")
    assert [tuple(r) for r in serving.missing_official(spark, str(tmp_path)).collect()] == [("b", "b.example", 60)]
    placed = serving.official_first(spark, str(tmp_path)).where("entity_id = 'a'").orderBy("place").collect()
    assert [r.doc_id for r in placed] == ["a59", *(f"a{n:02d}" for n in range(59))]
