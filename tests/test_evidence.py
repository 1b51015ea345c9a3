"""Lexical search where documents are, hybrid candidates, citations and evaluation: small and edge cases."""

import pytest
from pyspark.sql import functions as F

from loomsearch.functions import replies
from loomsearch.operators import analytics, ranking, text

DOCS = [(n, f"alpha {'beta ' * (n % 4)}w{n % 7}", "gamma alpha" if n % 3 else None, n / 100) for n in range(60)] + [(100, "", "", None), (101, None, None, 0.5), (102, "beta beta", "beta", None)]
QUERIES = [("a", "alpha"), ("a", "beta"), ("b", "w3"), ("c", "nowhere"), ("d", "gamma"), ("d", "gamma"), (None, "alpha"), ("e", None)]


@pytest.mark.parametrize("with_static", [False, True])
def test_best_lexical_is_the_join(spark, with_static):
    docs = spark.createDataFrame(DOCS, "doc_id int, t string, u string, s double").withColumn("id", F.lit("x")).withColumn("score", F.lit(0)).repartition(3)
    q = spark.createDataFrame(QUERIES, "query_id string, term string")
    static = F.col("s") if with_static else None
    run = lambda most: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in text.best_lexical(docs, q, "doc_id", [F.col("t"), F.col("u")], 5, static, most).collect())
    here, joined = run(1000), run(0)
    assert here == joined and {r[0] for r in here} == {"a", "b", "d"} and len(here) == 15
    assert text.best_lexical(docs.limit(0), q, "doc_id", [F.col("t")], 5).count() == 0
    assert text.best_lexical(docs, q.limit(0), "doc_id", [F.col("t")], 5).count() == 0


def test_fields_are_summed(spark):
    df = spark.createDataFrame([(1, "x y", "x"), (2, "x", None), (3, "z", "x x")], "id int, a string, b string")
    q = spark.createDataFrame([("q", "x")], "query_id string, term string")
    one = lambda c: {r.id: r.score for r in text.bm25(df, q, "id", F.col(c)).collect()}
    a, b = one("a"), one("b")
    both = {r.id: r.score for r in text.bm25(df, q, "id", [F.col("a"), F.col("b")]).collect()}
    assert both == pytest.approx({n: a.get(n, 0) + b.get(n, 0) for n in (1, 2, 3)})


def test_hybrid_takes_either_side(spark):
    lexical = spark.createDataFrame([("q", 1, 12.0), ("q", 2, 4.0)], "query_id string, id int, score double")
    near = spark.createDataFrame([("q", 2, 0.9), ("q", 3, 0.5), ("r", 9, 0.9)], "query_id string, id int, closeness double")
    static = spark.createDataFrame([(n, 0.1) for n in (1, 2, 3)], "id int, static double")
    got = {r.id: r.total for r in ranking.hybrid(lexical, near, static).collect()}
    assert got == pytest.approx({1: 0.6, 2: 0.25 + 0.9 + 0.1, 3: 0.6})


def test_citations_resolve(spark):
    said = [("a", "One [1].  Two [9] and [2, 7,1] [99999999999]."), ("b", None), ("c", ""), ("d", "[1] only"), ("e", "plain [x] [1.5]")]
    answers = spark.createDataFrame(said, "k string, t string").withColumn("text", F.lit(1)).withColumn("rank", F.lit(1))
    results = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("z", 1)], "k string, rank int")
    got = {r.k: (r.text, r.cited, r.named) for r in replies.resolve(answers, results, "k", "t").collect()}
    assert got["a"] == ("One [1]. Two and [2,1] .", [1, 2], [1, 9, 2, 7, None])
    assert got["c"] == ("", [], []) and got["d"] == ("only", [], [1]) and got["e"] == ("plain [x] [1.5]", [], []) and "b" not in got


def test_metrics(spark):
    rows = [(["Redis", "Go"], "about REDIS only", "x", [1, 2], [1], "news", ["news", "event"], 0, True), ([], "x", "", [], [], None, ["news"], 3, True), (None, None, "x", [], [], "a", None, 0, None), (["a"], None, None, [], [], "b", ["c"], 2, False)]
    df = spark.createDataFrame(rows, "needles array<string>, hay string, answer string, named array<int>, cited array<int>, intent string, accepted array<string>, n int, expected boolean")
    c = F.col
    got = [tuple(r) for r in df.select(analytics.share_held(c("needles"), c("hay")), analytics.integrity(c("answer"), c("named"), c("cited")), analytics.accuracy(c("intent"), c("accepted")), analytics.empty_handled(c("n"), c("answer"), c("expected"))).collect()]
    assert got == [(0.5, 0.5, 1, 1), (None, None, 0, 1), (None, 0.0, None, None), (0.0, None, 0, 1)]
    said = spark.range(1).select(replies.extractive(F.lit(None).cast("string"), F.lit("s")), replies.extractive(F.lit(None).cast("string"), F.lit("")), replies.source_block(F.lit(2), F.lit(None).cast("string"), [F.lit("t"), F.lit(""), F.lit("x" * 2000)])).first()
    assert said[0] == "s [1]" and said[1] == "" and said[2].startswith('<source n="2" domain="">\nt\nxxx') and len(said[2].split("\n")[2]) == 1498
