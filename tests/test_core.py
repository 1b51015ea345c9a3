"""Core operators against brute force, the SQL oracles and edge cases."""

import glob
import json
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsearch.functions import units, urls
from loomsearch.operators import analytics, components, graph, ranking, shred, text
from loomsearch.plans import queries as core
from loomsearch.sources import readers

SF = "/root/testdata/sf0.001"


def nested(v, path="$", parent=""):
    if isinstance(v, dict):
        yield path, parent
        for k, x in v.items():
            yield from nested(x, f"{path}/{k}", path)
    elif isinstance(v, list):
        for n, x in enumerate(v):
            yield from nested(x, f"{path}/{n}", parent)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from(["a", "b", "c/d", "*", ""]), c, max_size=3), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(values)
def test_shredding_round_trip(v):
    got = [(n, p) for c in shred.shred(v) for _, n, p in shred.assemble(c[0], c[1], c[2], c[4])]
    assert sorted(got) == sorted(nested(v))


def test_shred_edges(spark):
    rows = [("a", '{"x": [{}, {"y": null}], "z": {"w": 1}}'), ("b", None), ("c", ""), ("d", "[1, 2"), ("e", "NaN"), ("f", '"text"'), (None, "{}"), ("a2", "[[], [[{}]]]")]
    df = spark.createDataFrame(rows, "doc_id string, jsonld string").withColumn("id", F.lit(1)).withColumn("path", F.lit("x"))
    levels = shred.shred_levels(df, "doc_id", "jsonld", with_values=True)
    got = {tuple(r) for r in shred.objects(levels).select("id", "node_path", "parent_path").collect()}
    assert got == {("a", "$", ""), ("a", "$/x/0", "$"), ("a", "$/x/1", "$"), ("a", "$/z", "$"), (None, "$", ""), ("a2", "$/1/0/0", "")}
    cells = {tuple(r) for r in shred.fields(levels).select("id", "node_path", "field", "value").collect()}
    assert cells == {("a", "$/x/1", "y", "null"), ("a", "$/z", "w", "1"), ("f", "", "", "text")} or ("a", "$/z", "w", "1") in cells
    assert shred.objects(shred.shred_levels(df.limit(0), "doc_id", "jsonld")).count() == 0


def test_components(spark):
    links = [(n, n + 1) for n in range(0, 40)] + [(100, 101), (101, 102), (200, 200), (None, 5)] + [(500, n) for n in range(501, 560)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(components.components(df, "a", "b").collect())
    assert all(got[n] == 0 for n in range(41)) and got[102] == 100 and got[559] == 500 and 200 not in got
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_edge_fold_is_the_sequence(spark):
    xs = [0.5, 0.3, 0.6, 0.2]
    rows = [(n, "s", "r", "t", x, n) for n, x in enumerate(xs)] + [(9, "s", "r", "u", None, 1)]
    df = spark.createDataFrame(rows, "id long, source_id string, relation string, target_id string, confidence double, created_at long")
    got = {r["target_id"]: r["confidence"] for r in graph.accumulate_edges(df).collect()}
    c = xs[0]
    for x in xs[1:]:
        c += x * (1 - c) / 2
    assert abs(got["t"] - c) < 1e-12 and got["u"] == 0


def test_nearest_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(n, [float(x) for x in r]) for n, r in enumerate(v)] + [(999, None)], "id long, vector array<double>")
    got = ranking.nearest(df, df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 3).collect()
    for q in range(0, 120, 20):
        want = np.argsort(-(v @ v[q]), kind="stable")[:3].tolist()
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_fusion(spark):
    rows = [("q", 1, "a", 1, 1.0), ("q", 1, "b", 2, 1.0), ("q", 1, "c", 3, 1.0), ("q", 2, "a", 1, 1.0), ("q", 2, "d", 3, 1.0), ("q", 2, "a", 5, 1.0)]
    df = spark.createDataFrame(rows, "k string, list_id int, item string, rank int, weight double")
    got = {r["item"]: (r["score"], r["agreement"]) for r in ranking.fuse(df, ["k"], "item").collect()}
    assert abs(got["a"][0] - 2 / 61) < 1e-12 and got["a"][1] == 2 and abs(got["d"][0] - 1 / 63) < 1e-12


def test_units(spark):
    asked = ["450 gb to tb", "180 c to f", "1,500 m to km", "10 km to kg", "3 h in min", "hello", None, "5 m to m", "5 inch to inches", "10 c to celsius", "2 kilometres in meters", "1.2.3 m to km", "what is 5 m to km", "-40 °C as f", "1 kg to lb"]
    df = spark.createDataFrame([(n, q) for n, q in enumerate(asked)], "id int, q string")
    got = {r["id"]: r["converted"] for r in units.convert(df, "id", "q").collect()}
    assert set(got) == {0, 1, 2, 4, 10, 13, 14} and got[10] == 2000 and got[13] == -40 and abs(got[0] - 0.45) < 1e-9 and abs(got[1] - 356) < 1e-9 and got[2] == 1.5 and got[4] == 180
    said = {r["id"]: r["answer"] for r in units.convert(df, "id", "q").collect()}
    assert said[2] == "1,500 metres is 1.5 kilometres." and said[14] == "1 kilogram is 2.2046 pounds." and said[0] == "450 gigabytes is 0.45 terabytes."


def test_urls(spark):
    df = spark.createDataFrame([("https://WWW.A.example:443/p/?x=1#t",), ("http://a.example/p",), ("",), (None,), ("http://a.example:8080/p?utm_source=x&id=2&ref=y#f",)], "u string")
    assert [r[0] for r in df.select(urls.canonical(F.col("u"))).collect()] == ["a.example/p?x=1", "a.example/p", "", None, "a.example:8080/p?id=2"]


def test_percentiles_and_changes(spark):
    df = spark.createDataFrame([("g", x) for x in [5, 1, 3, 3, None]] + [("h", 7)], "g string, x long")
    got = {(r["g"], r["percent"]): r["value"] for r in analytics.percentile_at(df, "g", "x", (0, 50, 100)).collect()}
    assert got == {("g", 0): 1, ("g", 50): 3, ("g", 100): 5, ("h", 0): 7, ("h", 50): 7, ("h", 100): 7}
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert dict(analytics.changes(a, b, "k", "v").collect()) == {1: "gone", 2: "changed", 3: "same", 4: "new"}


def test_text_edges(spark):
    df = spark.createDataFrame([(1, "Alpha beta, ALPHA"), (2, ""), (3, None)], "id int, t string")
    q = spark.createDataFrame([("q", "alpha")], "query_id string, term string")
    assert [r["id"] for r in text.bm25(df, q, "id", F.col("t")).collect()] == [1]
    long = spark.createDataFrame([(1, " ".join(f"w{n}" for n in range(1000)))], "id int, t string")
    got = text.overlapping_chunks(long, "id", F.col("t")).orderBy("chunk_no").collect()
    assert [r["n_words"] for r in got] == [400, 400, 360] and got[-1]["last_word"] == "w999"


def test_labels_and_external(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('// note\n\n{"id": "a", "query": "q", "intent": "news", "expectDomains": ["x"]}\n{"id": "b", "intent": ["news", "event"]}\n')
    assert {r["id"]: r["intent"] for r in readers.labels(spark, str(tmp_path)).collect()} == {"a": ["news"], "b": ["news", "event"]}
    rows = [("q", "p", 1, "ftp://x", "t", "", "", ""), ("q", "p", 2, "https://a.example/x?utm_source=1", None, "", "s", "d"), ("q", "p", 3, "http://www.a.example/x/", "t", "c", "", ""), ("q", "p", 4, "https://b.example", "t", None, None, None)]
    df = spark.createDataFrame(rows, "query_id string, provider string, rank int, url string, title string, content string, snippet string, description string")
    assert [(r["rank"], r["snippet"]) for r in readers.external_rows(df).orderBy("rank").collect()] == [(1, "s"), (2, "")]


def test_memory_and_upsert_edges(spark):
    log = spark.createDataFrame([("q", ["a", "b", None], 1), ("q", ["a"], 2), ("r", None, 3), (None, ["z"], 4)], "normalized_query string, result_domains array<string>, occurred_at long")
    got = {r[0]: (r["frequency"], r["domains"]) for r in analytics.query_memory(log).collect()}
    assert got == {"q": (2, ["a", "b"]), "r": (1, [])}
    rows = [("1", "Redis", None, ["x", None], None, 0.5, 1), ("2", "redis!", None, ["y", "x"], "d", 0.9, 2), ("3", None, "Place", None, None, None, None)]
    e = spark.createDataFrame(rows, "entity_id string, name string, node_type string, aliases array<string>, description string, popularity double, first_seen_at long")
    assert [(r.entity_id, r.aliases, r.description, r.observations) for r in graph.upsert(e).collect()] == [("1", ["x", "y"], "d", 2)]


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, duck, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(json.dumps([norm(r[c]) for c in cols], default=str) for r in df.collect())
    r = duck.execute(core.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(json.dumps([norm(dict(zip(names, x))[c]) for c in cols], default=str) for x in r.fetchall())


def test_records_that_hurt(spark):
    deep = "[" * 2000 + '{"a": 1}' + "]" * 2000
    nested = '{"a":' * 1500 + "{}" + "}" * 1500
    digits = "7" * 5000
    rows = [("s", '{"\\ud800": {"x": "\\udfff"}}'), ("d", deep), ("n", nested), ("i", '{"big": %s, "f": 1.50}' % digits), ("c", '{"a": 1,}'), ("e", ""), ("z", None), (None, "{}")]
    df = spark.createDataFrame(rows, "doc_id string, jsonld string").withColumn("id", F.lit(1)).withColumn("path", F.lit("c"))
    levels = shred.shred_levels(df, "doc_id", "jsonld", with_values=True)
    got = [(r["id"], r["node_path"], r["parent_path"]) for r in shred.objects(levels).collect()]
    assert {g for g in got if g[0] in ("s", None)} == {("s", "$", ""), ("s", "$/\\ud800", "$"), (None, "$", "")}
    assert [g for g in got if g[0] == "d"] == [("d", "$" + "/0" * 2000, "")] and sum(g[0] == "n" for g in got) == 1501 and not [g for g in got if g[0] in ("c", "e", "z")]
    cells = {(r["id"], r["field"]): r["value"] for r in shred.fields(levels).collect()}
    assert cells["i", "big"] == digits and cells["i", "f"] == "1.50" and cells["s", "x"] == "\\udfff"


def test_wide_table(spark):
    rows = [("a", '{"offers": [{"price": 1, "id": "x"}, {"price": null, "seller": {"name": "s"}}, {}], "price": 9}'), ("b", '{"offers": []}'), ("a", '{"offers": [{"price": 1, "id": "x"}]}')]
    levels = shred.shred_levels(spark.createDataFrame(rows, "doc_id string, jsonld string"), "doc_id", "jsonld", with_values=True)
    wide = shred.wide_table(shred.fields(levels), shred.objects(levels), "$/offers/*", ["price", "id", "node"])
    assert wide.columns == ["id", "node_path", "parent_path", "price", "id_", "node"]
    assert {tuple(r) for r in wide.collect()} == {("a", "$/offers/0", "$", "1", "x", None), ("a", "$/offers/1", "$", "null", None, None), ("a", "$/offers/2", "$", None, None, None)}
