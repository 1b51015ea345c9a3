"""Streams over files against the batch operators."""

import datetime as dt

from pyspark.sql import functions as F

from loomsearch.streaming import ops

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "id long, normalized_query string, intent string, occurred_at timestamp, served_from string"


def write(spark, path):
    rows = [(n, f"q{n % 3}" if n else None, "news" if n % 2 else None, T0 + dt.timedelta(minutes=n), "external" if n % 4 == 1 else "index") for n in range(40)]
    spark.createDataFrame(rows + rows[:5], SCHEMA).repartition(4).write.parquet(path)


def test_memory_and_sink(spark, tmp_path):
    src = str(tmp_path / "log")
    write(spark, src)
    schema = spark.read.parquet(src).schema
    q = ops.memory_sink(ops.log_stream(spark, src, schema, files_per_batch=1), str(tmp_path / "mem"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    got = {r[0]: r[1] for r in ops.memory(spark, str(tmp_path / "mem")).collect()}
    want = {r[0]: r[1] for r in spark.read.parquet(src).where("normalized_query is not null").groupBy("normalized_query").count().collect()}
    assert got == want
    ops.compact(spark, str(tmp_path / "mem"))
    assert {r[0]: r[1] for r in ops.memory(spark, str(tmp_path / "mem")).collect()} == want
    spark.createDataFrame([("q1", 5, T0)], "normalized_query string, frequency long, last_seen_at timestamp").write.parquet(str(tmp_path / "mem" / "delta" / "batch=99"))
    assert {r[0]: r[1] for r in ops.memory(spark, str(tmp_path / "mem")).collect()} == want | {"q1": want["q1"] + 5}
    assert ops.memory(spark, str(tmp_path / "none")).count() == 0
    ops.event_sink(ops.log_stream(spark, src, schema), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 45


def test_coverage_and_sessions(spark, tmp_path):
    src = str(tmp_path / "log")
    write(spark, src)
    log = ops.log_stream(spark, src, spark.read.parquet(src).schema)
    q = ops.coverage_stream(log).writeStream.format("memory").queryName("cov").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["intent"], r["searches"], r["from_external"]) for r in spark.table("cov").collect()] == [("news", 20, 10)]
    s = ops.session_stream(log.withColumn("u", F.col("id") % 2), "u", "occurred_at")
    q = s.writeStream.format("memory").queryName("ses").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("ses").collect()) == [22, 23]
