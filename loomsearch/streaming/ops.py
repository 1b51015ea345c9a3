"""Streaming forms of the log operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def log_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """A growing folder of query-log files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def session_stream(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of events; rows later than the watermark are left out, null keys too."""
    timed = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(user, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(
        user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"
    )


def coverage_stream(log: DataFrame, ts: str = "occurred_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Searches per intent and window, each log row once: redelivered ids are dropped within the watermark."""
    once = log.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"])
    return once.where("intent is not null").groupBy(F.window(ts, window), "intent").agg(F.count("*").alias("searches"), F.count_if(F.col("served_from") == "external").alias("from_external")).select(
        F.col("window.start").alias("day"), "intent", "searches", "from_external"
    )


def memory_sink(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep query memory (frequency, last seen) as one small delta for each micro-batch.

    A batch writes only the queries it holds, folded; one that runs again after a failure
    writes the same delta. ``memory`` reads the whole, ``compact`` folds deltas into a base.
    """

    def fold(batch: DataFrame, number: int) -> None:
        new = batch.where("normalized_query is not null").groupBy("normalized_query").agg(F.count("*").alias("frequency"), F.max("occurred_at").alias("last_seen_at"))
        new.write.mode("overwrite").parquet(f"{path}/delta/batch={number}")

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing written yet
        return None


def memory(spark: SparkSession, path: str) -> DataFrame:
    """(normalized_query, frequency, last_seen_at): the newest base and the deltas after it, folded by query."""
    columns, base, delta = ["normalized_query", "frequency", "last_seen_at"], _parts(spark, f"{path}/base"), _parts(spark, f"{path}/delta")
    if base is not None:
        newest = base.agg(F.max("upto")).first()[0]
        base = base.where(F.col("upto") == newest).select(*columns)
        delta = delta.where(F.col("batch") > newest)
    if delta is None:
        return spark.createDataFrame([], "normalized_query string, frequency long, last_seen_at timestamp")
    rows = delta.select(*columns) if base is None else base.union(delta.select(*columns))
    return rows.groupBy("normalized_query").agg(F.sum("frequency").alias("frequency"), F.max("last_seen_at").alias("last_seen_at"))


def compact(spark: SparkSession, path: str) -> None:
    """Write a new base up to the last delta; older bases and deltas are no longer read and may be deleted.

    Run between batches, as by the job that starts the stream.
    """
    delta = _parts(spark, f"{path}/delta")
    if delta is not None:
        memory(spark, path).write.mode("overwrite").parquet(f"{path}/base/upto={delta.agg(F.max('batch')).first()[0]}")


def event_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of search events to a folder, exactly once through the checkpoint."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
