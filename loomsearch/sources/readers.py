"""Readers of line formats, and rows that come from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomsearch.functions import urls

LABELS = T.StructType([T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("why", T.StringType()), T.StructField("intent", T.StringType())]
                      + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("expectDomains", "mustMention", "mustRetrieve")] + [T.StructField("expectEmpty", T.BooleanType())])


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation labels from lines of JSON; blank lines and ``//`` comments are dropped.

    ``intent`` may be a string or a list and always comes out as a list.
    """
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(//.*)?$"))
    row = lines.select(F.from_json("value", LABELS).alias("r")).select("r.*")
    listed = F.from_json("intent", "array<string>")
    return row.withColumn("intent", F.when(F.col("intent").startswith("["), listed).when(F.col("intent").isNotNull(), F.array("intent")))


def external_rows(rows: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, provider, rank, url, title, snippet): a provider's results made uniform.

    Rows without an http(s) URL go; of rows with one canonical URL the first stays; ranks are
    counted anew without gaps, up to ``most`` (a feature of the operator). The snippet is
    the first that is given of content, snippet and description.
    """
    keys = ["query_id", "provider"]
    usable = rows.where(F.lower("url").rlike("^https?://[^/]+")).withColumn("key", urls.canonical(F.col("url")))
    first = Window.partitionBy(*keys, "key").orderBy("rank", "url")
    once = usable.withColumn("n", F.row_number().over(first)).where("n = 1")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "url"))
    given = [F.nullif(c, F.lit("")) for c in ("content", "snippet", "description")]
    return once.select(*keys, place.alias("rank"), "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(*given, F.lit("")).alias("snippet")).where(F.col("rank") <= most)
