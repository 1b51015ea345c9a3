"""Query-log, ledger and session analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.operators.ranking import best_of


def once(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the first by ``order``, as an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    at = F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)])
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), at).alias("r")).select(key, "r.*")


def coverage(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per intent over the trailing days: volume, how it was served, distinct queries, last seen."""
    recent = log.where(F.col("intent").isNotNull() & (F.col("occurred_at") > F.expr(f"timestamp '{as_of}' - interval {days} days")))
    served = lambda s: F.count_if(F.col("served_from") == s)
    out = recent.groupBy("intent").agg(
        F.count("*").alias("searches"), served("index").alias("from_index"), served("external").alias("from_external"), served("mixed").alias("mixed"),
        F.count("served_from").alias("measured"), F.count_distinct("normalized_query").alias("distinct_queries"), F.max("occurred_at").alias("last_seen_at"),
    )
    share = F.round((F.col("from_external") + F.col("mixed")) / F.nullif("measured", F.lit(0)), 4)
    return out.withColumn("external_share", share).drop("measured")


def demand(log: DataFrame, column: str, name: str) -> DataFrame:
    """(name, searches, demand): how often a value (or element of an array) is asked, saturating to 1."""
    value = F.explode(column) if log.schema[column].dataType.typeName() == "array" else F.col(column)
    counts = log.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("searches"))
    return counts.withColumn("demand", F.least(F.lit(1.0), F.log(1.0 + F.col("searches")) / 10))


def query_memory(log: DataFrame) -> DataFrame:
    """One row for each normalised query: key, frequency, last seen and the domains it led to."""
    seen = log.where("normalized_query is not null")
    out = seen.groupBy("normalized_query").agg(F.count("*").alias("frequency"), F.max("occurred_at").alias("last_seen_at"))
    # Distinct pairs first: a query that holds a third of the log brings each of its domains once.
    pairs = seen.select("normalized_query", F.explode("result_domains").alias("domain")).where("domain is not null").distinct()
    domains = pairs.groupBy("normalized_query").agg(F.array_sort(F.collect_list("domain")).alias("domains"))
    out = out.join(domains, "normalized_query", "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))
    return out.withColumn("memory_id", F.substring(F.sha2("normalized_query", 256), 1, 24))


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """(user, session_start, session_end, n): sessions that end after a gap; the end is the last event's time plus the gap."""
    w = F.session_window(ts, gap)
    return events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(user, w).agg(F.count("*").alias("n")).select(
        user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"
    )


def windows_over(events: DataFrame, user: str, ts: str, seconds: int, most: int) -> DataFrame:
    """(user, window_start, n, over): requests by user and fixed window, and how many are over the limit."""
    w = F.window(ts, f"{seconds} seconds")
    counts = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(user, w).agg(F.count("*").alias("n"))
    return counts.select(user, F.col("window.start").alias("window_start"), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("over"))


def previous(events: DataFrame, user: str, ts: str, tie: str, value: str) -> DataFrame:
    """Each row with the user's previous value and the seconds since."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    return events.select(tie, user, value, F.lag(value).over(w).alias(f"previous_{value}"), gap.alias("seconds_since"))


def fetch_outcomes(ledger: DataFrame) -> DataFrame:
    """Per domain: fetches by outcome class of the ledger's distinct rows, and the last fetch."""
    rows = ledger.distinct()
    return rows.groupBy("domain").agg(
        F.count("*").alias("fetches"), F.count_if(F.col("http_status").between(200, 299)).alias("extracted"),
        F.count_if(F.col("http_status").isin(401, 403, 429)).alias("refused"), F.count_if(F.col("http_status") >= 500).alias("failed"),
        F.count_if(F.col("http_status").isNull()).alias("unknown"), F.max("fetched_at").alias("last_fetched_at"),
    )


def percentile_at(rows: DataFrame, group: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """(group, percent, value): the value at place min(n - 1, floor(p / 100 * n)) of the sorted group.

    Places are found by counting distinct values, which partial aggregation keeps small, so
    no group is collected.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    placed = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    asked = placed.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    place = F.least(F.col("n") - 1, F.floor(F.col("percent") / 100 * F.col("n")))
    return asked.where((place < F.col("upto")) & (place >= F.col("upto") - F.col("c"))).select(group, "percent", F.col(value).alias("value"))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): new, gone, changed or same, by a full outer join on the key."""
    a, b = before.select(key, F.col(value).alias("was")).withColumn("in_a", F.lit(True)), after.select(key, F.col(value).alias("now")).withColumn("in_b", F.lit(True))
    change = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "gone").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def repeats_within(log: DataFrame, key: str, ts: str, id_col: str, seconds: int = 86_400) -> DataFrame:
    """(id_col, key, hit): whether the same key came before, at most ``seconds`` earlier, so that a cache would hold it.

    The rows of a key are looked at by windows as long as the cache's time, each with the last
    time of the window before; a key that holds a tenth of the log is spread over its windows.
    Null keys and times are no request.
    """
    rows = log.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(id_col, key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    rows = rows.withColumn("bucket", F.floor(F.col("t") / (seconds * 1_000_000)))
    last = rows.groupBy(key, (F.col("bucket") + 1).alias("bucket")).agg(F.max("t").alias("before"))
    own = F.lag("t").over(Window.partitionBy(key, "bucket").orderBy("t", id_col))
    seen = rows.withColumn("own", own).join(last, [key, "bucket"], "left")
    return seen.select(id_col, key, F.coalesce(F.col("t") - F.coalesce("own", "before") <= seconds * 1_000_000, F.lit(False)).alias("hit"))


def hit_rate(hits: DataFrame, *by: str) -> DataFrame:
    """(by, hits, misses, rate): rate is null where nothing was asked."""
    out = hits.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return out.withColumn("rate", F.round(F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)), 6))


def metric_report(rows: DataFrame, id_col: str, metrics: tuple[str, ...], worst: int = 3) -> DataFrame:
    """(metric, n, mean, worst): mean of each metric over its non-null rows and its lowest rows' ids.

    The lowest rows are a top-k of each metric, so no metric's rows meet in one task.
    """
    means = rows.agg(*[F.struct(F.count(m).alias("n"), F.avg(m).alias("mean")).alias(m) for m in metrics])
    stats = means.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), f"{m}.n", f"{m}.mean") for m in metrics])).alias("s")).select("s.*")
    low = None
    for m in metrics:
        top = rows.where(F.col(m).isNotNull()).orderBy(F.round(m, 9), id_col).limit(worst).select(F.lit(m).alias("metric"), F.struct(F.round(m, 9).alias("v"), F.col(id_col).alias("i")).alias("x"))
        low = top if low is None else low.union(top)
    ids = low.groupBy("metric").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["i"]).alias("worst"))
    return stats.join(ids, "metric", "left")


def hypotheses(candidates: DataFrame, key: str, budget: int = 4, longest: int = 200) -> DataFrame:
    """(key, place, text, weight): the ways to ask one thing, best weight first, each once whatever its case.

    ``candidates`` hold key, text and weight. Empty texts and those over ``longest`` characters go;
    ``budget`` ways stay, a feature of the operator.
    """
    usable = candidates.where((F.trim("text") != "") & (F.length("text") <= longest)).withColumn("low", F.lower(F.trim("text")))
    best = F.struct(-F.col("weight"), F.trim("text"))
    once = usable.groupBy(key, "low").agg(F.min(best).alias("b")).select(key, F.col("b.col2").alias("text"), (-F.col("b.col1")).alias("weight"))
    return best_of(once, [key], [F.col("weight").desc(), F.lower("text")], budget).withColumnRenamed("rank", "place")


def share_held(needles: Column, haystack: Column) -> Column:
    """Share of ``needles`` that a text holds anywhere, whatever their case; null without needles, 0 for a null text."""
    held = F.filter(needles, lambda n: F.contains(F.lower(F.coalesce(haystack, F.lit(""))), F.lower(n)))
    return F.when(F.size(needles) > 0, F.size(held) / F.size(needles))


def integrity(answer: Column, named: Column, cited: Column) -> Column:
    """Share of an answer's citations that lead to a result; 0 for an answer without any, null without an answer."""
    return F.when(F.coalesce(answer, F.lit("")) != "", F.when(F.size(named) > 0, F.size(cited) / F.size(named)).otherwise(0.0))


def accuracy(given: Column, accepted: Column) -> Column:
    """1 where the value is among the accepted ones, 0 where not (a null value too), null where nothing is labelled."""
    return F.when(F.size(accepted) > 0, F.coalesce(F.array_contains(accepted, given), F.lit(False)).cast("int"))


def empty_handled(n_results: Column, answer: Column, expected: Column) -> Column:
    """1 where an empty response was expected and given, or neither; null where nothing is labelled."""
    empty = (F.coalesce(n_results, F.lit(0)) == 0) | F.coalesce(answer == "", F.lit(False))
    return F.when(expected.isNotNull(), (empty == expected).cast("int"))
