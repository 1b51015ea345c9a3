"""Knowledge-graph folds, look-ups and traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def accumulate_edges(edges: DataFrame) -> DataFrame:
    """One row for each (source, relation, target), its confidence folded over all observations.

    A new observation x moves confidence c to c + x (1 - c) / 2. The fold has a closed form in
    which only the first observation (by time and id) stands apart, so it is one aggregation
    with partial sums. Null confidences count as 0.
    """
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))
    rows = edges.select("source_id", "relation", "target_id", x.alias("x"), F.struct("created_at", "id").alias("at"))
    log = F.log(1 - F.col("x") / 2)
    folded = rows.groupBy("source_id", "relation", "target_id").agg(F.min_by("x", "at").alias("first"), F.sum(log).alias("logs"), F.count("*").alias("observations"))
    rest = F.exp(F.col("logs") - F.log(1 - F.col("first") / 2))
    return folded.select("source_id", "relation", "target_id", "observations", (1 - (1 - F.col("first")) * rest).alias("confidence"))


def neighbours(edges: DataFrame, entities: DataFrame, k: int = 50) -> DataFrame:
    """The k surest targets of each source, with their names."""
    w = Window.partitionBy("source_id").orderBy(F.col("confidence").desc_nulls_last(), "id")
    best = edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = entities.select(F.col("entity_id").alias("target_id"), F.col("name").alias("target_name"))
    return best.join(names, "target_id").select("source_id", "rank", "relation", "target_id", "target_name", "confidence")


def upsert(entities: DataFrame) -> DataFrame:
    """Entities folded by type and folded name: aliases united, the longest description kept.

    Popularity rises by 0.01 with each further observation, from the first one's, up to 1.
    """
    key = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    at = F.struct("first_seen_at", "entity_id")
    keyed = entities.where("name is not null").withColumn("name_key", key)
    alias = keyed.select("node_type", "name_key", F.explode("aliases").alias("a")).where("a is not null").distinct()
    # Null types match one another, so that no row loses its aliases.
    alias = alias.groupBy(F.col("node_type").alias("t"), F.col("name_key").alias("k")).agg(F.array_sort(F.collect_list("a")).alias("aliases"))
    folded = keyed.groupBy("node_type", "name_key").agg(
        F.min_by("entity_id", at).alias("entity_id"),
        F.max(F.struct(F.length(F.coalesce("description", F.lit(""))).alias("n"), F.coalesce("description", F.lit("")).alias("d")))["d"].alias("description"),
        F.min_by(F.col("popularity").cast("double"), at).alias("p0"), F.count("*").alias("observations"),
    )
    folded = folded.join(alias, F.col("node_type").eqNullSafe(F.col("t")) & (F.col("name_key") == F.col("k")), "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return folded.select("node_type", "name_key", "entity_id", "aliases", "description", F.least(F.lit(1.0), F.col("p0") + 0.01 * (F.col("observations") - 1)).alias("popularity"), "observations")


def surfaces(entities: DataFrame) -> DataFrame:
    """(surface, entity_id, popularity): every folded name and alias of an entity, once."""
    forms = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("entity_id", "popularity", F.explode(forms).alias("s")).select(
        F.trim(F.regexp_replace(F.lower("s"), "\\s+", " ")).alias("surface"), "entity_id", "popularity"
    ).where("surface <> ''").distinct()


def registry(entities: DataFrame) -> DataFrame:
    """(surface, entity_id): the strongest entity of each contested surface.

    The best is an aggregate, so a surface that a third of all entities share is combined
    before it moves.
    """
    best = F.max_by("entity_id", F.struct(F.coalesce("popularity", F.lit(0.0)).alias("p"), "entity_id"))
    return surfaces(entities).groupBy("surface").agg(best.alias("entity_id"), F.count("*").alias("claims"))


def longest_prefix(queries: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(query, surface, entity_id): the longest leading words (up to ``most``) that name an entity."""
    w = F.split(F.trim(F.regexp_replace(F.lower("query"), "\\s+", " ")), " ")
    sizes = F.sequence(F.lit(1), F.least(F.lit(most), F.size(w)))
    tries = queries.where("query is not null").select("query").distinct().select("query", F.explode(F.transform(sizes, lambda n: F.array_join(F.slice(w, 1, n), " "))).alias("surface"))
    found = tries.join(names.select("surface", "entity_id"), "surface")
    return found.groupBy("query").agg(F.max(F.struct(F.length("surface").alias("n"), "surface", "entity_id")).alias("b")).select("query", "b.surface", "b.entity_id")


def resolve_names(wanted: DataFrame, entities: DataFrame, k: int = 12) -> DataFrame:
    """(name, entity_id, rank): up to k entities whose folded name or whose alias is the name.

    The either-or of the look-up is two equi-joins united, not a join on a disjunction.
    """
    wanted = wanted.where("name is not null").select("name").distinct()
    slim = entities.select("entity_id", F.lower("name").alias("low"), "aliases", "popularity")
    by_name = wanted.join(slim, F.lower(wanted["name"]) == slim["low"]).select(wanted["name"], "entity_id", "popularity")
    alias = entities.select("entity_id", F.explode("aliases").alias("alias"), "popularity")
    by_alias = wanted.join(alias, wanted["name"] == alias["alias"]).select(wanted["name"], "entity_id", "popularity")
    w = Window.partitionBy("name").orderBy(F.col("popularity").desc_nulls_last(), "entity_id")
    return by_name.union(by_alias).distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("name", "entity_id", "rank")


def importance(edges: DataFrame) -> DataFrame:
    """(entity_id, degree, importance): distinct links of each node over the largest number."""
    once = edges.select("source_id", "relation", "target_id").distinct()
    ends = once.select(F.col("source_id").alias("entity_id")).union(once.select("target_id"))
    degree = ends.groupBy("entity_id").agg(F.count("*").alias("degree"))
    return degree.join(F.broadcast(degree.agg(F.max("degree").alias("most")))).select("entity_id", "degree", (F.col("degree") / F.col("most")).alias("importance"))
