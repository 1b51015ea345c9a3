"""Mixing sources to target shares of the total size, by raking and calibrated sampling.

Sizes are tokens. Documents are counted into cells of source, language and topic, and the
cells' weights are raked (iterative proportional fitting) until the weighted tokens meet the
source targets and, as far as these allow, the languages' and topics' own shares. Topics are
groups of texts that use like tokens, found by k-means. A cell's
weight is how often its documents are used on average: the whole part always, the fractional
part by sequential Poisson sampling, that is in order of a fixed random number over the
fraction, as far as the source's size goes. So shares are met to within one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomsearch.llm.tokens import VOCAB, encode_corpus
from loomsearch.plans.runtime import stage

#: Languages that have a marginal of their own; the rest is one.
LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru", "el", "ja", "zh", "ko", "ar", "hi")
MARGINS = ("source", "lang", "topic")
#: Groups of texts that are topics, and cells that tokens are hashed to for them.
TOPICS, CELLS = 12, 512
#: Bound of the factors of languages and topics, and when raking ends.
TRIM, ROUNDS, TOLERANCE = 4.0, 300, 1e-6
#: Steps of the sampling order in which tokens are counted before one step is sorted.
STEPS = 4096


def language(col: str = "lang") -> Column:
    """Two-letter language, ``und`` for null, odd or rare codes."""
    two = F.lower(F.substring(F.trim(col), 1, 2))
    return F.when(two.isin(*LANGUAGES), two).otherwise("und")


def with_topics(counted: DataFrame, seed: int) -> DataFrame:
    """Rows with their ``topic``: one of ``TOPICS`` groups of texts that use like tokens, by k-means.

    ``counted`` holds ``tf``, hashed token counts; the groups are fitted on all rows, in passes that
    Spark distributes, and only the ``TOPICS`` centres and one weight a cell of ``CELLS`` reach the driver.
    """
    weighed = IDF(inputCol="tf", outputCol="weighed").fit(counted).transform(counted)
    even = Normalizer(inputCol="weighed", outputCol="features").transform(weighed)
    groups = KMeans(k=TOPICS, maxIter=8, seed=seed, featuresCol="features", predictionCol="group").fit(even).transform(even)
    return groups.select("id", "source", "lang", "tokens", F.concat(F.lit("t"), F.col("group").cast("string")).alias("topic"))


def feasible(targets: list[dict], sizes: dict[str, int]) -> dict[str, float]:
    """Tokens each source is to give: its share of the total size of these sources.

    What a source cannot give, used ``max_repeats`` times, goes to the others in proportion
    to their shares, so the total stays.
    """
    total = float(sum(sizes.get(t["source"], 0) for t in targets))
    limit = {t["source"]: float(t["max_repeats"]) * sizes.get(t["source"], 0) for t in targets}
    share = {t["source"]: t["target_share"] for t in targets}
    out, free = {}, set(share)
    while free:
        left = total - sum(out.values())
        weight = sum(share[s] for s in free)
        goal = {s: left * share[s] / weight if weight else 0.0 for s in free}
        full = {s for s in free if goal[s] >= limit[s]}
        if not full:
            return out | goal
        out |= {s: limit[s] for s in full}
        free -= full
    return out


def rake(cells: list[Row], goals: dict[str, dict[str, float]], caps: dict[str, float], sizes: dict[str, int]) -> dict[str, dict[str, float]]:
    """Factors by margin (source, lang, topic) whose capped product weights meet the goals.

    ``cells`` (source, lang, topic, tokens) are at most sources x languages x topics rows, whatever
    the corpus. Ends on the source margin, which is met exactly, once no margin moves any more.
    Factors of languages and topics stay within ``TRIM`` times, so that margins which contradict
    the sources' do not drive weights to nothing; the gaps this leaves are in ``margins``.
    """
    factors = {m: {k: 1.0 for k in goals[m]} for m in MARGINS}
    # A source that is used up entirely needs no raking: every cell is at its cap.
    spent = {s for s, c in caps.items() if goals["source"].get(s, 0) >= c * sizes.get(s, 0) * (1 - 1e-9)}
    factors["source"] |= {s: 1e12 for s in spent if s in factors["source"]}
    place = {m: {k: n for n, k in enumerate(goals[m])} for m in MARGINS}
    at = {m: np.array([place[m][c[m]] for c in cells], np.int64) for m in MARGINS}
    weight = {m: np.array(list(factors[m].values())) for m in MARGINS}
    goal = {m: np.array([float(x) for x in goals[m].values()]) for m in MARGINS}
    tokens, cap = np.array([float(c["tokens"]) for c in cells]), np.array([float(caps[c["source"]]) for c in cells])
    fixed = np.array([k in spent for k in goals["source"]])

    def used(source: np.ndarray) -> np.ndarray:
        return np.minimum(source[at["source"]] * weight["lang"][at["lang"]] * weight["topic"][at["topic"]], cap) * tokens

    def meet_sources() -> np.ndarray:
        # What a source gives rises with its factor, so the factor that meets its goal is found by halving.
        low, high = np.full(len(fixed), -30.0), np.full(len(fixed), 30.0)
        for _ in range(80):
            middle = (low + high) / 2
            short = np.bincount(at["source"], used(np.exp(middle)), len(fixed)) < goal["source"]
            low, high = np.where(short, middle, low), np.where(short, high, middle)
        return np.where(fixed, weight["source"], np.exp(high))

    for _ in range(ROUNDS):
        before = {m: w.copy() for m, w in weight.items()}
        for m in ("topic", "lang"):
            have = np.bincount(at[m], used(weight["source"]), len(goal[m]))
            moves = (have > 0) & (goal[m] > 0)
            weight[m][moves] = np.clip(weight[m][moves] * goal[m][moves] / have[moves], 1 / TRIM, TRIM)
        weight["source"] = meet_sources()
        if all(np.allclose(before[m], weight[m], rtol=TOLERANCE, atol=0) for m in MARGINS):
            break
    return {m: {k: float(weight[m][n]) for k, n in place[m].items()} for m in MARGINS}


def mixture(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, shares, margins).

    chosen (id_col, source, tokens, copies): the documents of the mixture and how often each
    is used, at most ``max_repeats``. shares: for each target its share, the share that
    repeats allow, and the actual one. Documents with a null or unlisted source stay out, as
    do those without tokens (null or empty text), which add nothing; a source without
    documents gets an actual share of 0. Null rows of the targets are ignored; of a source
    listed twice the shares add up and the larger ``max_repeats`` holds. The table of targets
    is one row a source and comes to the driver. margins: for each value of each of the three
    margins its goal as a share of the size, the share of the raked weights and the actual one.
    """
    listed = [r.asDict() for r in targets.where("source is not null and target_share is not null").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")).collect()]
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    known = docs.where(F.col("source").isin([t["source"] for t in listed]))
    # The id carries the other columns through the encoder, so rows need no join afterwards.
    row = known.select(F.struct(F.col(id_col).alias("id"), "source", language().alias("lang")).alias("row"), F.col(text_col).alias("text"))
    hashed = HashingTF(inputCol="ids", outputCol="tf", numFeatures=CELLS, binary=True)
    encoded = encode_corpus(row, "row", "text", vocab).withColumn("tokens", F.size("ids").cast("long")).where("tokens > 0")
    counted = stage(hashed.transform(encoded.select("row", "tokens", F.col("ids").cast("array<string>").alias("ids"))).select("row.*", "tokens", "tf"))
    counted = stage(with_topics(counted, seed)) if counted.head(1) else counted.select("id", "source", "lang", "tokens", F.lit("t0").alias("topic"))
    cells = counted.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).collect()

    def total(margin: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for c in cells:
            out[c[margin]] = out.get(c[margin], 0) + c["tokens"]
        return dict(sorted(out.items()))

    sizes = total("source")
    goal = feasible(listed, sizes)
    caps = {t["source"]: t["max_repeats"] for t in listed}
    goals = {"source": goal, "lang": total("lang"), "topic": total("topic")}
    factors = rake(cells, goals, caps, sizes) if sizes else {m: {} for m in goals}

    weighed = counted
    for m, kind in (("source", "f_source double, cap double, goal double"), ("lang", "f_lang double"), ("topic", "f_topic double")):
        rows = [(k, f, float(caps[k]), float(goal[k])) if m == "source" else (k, f) for k, f in factors[m].items()]
        weighed = weighed.join(F.broadcast(spark.createDataFrame(rows, f"{m} string, {kind}")), m)
    weight = F.least(F.col("f_source") * F.col("f_lang") * F.col("f_topic"), F.col("cap"))
    chance = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = weighed.withColumn("w", weight).withColumn("whole", F.floor(F.col("w") + 1e-9)).withColumn("part", F.greatest(F.col("w") - F.col("whole"), F.lit(0.0)))
    # A document at its cap takes no further copy; one with a tiny fraction comes last.
    weighed = weighed.withColumn("turn", F.when((F.col("whole") < F.col("cap")), chance / F.greatest("part", F.lit(1e-9)))).withColumn(
        "step", F.coalesce(F.floor(F.lit(float(STEPS)) * F.col("turn") / (F.col("turn") + 1)), F.lit(STEPS + 1))
    )
    by_step = weighed.groupBy("source", "step").agg(F.sum("tokens").alias("step_tokens"), F.sum(F.col("whole") * F.col("tokens")).alias("base"), F.first("goal").alias("goal"))
    order = Window.partitionBy("source").orderBy("step")
    steps = by_step.withColumn("need", F.col("goal") - F.sum("base").over(Window.partitionBy("source"))).withColumn(
        "start", F.when(F.col("step") <= STEPS, F.sum("step_tokens").over(order) - F.col("step_tokens"))
    ).select("source", "step", "need", "start", (F.col("start") + F.col("step_tokens")).alias("end"))
    placed = weighed.join(F.broadcast(steps), ["source", "step"]).select(*MARGINS, "id", "tokens", "w", "whole", "turn", "need", "start", "end")
    at_cut = (F.col("turn").isNotNull()) & (F.col("start") < F.col("need")) & (F.col("end") > F.col("need"))
    inside = placed.where(~F.coalesce(at_cut, F.lit(False))).withColumn("more", F.coalesce((F.col("end") <= F.col("need")).cast("int"), F.lit(0)))
    # One step of one source: where its running size crosses the goal, the nearer side counts.
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = placed.where(at_cut).withColumn("upto", F.col("start") + running).withColumn("more", (F.col("upto") - F.col("tokens") / 2 <= F.col("need")).cast("int")).drop("upto")
    placed = inside.unionByName(edge).select(F.col("id").cast(id_type).alias(id_col), *MARGINS, "tokens", "w", (F.col("whole") + F.col("more")).cast("int").alias("copies"))
    chosen = placed.where("copies > 0").select(id_col, "source", "tokens", "copies")

    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"))
    whole = float(sum(sizes.values())) or 1.0
    plan = spark.createDataFrame(
        [(t["source"], float(t["target_share"]), int(t["max_repeats"]), goal[t["source"]] / whole, int(sizes.get(t["source"], 0))) for t in listed],
        T._parse_datatype_string("source string, target_share double, max_repeats int, feasible_share double, tokens_available long"),
    )
    shares = plan.join(F.broadcast(used), "source", "left").select(
        "source", "target_share", "max_repeats", "feasible_share", "tokens_available", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.coalesce("tokens_used", F.lit(0)) / whole).alias("actual_share"),
    )
    stacked = placed.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS])).alias("m"), (F.col("w") * F.col("tokens")).alias("raked"), (F.col("copies") * F.col("tokens")).alias("used"))
    sums = stacked.groupBy("m.margin", "m.value").agg(F.sum("raked").alias("raked"), F.sum("used").alias("used"))
    wanted = spark.createDataFrame([(m, k, float(x) / whole) for m in MARGINS for k, x in goals[m].items()], "margin string, value string, goal_share double")
    margins = wanted.join(sums, ["margin", "value"], "left").select("margin", "value", "goal_share", *[(F.coalesce(F.col(c), F.lit(0)) / whole).alias(f"{n}_share") for c, n in (("raked", "raked"), ("used", "actual"))])
    return chosen, shares, margins
