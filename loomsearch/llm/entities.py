"""Linking the spellings of one person or organisation by merging and matching again.

Rows become profiles: parsed spellings (own name and given names or common words), topics and
places from the description, and a domain that names the entity. Persons are blocked by the
own name with up to one letter left out together with an initial, a place or a domain,
organisations by the own name alone, and profiles of a block are compared in pairs. Matched
profiles are merged: spellings, initials and what is known of them are united, and the merged,
richer profiles enter blocking again, until no merge occurs.

No list of names, trades or phrases is built in. Which words are given names or common words
of organisations is learned from what stands beside many different own names; which words of
descriptions are places, from how they are written in all descriptions; and which given names
are forms of one another (familiar and short forms) from the united spellings of profiles: two
given names that one profile has for one surname, for several different surnames. After each
merge new forms can be learned, and lead to new matches. Links that rest on an initial alone
wait until the clear ones are merged, and hold only if a single full profile answers to them,
or a single short one and no full one.

All joins are sort-merge joins by hint: profiles, keys and pairs unfold many times beyond the size
of the compressed tables that they are read from, by which a broadcast would be chosen, and a
broadcast goes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsearch.llm import names
from loomsearch.operators.components import components
from loomsearch.plans.runtime import stage

KINDS = ("Person", "Organization")
FORMS = "array<struct<own:string,words:array<string>>>"
PROFILE = ["kind", "forms", "trades", "places", "domains"]
#: A word is common if it stands beside own names with this many different beginnings (two letters).
COMMON_OWN = 12
#: Two given names are forms of one name if profiles show it for surnames with this many different
#: beginnings, and for this share of the profiles in which the rarer of them stands beside another.
FORM_OWN, FORM_SHARE = 2, 0.3


def common_words(rows: DataFrame) -> dict[str, dict[str, int]]:
    """Words that stand beside many different own names, with the number of these.

    The own name of a spelling is the rarest of its words. Neither copies nor the rows of one
    entity make a word common: spellings of the same words count once, and own names by their
    beginning, which misspellings seldom touch. The number of rows is no matter, and the
    result is a vocabulary of given names and of words for trades, not of entities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [names.unknown_words(k, s) for k, s in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["kind", "words"])

    spelling = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    typed = rows.select("kind", spelling.alias("s")).where("s is not null").distinct()
    once = typed.mapInArrow(run, "kind string, words array<string>").where("size(words) > 0").distinct()
    each = stage(once.select("kind", "words", F.explode("words").alias("word")))
    uses = each.groupBy("kind", "word").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", -F.length("word"), "word"))["word"]
    own = each.where("size(words) > 1").join(uses.hint("merge"), ["kind", "word"]).groupBy("kind", "words").agg(rarest.alias("own"))
    beside = own.select("kind", F.substring("own", 1, 2).alias("start"), F.explode(F.array_remove("words", F.col("own"))).alias("word")).distinct()
    found = beside.groupBy("kind", "word").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_OWN).collect()
    return {k: {r["word"]: r["n"] for r in found if r["kind"] == k} for k in KINDS}


def about(rows: DataFrame) -> DataFrame:
    """(description, topics, places) of different descriptions: words that some description writes small,
    and words that none does. Words of fewer than three letters and stop words say nothing."""
    texts = rows.select("description").where("description is not null").distinct()
    each = texts.select("description", F.explode(F.split("description", r"[^\p{L}\p{M}]+")).alias("t")).where(F.length("t") > 2).withColumn("w", F.lower("t"))
    small = each.where("t = w").select("w").distinct().withColumn("small", F.lit(True))
    told = each.join(small.hint("merge"), "w", "left").where(~F.col("w").isin(*sorted(names.STOP)))
    return told.groupBy("description").agg(F.collect_set(F.when(F.col("small"), F.col("w"))).alias("topics"), F.collect_set(F.when(F.col("small").isNull(), F.col("w"))).alias("places"))


def parsed(rows: DataFrame, common: dict[str, dict[str, int]]) -> DataFrame:
    """(id, kind, forms, trades, places, domains) of each row."""
    id_type = rows.schema["id"].dataType.simpleString()
    given = frozenset(common["Person"])

    def one(kind: str, name: str | None, aliases: list | None, text: str | None, domain: str | None, topics: list | None, places: list | None):
        parse = (lambda s: names.parse_person(s, given)) if kind == "Person" else (lambda s: names.parse_org(s, common[kind]))
        forms = {(f[0], tuple(f[1])) for f in (parse(s) for s in [name, *(aliases or [])] if s) if f}
        told = {(f[0], tuple(f[1])) for f in map(parse, names.spellings_in(text)) if f}
        # A spelling that the description has is one of the row's if its own name is.
        forms |= {f for f in told if f[0] and any(names.near(f[0], g[0]) for g in forms)}
        used = {w for f in forms | told for w in (f[0], *f[1])}
        host = names.fold(domain or "")
        parts = re.split(r"[^\w]+", host)
        own = [host] if any(f[0] and (f[0] in host or any(len(p) > 3 and names.near(f[0], p) for p in parts)) for f in forms) else []
        places = sorted({names.fold(p) for p in places or []} - used)
        return kind, [{"own": a, "words": list(b)} for a, b in sorted(forms)], sorted(set(map(names.fold, topics or []))), places, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.list_(pa.struct([("own", pa.string()), ("words", pa.list_(pa.string()))]))
        for b in batches:
            out = [one(*r) for r in zip(*(c.to_pylist() for c in b.columns[1:]))]
            kinds = (pa.string(), form, *[pa.list_(pa.string())] * 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in out], k) for n, k in enumerate(kinds))], ["id", *PROFILE])

    told = rows.join(about(rows).hint("merge"), "description", "left")
    return told.select("id", "kind", "name", "aliases", "description", "domain", "topics", "places").mapInArrow(
        run, f"id {id_type}, kind string, forms {FORMS}, trades array<string>, places array<string>, domains array<string>"
    )


def learned_forms(profiles: DataFrame) -> dict[str, frozenset[str]]:
    """Other forms of each given name, from the united spellings of all profiles.

    What reaches the driver is a vocabulary: pairs of given names that several surnames show.
    """
    each = profiles.where("kind = 'Person'").select("pid", F.explode("forms").alias("f")).where("size(f.words) > 0")
    each = stage(each.select("pid", F.substring("f.own", 1, 3).alias("start"), F.element_at("f.words", 1).alias("g")).where(F.length("g") > 1).distinct())
    a, b = each.alias("a"), each.alias("b")
    two = stage(a.join(b.hint("merge"), ["pid", "start"]).where("a.g <> b.g").select("start", F.col("a.g").alias("g"), F.col("b.g").alias("h")).distinct())
    beside = two.groupBy("g").agg(F.count_distinct("start").alias("n"))
    seen = two.where("g < h").groupBy("g", "h").agg(F.count("*").alias("both")).where(F.col("both") >= FORM_OWN)
    rated = seen.join(beside.hint("merge"), "g").join(beside.select(F.col("g").alias("h"), F.col("n").alias("m")).hint("merge"), "h")
    out: dict[str, set[str]] = {}
    for r in rated.where(F.col("both") >= FORM_SHARE * F.least("n", "m")).collect():
        out.setdefault(r["g"], set()).add(r["h"])
        out.setdefault(r["h"], set()).add(r["g"])
    # Forms of one name reach one another through it.
    return {g: frozenset({x for h in hs for x in out[h]} | hs) - {g} for g, hs in out.items()}


def _short(forms: list[dict]) -> bool:
    return not any(f["words"] and len(f["words"][0]) > 3 for f in forms)


def compare(a: dict, b: dict, other: dict[str, frozenset[str]]) -> tuple[int, bool, bool]:
    """(2 clear, 1 on an initial alone, 0 no match; whether the left one, the right one is short)."""
    person = a["kind"] == "Person"
    best, against = 0, False
    for fa in a["forms"]:
        for fb in b["forms"]:
            x, y = (fa["own"], fa["words"]), (fb["own"], fb["words"])
            level = names.person_level(x, y, other) if person else names.org_level(x, y)
            if level == 0:
                against |= not person or all(len(w[0]) > 1 for w in (x[1], y[1]))
            best = max(best, level or 0)
    same = {what: bool(set(a[what]) & set(b[what])) for what in ("places", "trades", "domains")}
    # Who has one full name in common with another may have further ones.
    if against and not (person and best == 2):
        # Given names of which nothing is known yet may be forms of one, if all else is the same.
        alike = person and same["places"] and same["trades"] and not best
        own = alike and any(fa["own"] == fb["own"] for fa in a["forms"] for fb in b["forms"])
        return (2 if own else 0), False, False
    if not best or any(a[what] and b[what] and not same[what] for what in ("places", "trades")):
        return 0, False, False
    if best == 1 and (same["places"] or same["domains"]):
        best = 2
    return best, _short(a["forms"]), _short(b["forms"])


def matches(profiles: DataFrame, other: dict[str, frozenset[str]], fresh: DataFrame | None) -> DataFrame:
    """(a, b, level, short_a, short_b) of profiles that share a block and match.

    ``fresh`` limits pairs to those with a profile that changed in the round before.
    """
    id_type = profiles.schema["pid"].dataType.simpleString()

    def block_keys(kind: str, forms: list[dict], places: list[str], domains: list[str]) -> set[str]:
        if kind != "Person":
            return {f"o {d}" for f in forms if f["own"] for d in names.deletions(f["own"])}
        found = {f"{what} {x} {d}" for f in forms for d in names.deletions(f["own"]) for what, xs in (("p", places), ("d", domains)) for x in xs}
        for f in forms:
            given = f["words"][:1]
            initials = {g[0] for w in given for g in {w} | other.get(w, frozenset())}
            found |= {f"i {i} {d}" for d in names.deletions(f["own"]) for i in initials}
        return found

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k) for i, *known in zip(*(c.to_pylist() for c in b.columns)) for k in block_keys(*known)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string())], ["pid", "key"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for r in b.to_pylist():
                level, sa, sb = compare(r["pa"], r["pb"], other)
                if level:
                    found.append((r["a"], r["b"], level, sa, sb))
            kinds = (b.schema.field(0).type, b.schema.field(1).type, pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in enumerate(kinds)], ["a", "b", "level", "short_a", "short_b"])

    blocks = profiles.select("pid", "kind", "forms", "places", "domains").mapInArrow(keys, f"pid {id_type}, key string")
    x, y = blocks.select(F.col("pid").alias("a"), "key"), blocks.select(F.col("pid").alias("b"), "key")
    if fresh is None:
        pairs = x.join(y.hint("merge"), "key").where("a < b").select("a", "b").distinct()
    else:
        new = x.join(fresh.select(F.col("pid").alias("a")).hint("merge"), "a", "left_semi")
        pairs = new.join(y.hint("merge"), "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pack: Column = F.struct(*PROFILE)
    left, right = (profiles.select(F.col("pid").alias(x), pack.alias(f"p{x}")).hint("merge") for x in "ab")
    full = pairs.join(left, "a").join(right, "b")
    return full.select("a", "b", "pa", "pb").mapInArrow(judge, f"a {id_type}, b {id_type}, level int, short_a boolean, short_b boolean")


def merge(profiles: DataFrame, members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, members, changed) after uniting linked profiles under the least id."""
    group = stage(components(links, "a", "b").withColumnRenamed("node", "pid")).hint("merge")
    unite = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    moved = profiles.join(group, "pid").groupBy(F.col("component").alias("pid")).agg(F.first("kind").alias("kind"), *(unite(c) for c in PROFILE[1:]))
    kept = profiles.join(group, "pid", "left_anti")
    members = members.join(group, "pid", "left").select("id", F.coalesce("component", "pid").alias("pid"))
    return stage(kept.unionByName(moved)), stage(members), group.select(F.col("component").alias("pid")).distinct()


def resolve(entities: DataFrame) -> DataFrame:
    """(entity_id, kind, cluster_id): one row for each person or organisation row with an id.

    ``cluster_id`` is the least id of its cluster. Rows whose name and aliases are null,
    empty or too general (a title, a role) match nothing unless a whole row repeats. Rows
    equal in all that is compared go through as one, so no block is blown up by copies.
    """
    rows = entities.where(F.col("node_type").isin(*KINDS) & F.col("entity_id").isNotNull()).select(
        F.col("entity_id").alias("id"), F.col("node_type").alias("kind"), "name", "aliases", "description", F.col("official_domain").alias("domain")
    )
    common = common_words(rows)
    first = stage(parsed(rows, common))
    named = first.where(F.size("forms") > 0)
    bare = first.where(F.size("forms") == 0).select("id", F.col("id").alias("pid"))
    once = stage(named.groupBy(*PROFILE).agg(F.min("id").alias("pid")))
    profiles = once
    members = stage(named.join(once.hint("merge"), PROFILE).select("id", "pid").union(bare).distinct())
    fresh, other = None, learned_forms(profiles)
    # Each round but the last makes the profiles fewer or learns further forms, so the rounds end.
    while True:
        found = stage(matches(profiles, other, fresh))
        clear = found.where("level = 2")
        if not clear.isEmpty():
            profiles, members, fresh = merge(profiles, members, clear)
            continue
        # No clear match is left: what the united spellings teach may show some.
        more = {g: hs | other.get(g, frozenset()) for g, hs in learned_forms(profiles).items()}
        if any(hs - other.get(g, frozenset()) for g, hs in more.items()):
            other, fresh = other | more, None
            continue
        # Look at all links on initials once the profiles are at their richest.
        weak = found if fresh is None else stage(matches(profiles, other, None))
        sides = weak.where("short_a").select(F.col("a").alias("short"), F.col("b").alias("other"), F.col("short_b").alias("other_short"))
        sides = sides.union(weak.where("short_b").select("b", "a", "short_a")).distinct()
        # Other short profiles do not make an answer doubtful where one full profile answers.
        full = F.when(~F.col("other_short"), F.col("other"))
        answers = sides.groupBy("short").agg(F.count("*").alias("n"), F.count(full).alias("n_full"), F.min("other").alias("other"), F.min(full).alias("full"))
        sure = answers.where("n_full = 1 or (n_full = 0 and n = 1)").select(F.col("short").alias("a"), F.coalesce("full", "other").alias("b"))
        if sure.isEmpty():
            break
        profiles, members, fresh = merge(profiles, members, sure)
    return members.join(first.select("id", "kind").distinct().hint("merge"), "id").select(F.col("id").alias("entity_id"), "kind", F.col("pid").alias("cluster_id"))


def linked_pairs(entities: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b): every pair of rows of one person or organisation, smaller id first."""
    c = resolve(entities).select("entity_id", "cluster_id").distinct()
    a, b = c.select(F.col("entity_id").alias("entity_id_a"), "cluster_id"), c.select(F.col("entity_id").alias("entity_id_b"), "cluster_id")
    return a.join(b.hint("merge"), "cluster_id").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
