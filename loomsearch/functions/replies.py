"""Reading the line grammars of answers and extraction replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, section, n_rows): rows with cells under each ENTITIES or EDGES heading of a text.

    A line is a heading if its letters alone spell it; lines before the first belong to none.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line"))
    letters = F.upper(F.regexp_replace("line", "[^A-Za-z]", ""))
    headed = rows.withColumn("head", F.when(letters.isin("ENTITIES", "EDGES"), letters))
    w = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = headed.withColumn("section", F.last("head", ignorenulls=True).over(w)).where("section is not null")
    return placed.groupBy(id_col, "section").agg(F.count_if(F.col("head").isNull() & F.col("line").contains("|")).alias("n_rows"))


def citations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_citations, n_sources): marks like [3] in a text, all and distinct ones."""
    c = docs.where(F.col(text_col).isNotNull()).select(id_col, F.regexp_extract_all(text_col, F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)).alias("c"))
    return c.where(F.size("c") > 0).select(id_col, F.size("c").alias("n_citations"), F.size(F.array_distinct("c")).alias("n_sources"))


def answers(docs: DataFrame, id_col: str, text_col: str, most: int = 3) -> DataFrame:
    """(id_col, answer, suggestions): the answer of a reply, over its lines, and up to ``most`` suggestions.

    The answer ends where another key begins a line. Texts without one give no row; a reply
    without suggestions has an empty list.
    """
    part = lambda key: F.trim(F.regexp_extract(text_col, rf"(?s)(?:^|\n){key}:(.*?)(?:\n(?:SUGGESTIONS|COMPARE|ROW):|\z)", 1))
    listed = F.filter(F.transform(F.split(F.regexp_extract(text_col, r"(?:^|\n)SUGGESTIONS:([^\n]*)", 1), r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    out = docs.where(F.col(text_col).isNotNull()).select(id_col, part("ANSWER").alias("answer"), F.slice(listed, 1, most).alias("suggestions"))
    return out.where("answer <> ''")


def comparisons(docs: DataFrame, id_col: str, text_col: str, subjects: int = 4, rows: int = 6) -> DataFrame:
    """(id_col, subjects, rows, best): the comparison table of a reply.

    Subjects are the cells of COMPARE, rows those of each ROW: a label, then a cell a subject.
    ``best`` numbers, from 0, the cell marked by a trailing star in each row, -1 if none. A table
    of fewer than two subjects, no rows or a row of another width is dropped whole.
    """
    cells = lambda c: F.filter(F.transform(F.split(c, r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    heads = F.slice(cells(F.regexp_extract(text_col, r"(?:^|\n)COMPARE:([^\n]*)", 1)), 1, subjects)
    lines = F.slice(F.transform(F.regexp_extract_all(text_col, F.lit(r"(?:^|\n)ROW:([^\n]*)"), F.lit(1)), cells), 1, rows)
    out = docs.where(F.col(text_col).isNotNull()).select(id_col, heads.alias("subjects"), lines.alias("rows"))
    whole = F.forall("rows", lambda r: F.size(r) == F.size("subjects") + 1)
    best = F.transform("rows", lambda r: F.array_position(F.transform(F.slice(r, 2, subjects), lambda c: c.endswith(" *")), True).cast("int") - 1)
    return out.where((F.size("subjects") >= 2) & (F.size("rows") > 0) & whole).withColumn("best", best)


#: The kinds of node a graph holds.
NODE_TYPES = ("Person", "Organization", "Product", "Place", "Technology", "Event", "Capability")
#: A number as written in a cell.
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"


def confidence(cell: Column, most: float = 0.6, default: float = 0.3) -> Column:
    """A stated confidence on 0..``most``; ``default`` where it is no number."""
    stated = F.when(F.trim(cell).rlike(NUMBER), F.trim(cell)).try_cast("double")
    return F.coalesce(F.when(stated.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(0.0), stated))), F.lit(default))


def extracted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Entities (id, name, node_type, confidence) and edges (id, source, relation, target, confidence) of replies.

    Rows need the exact number of cells, none empty; names are up to 200 characters, types known,
    and both ends of an edge differ and are entities of the same reply, whatever their case.
    Entities named twice keep the highest confidence, edges too.
    """
    lines = F.transform(F.split(text_col, "\n", -1), lambda s: F.trim(s))
    head = lambda s: F.upper(F.regexp_replace(s, "[^A-Za-z]", ""))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(lines).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.where(F.col("line").contains("|") | head(F.col("line")).isin("ENTITIES", "EDGES"))
    placed = kept.withColumn("section", F.last(F.when(head(F.col("line")).isin("ENTITIES", "EDGES"), head(F.col("line"))), ignorenulls=True).over(w))
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    cut = placed.select("id", "section", cells.alias("c")).where(F.forall("c", lambda c: c != ""))
    e = cut.where((F.col("section") == "ENTITIES") & (F.size("c") == 3)).select("id", F.get("c", F.lit(0)).alias("name"), F.get("c", F.lit(1)).alias("node_type"), confidence(F.get("c", F.lit(2))).alias("confidence"))
    entities = e.where(F.col("node_type").isin(*NODE_TYPES) & (F.length("name") <= 200)).groupBy("id", "name", "node_type").agg(F.max("confidence").alias("confidence"))
    g = cut.where((F.col("section") == "EDGES") & (F.size("c") == 4)).select("id", F.get("c", F.lit(0)).alias("source"), F.get("c", F.lit(1)).alias("relation"), F.get("c", F.lit(2)).alias("target"), confidence(F.get("c", F.lit(3))).alias("confidence"))
    known = entities.select("id", F.lower("name").alias("low")).distinct()
    ends = g.where(F.lower("source") != F.lower("target"))
    for end in ("source", "target"):
        ends = ends.withColumn("low", F.lower(end)).join(known, ["id", "low"], "left_semi").drop("low")
    return entities, ends.groupBy("id", "source", "relation", "target").agg(F.max("confidence").alias("confidence"))


#: A citation mark: one number or several in square brackets.
MARK = r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"


def resolve(answers: DataFrame, results: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, text, cited, named): answers whose citations all lead to a result.

    ``results`` holds id_col, ``rank`` from 1 and more. Numbers without a result go from their mark, a
    mark without numbers goes whole, blanks that then meet become one. ``cited`` are the places
    cited, ascending and once each; ``named`` all numbers of the text before. A null text gives no
    row; an answer without results keeps no citation.
    """
    known = results.groupBy(id_col).agg(F.max("rank").alias("_n"))
    base = answers.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_t")).join(known, id_col, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    numbers = lambda m: F.transform(F.split(m, ","), lambda x: F.trim(x).try_cast("int"))
    marks = base.withColumn("_m", F.transform(F.regexp_extract_all("_t", F.lit(MARK), F.lit(1)), numbers)).withColumn("_p", F.split("_t", MARK, -1))
    kept = marks.withColumn("_k", F.transform("_m", lambda m: F.filter(m, lambda x: (x >= 1) & (x <= F.col("_n")))))
    shown = F.transform("_k", lambda k: F.when(F.size(k) > 0, F.concat(F.lit("["), F.array_join(k.cast("array<string>"), ","), F.lit("]"))).otherwise(""))
    joined = F.array_join(F.transform("_p", lambda p, i: F.concat(p, F.coalesce(F.get(shown, i), F.lit("")))), "")
    text = F.regexp_replace(F.regexp_replace(joined, " {2,}", " "), r"^\s+|\s+$", "")
    return kept.select(id_col, text.alias("text"), F.array_sort(F.array_distinct(F.flatten("_k"))).alias("cited"), F.array_distinct(F.flatten("_m")).alias("named"))


def source_block(n: Column, domain: Column, parts: list[Column], most: int = 1500) -> Column:
    """A result fenced as a numbered source: its non-empty parts, a line each, up to ``most`` characters (a feature)."""
    body = F.substring(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n"), 1, most)
    return F.concat(F.lit('<source n="'), n.cast("string"), F.lit('" domain="'), F.coalesce(domain, F.lit("")), F.lit('">\n'), body, F.lit("\n</source>"))


def extractive(passage: Column, snippet: Column, most: int = 400) -> Column:
    """The answer without a model: the beginning of the first passage, else of the snippet, and its citation; empty if neither."""
    said = F.coalesce(passage, snippet, F.lit(""))
    return F.when(said != "", F.concat(F.substring(said, 1, most), F.lit(" [1]"))).otherwise("")
