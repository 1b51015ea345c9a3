"""One consistent form for texts that look the same on the screen.

A text is exploded to positioned units. Runs of characters that stand for themselves stay
whole; every other unit is a character with its combining marks. The distinct units of the
corpus are exploded to code points, joined with the decomposition and look-alike mappings
(fixed tables made from the Unicode rules, so a broadcast has a proven bound), their marks are
ordered by combining class and recomposed, and the units' forms are joined back and rebuilt
into strings by position.

The form: full and half width become normal width, every blank a space, line ends one line
feed; invisible characters go, except where they shape what is seen (emoji sequences, joiners
after Arabic and Indic letters); look-alike letters become the Latin one; marks are in
canonical order and composed with their letter as far as a composed character exists for the
letter and the first marks. Letters that differ visibly, such as superscripts, cases, font
variants and digraphs, are kept.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.plans.runtime import stage

#: Letters of other scripts and their Latin look-alikes, in two lines each.
LOOKALIKES = {
    "cyrillic": (
        "аеорсухіјѕһԁԛԝҮАВЕКМНОРСТУХІЈЅԌԜ",
        "aeopcyxijshdqwYABEKMHOPCTYXIJSGW",
    ),
    "greek": (
        "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳϹͿ",
        "ovABEZHIKMNOPTYXcjCJ",
    ),
    "other": (
        "ɑɡօոսᴏⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ",
        "agonuoivxlcdmIVXLCDM",
    ),
}
#: Format characters that are seen, so they stay.
_SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}]"
_TINT = r"[\x{FE0E}\x{FE0F}\x{20E3}\x{1F3FB}-\x{1F3FF}]"
_JAMO = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?"
_JOINED = r"[\x{0600}-\x{0DFF}][\x{200C}\x{200D}]"
#: Characters that stand for themselves unless a combining mark follows.
PLAIN = r"\x{00}-\x{7F}\x{A1}-\x{AC}\x{AE}-\x{0250}\x{0252}-\x{0260}\x{0262}-\x{02AF}\x{0431}-\x{0434}\x{0436}-\x{0438}\x{043A}-\x{043D}\x{0442}\x{0444}\x{0446}-\x{044F}\x{03B1}-\x{03BC}\x{03BE}\x{03C0}-\x{03C9}\x{2010}\x{2012}-\x{2027}\x{2030}-\x{205E}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FC}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
UNIT = rf"(?s){_EMOJI}{_TINT}*(?:\x{{200D}}{_EMOJI}{_TINT}*)*|{_JAMO}|{_JOINED}|[{PLAIN}]+(?![\p{{M}}\x{{FF9E}}\x{{FF9F}}])|.[\p{{M}}\x{{FF9E}}\x{{FF9F}}]*"
_KEPT = rf"(?s)(?:{_EMOJI}{_TINT}*(?:\x{{200D}}{_EMOJI}{_TINT}*)*|{_JOINED}|[{PLAIN}]+)"


def _decomposed(c: int) -> list[int]:
    """Full canonical decomposition, also of width and no-break variants."""
    parts = unicodedata.decomposition(chr(c)).split()
    if parts and parts[0] in ("<wide>", "<narrow>", "<noBreak>"):
        parts = parts[1:]
    if not parts or parts[0][0] == "<":
        return [c]
    return [x for p in parts for x in _decomposed(int(p, 16))]


@lru_cache(maxsize=1)
def mapping() -> list[tuple[int, list[int], list[int]]]:
    """(code point, code points it becomes, their combining classes) where it is not kept as it is."""
    alike = {ord(a): ord(b) for x, y in LOOKALIKES.values() for a, b in zip(x, y)}
    out = []
    for c in [*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]:
        kind = unicodedata.category(chr(c))
        if kind == "Cn" or 0xAC00 <= c <= 0xD7A3:
            continue
        hidden = (kind == "Cf" and c not in _SEEN_FORMAT) or c in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF
        if hidden:
            to = []
        elif kind == "Zs":
            to = [0x20]
        elif kind in ("Zl", "Zp"):
            to = [0x0A]
        else:
            to = [alike.get(x, x) for x in _decomposed(c)]
        classes = [unicodedata.combining(chr(x)) for x in to]
        if to != [c] or any(classes):
            out.append((c, to, classes))
    return out


@lru_cache(maxsize=1)
def compositions() -> list[tuple[str, str]]:
    """(decomposed, composed) of every character that canonical composition may make."""
    out = []
    for c in range(0xC0, 0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        d = unicodedata.normalize("NFD", s)
        if d != s and unicodedata.normalize("NFC", d) == s:
            out.append((d, s))
    return out


def unit_forms(units: DataFrame) -> DataFrame:
    """(unit, form) of distinct units."""
    spark: SparkSession = units.sparkSession
    table = F.broadcast(spark.createDataFrame(mapping(), "cp int, to array<int>, classes array<int>"))
    composed = F.broadcast(spark.createDataFrame(compositions(), "parts string, whole string"))
    points = units.select("unit", F.posexplode(F.split("unit", "")).alias("pos", "ch")).where("ch <> ''").select("unit", "pos", "ch", F.ascii("ch").alias("cp"))
    mapped = points.join(table, "cp", "left").select(
        "unit", "pos",
        F.coalesce("to", F.array("cp")).alias("to"), F.coalesce("classes", F.array(F.lit(0))).alias("classes"),
    ).select("unit", "pos", F.posexplode_outer(F.arrays_zip("to", "classes")).alias("sub", "z")).where("z is not null")
    # Marks go in the order of their class behind the character that they stand on.
    placed = mapped.select("unit", F.struct(F.when(F.col("z.classes") == 0, F.lit(0)).otherwise(F.col("z.classes")).alias("c"), "pos", "sub", F.col("z.to").alias("cp")).alias("x"))
    ordered = placed.groupBy("unit").agg(F.sort_array(F.collect_list("x")).alias("xs")).select(
        "unit", F.transform("xs", lambda x: F.decode(F.unhex(F.lpad(F.hex(x["cp"]), 8, "0")), "UTF-32")).alias("chars")
    )
    prefixes = ordered.where(F.size("chars") > 1).select("unit", "chars", F.explode(F.sequence(F.lit(2), F.size("chars"))).alias("n")).select(
        "unit", "n", F.array_join(F.slice("chars", 1, F.col("n")), "").alias("parts")
    )
    best = prefixes.join(composed, "parts").groupBy("unit").agg(F.max_by("whole", "n").alias("whole"), F.max("n").alias("n"))
    joined = ordered.join(best, "unit", "left")
    rest = F.expr("if(n < size(chars), array_join(slice(chars, n + 1, size(chars)), ''), '')")
    forms = joined.select("unit", F.when(F.col("n").isNull(), F.array_join("chars", "")).otherwise(F.concat("whole", rest)).alias("form"))
    return units.join(forms, "unit", "left").select("unit", F.coalesce("form", F.lit("")).alias("form"))


def canonical(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, form): each row's text and its consistent form.

    A null text has a null form, an empty one or one of invisible characters only an empty
    form. Repeated rows come out once each; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    lines = F.regexp_replace("text", "\r\n?", "\n")
    itself = F.coalesce(F.col("text").rlike(r"\A[\x{00}-\x{7F}]*\z"), F.lit(True))
    simple = rows.where(itself).select("id", "text", lines.alias("form"))
    units = rows.where(~itself).select("row", "id", "text", F.posexplode(F.regexp_extract_all(lines, F.lit(UNIT), F.lit(0))).alias("pos", "unit"))
    units = stage(units.select("row", "pos", "unit", F.when(F.col("pos") == 0, F.struct("id", "text")).alias("doc"), (~F.col("unit").rlike(rf"\A{_KEPT}\z")).alias("open")))
    forms = unit_forms(units.where("open").select("unit").distinct())
    done = units.where("open").join(forms, "unit").select("row", "pos", "form", "doc").union(units.where("not open").select("row", "pos", F.col("unit").alias("form"), "doc"))
    rebuilt = done.groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "form"))), lambda x: x["form"]), "").alias("form"))
    return simple.union(rebuilt.select("doc.id", "doc.text", "form")).withColumnRenamed("id", id_col)


def alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of rows that look the same but are not equal, smaller id first.

    Texts without a visible character are in no pair. Texts are compared by digests of form
    and text, groups of equal texts only where the group holds different ones.
    """
    forms = canonical(docs, id_col, text_col).where(F.col("form").rlike(r"[^\s\p{Cntrl}]"))
    keys = stage(forms.select(F.col(id_col).alias("id"), F.md5("form").alias("form"), F.md5("text").alias("text")))
    mixed = keys.groupBy("form", "text").agg(F.lit(1).alias("one")).groupBy("form").agg(F.count("*").alias("texts")).where("texts > 1").select("form")
    left = keys.join(mixed, "form", "left_semi")
    a, b = left.alias("a"), left.alias("b")
    return a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.text") != F.col("b.text")) & (F.col("a.id") < F.col("b.id"))).select(
        F.col("a.id").alias("doc_id_a"), F.col("b.id").alias("doc_id_b")
    ).distinct()
