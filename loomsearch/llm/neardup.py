"""Near-duplicate pages by Golay-code fuzzy hashing.

A page gives windows of successive words that begin where a hash of two words says so, so an
edit, an insertion or another order leaves most windows in place. A window's words are dealt
by a hash to three segments, each a word of 23 bits in which every word sets one: a word
that is put in, left out or changed flips at most two bits of the whole window. Each segment
is decoded to the indices of the Golay codewords near it; two segments that differ in up to
two bits always have one of these in common. By the pigeonhole principle few errors leave
segments without any: for each segment in turn a window's keys are its first two words, the
nearest indices of the two other segments and one of the near indices of this one. Parts of
keys that no other page has are dropped before near indices are made. Pages that share a key
are compared by half of a 256-bit sketch while they are joined and by all of it then, and
what is left is verified on the exact shingle sets. Pages with the same
series of words go through as one. All windows of a page give all their keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsearch.llm import golay
from loomsearch.operators.components import components
from loomsearch.plans.runtime import stage

SHINGLE = 3
#: (words of a window, one in how many places a window begins, least and most words of the
#: pages that have it). A page of twice another's length has some length of window in common with it.
WINDOWS = ((40, 12, 80, None), (20, 8, 30, 170), (10, 4, SHINGLE, 64))
SEGMENTS, BITS = 3, 23
#: Bits of 256 in which the sketches of a pair agree at least; 0.5 of shingles in common gives 187 on
#: average with a deviation of 7, so one such pair in 300,000 falls below; unrelated pages give 128.
SKETCH_AGREE = 155
#: The same for the half of the bits that goes through the join on keys: 93 with a deviation of 5.
HALF_AGREE = 74
SKETCH = ("size", "s0", "s1")
_words = re.compile(r"[^\W_]+")
_cache: dict[str, tuple[int, int]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(title: str | None, body: str) -> list[str]:
    """The page's words: longest runs of letters and digits, lower-cased."""
    return _words.findall(f"{title or ''} {body}".lower())


def _hashes(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, exact and with every number the same."""
    if len(_cache) > 500_000:
        _cache.clear()
    out = []
    for w in ws:
        h = _cache.get(w)
        if h is None:
            exact = xxhash.xxh3_64_intdigest(w)
            h = _cache[w] = exact, xxhash.xxh3_64_intdigest("0") if w.isdigit() else exact
        out.append(h)
    both = np.array(out, dtype=np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def digest(ws: list[str]) -> bytes:
    """What pages with the same series of words have in common."""
    return xxhash.xxh3_128_digest(" ".join(ws).encode("utf-8", "surrogatepass"))


def shingles(exact: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of all series of three successive words."""
    if len(exact) < SHINGLE:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(mix(mix(mix(exact[:-2]) + exact[1:-1]) + exact[2:]))


def _votes(h: np.ndarray, longs: int) -> np.ndarray:
    """Pseudo-random bits of each hash, as rows of 0 and 1."""
    each = np.stack([mix(h + np.uint64(k)) for k in range(1, longs + 1)], axis=1)
    return np.unpackbits(each.view(np.uint8).reshape(len(h), 8 * longs), axis=1)


def sketch(sh: np.ndarray) -> list[int]:
    """256-bit similarity sketch of a shingle set, as four signed longs."""
    bits = _votes(sh, 4).sum(axis=0, dtype=np.int32) * 2 > len(sh)
    return np.packbits(bits).view(np.int64).tolist()


def windows(loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a page's windows: two segments in one long, and the third with a hash of kind and first words."""
    n = len(loose)
    starts = mix(mix(loose[:-1]) + loose[1:])
    place = mix(loose * np.uint64(7) + np.uint64(11))
    segment = (place % np.uint64(SEGMENTS)).astype(np.int8)
    bit = np.int64(1) << ((place >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)
    pairs, thirds = [], []
    for kind, (width, every, least, most) in enumerate(WINDOWS):
        if n < least or (most and n > most):
            continue
        width = min(width, n)
        at = np.flatnonzero(starts % np.uint64(every) == 0)
        if not len(at):
            at = np.array([int(np.argmin(starts))])
        # One window is the page's last words, for all that would go beyond its end.
        at = np.unique(np.minimum(at, n - width))
        inside = at[:, None] + np.arange(width)
        s = [np.bitwise_or.reduce(np.where(segment[inside] == k, bit[inside], 0), axis=1) for k in range(SEGMENTS)]
        pairs.append(s[0] << BITS | s[1])
        first = mix(starts[at] + np.uint64(kind)) >> np.uint64(BITS + 1)
        thirds.append(first.astype(np.int64) << BITS | s[2])
    return np.concatenate(pairs), np.concatenate(thirds)


def window_parts(pair: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, word), each of shape (segments, windows): what a window's keys have in common where
    the errors are in one segment, and that segment."""
    low = (1 << BITS) - 1
    words = [pair >> BITS, pair & low, third & low]
    index = [golay.nearest_codeword(w).astype(np.uint64) for w in words]
    first = mix((third >> BITS).astype(np.uint64))
    parts = []
    for i in range(SEGMENTS):
        x, y = (index[j] for j in range(SEGMENTS) if j != i)
        parts.append(mix(first + (x << np.uint64(24) | y << np.uint64(12) | np.uint64(i))).view(np.int64))
    return np.stack(parts), np.stack(words)


def near_lists(word: np.ndarray, near: bool = True) -> pa.ListArray:
    """The different near indices of each word, or its nearest one only."""
    each = golay.near_codewords(word).astype(np.int16)
    own = each != each[:, :1]
    own[:, 0] = True
    if not near:
        own[:, 1:] = False
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own.sum(axis=1))]), pa.int32()), pa.array(each[own], pa.int16()))


def _pages(docs: DataFrame, id_col: str, title_col: str, body_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"), F.col(body_col).alias("body"))
    return docs.where(F.col("id").isNotNull() & (F.length("body") > 0))


def fingerprints(pages: DataFrame) -> DataFrame:
    """(id, same, size, s0..s3, pair, third) of each page with three words or more."""
    id_type = pages.schema["id"].dataType.simpleString()
    names = ["id", "same", *SKETCH, "s2", "s3", "pair", "third"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, same, size, sketches, found = [], [], [], [], []
            for i, title, body in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(title, body)
                if len(ws) < SHINGLE:
                    continue
                exact, loose = _hashes(ws)
                sh = shingles(exact)
                ids.append(i)
                same.append(digest(ws))
                size.append(len(sh))
                sketches.append(sketch(sh))
                found.append(windows(loose))
            offsets = pa.array(np.cumsum([0, *(len(w[0]) for w in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([w[k] for w in found]) if found else [], pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(same, pa.binary()), pa.array(size, pa.int32()),
                 *(pa.array([x[k] for x in sketches], pa.int64()) for k in range(4)), *lists], names,
            )

    return pages.mapInArrow(run, f"id {id_type}, same binary, size int, s0 long, s1 long, s2 long, s3 long, pair array<long>, third array<long>")


def parted(reps: DataFrame) -> DataFrame:
    """(part, n, word) of all windows of each page, for each segment that may hold the errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = np.repeat(b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy()))
            part, word = window_parts(*(b.column(k).flatten().to_numpy() for k in (1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(part.ravel(), pa.int64()), pa.array(np.tile(pages, SEGMENTS), pa.int64()), pa.array(word.ravel(), pa.int32())], ["part", "n", "word"])

    return reps.select("n", "pair", "third").mapInArrow(run, "part long, n long, word int")


def keyed(parts: DataFrame, near: bool = True) -> DataFrame:
    """(part, near, n, size, s0, s1): parts with the near indices that complete their keys, and their pages' sketches."""
    names = ["part", "near", "n", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), near_lists(b.column(1).to_numpy(), near), *b.columns[2:]], names)

    return parts.select("part", "word", "n", *SKETCH).mapInArrow(run, "part long, near array<short>, n long, size int, s0 long, s1 long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(n, shingles): the exact shingle set of each page (n, same, title, body) that still has the words of ``same``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sets = [], []
            for n, same, title, body in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(title, body)
                if digest(ws) == same:
                    rows.append(n)
                    sets.append(shingles(_hashes(ws)[0]).view(np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else [], pa.int64()))], ["n", "shingles"])

    return texts.mapInArrow(run, "n long, shingles array<long>")


def _differ(longs: int) -> Column:
    """Bits of the sketches in which rows ``a`` and ``b`` differ."""
    return sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(longs)), F.lit(0))


def _alike(similarity: float) -> Column:
    """Rows ``a`` and ``b`` of one part have a key in common and may be similar, by size and half of the sketch."""
    return F.arrays_overlap("a.near", "b.near") & (F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size")) & (128 - _differ(2) >= HALF_AGREE)


class Candidates:
    """Pages as distinct series of words (row numbers), with those of their keys that others have."""

    def __init__(self, docs: DataFrame, id_col: str, title_col: str, body_col: str, similarity: float, near: bool = True) -> None:
        self.similarity = similarity
        self.pages = _pages(docs, id_col, title_col, body_col)
        self.prints = stage(fingerprints(self.pages).withColumn("n", F.monotonically_increasing_id()))
        # Row numbers of the written table stand for pages until the pairs are verified.
        reps_of = self.prints.groupBy("same").agg(F.min(F.struct("id", "n")).alias("rep"))
        self.members = stage(self.prints.select("id", "same").join(reps_of, "same").select("id", F.col("rep.n").alias("rep")))
        self.names = reps_of.select("rep.n", "rep.id", "same")
        parts = parted(stage(self.prints.select("n", "pair", "third").join(self.names.select("n"), "n", "left_semi")))
        shared = parts.groupBy("part").agg(F.count("*").alias("pages")).where("pages > 1").select("part")
        self.sides = stage(keyed(parts.join(shared, "part", "left_semi").join(self.prints.select("n", *SKETCH), "n"), near))

    def pairs(self, sides: DataFrame, extra: Column | None = None) -> DataFrame:
        """(x, y), x < y: pairs of row numbers that share a key and may be similar."""
        a, b = sides.alias("a"), sides.alias("b")
        on = (F.col("a.part") == F.col("b.part")) & (F.col("a.n") < F.col("b.n")) & _alike(self.similarity)
        return a.join(b, on if extra is None else on & extra).select(F.col("a.n").alias("x"), F.col("b.n").alias("y")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(x, y, similarity) of the pairs whose exact similarity is high enough."""
        sketches = self.prints.select("n", "s0", "s1", "s2", "s3")
        a, b = sketches.alias("a"), sketches.alias("b")
        pairs = stage(pairs.join(a, F.col("x") == F.col("a.n")).join(b, F.col("y") == F.col("b.n")).where(256 - _differ(4) >= SKETCH_AGREE).select("x", "y"))
        needed = pairs.select(F.col("x").alias("n")).union(pairs.select("y")).distinct()
        texts = self.pages.join(self.names.join(needed, "n", "left_semi"), "id").select("n", "same", "title", "body")
        sets = stage(shingle_sets(texts))
        left, right = (sets.select(F.col("n").alias(k), F.col("shingles").alias(f"s{k}")) for k in "xy")
        sizes = F.size("sx") + F.size("sy")
        found = pairs.join(left, "x").join(right, "y").select("x", "y", F.size(F.array_intersect("sx", "sy")).alias("common"), sizes.alias("sizes"))
        found = found.where(F.col("common") >= F.lit(self.similarity) * (F.col("sizes") - F.col("common")))
        return found.select("x", "y", (F.col("common") / (F.col("sizes") - F.col("common"))).alias("similarity")).distinct()


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", title_col: str = "title", body_col: str = "body", similarity: float = 0.5, near: bool = True) -> DataFrame:
    """(doc_id_a, doc_id_b): every pair of rows of at least that similarity, smaller id first.

    Rows with a null id, a null or empty body, or fewer than three words have no shingles
    and are in no pair; of repeated rows of one id the pairs are those of the id. Neither
    windows, keys, candidates nor partners are capped. ``near=False`` leaves the near
    codewords out, to measure what they add.
    """
    c = Candidates(docs, id_col, title_col, body_col, similarity, near)
    found = c.verified(c.pairs(c.sides))
    x, y = (c.members.select(F.col("id").alias(k), F.col("rep").alias(k + "_rep")) for k in "xy")
    across = found.select(F.col("x").alias("x_rep"), F.col("y").alias("y_rep")).join(x, "x_rep").join(y, "y_rep").select("x", "y")
    copies = x.join(y, F.col("x_rep") == F.col("y_rep")).where("x < y").select("x", "y")
    return across.union(copies).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).where("doc_id_a <> doc_id_b").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", title_col: str = "title", body_col: str = "body", similarity: float = 0.5) -> DataFrame:
    """(id_col, group_id): one row per page that has shingles, with the least id of its group.

    Groups are those of the pairs of ``similar_pairs``, but pairs within a group are not
    listed: first each page is compared with the least page of each of its parts of keys; then
    only pages of one part that are still in different groups are compared with one another, and
    parts all of whose pages are in one group are left alone. So no link between groups is
    lost, and many near-copies of one page cost a comparison each.
    """
    c = Candidates(docs, id_col, title_col, body_col, similarity)
    leader = c.sides.groupBy("part").agg(F.min(F.struct("n", "near", *SKETCH)).alias("b"))
    star = c.sides.alias("a").join(leader, "part").where((F.col("a.n") > F.col("b.n")) & _alike(similarity))
    links = stage(c.verified(star.select(F.col("b.n").alias("x"), F.col("a.n").alias("y")).distinct()).select("x", "y"))
    group = stage(components(links, "x", "y").select(F.col("node").alias("n"), F.col("component").alias("g")))
    sides = stage(c.sides.join(group, "n", "left").withColumn("g", F.coalesce("g", "n")))
    mixed = sides.groupBy("part").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("part")
    rest = c.verified(c.pairs(sides.join(mixed, "part", "left_semi"), F.col("a.g") != F.col("b.g"))).select("x", "y")
    group = components(stage(links.union(rest)), "x", "y").withColumnRenamed("node", "rep")
    ids = stage(c.members.join(group, "rep", "left").select("id", F.coalesce("component", "rep").alias("g")))
    least = ids.groupBy("g").agg(F.min("id").alias("group_id"))
    return ids.join(least, "g").select(F.col("id").alias(id_col), "group_id").distinct()
