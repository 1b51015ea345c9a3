"""Main content of pages by wrapper induction over pages of one host.

A page is a tree: the page, its lines with a shape for a tag, their words. Pages of a host
are put into groups of bounded size, copies and near-copies enter once, and a group's
template is induced: lines of one shape whose words match in order form a node, nodes stand in
the order of their places in the pages, and each page is aligned with this sequence by simple
tree matching (the heaviest ordered matching). A node to which enough of the group's different
pages are aligned is constant and becomes template; every other line is a varying slot. A
page's own lines are then told by its host's template: lines of a constant node are cut,
running text and list items in varying slots are article unless they plainly consist of
words of other hosts' templates.

Where a host has too few different pages for that, and for short sentences in varying slots
(prompts and notes that a page has by itself), the words decide: those of all templates' constant
nodes and of all varying paragraphs are counted in a hashed table of fixed size, and each
line gets the log-odds of its words. The page's headline and its headings are article; menus,
bylines, tags and lists of links in varying slots are neither running text nor list items.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.plans.runtime import stage

#: Pages of a host that are aligned with one another.
GROUP = 48
#: Parts into which a host's pages are spread while they learn their host's number of groups.
SPREAD = 64
#: A node is constant if this many different pages of its group have it, and this share of the group.
CONSTANT, CONSTANT_SHARE = 3, 0.25
#: Different pages that a group needs for its template to decide.
LEAST_PAGES = 4
#: Share of the words of two lines, in order, that is common if they belong to one node; lines of
#: more than ``LONG_WORDS`` words are compared by their words without the order.
SAME_NODE, LONG_WORDS = 0.8, 200
#: A varying slot is filled by other hosts' template words if its log-odds are not above this.
VARYING_LEAST = -1.5
#: Pages are near-copies if this share of their word pairs is common, the rare ones of a group weighing most.
NEAR_COPY = 0.4
#: Words and word pairs are counted in this many hashed cells.
CELLS = 1 << 18
#: Words of a line of running text.
LONG_LINE = 12

_word = re.compile(r"[^\W\d_]+|\d+")
_mark = re.compile(r"^\s*[-*•–]\s+")
_end = re.compile(r"[.!?…。]['\"»”)]*\s*$")


def line_words(line: str) -> list[str]:
    """Lower-case words, every number written 0."""
    return ["0" if w[0].isdigit() else w for w in _word.findall(line.lower())]


def shape(line: str, words: list[str]) -> str:
    """What stands for the line's tag: list item, running text, sentence, or other."""
    if _mark.match(line):
        return "li"
    if _end.search(line):
        return "p" if len(words) >= LONG_LINE else "s"
    return "x"


def common_series(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for n, y in enumerate(b, 1):
            row[n], before = (before + 1 if x == y else max(row[n], row[n - 1])), row[n]
    return row[-1]


class Nodes:
    """Lines of pages as nodes: a node's first line stands for it, later ones join the likest."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.first: list[tuple[list[str], frozenset[str]]] = []
        self.having: dict[str, dict[str, list[int]]] = {}

    def find(self, shape: str, words: list[str], add: bool = False) -> int:
        """Number of the line's node, -1 if it is like none; ``add`` makes it one of its own then."""
        key = (shape, *words)
        if key in self.known:
            return self.known[key]
        kinds, size, having = frozenset(words), len(words), self.having.setdefault(shape, {})
        # Lines with that much in common share one of any so many words; new words are had by none.
        known = [w for w in kinds if w in having]
        some = int((1 - SAME_NODE) * size) + 1 - (len(kinds) - len(known))
        rarest = [w for _, w in sorted([(len(having[w]), w) for w in known])[:some]] if some > 0 else []
        best, node, twice = 0.0, -1, size - len(kinds)
        for n in sorted({n for w in rarest for n in having[w]}):
            other, its = self.first[n]
            shortest, longest = (size, len(other)) if size < len(other) else (len(other), size)
            least = SAME_NODE * longest
            # Words that a line has twice are the most that its words' kinds leave out.
            if shortest < least or len(kinds & its) + twice < least:
                continue
            c = (Counter(words) & Counter(other)).total() if longest > LONG_WORDS else common_series(words, other)
            if c >= least and c / longest > best:
                best, node = c / longest, n
        if node < 0 and add:
            node = len(self.first)
            self.first.append((words, kinds))
            for w in kinds:
                having.setdefault(w, []).append(node)
        if node >= 0:
            self.known[key] = node
        return node


def tree_match(lines: list[tuple[int, float]], place: dict[int, int]) -> list[int]:
    """Simple tree matching of a page's lines (node, weight) with a template: the lines of the heaviest
    series whose nodes stand in the order of ``place``, each node once."""
    size = len(place) + 1
    tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)
    before = [-1] * len(lines)
    for n, (node, weight) in enumerate(lines):
        at = place.get(node, -1) + 1
        if not at:
            continue
        best, k = (0.0, -1), at - 1
        while k > 0:
            best, k = max(best, tree[k]), k - (k & -k)
        before[n] = best[1]
        k, mine = at, (best[0] + weight, n)
        while k <= size:
            tree[k], k = max(tree[k], mine), k + (k & -k)
    k, best = size, (0.0, -1)
    while k > 0:
        best, k = max(best, tree[k]), k - (k & -k)
    out, n = [], best[1]
    while n >= 0:
        out.append(n)
        n = before[n]
    return out[::-1]


def cells(words: Sequence[str], cache: dict[str, int]) -> list[int]:
    """Hashed cells of a line's words and pairs of neighbouring words."""
    out = []
    for w in [*words, *map(" ".join, zip(words, words[1:]))]:
        c = cache.get(w)
        if c is None:
            if len(cache) > 1_000_000:
                cache.clear()
            c = cache[w] = xxhash.xxh3_64_intdigest(w) % CELLS
        out.append(c)
    return out


def page_lines(body: str) -> list[tuple[int, str, list[str], str]]:
    """(number from 1, line, words, shape) of the non-empty lines."""
    out = []
    for n, line in enumerate(body.split("\n"), 1):
        if line.strip():
            ws = line_words(line)
            out.append((n, line, ws, shape(line, ws)))
    return out


def different(pages: list[str], words: dict[str, list[str]] | None = None) -> list[str]:
    """One page of each set of copies and near-copies, in an order that is not that of their words."""
    pages = sorted(set(pages), key=lambda p: (xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")), p))
    sets = []
    for p in pages:
        ws = words[p] if words else line_words(p)
        sets.append(frozenset(zip(ws, ws[1:])))
    # What all pages of a host have weighs next to nothing, so a large template makes no near-copies.
    df: Counter = Counter()
    for s in sets:
        df.update(s)
    # Pairs that one page has by itself count in its weight, but no two pages have them in common.
    one = math.log(len(pages) + 1)
    weight = {x: math.log((len(pages) + 1) / n) for x, n in df.items() if n > 1}
    shared = [s & weight.keys() for s in sets]
    most = [sum(map(weight.__getitem__, s)) for s in shared]
    total = [m + one * (len(s) - len(x)) for m, s, x in zip(most, sets, shared)]
    root = list(range(len(pages)))

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for j in range(len(pages)):
        for i in range(j):
            # The least weight in common that makes near-copies, a little less for rounding.
            least = NEAR_COPY / (1 + NEAR_COPY) * (total[i] + total[j]) * (1 - 1e-9)
            if most[i] >= least and most[j] >= least and find(i) != find(j):
                both = sum(map(weight.__getitem__, shared[i] & shared[j]))
                if both and both >= NEAR_COPY * (total[i] + total[j] - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [p for n, p in enumerate(pages) if find(n) == n]


def group_labels(pages: list[str]) -> tuple[list[str | None], list[list[str]], list[list[str]]]:
    """Of one group of a host's pages: a letter for each non-empty line of each page, ``t`` for template and
    ``v`` for a varying slot (None if the pages are too few), and words of constant and of varying lines."""
    lines = {p: [(ws, s) for _, _, ws, s in page_lines(p)] for p in set(pages)}
    trees = [[(ws, s) for ws, s in lines[p] if ws] for p in different(pages, {p: [w for ws, _ in x for w in ws] for p, x in lines.items()})]
    often = Counter(x for tree in trees for x in {(s, *ws) for ws, s in tree})
    nodes = Nodes()
    # What most pages have comes first, so that it stands for its node.
    for s, *ws in sorted(often, key=lambda x: (-often[x], x)):
        nodes.find(s, ws, add=True)
    of = [[nodes.find(s, ws) for ws, s in tree] for tree in trees]
    pages_of, at = Counter(n for own in of for n in set(own)), Counter()
    for own in of:
        seen: set[int] = set()
        for k, n in enumerate(own):
            if n not in seen:
                seen.add(n)
                at[n] += (k + 0.5) / len(own)
    place = {n: k for k, n in enumerate(sorted((n for n in at if pages_of[n] > 1), key=lambda n: (at[n] / pages_of[n], n)))}
    aligned: Counter = Counter()
    for own, tree in zip(of, trees):
        aligned.update({own[k] for k in tree_match([(n, 1.0 + len(ws)) for n, (ws, _) in zip(own, tree)], place)})
    least = max(CONSTANT, CONSTANT_SHARE * len(trees))
    template = [ws for own, tree in zip(of, trees) for n, (ws, _) in zip(own, tree) if aligned[n] >= least]
    content = [ws for own, tree in zip(of, trees) for n, (ws, s) in zip(own, tree) if pages_of[n] == 1 and s == "p"]
    if len(trees) < LEAST_PAGES:
        return [None] * len(pages), template, content
    labels = []
    for p in pages:
        found = (nodes.find(s, ws) if ws else -1 for ws, s in lines[p])
        labels.append("".join("t" if n >= 0 and aligned[n] >= least else "v" for n in found))
    return labels, template, content


def is_headline(words: list[str], title: list[str]) -> bool:
    """The line is the title but for a site's name, a note or a typing error in either."""
    if not words or not title:
        return False
    c = common_series(words, title)
    return c >= min(2, len(words)) and 10 * c >= 6 * len(words) and 2 * c >= len(title)


def line_score(words: list[str], odds: np.ndarray, cache: dict[str, float]) -> float:
    """Mean log-odds of a line's words and word pairs; lines without words are furniture."""
    if not words:
        return -9.0
    total = 0.0
    for w in [*words, *map(" ".join, zip(words, words[1:]))]:
        v = cache.get(w)
        if v is None:
            if len(cache) > 1_000_000:
                cache.clear()
            v = cache[w] = float(odds[xxhash.xxh3_64_intdigest(w) % CELLS])
        total += v
    return total / (2 * len(words) - 1)


def article_lines(title: str | None, body: str, headings: list[str] | None, labels: str | None, odds: np.ndarray, cache: dict[str, float]) -> list[int]:
    """Numbers of the lines that belong to the article; ``labels`` are the letters of ``group_labels``."""
    lines = page_lines(body)
    heads = {tuple(line_words(h)) for h in headings or [] if h}
    top = line_words(title or "")
    score = lambda n: line_score(lines[n][2], odds, cache)
    main = []
    for n, (_, line, ws, s) in enumerate(lines):
        if labels and (labels[n] == "t" or s in ("p", "li")):
            main.append(labels[n] == "v" and bool(ws) and score(n) > VARYING_LEAST)
            continue
        # A full sentence may be about a template's subject; text that lost its end is still text.
        least = {"p": 0.0, "li": 0.0, "s": 0.0 if line.rstrip().endswith(".") else 1.0, "x": 1.0}[s]
        if s == "s" and len(ws) >= 8 and line.rstrip().endswith("."):
            least = -2.0
        main.append((s != "x" or len(ws) >= LONG_LINE) and score(n) > least)
    first = next((n for n, (m, (_, _, _, s)) in enumerate(zip(main, lines)) if m and s in "px"), len(lines))
    out, headline = [], False
    for n, (number, _, ws, s) in enumerate(lines):
        if main[n] or tuple(ws) in heads:
            out.append(number)
        elif s != "li" and n < first and is_headline(ws, top):
            out.append(number)
            headline = True
    if not headline and not top:
        # Without a title the headline is the last line of content words before the text.
        for n in range(first - 1, -1, -1):
            number, _, ws, s = lines[n]
            least = -0.6 if len(ws) >= 6 and "|" not in lines[n][1] else 0.0
            if s in "xs" and len(ws) >= 3 and number not in out and score(n) > least:
                out.append(number)
                break
    return sorted(set(out))


def grouped(pages: DataFrame) -> DataFrame:
    """(domain, pages): groups of different bodies of one host."""
    hosts = pages.where(F.col("domain").isNotNull() & (F.length("body") > 0)).select("domain", "body").distinct().withColumn("h", F.xxhash64("body"))
    hosts = hosts.withColumn("part", F.pmod(F.shiftright("h", 32), F.lit(SPREAD)))
    groups = hosts.groupBy("domain").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("groups")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<long>")))
    # Without its own exchange the grouping would take over the join's, a whole host in one task.
    placed = hosts.join(groups, ["domain", "part"]).select("domain", F.pmod("h", "groups").alias("group"), "body", "h").repartition("domain", "group")
    return placed.groupBy("domain", "group").agg(F.collect_list(F.struct("body", "h")).alias("pages")).select("domain", "pages")


def induced(groups: DataFrame) -> DataFrame:
    """(domain, h, labels, cell, template, content): labels of each page of a group by the hash of its body,
    and in rows without a domain the counts of words by hashed cell."""
    names = ["domain", "h", "labels", "cell", "template", "content"]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        total = np.zeros((2, CELLS), dtype=np.int64)
        for b in batches:
            rows = []
            for domain, pages in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                labels, *words = group_labels([p["body"] for p in pages])
                rows += [(domain, p["h"], x) for p, x in zip(pages, labels) if x]
                for side, lines in enumerate(words):
                    # Lines that pages repeat are hashed once.
                    often = [(cells(ws, cache), n) for ws, n in Counter(map(tuple, lines)).items()]
                    at = np.array([c for own, _ in often for c in own], dtype=np.int64)
                    np.add.at(total[side], at, np.repeat(np.array([n for _, n in often], dtype=np.int64), [len(own) for own, _ in often]))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[n] for r in rows], kinds[n]) for n in range(3)), *(pa.nulls(len(rows), k) for k in kinds[3:])], names)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), k) for k in kinds[:3]), pa.array(at, pa.int32()), pa.array(total[0][at]), pa.array(total[1][at])], names)

    return groups.mapInArrow(run, "domain string, h long, labels string, cell int, template long, content long")


def learned(found: DataFrame) -> np.ndarray:
    """Log-odds of content against template by hashed cell, counted over all groups of pages."""
    # One row a cell: bounded by CELLS, whatever the corpus.
    rows = found.where("cell is not null").groupBy("cell").agg(F.sum("template").alias("t"), F.sum("content").alias("c")).toPandas()
    t, c = np.zeros(CELLS), np.zeros(CELLS)
    t[rows["cell"]], c[rows["cell"]] = rows["t"], rows["c"]
    return log_odds(t, c)


def log_odds(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Zero for cells never seen, and near zero for rare ones."""
    share = c.sum() / max(1.0, t.sum() + c.sum())
    a, b = c + share, t + (1 - share)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(a / a.sum()) - np.log(b / b.sum())
    return np.nan_to_num(odds - (np.log(share / (1 - share)) - np.log(a.sum() / b.sum()) if 0 < share < 1 else 0.0), nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)


def article(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, unit, pos): lines and chunks of each page that belong to its article.

    ``unit`` is ``line`` (numbered from 1 after splitting ``body`` at line feeds) or ``chunk``
    (elements of ``chunks`` from 1 that hold such a line). A page with a null or empty body
    gives no rows; null titles, headings and chunks are allowed, as are pages without a
    domain, which take no part in the alignment. Repeated rows give repeated results.
    """
    pages = docs.select(F.col(id_col).alias("id"), "title", "body", "headings", "chunks", "domain")
    found = stage(induced(grouped(pages)))
    odds = docs.sparkSession.sparkContext.broadcast(learned(found))
    labels = found.where("labels is not null").select("domain", "h", "labels")
    id_type = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            rows = []
            for i, title, body, headings, chunks, known in zip(*(c.to_pylist() for c in b.columns)):
                own = article_lines(title, body, headings, known, odds.value, cache)
                lines = body.split("\n")
                texts = {lines[n - 1].strip() for n in own}
                rows += [(i, "line", n) for n in own]
                rows += [(i, "chunk", n) for n, c in enumerate(chunks or [], 1) if c and any(x.strip() in texts for x in c.split("\n"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["id", "unit", "pos"])

    usable = pages.where(F.length("body") > 0).withColumn("h", F.xxhash64("body")).join(labels, ["domain", "h"], "left").select("id", "title", "body", "headings", "chunks", "labels")
    return usable.mapInArrow(run, f"id {id_type}, unit string, pos int").withColumnRenamed("id", id_col)


def article_text(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text): the article of every page, empty where none is found, null for a null body."""
    found = article(docs, id_col).where("unit = 'line'").groupBy(F.col(id_col).alias("_id")).agg(F.collect_set("pos").alias("_own"))
    joined = docs.select(F.col(id_col), F.col("body").alias("_body")).join(found, F.col(id_col) == F.col("_id"), "left")
    kept = F.filter(F.split("_body", "\n", -1), lambda x, i: F.coalesce(F.array_contains("_own", i + 1), F.lit(False)))
    return joined.select(id_col, F.array_join(kept, "\n").alias("text"))
