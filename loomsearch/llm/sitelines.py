"""Lines repeated across one source's documents, found through content-defined chunks.

The normalised text of a document is cut where a rolling hash of the last ``WINDOW`` bytes
hits a mask, wherever line breaks are. A chunk whose cuts both depend on one line's bytes
alone comes out the same wherever that line stands; each line is represented by the least of
its chunks (a line too short to hold one, by itself). Distinct documents are counted for each
chunk and source; only lines whose chunk is repeated in enough documents go on, and an exact
count of these lines by their whole content decides. A line in N documents has its chunk in
at least N, so no repeated line is lost; most text never reaches the exact count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.plans.runtime import stage

WINDOW = 8
#: A cut at one in 32 positions on average.
MASK = np.uint64(31)
_P = np.uint64(0x9E3779B97F4A7C15)
_digits = re.compile(r"\d+")


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _P)


def normal_line(line: str) -> str:
    """Lower case, each run of white space one blank, trimmed, each run of digits one 0."""
    return _digits.sub("0", " ".join(line.lower().split()))


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions where chunks end, from the rolling hash of the ``WINDOW`` bytes before."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    table = _BYTES[data]
    h = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = h * _P + table[k : n - WINDOW + 1 + k]
    return np.flatnonzero((_mix(h) & MASK) == 0) + WINDOW


def line_chunks(lines: list[str]) -> list[int]:
    """The representing chunk hash of each (normalised, non-empty) line of one text."""
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    ends = np.cumsum([len(x) + 1 for x in raw])
    starts = ends - [len(x) + 1 for x in raw]
    joined = b"\n".join(raw)
    at = cuts(np.frombuffer(joined, dtype=np.uint8))
    # Cuts of a line alone: the window lies within it. Chunks lie between two of these.
    lo = np.searchsorted(at, starts + WINDOW)
    hi = np.searchsorted(at, ends - 1, side="right")
    out = []
    for x, a, b in zip(raw, lo, hi):
        if b - a < 2:
            out.append(xxhash.xxh3_64_intdigest(x) - (1 << 63))
        else:
            own = at[a:b].tolist()
            out.append(min(xxhash.xxh3_64_intdigest(joined[s:e]) for s, e in zip(own, own[1:])) - (1 << 63))
    return out


def line_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, line_no, chunk, line): non-empty lines with the hashes of chunk and line."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sources, numbers, chunks, hashes = [], [], [], [], []
            for i, source, text in zip(*(c.to_pylist() for c in b.columns)):
                lines = [(n, x) for n, x in ((n, normal_line(x)) for n, x in enumerate(text.split("\n"), 1)) if x]
                if not lines:
                    continue
                chunks += line_chunks([x for _, x in lines])
                hashes += [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for _, x in lines]
                numbers += [n for n, _ in lines]
                ids += [i] * len(lines)
                sources += [source] * len(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(sources, b.schema.field(1).type), pa.array(numbers, pa.int32()), pa.array(chunks, pa.int64()), pa.array(hashes, pa.binary())],
                ["id", "source", "line_no", "chunk", "line"],
            )

    usable = docs.where(F.col("id").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0))
    return usable.mapInArrow(run, f"id {kinds['id']}, source {kinds['source']}, line_no int, chunk long, line binary")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body", source_col: str = "domain", least: int = 8) -> DataFrame:
    """(id_col, line_no): lines that occur in at least ``least`` documents of their source.

    Rows with a null id, source or text give nothing; a document given by several rows counts
    once. Counting is by (source, chunk) and then (source, line, document), so a source or a
    line that holds a third of all rows is spread over tasks and combined before it moves.
    """
    rows = stage(line_rows(docs, id_col, text_col, source_col))
    hot = (
        rows.groupBy("source", "chunk", "id").agg(F.lit(1).alias("one")).groupBy("source", "chunk").agg(F.count("*").alias("docs"))
        .where(F.col("docs") >= least).select("source", "chunk")
    )
    candidates = rows.join(hot, ["source", "chunk"], "left_semi")
    repeated = (
        candidates.groupBy("source", "line", "id").agg(F.lit(1).alias("one")).groupBy("source", "line").agg(F.count("*").alias("docs"))
        .where(F.col("docs") >= least).select("source", "line")
    )
    return candidates.join(repeated, ["source", "line"], "left_semi").select(F.col("id").alias(id_col), "line_no").distinct()


def without_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body", source_col: str = "domain", least: int = 8) -> DataFrame:
    """(id_col, text, removed): every text without its repeated lines, and how many went.

    A null text stays null; a text all of whose lines repeat becomes empty.
    """
    found = repeated_lines(docs, id_col, text_col, source_col, least).groupBy(F.col(id_col).alias("_id")).agg(F.collect_set("line_no").alias("_cut"))
    base = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    joined = base.join(found, F.col(id_col) == F.col("_id"), "left")
    kept = F.filter(F.split("_text", "\n", -1), lambda x, i: F.coalesce(~F.array_contains("_cut", i + 1), F.lit(True)))
    return joined.select(id_col, F.array_join(kept, "\n").alias("text"), F.coalesce(F.size("_cut"), F.lit(0)).alias("removed"))
