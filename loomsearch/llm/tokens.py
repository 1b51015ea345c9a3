"""Token ids of a whole corpus with a public byte-level BPE tokenizer.

Short texts are encoded where they are read, without a shuffle. Long texts go through tree
concatenation: halves of a text are encoded in parallel as separate rows, and neighbours are
joined level by level. Most halves are cut where every pre-token ends anyway, so their ids
are simply concatenated. Inside a long unsplit stretch (one pre-token) the cut falls within a
merge sequence; there a window of tokens around the join is encoded again and grows until its
first token agrees with the left side and its last one with the right side. A token sequence
is the encoding of its bytes exactly if each neighbouring pair is the encoding of its own two
pieces of text, so agreement at both ends makes the joined sequence exact.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 4096
#: A cut inside a stretch has this many characters of one class on both sides.
MARGIN = 16

_pre = regex.compile(PATTERN)
#: Places where every pre-token ends, whatever stands around them.
_safe = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)|(?<=[^\s\p{L}\p{N}])(?=\p{N})")
_runs = regex.compile(r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}]+")


@lru_cache(maxsize=4)
def encoder(vocab: str = VOCAB):
    """The tokenizer, once per Python worker."""
    import tiktoken

    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _middle(text: str, margin: int = MARGIN) -> tuple[int, bool]:
    """Where to halve a text, and whether the cut is inside a pre-token (hard)."""
    half, n = len(text) // 2, len(text)
    width = max(4 * margin, 64)
    while True:
        a, b = max(0, half - width), min(n, half + width)
        cuts = [m.start() for m in _safe.finditer(text, a, b) if 0 < m.start() < n]
        if cuts:
            return min(cuts, key=lambda c: abs(c - half)), False
        runs = [m.span() for m in _runs.finditer(text, a, b)]
        s, e = max(runs, key=lambda r: r[1] - r[0])
        if e - s >= 2 * margin + 2:
            return min(max(half, s + margin), e - margin), True
        if a == 0 and b == n:
            return 0, False
        width *= 2


def leaves(text: str, leaf: int = LEAF) -> list[tuple[bool, str]]:
    """(hard cut on the left, text) of each leaf, in order; halves until ``leaf`` characters."""
    out, todo = [], [(False, text)]
    while todo:
        hard, part = todo.pop()
        at, inside = _middle(part) if len(part) > leaf else (0, False)
        if at:
            todo += [(inside, part[at:]), (hard, part[:at])]
        else:
            out.append((hard, part))
    return out


def encode_leaf(text: str, vocab: str = VOCAB) -> tuple[list[int], int, int]:
    """Ids of a leaf with the numbers of tokens in its first and its last pre-token."""
    enc = encoder(vocab)
    ids = enc.encode_ordinary(text)
    first = last = None
    for m in _pre.finditer(text):
        first, last = first or m, m
    if first is None:
        return ids, 0, 0
    return ids, len(enc.encode_ordinary(first.group())), len(enc._encode_single_piece(last.group()))


def stitch(left: list[int], right: list[int], vocab: str = VOCAB, window: int = 8) -> list[int]:
    """Encoding of one unsplit stretch from those of its two parts."""
    enc = encoder(vocab)
    while True:
        a, b = left[-window:], right[:window]
        mid = enc._encode_single_piece(enc.decode_bytes(a) + enc.decode_bytes(b))
        if (window >= len(left) or mid[0] == a[0]) and (window >= len(right) or mid[-1] == b[-1]):
            return left[: max(0, len(left) - window)] + mid + right[window:]
        window *= 2


def join_nodes(left: dict, right: dict, vocab: str = VOCAB) -> dict:
    """Concatenate two neighbouring nodes {hard, ids, head, tail} of one text's tree."""
    li, ri = list(left["ids"]), list(right["ids"])
    if not li or not ri or not right["hard"]:
        head = left["head"] if li else right["head"]
        return {"hard": left["hard"], "ids": li + ri, "head": head, "tail": right["tail"] if ri else left["tail"]}
    lt, rh = left["tail"], right["head"]
    mid = stitch(li[len(li) - lt :], ri[:rh], vocab)
    return {
        "hard": left["hard"],
        "ids": li[: len(li) - lt] + mid + ri[rh:],
        "head": len(mid) if lt == len(li) else left["head"],
        "tail": len(mid) if rh == len(ri) else right["tail"],
    }


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, leaf: int = LEAF) -> DataFrame:
    """(id_col, ids): the token ids of every row's text, without special tokens.

    A null or empty text gives an empty list, a null id is kept, repeated rows give a row
    each, other columns are ignored. Texts of any length are encoded whole; those over two
    leaves go through the tree, whose depth follows from the longest text.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text"), F.lit(0)) > 2 * leaf

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            rows = [enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(rows)], ["id", "ids"])

    short = docs.where(~is_long).mapInArrow(whole, f"id {id_type}, ids array<int>")
    long_docs = docs.where(is_long)
    longest = long_docs.agg(F.max(F.length("text"))).first()[0]
    if longest is None:
        return short.withColumnRenamed("id", id_col)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row, text in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                parts = leaves(text, leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()] * len(parts), b.schema.field(0).type), pa.array([row.as_py()] * len(parts), pa.int64()),
                     pa.array(range(len(parts)), pa.int32()), pa.array([h for h, _ in parts]), pa.array([t for _, t in parts], pa.string())],
                    ["id", "row", "node", "hard", "text"],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [encode_leaf(t, vocab) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], _lists([d[0] for d in done]), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())], names
            )

    names = ["id", "row", "node", "hard", "ids", "head", "tail"]
    shape = f"id {id_type}, row long, node int, hard boolean, ids array<int>, head int, tail int"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for kids in b.column(3).to_pylist():
                done.append(join_nodes(*kids, vocab) if len(kids) == 2 else kids[0])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([d["hard"] for d in done]), _lists([d["ids"] for d in done]), pa.array([d["head"] for d in done], pa.int32()), pa.array([d["tail"] for d in done], pa.int32())], names
            )

    numbered = long_docs.select("id", F.monotonically_increasing_id().alias("row"), "text")
    nodes = (
        numbered.mapInArrow(split, f"id {id_type}, row long, node int, hard boolean, text string")
        .repartition("row", "node")
        .mapInArrow(encode, shape)
    )
    # A cut can fall off the middle, so a text may have somewhat more leaves than its length says.
    for _ in range(math.ceil(math.log2(longest / leaf)) + 2):
        nodes = (
            nodes.groupBy("row", (F.col("node") / 2).cast("int").alias("node"))
            .agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("node", "hard", "ids", "head", "tail"))).alias("kids"))
            .select("id", "row", "node", F.transform("kids", lambda k: F.struct(k["hard"].alias("hard"), k["ids"].alias("ids"), k["head"].alias("head"), k["tail"].alias("tail"))).alias("kids"))
            .mapInArrow(merge, shape)
        )
    return short.unionByName(nodes.select("id", "ids")).withColumnRenamed("id", id_col)
