"""Terms, lexical scoring, passages and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.plans.runtime import stage

K1, B = 1.2, 0.75


def words(text: Column | str) -> Column:
    """Lower-case words of letters a-z and digits, empties dropped; null for a null text."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def postings(docs: DataFrame, id_col: str, fields: list[Column]) -> DataFrame:
    """(field, id, term, tf, len): how often each term is in each field of a document, combined before the shuffle."""
    split = docs.select(F.col(id_col).alias("id"), F.posexplode(F.array(*[words(f) for f in fields])).alias("field", "w"))
    exploded = split.select("field", "id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return exploded.groupBy("field", "id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text: Column | list[Column]) -> DataFrame:
    """(query_id, id, score): BM25 of every document that has a term of a query, summed over its fields.

    ``queries`` are (query_id, term) rows, distinct. Corpus statistics cover all documents, for
    each field by itself; only postings of terms that some query has are moved. Null and empty
    texts count as documents of length 0.
    """
    fields = text if isinstance(text, list) else [text]
    lengths = docs.select(F.posexplode(F.array(*[F.coalesce(F.size(words(F.coalesce(f, F.lit("")))), F.lit(0)) for f in fields])).alias("field", "len"))
    stats = lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    asked = queries.select("term").distinct()
    hits = stage(postings(docs, id_col, fields).join(asked, "term", "left_semi"))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats), "field").select("field", "term", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    weight = hits.join(idf, ["field", "term"]).select("term", "id", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("weight"))
    return weight.join(queries, "term").groupBy("query_id", "id").agg(F.sum("weight").alias("score"))


def _counted(docs: DataFrame, id_col: str, fields: list[Column], static: Column, terms: Broadcast) -> DataFrame:
    """(id, static, lens, keys, tfs): of each document the fields' lengths and the counts of asked terms, by field and term number."""
    n = len(fields)
    rows = docs.select(F.col(id_col).alias("id"), static.cast("double").alias("static"), *[F.coalesce(words(f), F.array().cast("array<string>")).alias(f"w{i}") for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms.value, pa.string())
        size = max(len(known), 1)
        for b in batches:
            rows, keys, lens = [], [], np.empty((b.num_rows, n), np.int32)
            for f in range(n):
                column = b.column(f + 2)
                lens[:, f] = pc.list_value_length(column).to_numpy(zero_copy_only=False)
                at = pc.index_in(column.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), lens[:, f])
                rows.append(row[at >= 0])
                keys.append(at[at >= 0].astype(np.int64) + f * size)
            pair, tf = np.unique(np.concatenate(rows) * (n * size) + np.concatenate(keys), return_counts=True)
            ends = np.searchsorted(pair, np.arange(b.num_rows + 1) * (n * size)).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32()))
            fixed = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * n), pa.array(lens.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fixed, listed(pair % (n * size)), listed(tf)], ["id", "static", "lens", "keys", "tfs"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, static double, lens array<int>, keys array<int>, tfs array<int>")


def best_lexical(docs: DataFrame, queries: DataFrame, id_col: str, fields: list[Column], k: int, static: Column | None = None, most: int = 5_000_000) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query by BM25 summed over fields.

    With ``static``, a score of each document by itself, the rank is by lexical / (lexical + 12)
    plus it (null as 0). Documents without a term of the query are no result. Queries are (query_id, term)
    rows. Up to ``most`` of them go to every task, which scores its documents where they are and
    passes on only those that can be among a query's k best, so that neither postings nor scored
    pairs are shuffled; more queries take the joins of ``bm25``, with the same result.
    """
    fixed = F.lit(0.0) if static is None else F.coalesce(static, F.lit(0.0))
    asked = stage(queries.where("query_id is not null and term is not null").select("query_id", "term").distinct())
    if asked.count() > most:
        scored = bm25(docs, asked, id_col, fields)
        if static is not None:
            scored = scored.join(docs.select(F.col(id_col).alias("id"), fixed.alias("static")), "id").select("query_id", "id", (F.col("score") / (F.col("score") + 12) + F.col("static")).alias("score"))
        return top_per_query(scored, k)
    sc = docs.sparkSession.sparkContext
    pairs = asked.toPandas()
    terms, names = sorted(set(pairs["term"])), sorted(set(pairs["query_id"]))
    place = {t: n for n, t in enumerate(terms)}
    number = {q: n for n, q in enumerate(names)}
    q_of, t_of = np.array([number[q] for q in pairs["query_id"]], np.int64), np.array([place[t] for t in pairs["term"]], np.int64)
    counted = stage(_counted(docs, id_col, fields, fixed, sc.broadcast(terms)))
    size = max(len(terms), 1)
    # Both are as small as the asked terms and the fields.
    df, idf = dict(counted.select(F.explode("keys").alias("key")).groupBy("key").count().collect()), np.zeros(size * len(fields))
    stats = counted.agg(F.count("*"), *[F.avg(F.get("lens", F.lit(f))) for f in range(len(fields))]).first()
    for key, n in df.items():
        idf[key] = np.log(1 + (stats[0] - n + 0.5) / (n + 0.5))
    average = np.array([x or 1.0 for x in stats[1:]])
    blocks = []
    for first in range(0, len(names), 2048):
        mine = (q_of >= first) & (q_of < first + 2048)
        order = np.argsort(t_of[mine], kind="stable")
        blocks.append((first, min(2048, len(names) - first), (q_of[mine] - first)[order], np.searchsorted(t_of[mine][order], np.arange(size + 1))))
    shared, with_static = sc.broadcast((blocks, idf, average, names)), static is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, idf, average, names = shared.value
        floor = [np.full(b[1], -np.inf) for b in blocks]
        labels = pa.array(names, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                count = pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False)
                key, tf = (b.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in (3, 4))
                doc = np.repeat(np.arange(b.num_rows), count)
                lens = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                field = key // size
                weight = idf[key] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[doc, field] / average[field]))
                cell, slot = np.unique(key % size * b.num_rows + doc, return_inverse=True)
                weight = np.bincount(slot, weight, len(cell))
                term, doc = cell // b.num_rows, cell % b.num_rows
                starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
                for (first, width, queries_of, ptr), least in zip(blocks, floor):
                    score = np.zeros((width, b.num_rows))
                    for s, e in zip(starts, [*starts[1:], len(term)]):
                        qs = queries_of[ptr[term[s]] : ptr[term[s] + 1]]
                        if len(qs):
                            score[np.ix_(qs, doc[s:e])] += weight[s:e]
                    hit = score > 0
                    if with_static:
                        score = score / (score + 12) + b.column(1).to_numpy(zero_copy_only=False)
                    score[~hit] = -np.inf
                    if b.num_rows >= k:
                        np.maximum(least, np.partition(score, b.num_rows - k, axis=1)[:, b.num_rows - k], out=least)
                    # Ranks are by rounded scores, so those just below are passed on too.
                    q, d = np.nonzero(hit & (score >= least[:, None] - 2e-6))
                    yield pa.RecordBatch.from_arrays([labels.take(pa.array(q + first)), b.column(0).take(pa.array(d)), pa.array(score[q, d])], ["query_id", "id", "score"])

    found = counted.mapInArrow(run, f"query_id string, id {counted.schema['id'].dataType.simpleString()}, score double")
    return top_per_query(found, k)


def top_per_query(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best documents of each query, by score rounded to six places and then id."""
    w = Window.partitionBy("query_id").orderBy(F.round(score, 6).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def passages(docs: DataFrame, id_col: str, query: Column, chunks: Column, k: int = 3) -> DataFrame:
    """(id, pos, score): the k passages with most query words over the root of their length, in document order.

    Query words of three letters or more count; a passage without one scores 0.
    """
    asked = F.filter(words(query), lambda w: F.length(w) > 2)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(asked, F.array().cast("array<string>")).alias("asked"), F.posexplode(chunks).alias("pos", "chunk"))
    # Empty pieces of the split count in a passage's length.
    pieces = F.split(F.lower(F.coalesce("chunk", F.lit(""))), "[^a-z0-9]+")
    scored = base.select("id", "pos", (F.size(F.filter(pieces, lambda w: F.array_contains("asked", w))) / F.sqrt(F.size(pieces).cast("double"))).alias("score"))
    best = Window.partitionBy("id").orderBy(F.round("score", 9).desc(), "pos")
    return scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def overlapping_chunks(docs: DataFrame, id_col: str, text: Column, size: int = 400, step: int = 320) -> DataFrame:
    """(id, chunk_no, n_words, first_word, last_word): windows of ``size`` words, the next begins ``step`` on."""
    w = docs.select(F.col(id_col).alias("id"), words(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - (size - step), F.lit(0)), F.lit(step))
    rows = w.select("id", "w", F.posexplode(starts).alias("chunk_no", "start"))
    part = F.slice("w", F.col("start") + 1, size)
    return rows.select("id", "chunk_no", F.size(part).alias("n_words"), F.element_at(part, 1).alias("first_word"), F.element_at(part, -1).alias("last_word"))
