"""Retrieval channels. Each returns (query_id, chunk_id, score) for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import textindex
from quarry.sources.shared import dealt


def top_k(scored: DataFrame, k: int, *more) -> DataFrame:
    """The k best of each query, ties by chunk_id, with their rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *more, "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(chunks: DataFrame, text: str = "content") -> DataFrame:
    """(chunk_id, term, tf, length)."""
    return textindex.counted(chunks, [text]).select("chunk_id", "term", "tf", "length")


def bm25(chunks: DataFrame, queries: DataFrame, text: str = "content", k1: float = 1.2, b: float = 0.75, weight: float = 1.0) -> DataFrame:
    """Scores of all chunks that share a term with a query (query_id, query), for chunks that have no stored index: their tokens are
    counted for this search. See TextIndex.bm25."""
    return textindex.passing(chunks, [text]).bm25(queries, {text: weight}, k1, b)


def bm25_fields(chunks: DataFrame, queries: DataFrame, fields: dict[str, float]) -> DataFrame:
    """BM25 of each field with statistics of its own, weighted and added."""
    return textindex.passing(chunks, list(fields)).bm25(queries, fields)


def exact(chunks: DataFrame, queries: DataFrame, text: str = "content", most_queries: int = 20_000) -> DataFrame:
    """(query_id, chunk_id, score 1.0) where the text contains the query, in either case.

    The queries go to the tasks as automata (Aho-Corasick) of about ``most_queries``, or 16 MB, each; a task reads each text once for an automaton,
    whatever the number of queries in it. Nothing is shuffled and no text meets a query that it doesn't contain.
    """
    c = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower(text).alias("t")).where("t <> ''")
    q = queries.select("query_id", F.lower("query").alias("q")).where("q <> ''")
    r, out = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("q")), F.lit(0)).alias("size")).first(), None
    blocks = max(1, -(-r.n // max(1, most_queries)), -(-r.size // (16 << 20)))
    for block in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)).collect()
        sent = chunks.sparkSession.sparkContext.broadcast([(r.query_id, r.q) for r in rows])
        one = c.mapInArrow(_containing(sent), "query_id long, chunk_id long, score double")
        out = one if out is None else out.unionByName(one)
    return out


def _containing(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, list[int]] = {}
        for i, q in sent.value:
            of.setdefault(q, []).append(i)
        a = ahocorasick.Automaton()
        for q, ids in of.items():
            a.add_word(q, ids)
        if of:
            a.make_automaton()
        for b in batches if of else ():
            ids, own = [], []
            for chunk, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                met = {id(found): found for _, found in a.iter(t)}
                for found in met.values():
                    ids += found
                    own += [chunk] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array([1.0] * len(ids), pa.float64())], ["query_id", "chunk_id", "score"])

    return run


def _matrix(df: DataFrame, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select(id_col, vec_col).orderBy(id_col).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)


#: How many products of a row and a query a task holds at once.
PRODUCTS = 1 << 20


class Best:
    """The k best rows of each of n queries, by score rounded to so many places and then by id, out of rows that come in parts. What
    it holds is bounded by n x k and by a part, whatever the number of rows."""

    def __init__(self, n: int, k: int, places: int):
        self.n, self.k, self.places = n, k, places
        self.least = np.full(n, -np.inf)  # each query's k-th best so far
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        self.waiting = 0

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        """s: scores of these rows (first axis) for each query."""
        if not s.size or not self.k:
            return
        if np.isnan(s.sum()):
            s = np.where(np.isnan(s), -np.inf, s)
        margin = 10.0**-self.places
        over = s >= self.least - margin
        if len(s) > self.k and np.count_nonzero(over) > 2 * self.k * self.n:
            over &= s >= np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k] - margin
        r, q = np.nonzero(over)
        self.held.append((q, ids[r], np.round(s[r, q], self.places)))
        self.waiting += len(r)
        if self.waiting > max(PRODUCTS, self.k * self.n):
            self.settle()

    def settle(self) -> None:
        q, ids, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.searchsorted(q, np.arange(self.n))
        place = np.arange(len(q)) - first[q]
        self.least[q[place == self.k - 1]] = s[place == self.k - 1]
        self.held, self.waiting = [tuple(x[place < self.k] for x in (q, ids, s))], 0

    def batches(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(query_id, chunk_id, score); names: the queries' ids."""
        self.settle()
        q, ids, s = self.held[0]
        for at in range(0, len(q), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[q[part]]), pa.array(ids[part]), pa.array(s[part])], ["query_id", "chunk_id", "score"])


def dense(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int = 5000, places: int = 12) -> DataFrame:
    """The k vectors (chunk_id, vector) of the largest cosine with each query (query_id, vector), rounded to so many places, ties by chunk_id.

    Queries go to the tasks in blocks of ``most_queries``, so what is sent has a
    bound; the vectors are dealt over the cores, and a task multiplies a few rows at a time with a block and passes on
    only the best k of all its rows, so what moves grows with the queries alone.
    """
    out, n = None, queries.count()
    rows = dealt(vectors.select(F.col("chunk_id").cast("long"), "vector"))
    for block in range(max(1, -(-n // most_queries))):
        part = queries if n <= most_queries else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // most_queries))) == block)
        ids, m = _matrix(part, "query_id", "vector")
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(m) else m
        sent = vectors.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            best = Best(len(ids), k, places)
            for b in batches if len(ids) else ():
                for at in range(0, b.num_rows, step := max(1, PRODUCTS // len(ids))):
                    p = b.slice(at, step)
                    v = np.array(p.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(p.num_rows, -1)
                    size = np.linalg.norm(v, axis=1, keepdims=True)
                    best.add(p.column(0).to_numpy(zero_copy_only=False), np.where(size > 0, v / np.maximum(size, 1e-300), 0) @ m.T)
            yield from best.batches(ids)

        one = rows.mapInArrow(run, "query_id long, chunk_id long, score double")
        out = one if out is None else out.unionByName(one)
    return top_k(out.withColumn("score", F.round("score", places)), k).select("query_id", "chunk_id", "score")


def maxsim(doc_tokens: DataFrame, query_tokens: DataFrame, most_tokens: int = 20_000, k: int | None = None, places: int = 9) -> DataFrame:
    """Late interaction: for each query token (query_id, pos, vector) the largest dot product with a chunk's tokens (chunk_id,
    vector), summed over the query's tokens. k: only each query's k best, by score rounded to so many places and then by chunk_id.

    A chunk's tokens are brought together, and a task sums a chunk up before it passes anything on: no row is written out for a query's token.
    Queries are worked on in blocks of about ``most_tokens`` tokens; as many as have 20,000 tokens go out, and read the chunks, together."""
    n, out = query_tokens.count(), None
    passes = max(1, -(-n // max(most_tokens, 20_000)))
    tasks = 2 * max(8, doc_tokens.sparkSession.sparkContext.defaultParallelism)
    rows = doc_tokens.select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector").repartition(tasks, "chunk_id").sortWithinPartitions("chunk_id")
    for p in range(passes):
        part = query_tokens if passes == 1 else query_tokens.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        one = _maxsim(rows, part.select("query_id", "pos", "vector").orderBy("query_id", "pos").collect(), most_tokens, k, places)
        out = one if out is None else out.unionByName(one)
    return out if k is None else top_k(out, k).select("query_id", "chunk_id", "score")


def _query_blocks(rows: list, most_tokens: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, where each query's places begin, where each place's tokens begin, vectors) of whole queries with about so many tokens."""
    q, pos, m = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64).reshape(len(rows), -1)
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    out, at = [], 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(first, first[at] + most_tokens, "right")) - (len(q) - first[at] > most_tokens))
        own = slice(first[at], first[to] if to < len(first) else len(q))
        places = np.flatnonzero(np.r_[True, (q[own][1:] != q[own][:-1]) | (pos[own][1:] != pos[own][:-1])])
        out.append((q[first[at:to]], np.searchsorted(places, first[at:to] - first[at]), places, m[own]))
        at = to
    return out


def _maxsim(doc_tokens: DataFrame, rows: list, most_tokens: int, k: int | None, places: int) -> DataFrame:
    sent = doc_tokens.sparkSession.sparkContext.broadcast(_query_blocks(rows, most_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        best = [Best(len(ids), k, places) for ids, *_ in blocks] if k is not None else None
        open_, last = [None] * len(blocks), None  # of the chunk that the next rows may go on with

        def done(i: int, chunk: np.ndarray, top: np.ndarray):
            ids, queries, starts, m = blocks[i]
            if len(starts) < len(m):
                top = np.maximum.reduceat(top, starts, axis=1)
            s = np.add.reduceat(top, queries, axis=1)
            if best is not None:
                best[i].add(chunk, s)
                return
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(chunk))), pa.array(np.repeat(chunk, len(ids))), pa.array(s.ravel())], ["query_id", "chunk_id", "score"])

        for b in batches:
            if not b.num_rows or not blocks:
                continue
            c = b.column(0).to_numpy(zero_copy_only=False)
            v = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
            for i, (_, _, _, m) in enumerate(blocks):
                now = last
                for at in range(0, len(c), step := max(1, PRODUCTS // len(m))):
                    own = c[at : at + step]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    top, chunk = np.maximum.reduceat(v[at : at + step] @ m.T, first, axis=0), own[first]
                    if now is not None and now == chunk[0]:
                        top[0] = np.maximum(top[0], open_[i])
                    elif now is not None:
                        yield from done(i, np.array([now]), open_[i][None])
                    if len(chunk) > 1:
                        yield from done(i, chunk[:-1], top[:-1])
                    now, open_[i] = chunk[-1], top[-1].copy()
            last = c[-1]
        for i in range(len(blocks) if last is not None else 0):
            yield from done(i, np.array([last]), open_[i][None])
            if best is not None:
                yield from best[i].batches(blocks[i][0])

    return doc_tokens.mapInArrow(run, "query_id long, chunk_id long, score double")


def grep_fuse(sparse: DataFrame, hits: DataFrame) -> DataFrame:
    """Exact hits first, at 1.0, then BM25 squashed by s / (s + 1); each chunk once."""
    a = hits.select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.lit(0).alias("source"), F.col("chunk_id").cast("double").alias("order"))
    b = sparse.select("query_id", "chunk_id", (F.col("score") / (F.col("score") + 1)).alias("score"), F.lit(1).alias("source"), (-F.col("score")).alias("order"))
    best = a.unionByName(b).groupBy("query_id", "chunk_id").agg(F.min(F.struct("source", "order", "score")).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m.source", "m.order", "chunk_id")
    return best.select("query_id", "chunk_id", F.col("m.score").alias("score"), F.row_number().over(w).alias("rank"))
