"""A stored text index for BM25: tokens are counted once, when it is built; a search reads what was counted and no text.

Its postings (chunk_id, field, term, tf, length) are a table that is bucketed by chunk
and sorted by field and term within a bucket. So a search skips row groups without
its terms, and adds up a chunk's score without a shuffle, as all of a chunk's
postings lie in one bucket; only the best of each bucket move. Beside them are the
terms (field, term, df) and one row of statistics for each field.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.stem import stem
from quarry.sources.shared import cut

LOWER_UPPER, UPPERS_LOWER, RUN = re.compile(r"([a-z0-9])([A-Z])"), re.compile(r"([A-Z]{2,})([A-Z][a-z])"), re.compile(r"\w+")
POSTINGS = "chunk_id long, field string, term string, tf long, length int"


def terms(text: str | None) -> list[str]:
    """The tokens of functions.text.tokens, for whole texts in Python."""
    t = UPPERS_LOWER.sub(r"\1_\2", LOWER_UPPER.sub(r"\1_\2", text or ""))
    if "_" not in t:
        return RUN.findall(t.lower()) if t.isascii() else [r.lower() for r in RUN.findall(t)]
    out = []
    for run in RUN.findall(t):
        if "_" not in run:
            out.append(run.lower())
            continue
        parts = [p for p in run.lower().split("_") if p]
        out += parts
        if len(parts) > 1:
            out.append("".join(parts))
            out += [f"{a}_{b}" for a, b in zip(parts, parts[1:], strict=False)]
    return out


def counted(chunks: DataFrame, fields: list[str], stemmed: bool = False) -> DataFrame:
    """POSTINGS of these text columns of chunks; what a chunk has of a term is settled in the chunk's row, so nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids, names, words, n, length = [], [], [], [], []
                for k, field in enumerate(fields, 1):
                    for i, text in zip(part.column(0).to_pylist(), part.column(k).to_pylist(), strict=True):
                        found = terms(text)
                        tf = Counter(map(stem, found) if stemmed else found)
                        ids += [i] * len(tf)
                        names += [field] * len(tf)
                        words += tf.keys()
                        n += tf.values()
                        length += [len(found)] * len(tf)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(length, pa.int32())], ["chunk_id", "field", "term", "tf", "length"])

    return chunks.select(F.col("chunk_id").cast("long"), *(F.col(f).cast("string") for f in fields)).mapInArrow(run, POSTINGS)


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    terms: DataFrame
    #: of each field the number of chunks and their mean length in tokens
    stats: dict[str, tuple[int, float]]
    stemmed: bool = False

    def bm25(self, queries: DataFrame, fields: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75, among: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, score): the weighted sum of the fields' BM25, for all chunks that share a term with a query (query_id,
        query). A query's repeated terms count as often. among (chunk_id): the only chunks that may be found; the statistics are
        those of the whole index all the same."""
        q, p, part, send = self._weighed(queries, fields, k1, b, among)
        return p.join(send(q), ["field", "term"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("__w") * part).alias("score"))

    def best(self, queries: DataFrame, k: int, fields: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75, places: int = 9, most_queries: int = 500, most_terms: int = 10_000, most_rows: int = 200_000) -> DataFrame:
        """(query_id, chunk_id, score): the k best of bm25, by score rounded to so many places and then by chunk_id.

        Postings of the queries' terms are put in order of their chunks where they lie; tasks add up a few chunks at a time for a block of
        queries, and pass on no more than their best k. So no row is made for a query and a chunk, however many chunks a frequent
        term finds. Queries with more terms than a block or the driver may have go by bm25, as do weights that aren't positive."""
        fields = fields or dict.fromkeys(self.stats, 1.0)
        q, p, part, _ = self._weighed(queries, fields, k1, b, None)
        rows = q.select("query_id", "field", "term", "__w", "__mean").limit(most_rows + 1).collect()
        ids = sorted({r.query_id for r in rows})
        block = {i: k // most_queries for k, i in enumerate(ids)}
        parts: list[list] = [[] for _ in range(-(-len(ids) // most_queries))]
        for r in rows:
            parts[block[r.query_id]].append(r)
        if min(fields.values()) <= 0 or len(rows) > most_rows or any(len({(r.field, r.term) for r in x}) > most_terms for x in parts):
            return channels().top_k(rounded(self.bm25(queries, fields, k1, b), places), k).select("query_id", "chunk_id", "score")
        spark, out = queries.sparkSession, None
        for x in parts:
            names, at = sorted({r.query_id for r in x}), {}
            for r in x:
                at.setdefault((r.field, r.term), len(at))
            place = {n: i for i, n in enumerate(names)}
            w = np.zeros((len(at), len(names)))
            for r in x:
                w[at[r.field, r.term], place[r.query_id]] += r["__w"]
            mean = {(r.field, r.term): r["__mean"] for r in x}
            terms_ = spark.createDataFrame([(f, t, i, mean[f, t]) for (f, t), i in at.items()], "field string, term string, __t int, __mean double")
            near = p.join(F.broadcast(terms_), ["field", "term"]).select("chunk_id", "__t", part.alias("__p")).sortWithinPartitions("chunk_id")
            one = near.mapInArrow(_multiplied(spark.sparkContext.broadcast((np.array(names, np.int64), w)), k, places), "query_id long, chunk_id long, score double")
            out = one if out is None else out.unionByName(one)
        if out is None:
            return spark.createDataFrame([], "query_id long, chunk_id long, score double")
        return channels().top_k(rounded(out, places), k).select("query_id", "chunk_id", "score")

    def _weighed(self, queries: DataFrame, fields: dict[str, float] | None, k1: float, b: float, among: DataFrame | None):
        """Terms of the queries with their weights (query_id, field, term, __w, __mean), the postings, and what a posting adds for a weight of one."""
        fields = fields or dict.fromkeys(self.stats, 1.0)
        if missing := set(fields) - set(self.stats):
            raise ValueError(f"the index has no field {sorted(missing)}")
        words = queries.select("query_id", F.explode(T.tokens("query")).alias("term"))
        if self.stemmed:
            words = counted(queries.select(F.col("query_id").alias("chunk_id"), "query"), ["query"], True).select(F.col("chunk_id").alias("query_id"), F.explode(F.array_repeat("term", F.col("tf").cast("int"))).alias("term"))
        q = words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        few = q.limit((1 << 20) + 1).count() <= 1 << 20
        send = F.broadcast if few else lambda df: df  # a bound of rows; beyond it Spark joins as it sees fit
        idf, mean, weight = None, None, None
        for f, w in fields.items():
            n, length = self.stats[f]
            one = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            idf = F.when(F.col("field") == f, one) if idf is None else idf.when(F.col("field") == f, one)
            mean = F.when(F.col("field") == f, length) if mean is None else mean.when(F.col("field") == f, length)
            weight = F.when(F.col("field") == f, w) if weight is None else weight.when(F.col("field") == f, w)
        own = lambda df: df.where(F.col("field").isin(*fields))
        q = own(self.terms).join(send(q), "term").select("query_id", "field", "term", (weight * F.col("qtf") * idf * (k1 + 1)).alias("__w"), mean.alias("__mean"))
        p = own(self.postings) if among is None else own(self.postings).join(among.select("chunk_id"), "chunk_id", "left_semi")
        return q, p, F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("__mean"))), send

    def check_stemmer(self, expected: bool) -> None:
        if self.stemmed != expected:
            raise ValueError(f"the index was built {'with' if self.stemmed else 'without'} a stemmer; build it anew")


def channels():
    from quarry.operators import channels  # which imports this module

    return channels


def rounded(df: DataFrame, places: int) -> DataFrame:
    return df.withColumn("score", F.round("score", places))


def _multiplied(sent, k: int, places: int):
    """Of rows (chunk_id, __t, __p) in order of chunk_id, the k best chunks for each query; sent: the queries' ids, and weights of terms by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w = sent.value
        best, open_ = channels().Best(len(names), k, places), None  # open_: the terms of the chunk that the next rows may go on with
        some = max(1, channels().PRODUCTS // len(names))

        def score(chunk: np.ndarray, terms_: np.ndarray, x: np.ndarray) -> None:
            first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            at = 0
            while at < len(first):  # whole chunks with about so many postings
                to = max(at + 1, int(np.searchsorted(first, first[at] + some)))
                own = slice(first[at], first[to] if to < len(first) else len(chunk))
                s = np.add.reduceat(w[terms_[own]] * x[own, None], first[at:to] - first[at], axis=0)
                best.add(chunk[first[at:to]], np.where(s > 0, s, np.nan))
                at = to

        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            c, t, x = new if open_ is None else [np.concatenate(y) for y in zip(open_, new, strict=True)]
            if len(c):
                whole = int(np.searchsorted(c, c[-1]))
                if whole:
                    score(c[:whole], t[:whole], x[:whole])
                open_ = (c[whole:], t[whole:], x[whole:])
        if open_ is not None:
            score(*open_)
        for b in best.batches(names):
            yield b.filter(pc.is_finite(b.column(2)))

    return run


def _statistics(chunks: int, postings: DataFrame, fields: list[str]) -> dict[str, tuple[int, float]]:
    total = {r.field: r.n for r in postings.groupBy("field").agg(F.sum("tf").alias("n")).collect()}  # a row a field
    return {f: (chunks, total.get(f, 0) / chunks if chunks else 0.0) for f in fields}


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def _table(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """The postings of a folder as a bucketed table of this session's catalog."""
    name = f"postings_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({POSTINGS}) USING parquet CLUSTERED BY (chunk_id) SORTED BY (field, term) INTO {buckets} BUCKETS LOCATION '{folder}/postings'")
    return spark.table(name)


def store(chunks: DataFrame, fields: list[str], folder: str, stemmed: bool = False, buckets: int | None = None) -> TextIndex:
    """Builds the index of chunks (chunk_id, fields ...) in a new folder that all executors share. Texts are shuffled once, by chunk;
    buckets should be so many that one's postings are a task's work."""
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), *fields).repartition(buckets, "chunk_id")
    _table(spark, folder, buckets)
    name = f"postings_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
    counted(dealt, fields, stemmed).write.mode("append").insertInto(name)
    postings = spark.table(name)
    _terms(postings).sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    stats = _statistics(chunks.count(), postings, fields)
    rows = [(f, n, mean, buckets, stemmed) for f, (n, mean) in stats.items()]
    spark.createDataFrame(rows, "field string, n long, mean double, buckets int, stemmed boolean").coalesce(1).write.parquet(f"{folder}/meta")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> TextIndex:
    rows = spark.read.parquet(f"{folder}/meta").collect()
    return TextIndex(_table(spark, folder, rows[0].buckets), spark.read.parquet(f"{folder}/terms"), {r.field: (r.n, r["mean"]) for r in rows}, rows[0].stemmed)


def passing(chunks: DataFrame, fields: list[str]) -> TextIndex:
    """An index for one search or a few: tokens are counted once and kept in the shared folder, without a table."""
    postings = cut(counted(chunks, fields))
    return TextIndex(postings, _terms(postings), _statistics(chunks.count(), postings, fields))
