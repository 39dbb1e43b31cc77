"""A vector store in a folder: rows are appended, deletions are marks, a pointer names the version that counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.operators.channels import PRODUCTS, Best, top_k
from quarry.sources.shared import dealt


class VectorStore:
    """int8 rows with their scale beside the vectors. Readers follow the pointer, so a build shows when it is whole."""

    def __init__(self, spark: SparkSession, folder: str, version: str = "v0"):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    def _at(self, part: str) -> str:
        return f"{self.folder}/{self.version}/{part}"

    def append(self, vectors: DataFrame) -> None:
        x = vectors.select(F.col("chunk_id").cast("long"), N.doubles("vector").alias("vector")).withColumn("scale", N.int8_scale("vector"))
        x.withColumn("q", N.int8("vector", "scale")).write.mode("append").parquet(self._at("rows"))

    def delete(self, ids: DataFrame) -> None:
        ids.select(F.col("chunk_id").cast("long")).distinct().write.mode("append").parquet(self._at("deleted"))

    def _read(self, part: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(part))
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self._at(part)) if there else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read("rows", "chunk_id long, vector array<double>, scale double, q array<tinyint>").join(self._read("deleted", "chunk_id long"), "chunk_id", "left_anti")

    def publish(self) -> None:
        self.spark.createDataFrame([(self.version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/active")

    @classmethod
    def active(cls, spark: SparkSession, folder: str) -> VectorStore:
        return cls(spark, folder, spark.read.parquet(f"{folder.rstrip('/')}/active").first().version)

    def two_stage(self, queries: DataFrame, k: int, wide: int = 4, most_queries: int = 10_000) -> DataFrame:
        """The k best of the wide x k rows of the largest int8 product; a query is (query_id, vector). Queries go to the tasks in
        blocks of about ``most_queries``, and a task passes on no more than its rows' wide x k best; vectors are fetched for these."""
        q = queries.select("query_id", N.doubles("vector").alias("qv")).withColumn("qs", N.int8_scale("qv")).withColumn("qq", N.int8("qv", "qs"))
        blocks, out = max(1, -(-queries.count() // most_queries)), None
        rows = self.rows()
        coarse = rows.select("chunk_id", "q", (F.col("scale") / N.norm("vector")).alias("factor"))
        for block in range(blocks):
            part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            best = top_k(_coarse(coarse, part, wide * k), wide * k).select("query_id", "chunk_id")
            one = best.join(rows.select("chunk_id", "vector"), "chunk_id").join(part.select("query_id", "qv"), "query_id")
            one = top_k(one.select("query_id", "chunk_id", F.round(N.cosine("vector", "qv"), 9).alias("score")), k)
            out = one if out is None else out.unionByName(one)
        return out


def _coarse(rows: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): of each task's int8 rows (chunk_id, q, factor) the k best for each query (query_id, qq)."""
    import numpy as np

    found = part.select("query_id", "qq").collect()
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in found], np.int64), np.array([r.qq for r in found], np.float64)))

    def run(batches):
        ids, m = sent.value
        best = Best(len(ids), k, 9)
        for b in batches if len(ids) else ():
            for at in range(0, b.num_rows, step := max(1, PRODUCTS // len(ids))):
                p = b.slice(at, step)
                v = np.array(p.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(p.num_rows, -1)
                best.add(p.column(0).to_numpy(zero_copy_only=False), v @ m.T * p.column(2).to_numpy(zero_copy_only=False)[:, None])
        yield from best.batches(ids)

    return dealt(rows.select("chunk_id", "q", "factor")).mapInArrow(run, "query_id long, chunk_id long, score double")


def semantic_cache(cache: DataFrame, queries: DataFrame, stamp: str, threshold: float = 0.85, others: bool = False) -> DataFrame:
    """(query_id, cached_id, similarity): of the cached queries (cached_id, vector, stamp) of the same index stamp the nearest, if it
    is near enough. A cache holds a thousand queries, so it goes to every task, which multiplies batches of queries with all of it: no row
    is written out for a query and a cached one. others: a query isn't compared with a cached one of its own number."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    # in order of the number, so the first of equally near ones is the least
    found = sorted(cache.where(F.col("stamp") == stamp).orderBy(F.desc("cached_id")).limit(1000).select("cached_id", N.doubles("vector").alias("cv")).collect(), key=lambda r: r.cached_id)
    sizes = {len(r.cv) for r in found if r.cv}
    of_size = {n: np.array([r.cv if r.cv and len(r.cv) == n and None not in r.cv else [0.0] * n for r in found], float) for n in sizes}
    sent = cache.sparkSession.sparkContext.broadcast(([r.cached_id for r in found], {n: m / np.where((size := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, size) for n, m in of_size.items()}))

    def run(batches):
        ids, matrices = sent.value
        own = np.array(ids)
        for b in batches:
            for at in range(0, b.num_rows if ids else 0, 500):
                part = b.slice(at, 500)
                s = np.zeros((part.num_rows, len(ids)))  # nought for vectors of no length or of another size
                for n, m in matrices.items():
                    here = np.array(pc.fill_null(pc.equal(pc.list_value_length(part.column(1)), n), False))
                    values = part.column(1).filter(pa.array(here)).flatten()
                    v = np.array(values.to_numpy(zero_copy_only=False), float).reshape(-1, n)
                    v[np.array(values.is_null()).reshape(-1, n).any(axis=1)] = 0
                    size = np.linalg.norm(v, axis=1, keepdims=True)
                    s[here] = np.round(v / np.where(size == 0, 1, size) @ m.T, 9)
                if others:
                    s[np.array(part.column(0).to_pylist())[:, None] == own] = -np.inf
                best = s.argmax(axis=1)
                top = s[np.arange(len(best)), best]
                near = np.flatnonzero((top >= threshold) | np.isnan(top))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(near)), pa.array([ids[i] for i in best[near]], kind), pa.array(top[near])], ["query_id", "cached_id", "similarity"])

    types, of = dict(queries.dtypes), dict(cache.dtypes)["cached_id"]
    kind = pa.int32() if of == "int" else pa.int64()
    x = dealt(queries.select("query_id", N.doubles("vector").alias("vector"))).mapInArrow(run, f"query_id {types['query_id']}, cached_id {of}, similarity double")
    return x.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("cached_id")).alias("n"))).alias("m")).select("query_id", (-F.col("m.n")).alias("cached_id"), "m.similarity")


def fit_mix_weights(tokens: DataFrame, target: str = "target") -> list[float]:
    """Least squares for the five weights with which a token's neighbours make up its vector: sums of products are aggregated, and
    the 5 x 5 system is solved here."""
    import numpy as np
    from pyspark.sql import Window

    w = Window.partitionBy("chunk_id").orderBy("pos")
    zero = F.transform("vector", lambda x: F.lit(0.0))
    x = tokens.select(target, *(F.coalesce(N.doubles(F.lag("vector", -d).over(w)) if d else N.doubles("vector"), zero).alias(f"n{d + 2}") for d in (-2, -1, 0, 1, 2)))
    products = [F.sum(N.dot(f"n{i}", f"n{j}")).alias(f"a{i}{j}") for i in range(5) for j in range(i, 5)] + [F.sum(N.dot(f"n{i}", target)).alias(f"b{i}") for i in range(5)]
    r = x.agg(*products).first()
    a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] or 0.0 for j in range(5)] for i in range(5)])
    return np.linalg.lstsq(a, np.array([r[f"b{i}"] or 0.0 for i in range(5)]), rcond=None)[0].tolist()


def mixer_forward(tokens: DataFrame, taps, projection) -> DataFrame:
    """(chunk_id, pos, vector): a depthwise filter of nine taps (9 x dims) over each chunk's tokens, GELU, a residual projection
    (dims x dims), length one. tokens (chunk_id, pos, window array of nine vectors)."""
    import numpy as np

    taps, projection = np.asarray(taps, float), np.asarray(projection, float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array([[list(v) for v in w] for w in f["window"]], float).reshape(len(f), 9, -1)
            h = (x * taps).sum(axis=1)
            h = 0.5 * h * (1 + np.tanh(0.7978845608028654 * (h + 0.044715 * h**3)))
            y = x[:, 4] + h @ projection
            n = np.linalg.norm(y, axis=1, keepdims=True)
            y = np.where(n > 0, y / np.where(n > 0, n, 1), 0)
            yield pd.DataFrame({"chunk_id": f["chunk_id"], "pos": f["pos"], "vector": y.tolist()})

    return tokens.select("chunk_id", "pos", "window").mapInPandas(run, "chunk_id long, pos int, vector array<double>")


def train_mixer(windows, targets, steps: int = 300, rate: float = 0.01, seed: int = 0):
    """(taps, projection, losses) for ``mixer_forward``: of a bounded sample of windows (n x 9 x dims) and the vectors that a text encoder
    gives their centres (n x dims), by Adam on one less the cosine, with a rate that falls along a cosine."""
    import numpy as np

    x, t = np.asarray(windows, float), np.asarray(targets, float)
    t = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
    n, _, dims = x.shape
    rng = np.random.default_rng(seed)
    params = [rng.standard_normal((9, dims)) * 0.1, rng.standard_normal((dims, dims)) * 0.01]
    first, second, losses = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], []
    c = 0.7978845608028654
    for k in range(1, steps + 1):
        taps, projection = params
        z = (x * taps).sum(axis=1)
        th = np.tanh(c * (z + 0.044715 * z**3))
        h = 0.5 * z * (1 + th)
        y = x[:, 4] + h @ projection
        size = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        cos = (y * t).sum(axis=1, keepdims=True) / size
        losses.append(float(1 - cos.mean()))
        dy = -(t - cos * y / size) / size / n
        dz = dy @ projection.T * (0.5 * (1 + th) + 0.5 * z * (1 - th**2) * c * (1 + 3 * 0.044715 * z**2))
        grads = [(x * dz[:, None, :]).sum(axis=0), h.T @ dy]
        step = rate * 0.5 * (1 + np.cos(np.pi * (k - 1) / steps))
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= step * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
    return params[0], params[1], losses
