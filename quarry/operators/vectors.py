"""Vector operators: centroids, shortlists, token mixing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import numbers as N


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, scale, q): symmetric int8."""
    return vectors.select("vec_id", "vector", N.int8_scale("vector").alias("scale")).select("vec_id", "scale", N.int8("vector", "scale").alias("q"))


def mean_vectors(tokens: DataFrame, key: str = "token_id") -> DataFrame:
    """(key, vector): the mean of the key's vectors, of length one. Dimensions are averaged apart, so no key's vectors are gathered."""
    each = tokens.select(key, F.posexplode("vector").alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    g = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))  # as many entries as dimensions
    return g.select(key, N.normalized(F.transform("v", lambda s: s["x"])).alias("vector"))


def bounded(centroids: DataFrame, most: int = 65_536) -> DataFrame:
    """(cid, c), or an error where there are more than ``most``."""
    if centroids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centroids")
    return centroids.select("cid", F.col("vector").alias("c"))


def best_centroids(rows: DataFrame, centroids: DataFrame, m: int) -> DataFrame:
    """(id, cid, dot, rank): the m centroids of the largest dot product with each row (id, vector), ties by cid. A batch of rows is
    multiplied with all centroids at once, and only the best leave it: no row is written out for a row and a centroid."""
    found = bounded(centroids).orderBy("cid").collect()
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r.cid for r in found], np.int64), np.array([r.c for r in found], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, c = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                if not len(cid):
                    continue
                v = np.zeros((part.num_rows, c.shape[1]))  # a row without a vector counts as nought
                whole = np.array(pc.fill_null(pc.equal(pc.list_value_length(part.column(1)), c.shape[1]), False))
                v[whole] = np.array(part.column(1).filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, c.shape[1])
                dots = np.round(v @ c.T, 12)
                k = min(m, len(cid))
                # sorted by product and then place, which is the order of cid
                best = np.argsort(-dots, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(cid[best.ravel()].astype(np.int32)), pa.array(dots[row, best.ravel()]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows))], ["id", "cid", "dot", "rank"])

    return rows.select("id", "vector").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cid int, dot double, rank int")


def shortlist(table: DataFrame, centroids: DataFrame, m: int = 8) -> DataFrame:
    """(token_id, cid, rank): each token's m centroids of the largest dot product, ties by cid. More than 65,536 centroids are an error.

    The list of the mean of all rows that aren't nought has a null token_id: it is the fallback for tokens that the table doesn't
    have, and tokens whose row is nought get it too. Without such rows it has the first m centroids."""
    table = table.where("token_id IS NOT NULL").select("token_id", N.doubles("vector").alias("vector"), F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)).alias("filled"))
    filled = table.where("filled").select("token_id", "vector")
    mean = filled.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x")).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    rows = filled.unionByName(mean.select(F.lit(None).cast(table.schema["token_id"].dataType).alias("token_id"), F.transform("v", lambda s: s["x"]).alias("vector")))
    ranked = best_centroids(rows.withColumnRenamed("token_id", "id"), centroids, m).select(F.col("id").alias("token_id"), "cid", "dot", "rank")
    fallback = ranked.where("token_id IS NULL").drop("token_id")
    return ranked.unionByName(table.where("NOT filled").select("token_id").crossJoin(fallback))


def shortlist_argmax(vectors: DataFrame, lists: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, cid): for vectors (vec_id, vector, token_ids) the best centroid among those on their tokens' lists; ties to the lowest.
    Tokens without a list, and vectors without tokens, take the fallback list, that of the null token_id."""
    lists = lists.select("token_id", "cid")
    x = vectors.select("vec_id", "vector", F.explode_outer("token_ids").alias("token_id")).join(lists.where("token_id IS NOT NULL"), "token_id", "left").select("vec_id", "vector", "cid")
    fallback = x.where("cid IS NULL").select("vec_id", "vector").crossJoin(F.broadcast(lists.where("token_id IS NULL").select("cid")))
    x = x.where("cid IS NOT NULL").unionByName(fallback).distinct()
    x = x.join(centroids.select("cid", F.col("vector").alias("c")), "cid").withColumn("dot", F.round(N.dot("vector", "c"), 12))
    return x.groupBy("vec_id").agg(F.max(F.struct("dot", (-F.col("cid")).alias("n"))).alias("m")).select("vec_id", (-F.col("m.n")).alias("cid"))


def full_argmax(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    return best_centroids(vectors.select(F.col("vec_id").alias("id"), N.doubles("vector").alias("vector")), centroids, 1).select(F.col("id").alias("vec_id"), "cid")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("vec_id", F.col("cid").alias("other")), "vec_id").agg(F.avg((F.col("cid") == F.col("other")).cast("double")).alias("agreement"), F.count("*").alias("n"))


def _times(w: float):
    return lambda x: x * w


def mix(tokens: DataFrame, weights: list[float]) -> DataFrame:
    """(chunk_id, pos, vector): each token's vector as the weighted sum of the five around it, of length one. A missing neighbour
    counts as nought; a token without a vector of its own gets the mean of the neighbours that have one, and null if none has."""
    w = Window.partitionBy("chunk_id").orderBy("pos")
    own = N.doubles("vector")
    near = [F.lag(own, -d).over(w) if d else own for d in (-2, -1, 0, 1, 2)]
    x = tokens.select("chunk_id", "pos", *(n.alias(f"n{i}") for i, n in enumerate(near)))
    some = F.array_compact(F.array("n0", "n1", "n3", "n4"))
    zero = F.transform(F.coalesce("n2", F.get(some, F.lit(0))), lambda v: F.lit(0.0))
    x = x.withColumns({"__zero": zero, "__n": F.size(some)})
    total = F.transform(F.coalesce("n0", "__zero"), lambda v: v * weights[0])
    for i in range(1, 5):
        total = F.zip_with(total, F.transform(F.coalesce(f"n{i}", "__zero"), _times(weights[i])), lambda a, b: a + b)
    mean = F.col("__zero")
    for i in (0, 1, 3, 4):
        mean = F.zip_with(mean, F.coalesce(f"n{i}", "__zero"), lambda a, b: a + b)
    mean = F.transform(mean, lambda v: v / F.col("__n"))
    return x.select("chunk_id", "pos", N.normalized(F.when(F.col("n2").isNotNull(), total).when(F.col("__n") > 0, mean)).alias("vector"))


def encode(tokens: DataFrame, table: DataFrame, weights: list[float], taps=None, projection=None) -> DataFrame:
    """(chunk_id, pos, vector) of tokens (chunk_id, pos, token_id) without a text encoder: their rows of a token table (token_id, vector),
    mixed with those of their neighbours, and passed through the mixer if there is one. A token that has no vector, nor a neighbour
    with one, is left out. Windows are by chunk, so a task holds a chunk's tokens at most."""
    from quarry.operators.store import mixer_forward

    mixed = mix(tokens.join(table.select("token_id", "vector"), "token_id", "left").select("chunk_id", "pos", "vector"), weights)
    if taps is None:
        return mixed.where("vector is not null")
    w = Window.partitionBy("chunk_id").orderBy("pos")
    zero = F.transform("vector", lambda v: F.lit(0.0))
    window = F.array(*(F.coalesce(F.lag("vector", -d).over(w), zero) if d else F.col("vector") for d in range(-4, 5)))
    return mixer_forward(mixed.where("vector is not null").withColumn("window", window), taps, projection)


def build_codes(tokens: DataFrame, table: DataFrame, centroids: DataFrame, weights: list[float], folder: str, m: int = 8, taps=None, projection=None) -> tuple[DataFrame, DataFrame]:
    """The late-interaction index without a text encoder, written to a new folder: vectors (chunk_id, pos, vector, cid), and lists
    (token_id, cid, rank). A vector's centroid is the best on the lists of the five tokens around it."""
    spark = tokens.sparkSession
    vectors = encode(tokens, table, weights, taps, projection)
    lists = shortlist(table, centroids, m)
    lists.write.parquet(f"{folder}/lists")
    w = Window.partitionBy("chunk_id").orderBy("pos")
    around = F.array_compact(F.array(*(F.lag("token_id", -d).over(w) if d else F.col("token_id") for d in (-2, -1, 0, 1, 2))))
    x = vectors.join(tokens.select("chunk_id", "pos", around.alias("token_ids")), ["chunk_id", "pos"]).withColumn("vec_id", F.struct("chunk_id", "pos"))
    best = shortlist_argmax(x, spark.read.parquet(f"{folder}/lists"), centroids)
    x.join(best, "vec_id").select("chunk_id", "pos", "vector", "cid").write.parquet(f"{folder}/vectors")
    return spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/lists")


def reservoir(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, always the same ones: those of the least hash."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def train_centroids(vectors: DataFrame, k: int, seed: int = 0, most: int = 1_000_000) -> DataFrame:
    """(cid, vector) by k-means over at most ``most`` vectors; k is no more than there are."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = reservoir(vectors, "vec_id", most, seed).select(array_to_vector(N.doubles("vector")).alias("features")).cache()
    n = sample.count()
    model = KMeans(k=max(1, min(k, n)), seed=seed, maxIter=20).fit(sample)
    sample.unpersist()
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cid int, vector array<double>")
