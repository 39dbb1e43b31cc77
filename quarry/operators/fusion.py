"""Fusion of ranked lists, and how far to trust what comes out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import numbers as N

#: Channel weights by query type.
CONVEX = {"identifier": (0.2, 0.6, 5.0), "keyword": (0.3, 0.6, 2.0), "semantic": (0.4, 0.5, 0.8), "mixed": (0.5, 0.4, 0.8)}
RRF_WEIGHTS = {"identifier": (0.2, 1.0), "keyword": (0.4, 0.8), "semantic": (0.1, 0.9), "mixed": (0.6, 0.6)}


def channels(**lists: DataFrame) -> DataFrame:
    """The lists one under the other, with the channel's name."""
    return reduce(DataFrame.unionByName, (df.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.lit(name).alias("channel")) for name, df in lists.items()))


def ranked(all_: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "chunk_id")
    return all_.withColumn("rank", F.row_number().over(w))


def rrf(all_: DataFrame, k: float = 60.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, hits): weighted reciprocal ranks, and in how many channels the chunk is.

    One union, one window and one aggregate for any number of channels, instead of
    outer joins of them.
    """
    w = F.lit(1.0)
    for name, x in (weights or {}).items():
        w = F.when(F.col("channel") == name, F.lit(float(x))).otherwise(w)
    return ranked(all_).groupBy("query_id", "chunk_id").agg(F.sum(w / (k + F.col("rank"))).alias("score"), F.count_distinct("channel").alias("hits"))


def weighted_rrf(all_: DataFrame, types: DataFrame, k: float = 60.0) -> DataFrame:
    """With each query's weights by its type (query_id, query_type); the exact channel counts 1.0."""
    dense = reduce(lambda w, t: w.when(F.col("query_type") == t, RRF_WEIGHTS[t][0]), RRF_WEIGHTS, F)
    sparse = reduce(lambda w, t: w.when(F.col("query_type") == t, RRF_WEIGHTS[t][1]), RRF_WEIGHTS, F)
    w = F.when(F.col("channel").endswith("dense"), dense).when(F.col("channel").endswith("sparse"), sparse).otherwise(1.0)
    return ranked(all_).join(types, "query_id").groupBy("query_id", "chunk_id").agg(F.sum(w / (k + F.col("rank"))).alias("score"), F.count_distinct("channel").alias("hits"))


def normalized(list_: DataFrame, *key: str) -> DataFrame:
    """Scores over the list's largest; a list of one gets 1.0, and one whose largest is nought gets 0."""
    w = Window.partitionBy("query_id", *key)
    top, n = F.max("score").over(w), F.count("*").over(w)
    return list_.withColumn("score", F.when(n == 1, 1.0).when(top <= 1e-12, 0.0).otherwise(F.col("score") / top))


def convex(all_: DataFrame, types: DataFrame) -> DataFrame:
    """Weighted sum of the channels' normalised scores, the exact channel as 0 or 1. If a query's exact channel has anything, it
    counts half as much again."""
    n = normalized(all_.where("channel <> 'exact'"), "channel").unionByName(all_.where("channel = 'exact'").withColumn("score", F.lit(1.0)))
    pick = lambda i: reduce(lambda w, t: w.when(F.col("query_type") == t, CONVEX[t][i]), CONVEX, F)
    w = F.when(F.col("channel") == "dense", pick(0)).when(F.col("channel") == "sparse", pick(1)).otherwise(pick(2) * 1.5)
    return n.join(types, "query_id").groupBy("query_id", "chunk_id").agg(F.sum(w * F.col("score")).alias("score"))


def adapted_weights(tops: DataFrame) -> DataFrame:
    """tops (query_id, query_type, dense, sparse, exact): the best score of each channel, null where it found nothing. Returns (query_id,
    w_dense, w_sparse, w_exact): the type's weights, drawn towards a channel that is much surer than the other."""
    pick = lambda i: reduce(lambda w, t: w.when(F.col("query_type") == t, CONVEX[t][i]), CONVEX, F)
    ratio = F.when((F.col("sparse") > 0) & (F.col("dense") > 0), F.col("sparse") / F.col("dense"))
    return tops.select(
        "query_id", (pick(0) * F.when(ratio > 2.5, 0.8).when(ratio < 0.4, 1.3).otherwise(1.0)).alias("w_dense"), (pick(1) * F.when(ratio > 2.5, 1.3).when(ratio < 0.4, 0.8).otherwise(1.0)).alias("w_sparse"),
        (pick(2) * F.when(F.col("exact") > 0.8, 1.5).otherwise(1.0)).alias("w_exact"),
    )


def response_confidence(ranked_: DataFrame) -> DataFrame:
    """(query_id, confidence) of rankings with rank."""
    best = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return ranked_.groupBy("query_id").agg(best(1).alias("top"), best(2).alias("second")).select("query_id", N.response_confidence("top", "second").alias("confidence"))


def dual_route(original: DataFrame, expanded: DataFrame, w_original: float = 1.0, w_expanded: float = 0.5) -> DataFrame:
    both = original.withColumn("score", F.col("score") * w_original).unionByName(expanded.withColumn("score", F.col("score") * w_expanded))
    return both.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))


def max_merge(a: DataFrame, b: DataFrame, w_a: float, w_b: float) -> DataFrame:
    both = a.withColumn("score", F.col("score") * w_a).unionByName(b.withColumn("score", F.col("score") * w_b))
    return both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def confidence(fused: DataFrame, fired: DataFrame, gap: float = 0.05) -> DataFrame:
    """Adds label and confidence: extracted if all of the query's channels that fired (at least two) have the chunk, ambiguous if
    the next score is less than ``gap`` below, else inferred; confidence is the share of the channels."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    x = fused.withColumn("next", F.lead("score").over(w)).join(fired, "query_id")
    near = F.col("next").isNotNull() & (F.col("score") > 0) & ((F.col("score") - F.col("next")) / F.col("score") < gap)
    label = F.when((F.col("fired") >= 2) & (F.col("hits") == F.col("fired")), "extracted").when(near, "ambiguous").otherwise("inferred")
    return x.withColumn("label", label).withColumn("confidence", F.col("hits") / F.col("fired")).drop("next", "fired")


def fired(all_: DataFrame) -> DataFrame:
    return all_.groupBy("query_id").agg(F.count_distinct("channel").alias("fired"))


def target_rrf(hits: DataFrame, k: float = 60.0) -> DataFrame:
    """Federation: hits of (query_id, target, chunk_id, score) re-ranked in each target, interleaved by reciprocal rank."""
    w = Window.partitionBy("query_id", "target").orderBy(F.desc("score"), "chunk_id")
    x = hits.withColumn("rank", F.row_number().over(w)).withColumn("fused", 1 / (k + F.col("rank")))
    return x.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "target", "chunk_id")))
