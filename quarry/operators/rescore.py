"""Stages that change a ranking's scores. Their order matters: each sees the scores, and the largest score, that the stages before it left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def of_query():
    return Window.partitionBy("query_id")


def role_boost(scored: DataFrame) -> DataFrame:
    """scored has file_path and query_type; roles count for semantic and mixed queries."""
    w = T.role_weight(T.file_role("file_path"))
    return scored.withColumn("score", F.col("score") * F.when(F.col("query_type").isin("semantic", "mixed"), w).otherwise(1.0))


def path_penalty(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", F.col("score") * F.when(T.penalty_applies("query"), T.path_penalty("file_path")).otherwise(1.0))


def stem_boost(scored: DataFrame) -> DataFrame:
    """Adds a share of the query's largest score where the file's name has query words."""
    return scored.withColumn("score", F.col("score") + T.stem_boost("file_path", T.query_tokens("query")) * F.max("score").over(of_query()))


def definition_boost(scored: DataFrame, share: float = 0.2) -> DataFrame:
    """Where the chunk defines a name that has a query word."""
    hit = F.arrays_overlap(F.array_append(T.parts(T.split_camel("name")), F.lower("name")), T.query_tokens("query"))
    return scored.withColumn("score", F.col("score") + F.when(F.coalesce(hit, F.lit(False)), share).otherwise(0.0) * F.max("score").over(of_query()))


def coherence_boost(scored: DataFrame, share: float = 0.2) -> DataFrame:
    """Of each file with two or more chunks the best one gets share x the file's sum / the largest such sum x the largest score."""
    f = Window.partitionBy("query_id", "file_path")
    x = scored.withColumns({"__sum": F.sum("score").over(f), "__n": F.count("*").over(f), "__rank": F.row_number().over(f.orderBy(F.desc("score"), "chunk_id"))})
    most = F.max(F.when(F.col("__n") >= 2, F.col("__sum"))).over(of_query())
    add = F.when((F.col("__n") >= 2) & (F.col("__rank") == 1) & (most > 0), share * F.col("__sum") / most * F.max("score").over(of_query())).otherwise(0.0)
    return x.withColumn("score", F.col("score") + add).drop("__sum", "__n", "__rank")


def regex_boost(scored: DataFrame, pattern: str, factor: float = 1.5, text: str = "content") -> DataFrame:
    return scored.withColumn("score", F.col("score") * F.when(F.col(text).rlike(pattern), factor).otherwise(1.0))


def import_proximity(scored: DataFrame, neighbours: DataFrame, top: int = 5, share: float = 0.10) -> DataFrame:
    """Chunks of files next to the top files (query_id, file_path) in the import graph gain share x the mean of the top scores, up
    to the largest score."""
    rank = F.row_number().over(of_query().orderBy(F.desc("score"), "chunk_id"))
    x = scored.withColumn("__rank", rank)
    mean = F.avg(F.when(F.col("__rank") <= top, F.col("score"))).over(of_query())
    near = neighbours.select("query_id", "file_path", F.lit(True).alias("__near")).distinct()
    x = x.withColumns({"__mean": mean, "__max": F.max("score").over(of_query())}).join(near, ["query_id", "file_path"], "left")
    up = F.greatest(F.col("score"), F.least(F.col("score") + share * F.col("__mean"), F.col("__max")))
    return x.withColumn("score", F.when(F.col("__near") & (F.col("__rank") > top), up).otherwise(F.col("score"))).drop("__rank", "__mean", "__max", "__near")


def directory_proximity(scored: DataFrame, k: int = 10, share: float = 0.08) -> DataFrame:
    """If the top k lie in fewer than k / 3 folders, later chunks in the three most frequent of these gain share x the top's mean."""
    x = scored.withColumns({"__rank": F.row_number().over(of_query().orderBy(F.desc("score"), "chunk_id")), "__dir": T.parent_dir("file_path")})
    top = x.where(F.col("__rank") <= k)
    stats = top.groupBy("query_id").agg(F.count_distinct("__dir").alias("__dirs"), F.avg("score").alias("__mean"))
    best = top.groupBy("query_id", "__dir").agg(F.count("*").alias("n"))
    best = best.withColumn("r", F.row_number().over(of_query().orderBy(F.desc("n"), "__dir"))).where("r <= 3").select("query_id", "__dir", F.lit(True).alias("__near"))
    x = x.join(stats, "query_id").join(best, ["query_id", "__dir"], "left")
    on = (F.col("__dirs") < k / 3) & (F.col("__rank") > k) & F.coalesce("__near", F.lit(False))
    return x.withColumn("score", F.col("score") + F.when(on, share * F.col("__mean")).otherwise(0.0)).drop("__rank", "__dir", "__dirs", "__mean", "__near")


def centrality_prior(scored: DataFrame, centrality: DataFrame, weight: float) -> DataFrame:
    """Adds weight x the largest score x the chunk's centrality between the least and the largest among the candidates."""
    x = scored.join(centrality.select("chunk_id", F.col("centrality").alias("__c")), "chunk_id", "left").withColumn("__c", F.coalesce("__c", F.lit(0.0)))
    lo, hi = F.min("__c").over(of_query()), F.max("__c").over(of_query())
    return x.withColumn("score", F.col("score") + F.when(hi > lo, weight * F.max("score").over(of_query()) * (F.col("__c") - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.0)).drop("__c")


def docstring_boost(query: str, docstring: str, each: float = 0.15, most: float = 0.6) -> Column:
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 1))
    return F.least(each * F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce(docstring, F.lit(""))), w))), F.lit(most))
