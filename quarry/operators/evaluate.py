"""Evaluation: corpora and their gold, a lexical baseline, token accounts, comparisons of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def corpus_from_rows(rows: DataFrame, text: str, query: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, gold) of a table that has both a text and its description: each row's description is a query whose one
    relevant document is the row's text. Ids are the key after d or q."""
    x = rows.where(F.col(text).isNotNull() & (F.length(F.trim(query)) > 0))
    x = x.withColumn("__id", F.concat(F.lit("d"), F.col(key).cast("string")))
    docs = x.select(F.col("__id").alias("item"), F.col(text).alias("text"))
    queries = x.select(F.concat(F.lit("q"), F.col(key).cast("string")).alias("query_id"), F.col(query).alias("text"))
    gold = x.select(F.concat(F.lit("q"), F.col(key).cast("string")).alias("query_id"), F.col("__id").alias("item"))
    return docs, queries, gold


def corpus_from_splits(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (_id, text), queries (_id, text), qrels (query-id, corpus-id, score): only queries with a relevant document in the corpus stay."""
    gold = qrels.where(F.col("score") > 0).select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("item")).distinct()
    gold = gold.join(corpus.select(F.col("_id").alias("item")), "item", "left_semi")
    q = queries.select(F.col("_id").alias("query_id"), "text").join(gold, "query_id", "left_semi")
    return corpus.select(F.col("_id").alias("item"), "text"), q, gold.join(q, "query_id", "left_semi")


def select_queries(queries: DataFrame, n: int, seed: int) -> DataFrame:
    """The same n queries for a seed, whatever the partitions: those of the least hash."""
    return queries.orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(n)


def keyword_ranking(chunks: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, file_path, hits, rank): files by how many lines have one of the query's keywords (query_id, word), ties by path."""
    lines = chunks.select("file_path", F.xxhash64("content").alias("__chunk"), F.posexplode(F.split(F.lower("content"), "\n")).alias("__n", "line"))
    words = lines.select("file_path", F.struct("__chunk", "__n").alias("__line"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([a-z_][a-z0-9_]{2,})"), 1))).alias("word"))
    hits = words.join(keywords.distinct(), "word").select("query_id", "file_path", "__line").distinct().groupBy("query_id", "file_path").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "file_path")
    return hits.withColumn("rank", F.row_number().over(w))


def dedup_ranked(ranked: DataFrame) -> DataFrame:
    """A ranking of files in which each stands once, at its first place, with new ranks."""
    x = ranked.groupBy("query_id", "item").agg(F.min("rank").alias("first"))
    return x.select("query_id", "item", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "item")).alias("rank"))


def estimated_tokens(text) -> Column:
    return F.ceil(F.length(T._c(text)) / 4)


def context_burden(turns: DataFrame, *key: str) -> DataFrame:
    """(key, turns, burden): of a run's turns (input_tokens, cache_creation, cache_read) what was in context altogether."""
    return turns.groupBy(*key).agg(F.count("*").alias("turns"), F.sum(F.col("input_tokens") + F.col("cache_creation") + F.col("cache_read")).alias("burden"))


def tool_distribution(turns: DataFrame, *key: str) -> DataFrame:
    return turns.select(*key, F.explode("tool_calls").alias("tool")).groupBy(*key, "tool").agg(F.count("*").alias("n"))


def pareto(results: DataFrame) -> DataFrame:
    """(arm, quality, cost, n): means of the results without error by arm."""
    return results.where("error is null").groupBy("arm").agg(F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("cost"), 4).alias("cost"), F.count("*").alias("n"))


def within(measured: float, expected: float, tolerance: float) -> bool:
    return abs(measured - expected) <= tolerance
