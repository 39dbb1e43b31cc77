"""Keeping an index up to date, and checking it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str = "path", version: str = "hash") -> DataFrame:
    """(key, change): insert, update, delete or same."""
    a, b = old.select(key, F.col(version).alias("__a"), F.lit(True).alias("__o")), new.select(key, F.col(version).alias("__b"), F.lit(True).alias("__n"))
    change = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "delete").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("update")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(table: DataFrame, fresh: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """table without the rows of changed or deleted keys, with fresh's rows of new and changed ones."""
    gone = changes.where("change in ('update', 'delete')").select(key)
    come = changes.where("change in ('update', 'insert')").select(key)
    return table.join(gone, key, "left_anti").unionByName(fresh.join(come, key, "left_semi"))


def insert_missing(table: DataFrame, rows: DataFrame, key: str = "hash") -> DataFrame:
    return rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Each table without the rows whose key column holds a chunk that is gone."""
    return {n: t.join(gone.select(F.col("chunk_id").alias(keys[n])), keys[n], "left_anti") for n, t in tables.items()}


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, n): edge ends that no chunk has."""
    e = edges.select("kind", F.col("src").alias("chunk_id")).unionByName(edges.select("kind", F.col("dst").alias("chunk_id")))
    return e.join(nodes.select("chunk_id"), "chunk_id", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def validate(meta: DataFrame, chunks: DataFrame, postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """(check_name, expected, found, ok)."""
    n = lambda df, name: df.select(F.lit(name).alias("check_name"), "chunk_id").distinct().groupBy("check_name").agg(F.count("*").alias("found"))
    found = n(chunks, "chunks").unionByName(n(postings, "postings")).unionByName(n(vectors, "vectors"))
    return meta.join(found, "check_name", "left").select("check_name", "expected", F.coalesce("found", F.lit(0).cast("long")).alias("found"), (F.col("expected") == F.coalesce("found", F.lit(0))).alias("ok"))
