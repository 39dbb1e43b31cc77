"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import cut, new_folder, shared_dir

__all__ = ["cut", "new_folder", "shared_dir", "shuffle_parts", "small_side", "table", "tidy", "whole", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run):
    """A function of Arrow batches that gives freed memory back to the system when its task is done: Python workers live on and serve
    other stages, beside those of the JVM."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def small_side(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """df, a table of few columns of numbers, to be sent to every task if it has no more than so many rows; else it is joined like
    any other. The result is the same; sending it saves shuffling the texts on the other side."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, found: DataFrame, id_col: str, stays) -> DataFrame:
    """The rows of docs whose identifier is in a row of found (doc_id, ...) for which ``stays`` holds. found has all of docs' identifiers;
    those to go are mostly far fewer."""
    gone = cut(found.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or(stays).alias("__stays")).where("not __stays").select("__id"))
    gone = small_side(gone)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left_anti")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text="text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))
