"""Schemas of the engine's tables, in one place, with their version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
TABLES = {
    "chunks": "chunk_id long, file_path string, start_line int, end_line int, content string, chunk_kind string, name string, ast_kind string, language string",
    "files": "path string, hash long, size long, mtime long",
    "postings": "chunk_id long, term string, tf long, length int",
    "call_edges": "src long, dst long, kind string",
    "symbol_defs": "symbol string, kind string, chunk_id long, file_path string",
    "module_edges": "importer string, imported string",
    "commits": "hash string, author string, ts long, message string",
    "file_commits": "hash string, path string",
    "notes": "note_id long, created_ts long, scope string, content string, tags string",
    "meta": "version int, fingerprint string, chunks long, files long",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with just the table's columns and types; fails on a column that is missing."""
    return df.to(empty(df.sparkSession, name).schema)


def check_version(meta: DataFrame, fingerprint: str) -> str:
    """not_indexed, stale or ready. An index of another version or fingerprint is stale."""
    row = meta.first()
    if row is None:
        return "not_indexed"
    return "ready" if (row.version, row.fingerprint) == (VERSION, fingerprint) else "stale"
