"""Lookups, joins and counts over the engine's tables, its history and its notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi")


def symbol_exact(defs: DataFrame, chunks: DataFrame, symbol: str) -> DataFrame:
    return defs.where(F.col("symbol") == symbol).select("symbol", "chunk_id").join(chunks, "chunk_id")


def commits_touching(commits: DataFrame, file_commits: DataFrame, path: str, limit: int = 20) -> DataFrame:
    hit = file_commits.where(F.col("path") == path).select("hash")
    return commits.join(hit, "hash", "left_semi").orderBy(F.desc("ts"), F.desc("hash")).limit(limit)


def filter_commits(commits: DataFrame, file_commits: DataFrame | None = None, since: int | None = None, author: str | None = None, path: str | None = None, message: str | None = None, limit: int = 20) -> DataFrame:
    """All conditions together, newest first. since is strict; author and message are parts in either case, in which % and _ mean nothing."""
    x = commits
    if since is not None:
        x = x.where(F.col("ts") > since)
    for column, part in (("author", author), ("message", message)):
        if part:
            x = x.where(F.contains(F.lower(column), F.lit(part.replace("%", "").replace("_", "").lower())))
    if path is not None:
        x = x.join(file_commits.where(F.col("path") == path).select("hash"), "hash", "left_semi")
    return x.orderBy(F.desc("ts"), F.desc("hash")).limit(limit)


def search_messages(commits: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Messages with any of the words, newest first."""
    words = [w.lower() for w in query.split()]
    hit = T.any_of(F.lower("message"), words) if words else F.lit(False)
    return commits.where(hit).orderBy(F.desc("ts"), F.desc("hash")).limit(limit)


def recent_changes(hits: DataFrame, file_commits: DataFrame, commits: DataFrame, files: int = 5) -> DataFrame:
    """(query_id, path, hash, ts): of the first different files among the hits (query_id, file_path, rank) the latest commit."""
    first = hits.groupBy("query_id", "file_path").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "file_path")
    first = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= files)
    x = first.join(file_commits, first["file_path"] == file_commits["path"]).join(commits.select("hash", "ts"), "hash")
    return x.groupBy("query_id", "path").agg(F.max(F.struct("ts", "hash")).alias("m")).select("query_id", "path", "m.hash", "m.ts")


def blame_chunks(blame: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, hash): lines (file_path, line, hash) in the range of lines of a chunk of that file."""
    c = chunks.select("chunk_id", "file_path", "start_line", "end_line")
    return blame.join(c, "file_path").where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("chunk_id", "hash").distinct()


def overlapping(ranked: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs of a query's results of one file, the later of which has more than ``share`` of its lines in the earlier."""
    a, b = ranked.alias("a"), ranked.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("query_id", "file_path")]
    common = F.least("a.end_line", "b.end_line") - F.greatest("a.start_line", "b.start_line") + 1
    hit = (F.col("b.rank") < F.col("a.rank")) & (common > share * (F.col("a.end_line") - F.col("a.start_line") + 1))
    return a.join(b, [*same, hit]).select(F.col("a.query_id"), F.col("a.chunk_id"), F.col("b.chunk_id").alias("covers"))


def methods_within(defs: DataFrame, spans: DataFrame) -> DataFrame:
    """(name, start_line): definitions that lie in the line range of a span of their file, first line of each name."""
    d, s = defs.alias("d"), spans.alias("s")
    hit = (F.col("d.file_path") == F.col("s.file_path")) & (F.col("d.start_line") > F.col("s.start_line")) & (F.col("d.end_line") <= F.col("s.end_line"))
    return d.join(s, hit).groupBy("d.name").agg(F.min("d.start_line").alias("start_line")).orderBy("start_line", "name")


def implementations(hierarchy: DataFrame, trait: str, trait_chunks: DataFrame) -> DataFrame:
    by_name = hierarchy.where(F.col("parent_name") == trait).select("child_chunk")
    by_chunk = hierarchy.join(trait_chunks.select(F.col("chunk_id").alias("parent_chunk")), "parent_chunk", "left_semi").select("child_chunk")
    return by_name.unionByName(by_chunk).where("child_chunk is not null").distinct()


def references(calls: DataFrame, type_refs: DataFrame, symbol: str) -> DataFrame:
    return calls.where(F.col("name") == symbol).select("chunk_id").distinct().union(type_refs.where(F.col("name") == symbol).select("chunk_id").distinct()).distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("call", "type_ref", "hierarchy")), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


def per_file(df: DataFrame, name: str = "n") -> DataFrame:
    return df.groupBy("file_path").agg(F.count("*").alias(name))


def language_stats(chunks: DataFrame, language: Column) -> DataFrame:
    return chunks.withColumn("language", language).groupBy("language").agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("chunks"))


def per_directory(items: DataFrame, top: int = 3) -> DataFrame:
    """(group, dir, n, others, rest): the most frequent folders of each group, with how many folders and items are left."""
    x = items.groupBy("group", T.parent_dir("file_path").alias("dir")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("group")
    x = x.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "dir")), "dirs": F.count("*").over(w), "total": F.sum("n").over(w)})
    kept = F.sum(F.when(F.col("r") <= top, F.col("n"))).over(w)
    return x.withColumn("rest", F.col("total") - kept).where(F.col("r") <= top).select("group", "dir", "n", F.greatest(F.col("dirs") - top, F.lit(0)).alias("others"), "rest")


def evict(notes: DataFrame, cap: int = 1000) -> DataFrame:
    """The newest notes of each scope, up to cap."""
    w = Window.partitionBy("scope").orderBy(F.desc("created_ts"), F.desc("note_id"))
    return notes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).drop("r")


def save_note(notes: DataFrame, new: DataFrame) -> DataFrame:
    """new (note_id, created_ts, scope, content, tags) take the place of notes of their scope and content; blank ones are no notes."""
    new = new.withColumn("content", F.trim("content")).where("content <> ''")
    return notes.join(new.select("scope", "content"), ["scope", "content"], "left_anti").unionByName(new)


def recall(notes: DataFrame, queries: DataFrame, scope: str | None = None, limit: int = 20) -> DataFrame:
    """Notes by BM25 over content (x 3) and tags (x 1), if there are any; newest first among equals."""
    from quarry.operators.channels import bm25_fields, top_k

    n = notes.where(F.lit(scope is None) | (F.col("scope") == scope)).withColumnRenamed("note_id", "chunk_id")
    fields = {"content": 3.0} | ({"tags": 1.0} if "tags" in notes.columns else {})
    scored = bm25_fields(n, queries, fields).join(n.select("chunk_id", "created_ts"), "chunk_id")
    return top_k(scored.withColumn("score", F.round("score", 9)), max(1, min(200, limit)), F.desc("created_ts")).withColumnRenamed("chunk_id", "note_id")


def recall_contains(notes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """How many of the query's words a note contains, in either case."""
    words = [w.lower() for w in query.split()]
    hits = sum((F.contains(F.lower("content"), F.lit(w)).cast("int") for w in words), F.lit(0))
    return notes.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.desc("created_ts"), F.desc("note_id")).limit(limit)


def targets(registry: DataFrame) -> DataFrame:
    """(project, branch) of a registry with an array of branches; a project without any is a target itself."""
    return registry.select("project", F.explode_outer("branches").alias("branch"))
