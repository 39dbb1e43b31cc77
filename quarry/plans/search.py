"""Whole searches, composed of the operators. Everything works on batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.stem import decompose, expand_queries, facets, synonym_table
from quarry.operators import channels as C
from quarry.operators import cut, fusion, graph, relational, rescore, textindex
from quarry.operators.textindex import TextIndex
from quarry.sources.files import NOT_CODE, extension_filter
from quarry.sources.shared import new_folder


#: What BM25 reads of a chunk, and how heavy it is.
FIELDS = {"content": 1.0, "file_path": 2.0}


@dataclass(frozen=True)
class SearchSpec:
    """What a search asks for. reranker is (query, content) columns -> score column, where there is one."""

    max_results: int = 15
    dense: bool = True
    sparse: bool = True
    grep: bool = False
    regex: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    adaptive: bool = True
    expand: bool = False
    weighted: bool = False
    graph: bool = True
    candidates: int = 100
    reranker: Callable | None = None
    diversity: float | None = None

    def code_only(self) -> SearchSpec:
        return replace(self, exclude=(*self.exclude, *NOT_CODE))


@dataclass
class Index:
    """chunks (chunk_id, file_path, content, start_line, end_line, name); vectors (chunk_id, vector); edges (src, dst, kind);
    imports (importer, imported). encode gives a query's vector from its text column, for queries that bring none. text is the stored
    text index of the chunks; where none is given one is built at the first search and kept."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    edges: DataFrame | None = None
    imports: DataFrame | None = None
    encode: Callable | None = None
    text: TextIndex | None = None
    more: dict = field(default_factory=dict)

    def text_index(self) -> TextIndex:
        if self.text is None:
            self.text = textindex.store(self.chunks, list(FIELDS), new_folder(self.chunks.sparkSession, "text-index"))
        return self.text


def _wanted(index: Index, spec: SearchSpec) -> DataFrame:
    return index.chunks.where(extension_filter("file_path", list(spec.include), list(spec.exclude))) if spec.include or spec.exclude else index.chunks


def retrieve(index: Index, queries: DataFrame, spec: SearchSpec) -> DataFrame:
    """(query_id, chunk_id, score, channel) of the channels that the spec asks for. The file filter comes before any scoring; BM25's
    statistics are those of the whole index."""
    chunks, lists = _wanted(index, spec), {}
    among = chunks.select("chunk_id") if spec.include or spec.exclude else None
    texts = queries.select("query_id", (T.merge_pattern("query", F.lit(spec.regex)) if spec.regex else F.col("query")).alias("query"))
    best = lambda df: C.top_k(df.withColumn("score", F.round("score", 9)), spec.candidates).drop("rank")
    wide = expand_queries(texts, synonym_table(chunks.sparkSession)) if spec.expand else None
    if spec.sparse:
        lists["sparse"] = best(index.text_index().bm25(texts, FIELDS, among=among))
        if wide is not None:
            lists["exp_sparse"] = best(index.text_index().bm25(wide, FIELDS, among=among))
    if spec.dense and index.vectors is not None and ("vector" in queries.columns or index.encode):
        own = index.vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi") if spec.include or spec.exclude else index.vectors
        q = queries.select("query_id", "vector") if "vector" in queries.columns else texts.select("query_id", index.encode("query").alias("vector"))
        lists["dense"] = C.dense(own, q, spec.candidates)
        if wide is not None and index.encode:
            lists["exp_dense"] = C.dense(own, wide.select("query_id", index.encode("query").alias("vector")), spec.candidates)
    lists["exact"] = C.top_k(C.exact(chunks, texts), spec.candidates).drop("rank")
    return fusion.channels(**lists)


def search(index: Index, queries: DataFrame, spec: SearchSpec = SearchSpec()) -> DataFrame:
    """Results (query_id, chunk_id, rank, score, label, confidence, source, file_path, ...) of queries (query_id, query[, vector]).

    Retrieve, fuse, hydrate the candidates, re-score in a fixed order (role, path,
    file name, definition, coherence, pattern, graph, proximity), re-rank, diversify,
    cut. After fusion at most a few hundred rows a query are left.
    """
    types = queries.select("query_id", "query", T.query_type("query").alias("query_type"))
    found = retrieve(index, queries, spec)
    if spec.grep:
        ranked = C.grep_fuse(found.where("channel = 'sparse'").drop("channel"), found.where("channel = 'exact'").drop("channel"))
        return ranked.where(F.col("rank") <= spec.max_results).join(index.chunks, "chunk_id")
    fused = fusion.weighted_rrf(found, types) if spec.weighted else fusion.rrf(found)
    fused = fusion.confidence(fused.withColumn("score", F.round("score", 12)), fusion.fired(found))
    # From here on there are at most a few hundred rows a query. They are written once, so that the stages, which look at them
    # several times, don't run the channels again.
    x = graph.cut(C.top_k(fused, spec.candidates).drop("rank").join(index.chunks, "chunk_id").join(types, "query_id"))
    x = rescore.path_penalty(rescore.role_boost(x))
    x = rescore.stem_boost(x)
    if "name" in x.columns:
        x = rescore.definition_boost(x)
    x = rescore.coherence_boost(x)
    if spec.regex:
        x = rescore.regex_boost(x, spec.regex)
    x = x.withColumn("source", F.lit("fused"))
    if spec.graph and index.edges is not None:
        x = graph.cut(_with_neighbours(index, queries, graph.cut(x), types, spec))
    if index.imports is not None:
        top = C.top_k(x.select("query_id", "chunk_id", "score", "file_path"), 5).select("query_id", "file_path").distinct()
        wide = queries.where(T.architectural("query")).select("query_id")
        x = rescore.import_proximity(x, graph.import_neighbours(top, index.imports).join(wide, "query_id", "left_semi"))
    x = graph.cut(rescore.directory_proximity(x))
    if spec.reranker is not None:
        x = x.withColumn("score", spec.reranker(F.col("query"), F.col("content")))
    if spec.diversity is not None and index.vectors is not None:
        order = cut.mmr(C.top_k(x, 50), index.vectors, spec.diversity).select("query_id", "chunk_id", F.col("rank").alias("__r"))
        x = x.join(order, ["query_id", "chunk_id"], "left").withColumn("score", F.coalesce(1 / F.col("__r"), F.lit(0.0))).drop("__r")
    if spec.adaptive:
        return cut.adaptive(x, spec.max_results)
    return C.top_k(x, spec.max_results)


def _with_neighbours(index: Index, queries: DataFrame, x: DataFrame, types: DataFrame, spec: SearchSpec) -> DataFrame:
    """Each graph preset for the queries that it is for; neighbours join the candidates as graph results."""
    preset = queries.select("query_id", T.graph_preset("query").alias("preset"))
    used = [r.preset for r in preset.select("preset").distinct().collect()]  # at most six names
    new = None
    for name in used:
        own = x.join(preset.where(F.col("preset") == name), "query_id", "left_semi").select("query_id", "chunk_id", "score")
        one = graph.propagate(own, index.edges, graph.PRESETS[name], spec.candidates).where("not seed").select("query_id", "chunk_id", "score")
        new = one if new is None else new.unionByName(one)
    if new is None:
        return x
    more = new.join(index.chunks, "chunk_id").join(types, "query_id").withColumns({"source": F.lit("graph"), "label": F.lit("inferred"), "confidence": F.lit(0.0), "hits": F.lit(0).cast("long")})
    return x.unionByName(more, allowMissingColumns=True)


def multi_search(index: Index, queries: dict[int, str], spec: SearchSpec = SearchSpec()) -> DataFrame:
    df = index.chunks.sparkSession.createDataFrame(list(queries.items()), "query_id long, query string")
    return search(index, df, spec)


def merge_first(base: DataFrame, more: DataFrame, most: int) -> DataFrame:
    """base's results and more's, each chunk once at its better place in base, best scores first."""
    u = base.select("query_id", "chunk_id", "score", F.lit(0).alias("o")).unionByName(more.select("query_id", "chunk_id", "score", F.lit(1).alias("o")))
    one = u.groupBy("query_id", "chunk_id").agg(F.min_by("score", "o").alias("score"))
    return C.top_k(one, most)


def deep_search(index: Index, query: str, max_results: int = 20, budget: int = 32_768) -> DataFrame:
    """One question: itself and its parts searched, triaged, widened by the graph and cut to a budget of bytes."""
    spec = SearchSpec(max_results=max(20, max_results), adaptive=False).code_only()
    spark = index.chunks.sparkSession
    parts = spark.createDataFrame(list(enumerate(decompose(query))), "query_id long, query string")
    found = search(index, parts, spec)
    best = found.groupBy("chunk_id").agg(F.max("score").alias("score")).withColumn("query_id", F.lit(0).cast("long"))
    best = graph.cut(C.top_k(best.join(index.chunks, "chunk_id"), 200))
    top = best.agg(F.max("score").alias("s")).first().s or 1.0
    # confidence is measured against the best there is, so the floor means the same for any fusion
    sure = best.orderBy(F.desc("score")).limit(3).agg(F.avg(F.col("score") / top).alias("s")).first().s or 0.0
    picked = cut.triage(best.withColumn("score", F.col("score") / top), most=cut.triage_cap(sure)).select("query_id", "chunk_id", "rank")
    x = best.drop("rank").join(picked, ["query_id", "chunk_id"])
    if index.edges is not None:
        extra = graph.expand(picked.select("query_id", "chunk_id"), index.edges).join(index.chunks, "chunk_id")
        x = x.unionByName(extra.withColumn("rank", F.lit(1000) + F.row_number().over(cut.by_score())), allowMissingColumns=True)
    x = x.withColumn("bytes", F.octet_length("content").cast("long"))
    return cut.byte_budget(x, "bytes", budget)


def route_of(spark, query: str) -> str:
    return spark.createDataFrame([(query,)], "q string").select(T.route("q").alias("r")).first().r


def agent(index: Index, query: str, mode: str | None = None) -> tuple[str, DataFrame]:
    """(route, results): the query's route, or the mode given, and what it finds; an empty result falls back to a plain search."""
    from quarry.sources.files import glob_files

    spark = index.chunks.sparkSession
    route = mode or route_of(spark, query)
    plain = lambda n=10, **k: multi_search(index, {0: query}, SearchSpec(max_results=n, **k))
    if route == "file_pattern":
        return route, glob_files(index.chunks.select(F.col("file_path").alias("path")).distinct(), query.strip())[0]
    if route == "exact_symbol":
        out = plain(5)
        return route, plain(10, grep=True) if out.isEmpty() else out
    if route == "regex":
        return route, plain(20, grep=True, regex=query)
    if route == "architecture" and index.edges is not None:
        return route, overview(index)
    if route == "feature_planning":
        return route, feature_plan(index, query)
    if route == "structural" and index.edges is not None:
        name = query.strip("?!. ").split()[-1]
        hit = index.chunks.where(F.lower("name") == name.lower()).select(F.lit(name).alias("symbol"), "chunk_id") if "name" in index.chunks.columns else None
        if hit is not None and not hit.isEmpty():
            return route, graph.walk(hit, index.edges)
        route = "deep"
    if route in ("deep", "architecture"):
        return route, deep_search(index, query)
    if route == "exhaustive":
        lists = multi_search(index, dict(enumerate(facets(query))), SearchSpec(max_results=20, adaptive=False))
        x = lists.withColumn("query_id", F.lit(0).cast("long"))
        return route, cut.union_diversify(x)
    return route, plain({"analytical": 5}.get(route, 10))


def federated(indexes: dict[str, Index], queries: DataFrame, spec: SearchSpec = SearchSpec(), limit: int = 20) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Hits of several indexes, re-ranked in each and interleaved; and which were left out, with the reason."""
    hits, skipped = None, []
    for name, index in sorted(indexes.items()):
        if index.chunks.isEmpty():
            skipped.append((name, "empty"))
            continue
        one = search(index, queries, spec).select("query_id", "chunk_id", "score", "file_path").withColumn("target", F.lit(name))
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        raise ValueError("no index to search: " + ", ".join(f"{n} ({r})" for n, r in skipped))
    return fusion.target_rrf(hits).where(F.col("position") <= limit), skipped


def architecture(index: Index, centrality: DataFrame) -> dict[str, DataFrame]:
    """Central chunks, communities and import boundaries, as many as fit the number of chunks."""
    gods, groups, bounds = graph.budget(index.chunks.count())
    out = {"god_nodes": graph.god_nodes(centrality, index.chunks, gods)}
    if groups:
        out["communities"] = graph.communities(centrality, index.edges.where("kind = 'call'"), most=groups)
    if bounds and index.imports is not None:
        out["boundaries"] = graph.boundaries(index.imports, bounds)
    return out


def overview(index: Index, centrality: DataFrame | None = None) -> DataFrame:
    """(section, rank, line): the most central chunks, the largest communities and the boundaries that most imports cross, as many as fit the
    number of chunks. centrality is what was kept at build time; without it PageRank runs now."""
    if centrality is None:
        centrality = graph.pagerank(index.chunks.select("chunk_id"), index.edges.where("kind = 'call'"))
    parts, names = architecture(index, graph.cut(centrality)), index.chunks
    what = F.coalesce("name", F.lit("?")) if "name" in names.columns else F.lit("?")
    place = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  a few rows
    out = parts["god_nodes"].select(F.lit("central").alias("section"), place(F.desc("centrality"), "chunk_id").alias("rank"), F.concat(what, F.lit("  "), "file_path").alias("line"))
    if "communities" in parts:
        c = parts["communities"].join(names.withColumnRenamed("chunk_id", "component"), "component")
        out = out.unionByName(c.select(F.lit("community").alias("section"), place(F.desc("size"), "component").alias("rank"), F.concat(what, F.lit("  "), "file_path", F.lit("  "), F.col("size").cast("string")).alias("line")))
    if "boundaries" in parts:
        b = parts["boundaries"]
        out = out.unionByName(b.select(F.lit("boundary").alias("section"), place(F.desc("count"), "from_dir", "to_dir").alias("rank"), F.concat("from_dir", F.lit(" -> "), "to_dir", F.lit("  "), F.col("count").cast("string")).alias("line")))
    return out


def feature_plan(index: Index, query: str, most: int = 40) -> DataFrame:
    """(step, chunk_id, file_path) of what a feature would touch: chunks to change, chunks of files that import these or are imported, and tests
    that call them. A chunk stands in its first step, and no more than ``most`` are named in one."""
    found = graph.cut(deep_search(index, query).select("chunk_id", "file_path").distinct())
    steps = [found.select(F.lit(1).alias("o"), F.lit("change").alias("step"), "chunk_id", "file_path")]
    places = index.chunks.select("chunk_id", "file_path")
    if index.imports is not None:
        near = graph.import_neighbours(found.select(F.lit(0).alias("query_id"), "file_path").distinct(), index.imports).select("file_path")
        steps.append(places.join(near, "file_path", "left_semi").select(F.lit(2).alias("o"), F.lit("follow").alias("step"), "chunk_id", "file_path"))
    if index.edges is not None:
        by = index.edges.where("kind = 'call'").join(found.select(F.col("chunk_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("chunk_id")).distinct()
        tests = places.join(by, "chunk_id").where(T.file_role("file_path") == "test")
        steps.append(tests.select(F.lit(3).alias("o"), F.lit("test").alias("step"), "chunk_id", "file_path"))
    u = steps[0]
    for s in steps[1:]:
        u = u.unionByName(s)
    first = u.groupBy("chunk_id", "file_path").agg(F.min(F.struct("o", "step")).alias("m"))
    w = Window.partitionBy("m.o").orderBy("file_path", "chunk_id")
    return first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("m.step", "chunk_id", "file_path")


def docs_context(index: Index, language) -> dict[str, DataFrame]:
    return {"languages": relational.language_stats(index.chunks, language), "files": relational.per_file(index.chunks, "chunks")}


def formatted(results: DataFrame, budget: int = 12_000) -> DataFrame:
    """(query_id, text): results as path:lines with their score, in order of rank, up to so many bytes a query."""
    line = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("  "), F.format_number("score", 4), F.lit("\n"))
    x = results.withColumn("line", line).withColumn("bytes", F.octet_length("line").cast("long"))
    x = cut.byte_budget(x, "bytes", budget)
    return x.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "").alias("text"))


def formatted_graph(walk: DataFrame, chunks: DataFrame, each: int = 20) -> DataFrame:
    """(symbol, text): a symbol's neighbours (symbol, relation, chunk_id), a heading a relation with their number, then a line each."""
    x = walk.join(chunks.select("chunk_id", "file_path", "start_line", "name"), "chunk_id")
    line = F.concat(F.lit("  "), F.coalesce("name", F.lit("?")), F.lit("  "), "file_path", F.lit(":"), F.col("start_line").cast("string"))
    g = x.groupBy("symbol", "relation").agg(F.slice(F.array_sort(F.collect_set(line)), 1, each).alias("lines"), F.count("*").alias("n"))
    part = F.concat("relation", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.array_join("lines", "\n"))
    return g.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relation", part.alias("part")))), lambda s: s["part"]), "\n").alias("text"))


def formatted_blocks(results: DataFrame, budget: int = 16_000, full: int = 5, most_bytes: int = 8_000) -> DataFrame:
    """(query_id, text): blocks of code in order of rank, up to so many characters a query: the whole content of the first ``full``, cut at
    most_bytes characters, and of the others their first line."""
    head = F.concat(F.lit("### "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"))
    body = F.when(F.col("rank") <= full, T.truncated("content", most_bytes)["text"]).otherwise(F.element_at(F.split("content", "\n"), 1))
    x = results.withColumn("block", F.concat(head, F.coalesce(body, F.lit("")), F.lit("\n"))).withColumn("bytes", F.length("block").cast("long"))
    x = cut.byte_budget(x, "bytes", budget)
    return x.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "").alias("text"))


def cached_search(index: Index, queries: DataFrame, cache: DataFrame, stamp: str, spec: SearchSpec = SearchSpec(), threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(results, cache): queries (query_id, query, vector) that are near one in the cache (cached_id, vector, stamp, results) of the same index
    stamp take its results; the others are searched and join the cache, of which the latest thousand stay."""
    from quarry.operators.store import semantic_cache

    near = graph.cut(semantic_cache(cache, queries, stamp, threshold))
    known = near.join(cache.where(F.col("stamp") == stamp), "cached_id").select("query_id", F.explode("results").alias("r")).select("query_id", "r.*")
    fresh = queries.join(near, "query_id", "left_anti")
    found = graph.cut(search(index, fresh, spec).select("query_id", "chunk_id", "rank", F.col("score").cast("double").alias("score")))
    of = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("results"))
    last = cache.agg(F.coalesce(F.max("cached_id"), F.lit(0)).alias("n")).first().n
    new = fresh.join(of, "query_id").select((F.lit(last) + F.row_number().over(Window.orderBy("query_id"))).alias("cached_id"), "vector", F.lit(stamp).alias("stamp"), "results")
    kept = cache.where(F.col("stamp") == stamp).unionByName(new).orderBy(F.desc("cached_id")).limit(1000)
    return known.select("query_id", "chunk_id", "rank", "score").unionByName(found.select("query_id", "chunk_id", "rank", "score")), kept


def search_with_draft(index: Index, query: str, write: Callable[[str], str], spec: SearchSpec = SearchSpec()) -> DataFrame:
    """What the query finds, and what a text written in answer to it finds, each chunk once. A draft that can't be written leaves the query's own."""
    base = multi_search(index, {0: query}, spec)
    try:
        draft = write(query)
    except Exception:  # whatever the writer raises
        return C.top_k(base.select("query_id", "chunk_id", "score"), spec.max_results)
    return merge_first(base, multi_search(index, {0: draft}, spec), spec.max_results)


def plan(steps: list[tuple[str, str]], run: Callable[[str, str], str], seconds: float = 10.0, most: int = 5) -> list[tuple[str, str]]:
    """(step, outcome) of at most ``most`` steps (name, query) while time is left; a step that fails says why."""
    import time

    end, out = time.monotonic() + seconds, []
    for name, query in steps[:most]:
        if time.monotonic() >= end:
            out.append((name, "skipped: out of time"))
            continue
        try:
            out.append((name, run(name, query)))
        except Exception as e:  # a step's failure is its outcome
            out.append((name, f"failed: {e}"))
    return out


def adaptive_walk(symbols: DataFrame, edges: DataFrame, chunks: DataFrame, few: int = 5, many: int = 50) -> tuple[str, DataFrame]:
    """A symbol's neighbours: with a second hop if there are few of them, by folder if there are many."""
    near = graph.walk(symbols, edges, 200)
    n = near.count()
    if n < few:
        more = near.select("symbol", "chunk_id").distinct()
        return "two hops", near.unionByName(graph.walk(more, edges, 20)).dropDuplicates(["symbol", "relation", "chunk_id"])
    if n > many:
        return "by folder", relational.per_directory(near.join(chunks.select("chunk_id", "file_path"), "chunk_id").select(F.col("relation").alias("group"), "file_path"))
    return "one hop", near


def suggestions(results: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, name): other names among the results of queries whose best result is ambiguous, best first."""
    unsure = results.where("rank = 1 and label = 'ambiguous'").select("query_id")
    x = results.join(unsure, "query_id", "left_semi").where("name is not null").groupBy("query_id", "name").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "name")
    return x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("query_id", "name", "rank")


def symbol_shortcut(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id): definitions of the symbol that a question is about, which make a search of it needless."""
    q = queries.select("query_id", T.symbol_in("query").alias("name")).where("name is not null")
    return index.chunks.where("name is not null").select("chunk_id", "name").join(q, "name").select("query_id", "chunk_id")


def federated_history(repos: dict[str, tuple[DataFrame, DataFrame | None]], limit: int = 20, **conditions) -> DataFrame:
    """Commits of several repositories (commits, file_commits), newest first, with the repository's name."""
    each = [relational.filter_commits(c, f, limit=limit, **conditions).withColumn("repo", F.lit(name)) for name, (c, f) in sorted(repos.items())]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.orderBy(F.desc("ts"), "repo", F.desc("hash")).limit(limit)


def module_scaffold(index: Index, folder: str, tokens: int = 2000) -> DataFrame:
    """(section, line): a folder's symbols, imports, importers, and calls out and in, in this order, up to so many tokens."""
    own = index.chunks.where(F.startswith(F.col("file_path"), F.lit(folder.rstrip("/") + "/")))
    parts = [own.where("name is not null").select(F.lit(0).alias("o"), F.lit("symbols").alias("section"), F.concat("file_path", F.lit(": "), "name").alias("line"))]
    if index.imports is not None:
        inside = lambda c: F.startswith(F.col(c), F.lit(folder.rstrip("/") + "/"))
        parts.append(index.imports.where(inside("importer")).select(F.lit(1).alias("o"), F.lit("imports").alias("section"), F.col("imported").alias("line")))
        parts.append(index.imports.where(inside("imported")).select(F.lit(2).alias("o"), F.lit("imported by").alias("section"), F.col("importer").alias("line")))
    if index.edges is not None:
        ids, names = own.select("chunk_id"), index.chunks.select("chunk_id", "name")
        calls = index.edges.where("kind = 'call'")
        out = calls.join(ids.withColumnRenamed("chunk_id", "src"), "src", "left_semi").join(names.withColumnRenamed("chunk_id", "dst"), "dst")
        into = calls.join(ids.withColumnRenamed("chunk_id", "dst"), "dst", "left_semi").join(names.withColumnRenamed("chunk_id", "src"), "src")
        parts += [x.where("name is not null").select(F.lit(o).alias("o"), F.lit(s).alias("section"), F.col("name").alias("line")) for o, s, x in ((3, "calls", out), (4, "called by", into))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.distinct().withColumns({"query_id": F.lit(0), "size": F.ceil(F.length("line") / 4)})
    u = u.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "line")))
    return cut.byte_budget(u, "size", tokens).select("rank", "section", "line")
