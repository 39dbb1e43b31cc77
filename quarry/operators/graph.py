"""Code-graph operators over edges (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.shared import cut

#: Decay by edge kind, second hop, and how many chunks may be added (a divisor of the number of candidates).
PRESETS = {
    "identifier": {"call": 0.10, "caller": 0.10, "type_ref": 0.05, "hierarchy": 0.05, "transitive": 0.0, "divide": 4},
    "keyword": {"call": 0.15, "caller": 0.15, "type_ref": 0.10, "hierarchy": 0.10, "transitive": 0.0, "divide": 3},
    "semantic": {"call": 0.15, "caller": 0.12, "type_ref": 0.08, "hierarchy": 0.12, "transitive": 0.0, "divide": 4},
    "mixed": {"call": 0.20, "caller": 0.15, "type_ref": 0.12, "hierarchy": 0.10, "transitive": 0.0, "divide": 3},
    "architectural": {"call": 0.30, "caller": 0.25, "type_ref": 0.20, "hierarchy": 0.15, "transitive": 0.08, "divide": 1},
    "localization": {"call": 0.35, "caller": 0.35, "type_ref": 0.25, "hierarchy": 0.20, "transitive": 0.12, "divide": 1},
}


def directed(calls: DataFrame, type_refs: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(src, dst): calls one way, references and hierarchy both ways. Repeated edges weigh more and stay; loops go."""
    both = type_refs.select("src", "dst").unionByName(hierarchy.select("src", "dst"))
    return calls.select("src", "dst").unionByName(both).unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")


def hops(edges: DataFrame) -> DataFrame:
    """Which way scores go, as (src, dst, kind): calls as call and, backwards, as caller; the other kinds both ways."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(F.col("kind") == "call", "caller").otherwise(F.col("kind")).alias("kind"))
    return edges.select("src", "dst", "kind").unionByName(back)


def _decay(preset: dict) -> Column:
    w = F
    for kind in ("call", "caller", "type_ref", "hierarchy"):
        w = w.when(F.col("kind") == kind, float(preset[kind]))
    return w.otherwise(0.0)


def propagate(seeds: DataFrame, edges: DataFrame, preset: dict, candidates: int = 100) -> DataFrame:
    """Seeds (query_id, chunk_id, score) with their scores, and their neighbours with the largest decayed one: score x decay of the
    edge's kind, then along calls from the neighbours x the transitive decay. At most as many chunks as candidates / divide are
    added. A seed's score is never changed. seed tells which is which."""
    top = seeds.groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    s = seeds.join(top.where("top > 0"), "query_id").select("query_id", F.col("chunk_id").alias("src"), (F.col("score") / F.col("top")).alias("base"))
    one = s.join(hops(edges), "src").select("query_id", F.col("dst").alias("chunk_id"), (F.col("base") * _decay(preset)).alias("bonus")).where("bonus > 0")
    one = one.groupBy("query_id", "chunk_id").agg(F.max("bonus").alias("bonus"))
    if preset["transitive"] > 0:
        first = one.join(seeds, ["query_id", "chunk_id"], "left_anti").select("query_id", F.col("chunk_id").alias("src"), "bonus")
        calls = edges.where("kind = 'call'").select("src", F.col("dst").alias("chunk_id"))
        two = first.join(calls, "src").select("query_id", "chunk_id", (F.col("bonus") * float(preset["transitive"])).alias("bonus"))
        one = one.unionByName(two).groupBy("query_id", "chunk_id").agg(F.max("bonus").alias("bonus"))
    new = one.join(seeds, ["query_id", "chunk_id"], "left_anti").join(top, "query_id").select("query_id", "chunk_id", (F.col("bonus") * F.col("top")).alias("score"), F.lit(False).alias("seed"))
    out = seeds.select("query_id", "chunk_id", "score", F.lit(True).alias("seed")).unionByName(new)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    out = out.withColumn("rank", F.row_number().over(w)).join(top.select("query_id", "n"), "query_id")
    return out.where(F.col("rank") <= F.col("n") + candidates // preset["divide"]).drop("n")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(chunk_id, centrality). Mass of nodes without outgoing edges is spread evenly; nodes without any edge stay. Each iteration is
    a join and an aggregate on one key and is written to the shared folder."""
    nodes = cut(nodes.select("chunk_id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("centrality", F.lit(0.0))
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    e = cut(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    dead = cut(nodes.join(e.select(F.col("src").alias("chunk_id")).distinct(), "chunk_id", "left_anti"))
    nodes = cut(nodes.join(dead.withColumn("dead", F.lit(True)), "chunk_id", "left").withColumn("dead", F.coalesce("dead", F.lit(False))))
    rank, lost = nodes.withColumn("centrality", F.lit(1.0 / n)), nodes.where("dead").count() / n
    for _ in range(iterations):
        got = e.join(rank, e["src"] == rank["chunk_id"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("centrality")).alias("g"))
        was = rank.select(F.col("chunk_id").alias("__id"), F.col("centrality").alias("was"))
        new = rank.select("chunk_id", "dead").join(got, rank["chunk_id"] == got["dst"], "left").join(was, F.col("chunk_id") == F.col("__id"))
        new = new.select("chunk_id", "dead", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + lost / n)).alias("centrality"), "was")
        new = cut(new)
        # the mass that the next round spreads and the change, from one pass
        r = new.agg(F.coalesce(F.sum(F.when(F.col("dead"), F.col("centrality"))), F.lit(0.0)).alias("lost"), F.sum(F.abs(F.col("centrality") - F.col("was"))).alias("change")).first()
        rank, lost = new.drop("was"), r.lost
        if r.change < tolerance:
            break
    return rank.select("chunk_id", "centrality")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(chunk_id, component): the smallest node reachable along edges in either direction, by labels that spread and shortcut."""
    e = edges.where("src <> dst").select("src", "dst")
    e = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(nodes.select("chunk_id").distinct().withColumn("component", F.col("chunk_id")))
    for _ in range(rounds):
        near = e.join(label, e["dst"] == label["chunk_id"]).groupBy("src").agg(F.min("component").alias("m"))
        step = label.join(near, label["chunk_id"] == near["src"], "left").select("chunk_id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = label.select(F.col("chunk_id").alias("component"), F.col("component").alias("root"))
        new = cut(step.join(jump, "component", "left").select("chunk_id", F.least("component", "root").alias("component"), "was"))
        done = new.where("component <> was").isEmpty()
        label = new.drop("was")
        if done:
            return label
    raise RuntimeError("components did not settle")


def communities(centrality: DataFrame, calls: DataFrame, seeds: int = 200, most: int = 10) -> DataFrame:
    """(component, size): components of the most central nodes and those they call or are called by, the largest first."""
    top = centrality.orderBy(F.desc("centrality"), "chunk_id").limit(seeds).select("chunk_id")
    e = calls.select("src", "dst").where("src <> dst")
    near = e.join(top.withColumnRenamed("chunk_id", "src"), "src", "left_semi").unionByName(e.join(top.withColumnRenamed("chunk_id", "dst"), "dst", "left_semi")).distinct()
    nodes = top.unionByName(near.select(F.col("src").alias("chunk_id"))).unionByName(near.select(F.col("dst").alias("chunk_id"))).distinct()
    return components(nodes, near).groupBy("component").agg(F.count("*").alias("size")).where("size > 1").orderBy(F.desc("size"), "component").limit(most)


def parts(df: DataFrame, key: str, rows: int, each: int = 1_000_000) -> DataFrame:
    """df dealt by a key over so many partitions that ``rows`` rows are about ``each`` in one, whatever the session's number of partitions."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)), key)


def walk(symbols: DataFrame, edges: DataFrame, each: int = 20) -> DataFrame:
    """For targets (symbol, chunk_id): callers (not itself), callees, type references and hierarchy, at most ``each`` of a relation.

    Repeated neighbours share a rank, so those beyond the limit go before anything is gathered by symbol, and what a task holds
    is a share of the edges that doesn't grow with them."""
    n = edges.count()
    t = symbols.select("symbol", F.col("chunk_id").alias("t"))
    a, b = (parts(edges.withColumn("t", F.col(c)), "t", n).join(parts(t, "t", n), "t") for c in ("src", "dst"))
    out = a.select("symbol", F.when(F.col("kind") == "call", "callee").otherwise(F.col("kind")).alias("relation"), F.col("dst").alias("chunk_id"))
    back = b.where("kind <> 'call' or src <> t").select("symbol", F.when(F.col("kind") == "call", "caller").otherwise(F.col("kind")).alias("relation"), F.col("src").alias("chunk_id"))
    w = Window.partitionBy("symbol", "relation").orderBy("chunk_id")
    return out.unionByName(back).withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= each).distinct()


def callers(symbols: DataFrame, calls: DataFrame, depth: int = 1) -> DataFrame:
    """(symbol, chunk_id, depth): chunks that call the target, and at depth 2 those that call these. A step is dealt by as many rows as
    there are calls, and written once where another follows."""
    found = symbols.select("symbol", "chunk_id", F.lit(0).alias("depth"))
    last, n = found, calls.count()
    for d in range(1, depth + 1):
        step = parts(calls.select("dst", "src"), "dst", n).join(parts(last.select("symbol", F.col("chunk_id").alias("dst")), "dst", n), "dst").select("symbol", F.col("src").alias("chunk_id"))
        step = parts(step, "symbol", n).distinct()
        last = step.join(parts(found, "symbol", n), ["symbol", "chunk_id"], "left_anti").withColumn("depth", F.lit(d))
        last = cut(last) if d < depth else last
        found = found.unionByName(last)
    return found.where("depth > 0")


def callees(symbols: DataFrame, calls: DataFrame, depth: int = 1) -> DataFrame:
    return callers(symbols, calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth)


def import_neighbours(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(query_id, file_path): what the files (query_id, file_path) import or are imported by, themselves left out."""
    a = files.join(imports, files["file_path"] == imports["importer"]).select("query_id", F.col("imported").alias("file_path"))
    b = files.join(imports, files["file_path"] == imports["imported"]).select("query_id", F.col("importer").alias("file_path"))
    return a.unionByName(b).distinct().join(files, ["query_id", "file_path"], "left_anti")


def module_cohesion(scored: DataFrame, chunks: DataFrame, imports: DataFrame, decay: float, most: int) -> DataFrame:
    """(query_id, chunk_id, score): chunks of the files next to a ranking's files (query_id, chunk_id, score, file_path) in the import
    graph, at decay x the ranking's best score; the first ``most`` of each query that it doesn't have. None where decay or the best
    score is nought or less."""
    top = scored.groupBy("query_id").agg(F.max("score").alias("top")).where((F.col("top") > 0) & F.lit(decay > 0))
    files = scored.join(top, "query_id", "left_semi").select("query_id", "file_path").distinct()
    new = import_neighbours(files, imports).join(chunks.select("chunk_id", "file_path"), "file_path").select("query_id", "chunk_id").distinct()
    w = Window.partitionBy("query_id").orderBy("chunk_id")
    new = new.join(scored, ["query_id", "chunk_id"], "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return new.join(top, "query_id").select("query_id", "chunk_id", (decay * F.col("top")).alias("score"))


def symbol_card(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(symbol, chunk_id, callers, callees): each definition (symbol, chunk_id) with how many different chunks call it and it calls."""
    into = calls.where("src <> dst").groupBy(F.col("dst").alias("chunk_id")).agg(F.count_distinct("src").alias("callers"))
    out = calls.groupBy(F.col("src").alias("chunk_id")).agg(F.count_distinct("dst").alias("callees"))
    zero = F.lit(0).cast("long")
    return symbols.select("symbol", "chunk_id").join(into, "chunk_id", "left").join(out, "chunk_id", "left").select("symbol", "chunk_id", F.coalesce("callers", zero).alias("callers"), F.coalesce("callees", zero).alias("callees"))


def boundaries(imports: DataFrame, most: int = 25) -> DataFrame:
    """(from_dir, to_dir, count): imports between different top folders."""
    x = imports.select(T.top_dir("importer").alias("from_dir"), T.top_dir("imported").alias("to_dir")).where("from_dir <> to_dir")
    return x.groupBy("from_dir", "to_dir").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "from_dir", "to_dir").limit(most)


def god_nodes(centrality: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    return centrality.orderBy(F.desc("centrality"), "chunk_id").limit(n).join(chunks, "chunk_id")


def budget(chunks: int) -> tuple[int, int, int]:
    """(god nodes, communities, boundaries) of an overview of so many chunks."""
    if chunks < 500:
        return 5, 0, 0
    return (5, 3, 10) if chunks <= 2000 else (10, 5, 25) if chunks <= 10_000 else (15, 8, 40)


def expand(selected: DataFrame, edges: DataFrame, budget_: int = 12, most: int = 7) -> DataFrame:
    """(query_id, chunk_id, score): neighbours of the selected chunks by how many edges lead to them, 0.5 + 0.2 for each edge more."""
    s = selected.select("query_id", F.col("chunk_id").alias("src"))
    support = hops(edges).join(s, "src").groupBy("query_id", F.col("dst").alias("chunk_id")).agg(F.count("*").alias("n"))
    new = support.join(selected, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.5) + 0.2 * (F.col("n") - 1))
    have = selected.groupBy("query_id").agg(F.count("*").alias("have"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return new.join(have, "query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.least(F.lit(most), F.greatest(F.lit(0), budget_ - F.col("have")))).select("query_id", "chunk_id", "score")


def resolve(calls: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """Unresolved calls (call_id, name, file_path) to definitions (symbol, chunk_id, file_path) of that name, or of the name without
    its module if there is none: one imported by the file, else in its folder, else next to that, else the first.

    The first definition of a symbol is settled for each place, each folder and each folder above before calls are joined, so a
    call meets at most one candidate of each kind, however many definitions a symbol has.
    """
    folder = T.parent_dir("file_path")
    c = calls.select("call_id", "name", T.strip_module("name").alias("bare"), "file_path", folder.alias("dir"), T.parent_dir(folder).alias("above"))
    d = defs.select("symbol", "chunk_id", F.col("file_path").alias("def_path"), folder.alias("dir"), T.parent_dir(folder).alias("above"))
    first = F.min("chunk_id").alias("first")
    linked = imports.select(F.col("importer").alias("file_path"), F.col("imported").alias("def_path")).distinct().join(d, "def_path").groupBy("file_path", "symbol").agg(first)
    of_dir, of_above, of_all = d.groupBy("dir", "symbol").agg(first), d.groupBy("above", "symbol").agg(first), d.groupBy("symbol").agg(first)
    x, found = c, []
    for name in ("name", "bare"):
        for where, key in ((linked, ["file_path"]), (of_dir, ["dir"]), (of_above, ["above"]), (of_all, [])):
            column = f"c{len(found)}"
            x = x.join(where.select(*key, F.col("symbol").alias(name), F.col("first").alias(column)), [*key, name], "left")
            found.append(column)
    return x.select("call_id", "name", F.coalesce(*found).alias("callee")).where("callee is not null")
