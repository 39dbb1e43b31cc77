"""Steps whose rows, bytes or memory once grew faster than the input."""

import math

import numpy as np

from quarry import queries
from quarry.functions import text as T
from quarry.operators import channels, chunking, graph, metrics, store, textindex


def top_of_plan(df, until: str = "Join") -> str:
    """The optimised plan from the result down to the first operator of this name."""
    return df._jdf.queryExecution().optimizedPlan().toString().split(until)[0]


CHUNKS = [(i, "f", "a" if i % 2 else "b", ["x.a", "b", "a"]) for i in range(60)] + [(100, "g", "a", ["a"]), (101, None, "a", ["a"]), (102, "f", None, ["a"]), (103, "f", "c", None)]


def chunks(spark, rows=CHUNKS):
    return spark.createDataFrame(rows, "chunk_id long, file_path string, name string, calls array<string>")


def brute(rows) -> set:
    return {(a, b) for a, f, _, calls in rows for b, g, name, _ in rows if f and f == g and a != b and name in [c.split(".")[-1] for c in calls or []]}


def test_call_edges_make_each_pair_once_and_sort_none(spark):
    e = chunking.call_edges(chunks(spark), block=7)
    got = [tuple(r) for r in e.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(CHUNKS)
    assert "Aggregate" not in top_of_plan(e)
    # ids that stand for two names or files
    twice = [*CHUNKS, (3, "f", "b", ["c"]), (3, "g", "a", ["a"])]
    got = [tuple(r) for r in chunking.call_edges(chunks(spark, twice), block=7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(twice)


def test_called_by_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(chunking, "call_edges", None)
    name = {i: n for i, _, n, _ in CHUNKS}
    want: dict = {}
    for a, b in brute(CHUNKS):
        want.setdefault(b, set()).add(name[a])
    got = {r.chunk_id: r.called_by for r in chunking.called_by(chunks(spark)).collect()}
    assert got == {b: sorted(n for n in names if n) for b, names in want.items()}


def test_a_cache_meets_its_queries_in_batches(spark):
    nan = float("nan")
    cached = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [None, 1.0])]
    asked = [(2, [3.0, 0.0]), (3, [0.1, 1.0]), (8, None), (9, [0.0, 0.0]), (10, [0.0, 5.0, 0.0]), (11, [1.0]), (12, [nan, 1.0]), (13, [1.0, None]), (14, [-1.0, -1.0])]
    c = spark.createDataFrame([(*r, "s") for r in cached], "cached_id long, vector array<double>, stamp string")
    q = spark.createDataFrame(asked, "query_id long, vector array<double>")
    found = store.semantic_cache(c, q, "s", 0.5, others=True)
    got = {r.query_id: (r.cached_id, r.similarity) for r in found.collect()}
    assert math.isnan(got.pop(12)[1]) and got == {2: (1, 1.0)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    # nought is near enough here: the least number of those at nought, for vectors of no length or of other sizes
    low = {r.query_id: (r.cached_id, r.similarity) for r in store.semantic_cache(c, q, "s", 0.0, others=True).collect()}
    assert low[8] == low[9] == low[11] == low[13] == (1, 0.0) and low[10] == (1, 0.0) and low[3] == (1, round(0.1 / math.sqrt(1.01), 9))


def vectors(spark, n, size=4, batch=50):
    """Few different vectors, so that many tie; in batches of Arrow that are small."""
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (n, size)).astype(float)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>").repartition(2)


def passed_on(spark, f):
    """The rows that f's tasks pass on to top_k, which is left out."""
    was, channels.top_k = channels.top_k, lambda df, k, *more: df
    try:
        return f().count()
    finally:
        channels.top_k = was
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def best_of(s, k):
    return {(q, c) for q in range(s.shape[0]) for c in np.lexsort((np.arange(s.shape[1]), -np.round(s[q], 9)))[:k].tolist()}


def test_a_dense_task_passes_on_k_rows_a_query(spark, monkeypatch):
    monkeypatch.setattr(channels, "dealt", lambda df: df.coalesce(2), raising=False)
    x, v = vectors(spark, 2000)
    q = v.where("chunk_id < 6").withColumnRenamed("chunk_id", "query_id")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    got = {(r.query_id, r.chunk_id) for r in channels.dense(v, q, 7).collect()}
    assert got == best_of(unit[:6] @ unit.T, 7)
    assert passed_on(spark, lambda: channels.dense(v, q, 7)) <= 2 * 6 * 7


def test_best_holds_no_more_than_its_bound(monkeypatch):
    monkeypatch.setattr(channels, "PRODUCTS", 100)
    rng = np.random.default_rng(0)
    s = rng.integers(0, 50, (3000, 5)).astype(float)
    s[::7] = 49
    b = channels.Best(5, 9, 9)
    for at in range(0, 3000, 20):
        b.add(np.arange(at, at + 20), s[at : at + 20])
        assert sum(len(x[0]) for x in b.held) <= 100 + 5 * 9 + 100
    assert {(q, c) for x in b.batches(np.arange(5)) for q, c in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)} == best_of(s.T, 9)


def late(x, chunk, q, pos):
    out: dict = {}
    for c in set(chunk):
        for i in set(q):
            own = [j for j in range(len(q)) if q[j] == i]
            out[i, c] = round(float(sum(max(x[own[0] + n] @ x[t] for t in range(len(chunk)) if chunk[t] == c) for n in range(len(own)))), 6)
    return out


def test_maxsim_sums_a_chunk_up_where_its_tokens_lie(spark):
    x, v = vectors(spark, 400, batch=7)
    d = v.selectExpr("chunk_id div 90 AS chunk_id", "vector")
    q = v.where("chunk_id < 30").selectExpr("chunk_id div 4 AS query_id", "chunk_id AS pos", "vector")
    want = late(x, [i // 90 for i in range(400)], [i // 4 for i in range(30)], range(30))
    for most in (3, 9, 1000):
        m = channels.maxsim(d, q, most_tokens=most)
        assert {(r.query_id, r.chunk_id): round(r.score, 6) for r in m.collect()} == want
        assert "Aggregate" not in m._jdf.queryExecution().optimizedPlan().toString()
    best = {(r.query_id, r.chunk_id): round(r.score, 6) for r in channels.maxsim(d, q, 9, k=2).collect()}
    assert len(best) == 2 * 8 and all(want[k] == s and sum((-t, c) < (-s, k[1]) for (i, c), t in want.items() if i == k[0]) < 2 for k, s in best.items())
    twice = channels.maxsim(d, q.unionAll(q.selectExpr("query_id", "pos", "transform(vector, x -> x - 100) AS vector").where("pos = 3")).cache())
    assert twice.count() == len(want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_int8_tasks_pass_on_k_rows_a_query(spark, monkeypatch):
    monkeypatch.setattr(store, "dealt", lambda df: df.coalesce(2), raising=False)
    _, v = vectors(spark, 1000)
    rows = v.selectExpr("chunk_id", "transform(vector, x -> cast(x AS tinyint)) AS q", "1.0D AS factor")
    part = rows.where("chunk_id < 5").selectExpr("chunk_id AS query_id", "q AS qq")
    assert store._coarse(rows, part, 3).count() <= 2 * 5 * 3
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_relevance_by_label_makes_no_pairs(spark, sf):
    r = queries._relevance(spark, sf)
    assert "label" not in r.columns and {"rel", "n_rel"} < set(r.columns)
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1), (3, 7, 1)], "query_id long, item long, rank int")
    q, items = [(1, 0), (2, 1), (3, None)], [(5, 0), (6, 1), (7, None), (8, 0)]
    one = metrics.relevance_by_label(ranked, spark.createDataFrame(q, "query_id long, label int"), spark.createDataFrame(items, "item long, label int"))
    gold = spark.createDataFrame([(i, j) for i, a in q for j, b in items if a is not None and a == b], "query_id long, item long")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "item", "rank", "rel", "n_rel").collect()))
    assert rows(one) == rows(metrics.relevance(ranked, gold))


def test_best_of_bm25_makes_no_row_for_a_query_and_a_chunk(spark):
    texts = [(i, " ".join(["the", f"w{i % 5}", f"w{i % 3}"] + ["pad"] * (i % 4)), f"a/w{i % 7}.py") for i in range(300)]
    c = spark.createDataFrame(texts, "chunk_id long, content string, file_path string")
    q = spark.createDataFrame([(1, "the w1"), (2, "w2 w2 w4"), (3, "the pad w0 w1"), (4, "none"), (5, "pad")], "query_id long, query string")
    index = textindex.passing(c, ["content", "file_path"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 8)) for r in df.collect())
    for fields in ({"content": 1.0}, {"content": 1.0, "file_path": 2.0}):
        all_ = index.bm25(q, fields).selectExpr("query_id", "chunk_id", "round(score, 9) AS score")
        want = rows(channels.top_k(all_, 13))
        assert rows(index.best(q, 13, fields)) == want
        assert rows(index.best(q, 13, fields, most_queries=2)) == want and rows(index.best(q, 13, fields, most_terms=1)) == want
    assert "Aggregate" not in index.best(q, 13)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_first_sentences_read_a_text_once(spark):
    texts = ["A. B! C? D.", "a\nb. c", "no mark", "", None, "...", "  x. y"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, q string").select("i", T.first_sentences("q", 3).alias("s"))
    assert [r.s for r in df.orderBy("i").collect()] == ["A. B! C?", "a\nb.", "", "", None, "...", "x."]
    assert "extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_graph_steps_are_dealt_by_their_rows(spark):
    assert graph.parts(spark.range(10), "id", 3_000_000, each=1000).rdd.getNumPartitions() == 3000
    symbols = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "symbol string, chunk_id long")
    edges = spark.createDataFrame([(1, i % 40, "call") for i in range(90)] + [(i, 3, "call") for i in range(30)] + [(2, 0, "call"), (3, 3, "call")], "src long, dst long, kind string")
    w = graph.walk(symbols, edges, 5)
    got = {(r.symbol, r.relation, r.chunk_id, r["rank"]) for r in w.collect()}
    assert got == {("a", "callee", i, i + 1) for i in range(5)} | {("a", "caller", 1, 1)} | {("b", "caller", i + (i > 2), i + 1) for i in range(5)} | {("b", "callee", 3, 1)}
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Window")[-1]
