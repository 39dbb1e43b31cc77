"""Composite operators over a small corpus, and against plain Python where they are greedy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.stem import hashed_vector
from quarry.operators import channels, chunking, cut, graph, maintain, metrics, relational, vectors
from quarry.plans import search as P
from quarry.sources import schemas

SOURCES = {
    "src/auth/login.py": 'import auth.session\n\n\ndef login_user(name):\n    """Logs a user in."""\n    token = make_token(name)\n    return open_session(token)\n\n\ndef make_token(name):\n    return name + "x"\n',
    "src/auth/session.py": "def open_session(token):\n    if token:\n        return {'token': token}\n    raise ValueError(token)\n",
    "src/store/cache.py": "class Cache:\n    def get_item(self, key):\n        return self.items[key]\n\n    def put_item(self, key, value):\n        self.items[key] = value\n",
    "tests/test_login.py": "from src.auth.login import login_user\n\n\ndef test_login_user():\n    assert login_user('a')\n",
    "README.md": "Login and sessions.\n\nThe cache keeps items.\n",
}


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([(p, s, "python" if p.endswith("py") else "markdown") for p, s in SOURCES.items()], "path string, content string, language string")
    chunks = chunking.with_ids(chunking.chunk_files(files)).cache()
    names = chunks.where("name is not null").select(F.col("name"), F.col("chunk_id").alias("dst"))
    calls = chunks.select(F.col("chunk_id").alias("src"), F.explode("calls").alias("c")).withColumn("name", F.substring_index("c", ".", -1)).join(names, "name").where("src <> dst").select("src", "dst", F.lit("call").alias("kind"))
    encode = lambda c: hashed_vector(T.tokens(c))
    return P.Index(chunks, chunks.select("chunk_id", encode("content").alias("vector")), calls, None, encode)


def test_chunks(index):
    rows = index.chunks.orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(1, len(rows) + 1))
    by = {r.name: r for r in rows if r.name}
    assert set(by) == {"login_user", "make_token", "open_session", "Cache", "get_item", "put_item", "test_login_user"}
    assert by["login_user"].calls == ["make_token", "open_session"] and by["login_user"].docstring == "Logs a user in." and by["open_session"].complexity == 2
    assert (by["get_item"].ast_kind, by["Cache"].ast_kind) == ("method", "class")
    assert {(r.src, r.dst) for r in chunking.call_edges(index.chunks).collect()} == {(by["login_user"].chunk_id, by["make_token"].chunk_id)}
    roles = {r.name: r.r for r in index.chunks.where("name is not null").select("name", chunking.semantic_role("name", "calls").alias("r")).collect()}
    assert roles["make_token"] == "constructor" and roles["get_item"] == "fetcher" and roles["put_item"] == "persister" and roles["Cache"] is None
    mined = chunking.mine_patterns(index.chunks, [("python", "raises", ["raise "], ["pass"]), ("rust", "unwrap", ["x"], [])]).collect()
    assert [(r.chunk_id, r.pattern) for r in mined] == [(by["open_session"].chunk_id, "raises")]
    assert "calls make_token, open_session" in index.chunks.where("name = 'login_user'").select(chunking.summary(index.chunks).alias("s")).first().s


def test_windows():
    text = "".join(f"line {k}\n" for k in range(1500))
    w = chunking.windows(text)
    assert all(len(t.encode()) <= 2048 for *_, t in w) and w[0][0] == 1 and w[-1][1] == 1500
    assert all(a[1] >= b[0] for a, b in zip(w, w[1:]))
    assert chunking.windows(" \n ") == [] and chunking.windows("short") == [(1, 1, "short")]
    assert "".join(chunking.windows("é" * 3000)[0][2]) == "é" * 1024


def test_search(index):
    got = P.multi_search(index, {1: "login_user", 2: "how are items kept in the cache"}, P.SearchSpec(max_results=3)).collect()
    top = {r.query_id: r for r in got if r.rank == 1}
    assert top[1].name == "login_user" and "cache" in top[2].file_path.lower() + (top[2].content or "").lower()
    grep = P.multi_search(index, {1: "raise ValueError"}, P.SearchSpec(grep=True)).orderBy("rank").collect()
    assert grep[0].name == "open_session"
    only = P.multi_search(index, {1: "login"}, P.SearchSpec(include=("md",), adaptive=False)).collect()
    assert {r.file_path for r in only if r.source == "fused"} == {"README.md"}
    wide = P.multi_search(index, {1: "login cache"}, P.SearchSpec(expand=True, weighted=True, diversity=0.7)).collect()
    assert len(wide) >= 3


def test_agent_and_deep(index, spark):
    assert P.agent(index, "*.md")[1].collect()[0].path == "README.md"
    route, out = P.agent(index, "who calls open_session")
    assert route == "structural" and {r.relation for r in out.collect()} == {"caller"}
    deep = P.deep_search(index, "how does login use the session?")
    rows = deep.orderBy("rank").collect()
    assert "open_session" in [r.name for r in rows] and len(rows) == len({r.chunk_id for r in rows})
    q = spark.createDataFrame([(1, "session")], "query_id long, query string")
    hits, skipped = P.federated({"a": index, "b": index, "c": P.Index(index.chunks.limit(0))}, q)
    assert [s[0] for s in skipped] == ["c"] and {r.target for r in hits.where("position <= 2").collect()} == {"a", "b"}
    text = P.formatted(P.multi_search(index, {1: "login_user"})).first().text
    assert "src/auth/login.py:4-7" in text


def test_mmr_as_plain_python(spark):
    rng = np.random.default_rng(3)
    v, s = rng.standard_normal((20, 5)), np.sort(rng.random(20))[::-1]
    ranked = spark.createDataFrame([(7, i, float(s[i]), i + 1) for i in range(20)], "query_id long, chunk_id long, score double, rank int")
    vec = spark.createDataFrame([(i, v[i].tolist()) for i in range(20)], "chunk_id long, vector array<double>")
    got = [r.chunk_id for r in cut.mmr(ranked, vec, 0.5).orderBy("rank").collect()]
    u, want, left = v / np.linalg.norm(v, axis=1, keepdims=True), [], list(range(20))
    while left:
        i = max(left, key=lambda j: (0.5 * s[j] / s[0] - 0.5 * (max(u[j] @ u[k] for k in want) if want else 0), -j))
        want.append(i)
        left.remove(i)
    assert got == want
    assert [r.chunk_id for r in cut.mmr(ranked, vec.where("chunk_id > 0"), 0.5).orderBy("rank").collect()] == list(range(20))


def test_triage_overlap(spark):
    rows = [(1, 10, 1.0, 1, "a", 1, 10), (1, 11, 0.9, 2, "a", 3, 8), (1, 12, 0.8, 3, "a", 9, 30), (1, 13, 0.05, 4, "b", 1, 2), (1, 14, 0.5, 5, "b", 1, 2)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int, file_path string, start_line int, end_line int")
    assert [r.chunk_id for r in cut.triage(df).orderBy("rank").collect()] == [10, 12, 14]
    assert [(r.chunk_id, r.covers) for r in relational.overlapping(df).collect()] == [(11, 10), (14, 13)]


def test_small_graph(spark):
    """A dangling node, a loop and a doubled edge."""
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "chunk_id long")
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 3), (3, 3), (4, 1)], "src long, dst long")
    got = {r.chunk_id: r.centrality for r in graph.pagerank(nodes, edges).collect()}
    p = {1: {2: 2 / 3, 3: 1 / 3}, 2: {3: 1.0}, 4: {1: 1.0}}
    want = dict.fromkeys(range(1, 6), 0.2)
    for _ in range(60):
        lost = want[3] + want[5]
        want = {i: 0.03 + 0.85 * (sum(want[a] * d.get(i, 0) for a, d in p.items()) + lost / 5) for i in want}
    assert got == pytest.approx(want, abs=1e-5) and sum(got.values()) == pytest.approx(1)
    assert {r.chunk_id: r.component for r in graph.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    sym = spark.createDataFrame([("s", 3)], "symbol string, chunk_id long")
    assert {(r.chunk_id, r.depth) for r in graph.callers(sym, edges, 2).collect()} == {(1, 1), (2, 1), (4, 2)}
    assert {r.chunk_id for r in graph.callees(sym, edges).collect()} == set()
    assert graph.budget(100) == (5, 0, 0) and graph.budget(3000) == (10, 5, 25)


def test_exact_by_tokens_as_by_scan(spark):
    chunks = spark.createDataFrame([(1, "the Quick brown fox"), (2, "quickly brown foxes run"), (3, "a b"), (4, None)], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "quick brown fox"), (2, "a b"), (3, ""), (4, "brown fox"), (5, "ick brown f")], "query_id long, query string")
    a, b = ({(r.query_id, r.chunk_id) for r in channels.exact(chunks, q, most_queries=m).collect()} for m in (100, 0))
    assert a == b == {(1, 1), (2, 3), (4, 1), (4, 2), (5, 1)}


def test_dense_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(60)], "chunk_id long, vector array<double>")
    q = v.where("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "vector")
    rows = lambda m: sorted(map(tuple, channels.dense(v, q, 5, most_queries=m).collect()))
    assert rows(100) == rows(2) and len(rows(2)) == 35


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "query_id string, item string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "x")], "query_id string, item string")
    r = {x.query_id: x for x in metrics.per_query(metrics.relevance(ranked, gold)).collect()}
    assert r["q"].rr == 0.5 and r["q"].recall == pytest.approx(2 / 3) and r["q"].ap == pytest.approx((1 / 2 + 2 / 3) / 3) and r["z"].rr == 0
    assert r["q"].ndcg == pytest.approx((1 / np.log2(3) + 1 / 2) / (1 + 1 / np.log2(3) + 1 / 2))
    o = spark.createDataFrame([(i, i < 8, i < 2) for i in range(10)], "item int, a boolean, b boolean")
    m = metrics.mcnemar(o).first()
    assert (m.only_a, m.only_b) == (6, 0) and m.p == pytest.approx(2 / 64)
    b = metrics.bootstrap(spark.createDataFrame([(i, 0.0, float(i % 3)) for i in range(300)], "item long, a double, b double"), 200).first()
    assert b.low < b["mean"] < b.high and b["mean"] == pytest.approx(1.0) and b.high - b.low < 0.4


def test_mixing_and_centroids(spark):
    t = spark.createDataFrame([(1, p, [float(p), 1.0]) for p in range(4)], "chunk_id long, pos int, vector array<double>")
    got = {r.pos: r.vector for r in vectors.mix(t, [0, 0, 1, 1, 0]).collect()}
    assert got[0] == pytest.approx([1 / np.sqrt(5), 2 / np.sqrt(5)]) and got[3] == pytest.approx([3 / np.sqrt(10), 1 / np.sqrt(10)])
    v = spark.createDataFrame([(i, [float(i % 2) * 10 + 0.01 * i, 0.0]) for i in range(40)], "vec_id long, vector array<double>")
    c = vectors.train_centroids(v, 2)
    assert sorted(round(r.vector[0]) for r in c.collect()) == [0, 10]
    full = vectors.full_argmax(v, c)
    assert vectors.agreement(full, full).first().agreement == 1.0


def test_shortlists_fall_back_to_the_mean(spark):
    table = spark.createDataFrame([(0, [2.0, 0.1]), (1, [0.1, 2.0]), (2, [-2.0, -0.1]), (3, [0.0, 0.0])], "token_id long, vector array<double>")
    cents = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [-1.0, 0.0], 3: [0.0, -1.0], 4: [0.7, 0.7]}
    c = spark.createDataFrame(list(cents.items()), "cid int, vector array<double>")
    got = {}
    for r in vectors.shortlist(table, c, 3).orderBy("rank").collect():
        got.setdefault(r.token_id, []).append(r.cid)
    assert got == {0: [0, 4, 1], 1: [1, 4, 0], 2: [2, 3, 1], 3: [1, 4, 0], None: [1, 4, 0]}
    v = spark.createDataFrame([(1, [1.0, 0.2], [99]), (2, [0.9, 0.1], None), (3, [0.1, 0.9], []), (4, [1.0, 0.0], [2, 99]), (5, [-1.0, 0.0], [2]), (6, [-1.0, -0.1], [3]), (7, [0.0, 1.0], [None])], "vec_id long, vector array<double>, token_ids array<long>")
    assert {r.vec_id: r.cid for r in vectors.shortlist_argmax(v, vectors.shortlist(table, c, 3), c).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 2, 6: 1, 7: 1}
    none = vectors.shortlist(table.where("token_id = 3"), c, 2)
    assert sorted((str(r.token_id), r.cid) for r in none.collect()) == [("3", 0), ("3", 1), ("None", 0), ("None", 1)]


def test_no_silent_bounds(spark, tmp_path):
    from quarry.operators import store

    c = spark.range(65_537).select(F.col("id").cast("int").alias("cid"), F.array(F.col("id").cast("double")).alias("vector"))
    v = spark.createDataFrame([(1, [1.0])], "vec_id long, vector array<double>")
    with pytest.raises(ValueError):
        vectors.full_argmax(v, c)
    with pytest.raises(ValueError):
        vectors.shortlist(v.withColumnRenamed("vec_id", "token_id"), c)
    assert vectors.full_argmax(v, c.where("cid <> 5")).first().cid == 65_536
    s = store.VectorStore(spark, str(tmp_path), "v1")
    s.append(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, vector array<double>"))
    q = spark.range(10_050).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.1)).alias("vector"))
    assert s.two_stage(q, 1).where("chunk_id = 1").select("query_id").distinct().count() == 10_050
    assert s.two_stage(q.limit(7), 1, most_queries=2).count() == 7


def test_notes_and_maintenance(spark):
    n = spark.createDataFrame([(1, 1, "r", "keep the cache", "x"), (2, 2, "r", "old", "")], "note_id long, created_ts long, scope string, content string, tags string")
    new = spark.createDataFrame([(3, 3, "r", " old ", "y"), (4, 4, "r", "  ", "")], n.schema)
    saved = relational.save_note(n, new)
    assert sorted(r.note_id for r in saved.collect()) == [1, 3]
    q = spark.createDataFrame([(1, "cache x")], "query_id long, query string")
    assert [r.note_id for r in relational.recall(saved, q).collect()] == [1]
    assert [r.note_id for r in relational.recall_contains(saved, "the CACHE old").collect()] == [1, 3]
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, hash long")
    fresh = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "path string, hash long")
    ch = maintain.diff(old, fresh)
    assert {r.path: r.change for r in ch.collect()} == {"a": "same", "b": "update", "c": "delete", "d": "insert"}
    assert {(r.path, r["hash"]) for r in maintain.upsert(old, fresh, ch).collect()} == {("a", 1), ("b", 2), ("d", 1)}
    meta = spark.createDataFrame([(schemas.VERSION, "f", 1, 1)], schemas.TABLES["meta"])
    assert [schemas.check_version(m, f) for m, f in ((meta, "f"), (meta, "g"), (meta.limit(0), "f"))] == ["ready", "stale", "not_indexed"]


def test_drafts_plans_and_walks(index, spark):
    got = P.search_with_draft(index, "login", lambda q: "cache items", P.SearchSpec(max_results=10, graph=False)).collect()
    assert len(got) == len({r.chunk_id for r in got}) > 3

    def broken(q):
        raise RuntimeError("no writer")

    assert P.search_with_draft(index, "login", broken, P.SearchSpec(graph=False)).count() > 0
    assert P.plan([("a", "x"), ("b", "y")], lambda n, q: q if n == "a" else broken(q)) == [("a", "x"), ("b", "failed: no writer")]
    assert P.plan([("a", "x")], lambda n, q: q, seconds=0) == [("a", "skipped: out of time")]
    sym = index.chunks.where("name = 'make_token'").select(F.lit("make_token").alias("symbol"), "chunk_id")
    kind, near = P.adaptive_walk(sym, index.edges, index.chunks)
    assert kind == "two hops" and near.count() >= 2


def test_vector_store(spark, tmp_path):
    from quarry.operators import store

    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(80)], "chunk_id long, vector array<double>")
    s = store.VectorStore(spark, str(tmp_path), "v1")
    s.append(v.where("chunk_id < 50"))
    s.append(v.where("chunk_id >= 50"))
    s.delete(v.where("chunk_id % 10 = 0"))
    s.publish()
    t = store.VectorStore.active(spark, str(tmp_path))
    assert t.version == "v1" and t.rows().count() == 72
    q = v.where("chunk_id in (3, 10)").select(F.col("chunk_id").alias("query_id"), "vector")
    want = channels.dense(v.where("chunk_id % 10 <> 0"), q, 3)
    assert {(r.query_id, r.chunk_id) for r in t.two_stage(q, 3, 8).collect()} == {(r.query_id, r.chunk_id) for r in want.collect()}
    cache = v.where("chunk_id < 5").select(F.col("chunk_id").alias("cached_id"), "vector", F.lit("s").alias("stamp"))
    assert [(r.query_id, r.cached_id) for r in store.semantic_cache(cache, q, "s").collect()] == [(3, 3)] and store.semantic_cache(cache, q, "other").count() == 0


def test_mixer(spark):
    from quarry.operators import store

    rng = np.random.default_rng(2)
    true = [0.1, 0.2, 1.0, -0.3, 0.05]
    x = rng.standard_normal((30, 4))
    pad = np.vstack([np.zeros((2, 4)), x, np.zeros((2, 4))])
    y = sum(w * pad[k : k + 30] for k, w in enumerate(true))
    t = spark.createDataFrame([(1, p, x[p].tolist(), y[p].tolist()) for p in range(30)], "chunk_id long, pos int, vector array<double>, target array<double>")
    assert store.fit_mix_weights(t) == pytest.approx(true)
    w = spark.createDataFrame([(1, 0, rng.standard_normal((9, 4)).tolist())], "chunk_id long, pos int, window array<array<double>>")
    got = store.mixer_forward(w, np.zeros((9, 4)), np.eye(4)).first().vector
    c = np.array(w.first().window[4])
    assert got == pytest.approx((c / np.linalg.norm(c)).tolist())


def test_evaluation_sets(spark):
    from quarry.operators import evaluate as E

    rows = spark.createDataFrame([(1, "code a", "does a"), (2, "code b", " "), (3, None, "x")], "k long, code string, doc string")
    d, q, g = E.corpus_from_rows(rows, "code", "doc", "k")
    assert [r.item for r in d.collect()] == ["d1"] and [tuple(r) for r in g.collect()] == [("q1", "d1")] and q.count() == 1
    corpus = spark.createDataFrame([("c1", "t")], "_id string, text string")
    queries = spark.createDataFrame([("q1", "x"), ("q2", "y")], "_id string, text string")
    rel = spark.createDataFrame([("q1", "c1", 1), ("q2", "c9", 1), ("q2", "c1", 0)], "`query-id` string, `corpus-id` string, score int")
    assert [r.query_id for r in E.corpus_from_splits(corpus, queries, rel)[1].collect()] == ["q1"]
    assert E.select_queries(q.unionByName(q.withColumn("query_id", F.lit("z"))), 1, 5).collect() == E.select_queries(q.unionByName(q.withColumn("query_id", F.lit("z"))).repartition(4), 1, 5).collect()
    chunks = spark.createDataFrame([("a", "foo bar\nfoo\nx"), ("b", "bar\nbar bar")], "file_path string, content string")
    kw = spark.createDataFrame([(1, "foo"), (1, "bar")], "query_id long, word string")
    assert [(r.file_path, r.hits, r["rank"]) for r in E.keyword_ranking(chunks, kw).orderBy("rank").collect()] == [("a", 2, 1), ("b", 2, 2)]
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query_id long, item string, rank int")
    assert [(r.item, r["rank"]) for r in E.dedup_ranked(ranked).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    turns = spark.createDataFrame([("r", 1, 2, 3, ["x", "y"]), ("r", 1, 0, 0, ["x"])], "run string, input_tokens long, cache_creation long, cache_read long, tool_calls array<string>")
    assert E.context_burden(turns, "run").first().burden == 7 and {(r.tool, r.n) for r in E.tool_distribution(turns, "run").collect()} == {("x", 2), ("y", 1)}


def test_shortcuts_and_scaffolds(index, spark):
    q = spark.createDataFrame([(1, "where is make_token used"), (2, "nothing")], "query_id long, query string")
    by = {r.name: r.chunk_id for r in index.chunks.where("name is not null").collect()}
    assert [tuple(r) for r in P.symbol_shortcut(index, q).collect()] == [(1, by["make_token"])]
    res = spark.createDataFrame([(1, "a", 1, "ambiguous"), (1, "b", 2, "inferred"), (1, "b", 3, "inferred"), (2, "c", 1, "extracted")], "query_id long, name string, rank int, label string")
    assert [(r.query_id, r.name) for r in P.suggestions(res).orderBy("rank").collect()] == [(1, "a"), (1, "b")]
    c = spark.createDataFrame([(1, 10, "x"), (2, 30, "y")], "hash long, ts long, message string")
    got = P.federated_history({"b": (c, None), "a": (c.where("hash = 1"), None)}, limit=2).collect()
    assert [(r.repo, r["hash"]) for r in got] == [("b", 2), ("a", 1)]
    rows = P.module_scaffold(index, "src/auth").collect()
    assert {(r.section, r.line) for r in rows} >= {("symbols", "src/auth/login.py: login_user"), ("calls", "make_token"), ("called by", "test_login_user")}
    assert len(P.module_scaffold(index, "src/auth", 10).collect()) < len(rows)


def test_overview_and_feature_plan(index, spark):
    by = {r.chunk_id: r.name for r in index.chunks.where("name is not null").collect()}
    route, rows = P.agent(index, "give me an architecture overview")
    rows = rows.collect()
    assert route == "architecture" and {r.section for r in rows} == {"central"} and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
    assert min(rows, key=lambda r: r["rank"]).line == "login_user  src/auth/login.py"  # a caller that calls two others
    im = spark.createDataFrame([("src/auth/login.py", "src/auth/session.py"), ("src/store/cache.py", "src/auth/session.py")], "importer string, imported string")
    more = P.Index(index.chunks, index.vectors, index.edges, im, index.encode, index.text)
    route, plan = P.agent(more, "how do I add a token to open_session")
    plan = [(r.step, by.get(r.chunk_id)) for r in plan.collect()]
    assert route == "feature_planning" and ("change", "open_session") in plan and len(plan) == len(set(plan)) and {s for s, _ in plan} <= {"change", "follow", "test"}
