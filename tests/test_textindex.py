"""The stored text index against plain Python, and the plan of a search."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.stem import stem
from quarry.operators import channels, textindex

BITS = ["getUserById", "XMLParser", "OAuth", "max_retry", "_", "__init__", "é", "Привет", "日本語", "HTTPSConnection2x", " ", "\n", "a1B", "ABc", "x", "²", "٣", "İ", "ß", "-", ".", "the", "caching", "cached", "ΣΑΣ"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["".join(rng.choices(BITS, k=rng.randrange(30))) if k % 3 else " ".join(rng.choices(BITS, k=rng.randrange(60))) for k in range(300)]


def test_terms_as_the_column_function(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "chunk_id long, content string")
    want = {r.chunk_id: r.t for r in df.select("chunk_id", T.tokens("content").alias("t")).collect()}
    assert want == {i: textindex.terms(t) for i, t in enumerate([*texts, None])}
    got = {(r.chunk_id, r.term): (r.tf, r.length) for r in channels.postings(df).collect()}
    assert got == {(i, w): (n, len(t)) for i, t in want.items() for w, n in Counter(t).items()}


def slow_bm25(texts, queries, tokens):
    docs = [tokens(t) for t in texts]
    mean, df, out = sum(map(len, docs)) / len(docs), Counter(w for d in docs for w in set(d)), {}
    for q, text in queries.items():
        for i, d in enumerate(docs):
            tf, s, hit = Counter(d), 0.0, False
            for w in tokens(text):
                if tf[w]:
                    hit = True
                    s += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / mean))
            if hit:
                out[q, i] = s
    return out


def found(df):
    return {(r.query_id, r.chunk_id): r.score for r in df.collect()}


def test_stored_index_as_plain_python(spark, texts, tmp_path):
    df = spark.createDataFrame([(i, t, f"src/maxRetry{i % 7}/f{i}.py") for i, t in enumerate(texts)], "chunk_id long, content string, file_path string")
    queries = {1: "maxRetry the the cached", 2: "x", 3: "", 4: "nowhere", 5: "Привет HTTPSConnection2x src"}
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    index = textindex.store(df, ["content", "file_path"], str(tmp_path / "a"), buckets=5)
    want = slow_bm25(texts, queries, textindex.terms)
    assert found(index.bm25(q, {"content": 1.0})) == pytest.approx(want)
    assert found(channels.bm25(df, q)) == pytest.approx(want)
    paths = slow_bm25([f"src/maxRetry{i % 7}/f{i}.py" for i in range(len(texts))], queries, textindex.terms)
    both = {k: want.get(k, 0) + 2 * paths.get(k, 0) for k in want | paths}
    assert found(index.bm25(q, {"content": 1.0, "file_path": 2.0})) == pytest.approx(both)
    assert found(channels.bm25_fields(df, q, {"content": 1.0, "file_path": 2.0})) == pytest.approx(both)
    few = df.where("chunk_id % 10 = 3").select("chunk_id")
    assert found(index.bm25(q, {"content": 1.0}, among=few)) == pytest.approx({k: v for k, v in want.items() if k[1] % 10 == 3})
    again = textindex.load(spark, str(tmp_path / "a"))
    assert again.stats == index.stats and found(again.bm25(q, {"content": 1.0})) == pytest.approx(want)
    with pytest.raises(ValueError, match="no field"):
        index.bm25(q, {"title": 1.0})


def test_stemmed_index(spark, texts, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    index = textindex.store(df, ["content"], str(tmp_path / "s"), stemmed=True, buckets=2)
    queries = {1: "caching caching xml"}
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    assert found(index.bm25(q)) == pytest.approx(slow_bm25(texts, queries, lambda t: [stem(w) for w in textindex.terms(t)]))
    index.check_stemmer(True)
    with pytest.raises(ValueError, match="stemmer"):
        index.check_stemmer(False)


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "chunk_id long, content string")
    index = textindex.store(df, ["content"], str(tmp_path / "e"), buckets=2)
    q = spark.createDataFrame([(1, "x")], "query_id long, query string")
    assert index.bm25(q).collect() == [] and index.stats == {"content": (0, 0.0)}


def test_a_search_shuffles_no_postings(spark, texts, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    index = textindex.store(df, ["content"], str(tmp_path / "p"), buckets=4)
    q = spark.createDataFrame([(1, "the cached")], "query_id long, query string")
    plan = index.bm25(q)._jdf.queryExecution().executedPlan().toString()
    scored = plan[: plan.index("postings_")]  # from the scores down to the scan of the postings
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in scored
    best = channels.top_k(index.bm25(q), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in best  # only the best of each bucket move


def test_texts_are_read_once_for_any_number_of_queries(spark):
    chunks = spark.createDataFrame([(i, f"Text {i} ends. İ") for i in range(50)], "chunk_id long, content string")
    q = spark.createDataFrame([(i, f"TEXT {i} e") for i in range(50)] + [(100, "text 7 e"), (101, "s. "), (102, None), (103, "i̇")], "query_id long, query string")
    got = sorted((r.query_id, r.chunk_id) for r in channels.exact(chunks, q).collect())
    assert got == sorted((r.query_id, r.chunk_id) for r in channels.exact(chunks, q, most_queries=7).collect())
    want = chunks.join(q, F.contains(F.lower("content"), F.lower("query")) & (F.col("query") != "")).select("query_id", "chunk_id")
    assert got == sorted((r.query_id, r.chunk_id) for r in want.collect())
