import hashlib
from collections import defaultdict

import pytest

from quarry.llm.exact_dedup import deduplicated, exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, digest int"


def brute(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = keep(ids) if ids else None
        out.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [(1, "a"), (2, "a"), (7, "b"), (3, None), (4, ""), (5, "a "), (None, "a"), (None, "only"), (7, "b"), (9, "x" * 200_000), (8, "x" * 200_000), (-3, "é"), (-4, "é")]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("shards", [1, 5, 16])
def test_as_brute_force(spark, keep, shards):
    rows = CASES + [(100 + i, f"t{i % 37}") for i in range(500)]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA).repartition(7)
    got = sorted((tuple(r) for r in exact_dedup(df, keep=keep, shards=shards, fan_in=2).collect()), key=str)
    assert got == brute(rows, max if keep == "largest" else min)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(df).collect() == []
    assert deduplicated(df).collect() == []


def test_deduplicated_keeps_one_of_repeats(spark):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in CASES], SCHEMA)
    got = deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text[:3] if r.text else r.text) for r in got.collect() if r.doc_id is not None) == [(-3, "é"), (2, "a"), (4, ""), (5, "a "), (7, "b"), (9, "xxx")]


def test_oracle(spark, sf):
    from quarry.llm.queries import ORACLE_SQL, QUERIES
    from tests.oracle import assert_same, duck

    assert assert_same(QUERIES["op1_exact_dedup"](spark, sf), duck(sf), ORACLE_SQL["op1_exact_dedup"]) == 200


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_partitions_of_many_batches(spark, small_batches, keep):
    rows = CASES + [(100 + i, f"t{i % 7}") for i in range(60)]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA).coalesce(1)
    assert sorted((tuple(r) for r in exact_dedup(df, keep=keep, shards=2, fan_in=2).collect()), key=str) == brute(rows, max if keep == "largest" else min)


def test_more_rows_in_a_partition_than_a_batch_holds(spark):
    # identifiers that can't be null, in three batches of the usual size
    df = spark.range(0, 25_000, 1, 1).selectExpr("id AS doc_id", "concat('t', id % 9000) AS text")
    assert sorted(r.doc_id for r in deduplicated(df).collect()) == list(range(16_000, 25_000))
