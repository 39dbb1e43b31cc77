import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from quarry.llm import decontaminate, simhash, toxicity
from tests.llm.test_simhash import components, slow_fingerprint
from tests.llm.test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted toxic texts, exact and near copies, and leaks."""
    rng, at = random.Random(9), str(tmp_path_factory.mktemp("corpus"))
    labelled = corpus(600, seed=12)
    docs = [(i, t, g, "s", len(t)) for i, t, g, _ in labelled]
    v = [f"v{k}" for k in range(900)]
    bench = [(k, " ".join(rng.choices(v, k=30))) for k in range(10)]
    for k in range(40):
        text = " ".join(rng.choices(v, k=300))
        docs.append((1000 + k, text, "en", "s", 0))
        if k % 4 == 0:
            docs += [(2000 + k, text, "en", "s", 0), (3000 + k, text.upper(), "en", "t", 0)]
        if k % 5 == 0:
            docs.append((4000 + k, text[:200] + " " + bench[k % 10][1] + " " + text[700:1200], "en", "s", 0))
    docs += [(5000, "", "en", "s", 0), (5001, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, _, y in labelled], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_as_brute_force(spark, folder):
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    docs = read("documents")
    model = toxicity.fit(docs, read("labels"))
    rows = [r for r in docs.collect()]
    rows = [r for r, s in zip(rows, model.scores([r.text for r in rows]), strict=True) if s < 0.3]
    toxic = {r.doc_id for r in docs.collect()} - {r.doc_id for r in rows}
    assert 60 < len(toxic) < 200 and max(toxic) < 1000
    last = {}
    for r in rows:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    rows = [r for r in rows if last[r.text or ""] == r.doc_id]
    fp = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in rows}
    comp = components([(a, b) for a in set(fp.values()) for b in set(fp.values()) if a < b and (a ^ b).bit_count() <= 3], set(fp.values()))
    least = {}
    for i, f in fp.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    rows = [r for r in rows if r.doc_id in least.values()]
    b = decontaminate.Benchmark([tuple(r) for r in read("benchmark").collect()], 5)
    leaks = {r.doc_id for r in rows if b.leaks(r.text, 3, 0.8)}
    assert leaks == {4000 + k for k in range(0, 40, 5)}
    rows = [r for r in rows if r.doc_id not in leaks]
    got = {r.doc_id: r for r in C.run(spark, folder).collect()}
    assert sorted(got) == sorted(r.doc_id for r in rows)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert all(got[r.doc_id].ids == lib.encode(r.text or "", add_special_tokens=False).ids for r in rows)


def test_fingerprint_of_three_words():
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choices(["a", "B", " ", "\n", "é", "\xa0", "\x1f", "word"], k=rng.randrange(40)))
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_stages_keep_columns_and_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [k for k, _ in C.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "benchmark decontamination", "bpe"]
    some = docs.where(F.col("doc_id") % 7 == 0)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, some, folder).columns == docs.columns
        assert stage(spark, some.limit(0), folder).collect() == []


def test_partitions_of_many_batches(spark, folder):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = lambda: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in C.run(spark, folder).collect())
    whole, before = rows(), spark.conf.get(key)
    spark.conf.set(key, "20")
    try:
        assert rows() == whole
    finally:
        spark.conf.set(key, before)
