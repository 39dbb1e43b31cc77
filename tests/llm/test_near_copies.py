import random

from quarry.llm import near_copies as N
from tests.llm.test_simhash import components, slow_fingerprint


def slow_shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def test_edited_copies_as_brute_force(spark):
    rng = random.Random(3)
    v = [f"w{k}" for k in range(2000)]
    docs = []
    for k in range(60):
        w = rng.choices(v, k=rng.choice([3, 5, 40, 150, 400]))
        docs.append((10 * k, " ".join(w)))
        for c in range(1, 5):
            e = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 30))):
                e[rng.randrange(len(e))] = rng.choice(v)
            docs.append((10 * k + c, " ".join(e)))
    base = rng.choices(v, k=200)  # one large group, and texts that only share a passage with it
    docs += [(1000 + k, " ".join(base[:k] + [rng.choice(v)] + base[k + 1 :])) for k in range(80)]
    docs += [(2000 + k, " ".join(base[:90] + rng.choices(v, k=90))) for k in range(20)]
    docs += [(3000, ""), (3001, None), (3002, " \n"), (None, docs[0][1]), docs[5]]
    sets, fps = {i: slow_shingles(t) for i, t in docs if i is not None}, {i: slow_fingerprint(t) for i, t in docs if i is not None}
    near = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    bits = [(a, b) for a in sets for b in sets if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert len(set(near) - set(bits)) > 100
    want = components(near + bits, sets)
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string").repartition(5)
    got = N.near_components(df).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == want | {None: want[0]}
    kept = N.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i is not None and want[i] == i)
    assert N.deduplicated(df.limit(0)).collect() == []


def test_bucket_shared_as_often_as_expected():
    rng, hit = random.Random(1), 0
    for _ in range(300):
        s = N.np.array([rng.getrandbits(64) for _ in range(110)], N.np.uint64)
        hit += bool(set(N.buckets(s[:90]).tolist()) & set(N.buckets(s[10:]).tolist()))  # 80 of 110: 0.73
    assert hit > 290


def test_prefix_pairs_lose_no_similar_pair(spark):
    """Against all pairs; and texts that share most of a passage make few pairs."""
    rng = random.Random(6)
    v = [f"w{k}" for k in range(300)]
    passage, texts = rng.choices(v, k=60), []
    for k in range(120):
        w = passage + rng.choices(v, k=25) if k % 2 else rng.choices(v, k=rng.choice([1, 4, 5, 6, 30, 80]))
        texts.append(" ".join(w))
        for _ in range(k % 3):
            e = list(w)
            e[rng.randrange(len(e))] = rng.choice(v)
            texts.append(" ".join(e))
    texts = list(dict.fromkeys(texts))
    sets = [slow_shingles(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8}
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    named = df.select("key", N.F.col("key").alias("component"))
    got = {(r.b, r.a) for r in N.prefix_pairs(named, df, 5, 0.8).collect()}
    assert len(want) > 50 and want <= got and len(got) < len(want) + 200
    one = named.withColumn("component", N.F.lit(1).cast("long"))
    assert N.prefix_pairs(one, df, 5, 0.8).collect() == [] and N.prefix_pairs(named.limit(0), df, 5, 0.8).collect() == []
