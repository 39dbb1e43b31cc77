import random
import re

import numpy as np
import pytest
import xxhash
from quarry.llm import simhash as S
from quarry.llm.components import connected_components


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_code_is_perfect():
    *_, message, within = S.golay()
    assert (within[0] == 1).all() and len(message) == within[3].sum()
    v = np.random.default_rng(0).integers(0, 1 << 23, 1000)
    assert len(set(S._decode(np.arange(4096 << 11, step=1 << 11))[1].tolist())) <= 4096
    _, m = S._decode(v)
    assert m.max() < 4096


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_each_near_pair_meets(threshold):
    rng = np.random.default_rng(threshold)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(threshold):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    (i, a), (j, b) = S.visits(x, threshold), S.visits(y, threshold)
    vx, vy = set(zip(i.tolist(), a.tolist(), strict=True)), set(zip(j.tolist(), b.tolist(), strict=True))
    hx, hy = S.homes(x).tolist(), S.homes(y).tolist()
    assert all((k, hy[k]) in vx or (k, hx[k]) in vy for k in range(len(x)))
    assert all((k, hx[k]) in vx for k in range(len(x)))


@pytest.mark.parametrize("slice_rows", [3, 20_000])
def test_links_connect_all_that_is_near(spark, slice_rows):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    c = rng.getrandbits(64)
    fps |= {c ^ 1 << k for k in range(64)} | {c ^ 1 << k ^ 1 << m for k in range(18) for m in range(18)}
    fps = sorted(fps)
    sign = np.array(fps, np.uint64)
    df = spark.createDataFrame(list(zip(sign.view(np.int64).tolist(), S.homes(sign).tolist(), strict=True)), "fp long, home int")
    links = [(r.a % 2**64, r.b % 2**64) for r in S.fingerprint_links(df, slice_rows=slice_rows).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links) or slice_rows == 20_000
    want = components([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3], fps)
    assert components(links, fps) == want


@pytest.mark.parametrize("extra", [1, 5, 18])
def test_near_pairs_meet_in_a_larger_code(extra):
    rng = np.random.default_rng(extra)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for threshold in (0, 1, 2, 3) if extra < 18 else (1,):
        y = x.copy()
        for _ in range(threshold):
            y ^= np.uint64(1) << rng.integers(0, 64 if threshold < 3 else 20, len(y)).astype(np.uint64)
        (i, a), (j, b) = S.visits(x, threshold, extra), S.visits(y, threshold, extra)
        vx, vy = set(zip(i.tolist(), a.tolist(), strict=True)), set(zip(j.tolist(), b.tolist(), strict=True))
        hx, hy = S.anchors(x, extra).tolist(), S.anchors(y, extra).tolist()
        assert len(vx) == len(i) and all((k, hx[k]) in vx for k in range(len(x)))
        assert all((k, hy[k]) in vx or (k, hx[k]) in vy for k in range(len(x)))


@pytest.mark.parametrize(("slice_rows", "extra"), [(5, 4), (20_000, 7)])
def test_links_of_a_larger_code_and_small_batches(spark, slice_rows, extra):
    """A hot anchor whose visitors come in many batches."""
    rng = random.Random(8)
    c = rng.getrandbits(64)
    fps = {c ^ 1 << k for k in range(64)} | {c ^ 1 << k ^ 1 << m for k in range(64) for m in range(0, 64, 3)} | {c ^ 0b1111 << k for k in range(60)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    sign = np.array(fps, np.uint64)
    df = spark.createDataFrame(list(zip(sign.view(np.int64).tolist(), S.homes(sign).tolist(), strict=True)), "fp long, home int")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        links = [(r.a % 2**64, r.b % 2**64) for r in S.fingerprint_links(df, slice_rows=slice_rows, extra=extra).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert components(links, fps) == components([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3], fps)


def test_components_of_documents(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    rows = [(-5, None), (6, ""), (7, " \t\n"), (None, "a b"), (9, "A  B"), (None, "lonely words stay here"), (10, "É é"), (11, "nb\xa0sp x y")]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 80, 400]))]
        rows.append((100 + i, " ".join(base)))
        if i % 3 == 0:
            rows.append((500 + i, " ".join(base).upper().replace(" ", "\n", 3)))
            if len(base) > 50:
                base[7] = "changed"
                rows.append((50 + i, "  ".join(base)))
    rows += rows[-3:]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component string").repartition(5)
    got = sorted((tuple(r) for r in S.simhash_components(df).collect()), key=str)
    fp = [slow_fingerprint(t) for _, t in rows]
    comp = components([(a, b) for a in set(fp) for b in set(fp) if a < b and (a ^ b).bit_count() <= 3], set(fp))
    least = {}
    for (i, _), f in zip(rows, fp, strict=True):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted(((i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(rows, fp, strict=True)), key=str)
    assert got == want
    kept = S.deduplicated(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())


def test_empty(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_component_rounds(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(500)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(200)] + [(5, 5), (5, 6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == components(edges, nodes)
