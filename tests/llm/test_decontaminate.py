import random

import numpy as np
import pytest

from quarry.llm import decontaminate as D


def slow_tiles(item, doc, least):
    """Greedy string tiling by looking at every pair of places, longest first."""
    fi, fd, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and fi[i + k] and fd[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                best.append((-k, i, j))
        k, i, j = min(best, default=(0, 0, 0))
        if -k < least:
            return out
        for x in range(-k):
            fi[i + x] = fd[j + x] = False
        out.append((-k, i, j))


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_tiles_as_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 25))]
        doc = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 40))]
        got = D.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), least)
        want = slow_tiles(item, doc, least)
        assert sorted(t[0] for t in got) == sorted(t[0] for t in want)
        used = [set(), set()]
        for n, i, j in got:
            assert item[i : i + n] == doc[j : j + n]
            for s, a in zip(used, (i, j), strict=True):
                assert not s & set(range(a, a + n))
                s.update(range(a, a + n))


def test_long_match_restarts_the_search():
    item = list(range(1, 101))
    assert D.tiles(np.array(item, np.uint64), np.array([7, *item, 9], np.uint64), 3) == [(100, 0, 1)]


def test_repetitive_texts_take_little_time_and_memory():
    """One word over and over, two words by turns, and words whose runs have equal hashes."""
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.perf_counter()
    for item, doc in (([1] * 1000, [1] * 20_000), ([1, 2] * 500, [1, 2, 1] * 6000), ([1 + k % 7 for k in range(3000)], [1 + k % 11 % 7 for k in range(20_000)])):
        got = D.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert all(item[i : i + n] == doc[j : j + n] for n, i, j in got)
    assert D.tiles(np.ones(1000, np.uint64), np.ones(20_000, np.uint64), 3) == [(1000, 0, 0)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 << 20 and time.perf_counter() - began < 20
    morse = [1 + (k.bit_count() & 1) for k in range(2048)]
    other = [3 - w for w in morse]
    assert D.Runs(np.array(morse, np.uint64)).windows(2048)[1] == D.Runs(np.array(other, np.uint64)).windows(2048)[1]
    got = D.tiles(np.array(morse, np.uint64), np.array([*other, 0, *morse], np.uint64), 3)
    assert got == [(2048, 0, 2049)]


def cases():
    rng = random.Random(8)
    v = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(v, k=rng.randint(12, 50)))) for k in range(30)] + [(90, "too short"), (91, ""), (92, None), (93, "solo"), (None, "an item that has no number at all")]
    docs = []
    for k in range(150):
        text = rng.choices(v, k=rng.choice([0, 5, 200]))
        if k % 3 == 0:
            w = items[k % 30][1].split()
            kind = k % 9
            if kind == 3:  # reordered
                h = len(w) // 2
                w = w[h:] + ["between"] + w[:h]
            if kind == 6:  # a third of it
                w = w[: len(w) // 3]
            text[len(text) // 2 : len(text) // 2] = w
        docs.append((k, " ".join(text).upper() if k % 2 else ", ".join(text)))
    docs += [(500, None), (501, ""), (502, "Too; short."), (None, items[3][1]), docs[0], docs[0], (503, "solo " * 9), (504, "an item that has no number at all"), (505, "é " * 50_000 + items[5][1])]
    return docs, items


def slow_leaks(docs, items, seed=5, least=3, threshold=0.8):
    out = []
    for i, t in docs:
        d = D.words(t)
        for k, s in items:
            w = D.words(s)
            n = min(seed, len(w))
            if n and len(d) < 3000 and any(d[a : a + n] == w[b : b + n] for a in range(len(d) - n + 1) for b in range(len(w) - n + 1)):
                m = sum(x[0] for x in slow_tiles(w, d, min(least, len(w))))
                if m / len(w) >= threshold:
                    out.append((i, k, m))
    return out


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_as_brute_force(spark, most):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, "s", 1.0) for i, t in docs], "doc_id long, text string, source string, coverage double").repartition(4)
    bench = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, source string")
    got = D.find_leaks(df, bench, broadcast_bytes=most).collect()
    want = slow_leaks(docs, items) + [(505, 5, len(D.words(items[5][1])))]
    assert sorted(((r.doc_id, r.item_id, r.matched) for r in got), key=str) == sorted(want, key=str)
    assert {r.reordered for r in got if r.doc_id is not None and r.doc_id % 9 == 3 and r.doc_id < 100} == {True}
    assert all(r.coverage == r.matched / r.n_words for r in got)
    kept = D.decontaminated(df, bench, broadcast_bytes=most)
    assert kept.columns == df.columns
    bad = {i for i, _, _ in want}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


@pytest.mark.parametrize("most", [1 << 20, -1])
def test_empty(spark, most):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.find_leaks(docs.limit(0), bench, broadcast_bytes=most).collect() == []
    assert D.find_leaks(docs, bench.limit(0), broadcast_bytes=most).collect() == []
    assert D.decontaminated(docs, bench.limit(0), broadcast_bytes=most).count() == 1
    assert [r.item_id for r in D.find_leaks(docs, bench, broadcast_bytes=most).collect()] == [1]


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_short_items_of_any_letters_and_repeated_items(spark, most):
    items = [(1, "für die Größe"), (2, "Привет мир"), (3, "naïve"), (4, "日本 語 の 文"), (5, "один два три четыре пять шесть")]
    items += [items[0], items[4], (6, items[1][1]), (7, None), (7, None)]
    docs = [(k, f"before {t} after".upper() if k % 2 else f"x {t}.") for k, (_, t) in enumerate(items[:5])] + [(90, "fur die große"), (91, "мир привет")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(df, bench, broadcast_bytes=most).collect()
    assert sorted((r.doc_id, r.item_id, r.matched) for r in got) == sorted(slow_leaks(docs, list(dict.fromkeys(items))))
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4}
    assert sorted(r.doc_id for r in D.decontaminated(df, bench, broadcast_bytes=most).collect()) == [90, 91]
