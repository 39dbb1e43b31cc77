import random
import zlib

import numpy as np
import pytest

from quarry.llm import toxicity as T

SYLLABLES = "ba ko ri tu me sa lo vi ne du".split()
BAD = {"en": ["vile", "rotten", "nasty"], "fr": ["zutalor", "zutaleur"], "de": ["quarkel", "quarkig"]}


def corpus(n=900, seed=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(sorted(BAD))
        words = T.FUNCTION_WORDS[lang].split()
        text = [rng.choice(words) if rng.random() < 0.4 else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 150))]
        toxic = int(rng.random() < 0.2)
        for _ in range(2 * toxic):
            w = rng.choice(BAD[lang])
            text.insert(rng.randrange(len(text)), w if lang == "en" else w + rng.choice(SYLLABLES))
        rows.append((i, " ".join(text), lang, toxic))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, g, 0.0) for i, t, g, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, T.fit(docs, labels)


def test_hashes_are_of_words_alone():
    a = T.word_hashes(b"one two words")
    b = T.word_hashes(b"--words, two; one")
    assert a[0].tolist() == [0, 4, 8] and set(a[1].tolist()) == set(b[1].tolist()) and len(set(a[1].tolist())) == 3
    assert T.word_hashes("wordsmith".encode())[2][0][0] == T.word_hashes("xx wordless".encode())[2][0][1] != 0
    assert T.word_hashes(b"")[1].tolist() == []


def test_held_out_accuracy(fitted):
    rows, docs, _, model = fitted
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert len(got) == len(rows)
    for i, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3)
    held = [(got[i], y) for i, _, _, y in rows if got[i].held_out]
    right = np.mean([r.predicted == y for r, y in held])
    assert right > 0.95
    caught = np.mean([r.predicted for r, y in held if y])
    assert caught > 0.85


def test_learns_nothing_from_held_out_rows(spark, fitted):
    rows, docs, labels, model = fitted
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(T.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.fit(docs.withColumn("lang", F.lit("xx")).repartition(3), other)
    texts = [t for _, t, _, _ in rows[:50]]
    assert again.scores(texts).tolist() == model.scores(texts).tolist()


def test_odd_rows(spark, fitted):
    model = fitted[3]
    long = ("ba ko the and ri " * 120_000) + " vile rotten nasty"
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "the vile rotten"), (4, "12 34 ..."), (5, long), (5, long), (6, "the vile rotten thing")]
    df = spark.createDataFrame([(i, t, 9, False) for i, t in rows], "doc_id long, text string, predicted int, held_out boolean")
    got = sorted(T.score(df, model).collect(), key=str)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score == by[4].score < 0.3
    assert by[5].predicted == by[6].predicted == by[None].predicted == 1 and by[None].held_out
    assert sorted(r.doc_id or 0 for r in T.clean(df, model).collect()) == [1, 2, 3, 4]
    assert T.clean(df, model).columns == df.columns
    assert T.score(df.limit(0), model).collect() == []


def test_stretches_pool_as_one():
    model = T.Classifier(buckets=1 << 12, seed=3)
    model.words[:] = np.random.default_rng(0).standard_normal(model.words.shape)
    model.words[0] = 0
    texts = ["a b c", "", "x " * 50, " ".join(f"w{k}" for k in range(999)), "z"]
    whole = [model.odds(t) for _, _, t in T.read(texts, 1 << 12, overlap=2)]
    parts = [model.odds(t) for _, _, t in T.read(texts, 1 << 12, room=64, overlap=2)]
    assert np.allclose(np.concatenate(whole), np.concatenate(parts), atol=1e-4)


def test_no_labels(spark, fitted):
    docs = fitted[1]
    model = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in T.score(docs, model).collect()} == {0}


def test_cut():
    assert 1 < T.best_cut(np.array([3.0, 2.0, 1.0, 0.0]), np.array([True, True, False, False])) < 2
    assert T.best_cut(np.array([1.0, 1.0]), np.array([True, False])) < 1
    assert T.best_cut(np.array([1.0]), np.array([False])) > 1


def slow_odds(model, text, room):
    """One text by plain loops: every filter at every word, the largest of each, their sum."""
    rows = []
    for _, _, t in T.read([text], len(model.words), room=room, overlap=model.overlap):
        own = t.buckets[~t.pad]
        starts = np.concatenate([np.flatnonzero(~t.pad)])
        stretch = np.searchsorted(t.stretch, starts, "right") - 1
        for k in range(len(t.stretch)):
            part = own[stretch == k]
            rows += part.tolist() if k == 0 else part[model.overlap :].tolist()  # a stretch begins with the last words of the one before
    x = [sum((model.words[b] for b in row), np.zeros(model.words.shape[1])) for row in rows]
    total = float(model.shift)
    for k, (w, conv, bias) in enumerate(zip(model.widths, model.conv, model.bias, strict=True)):
        for f in range(model.filters):
            best = float(bias[f])
            for p in range(len(x)):
                best = max(best, float(bias[f]) + sum(float(x[p + j] @ conv[j, :, f]) for j in range(w) if p + j < len(x)))
            total += best * float(model.out[k * model.filters + f])
    return total


def test_scores_as_plain_loops():
    rng = np.random.default_rng(4)
    model = T.Classifier(buckets=256, dims=4, filters=3)
    model.words = rng.standard_normal(model.words.shape).astype(np.float32)
    model.words[0] = 0
    model.bias = [rng.standard_normal(3).astype(np.float32) for _ in model.widths]
    vocabulary = [f"w{k}" for k in range(60)]
    texts = ["", "w1", "w1 w2", " ".join(rng.choice(vocabulary, 40)), " ".join(rng.choice(vocabulary, 700)), None, "W3, w4; é ü w5"]
    got, _ = model.log_odds(texts)
    want = [slow_odds(model, t, 1 << 19) for t in texts]
    assert got == pytest.approx(want, abs=1e-4)
    alone = [float(o) for t in texts for _, _, part in T.read([t], 256, room=300, overlap=model.overlap) for o in model.odds(part)]
    assert alone == pytest.approx(want, abs=1e-4)  # long texts in stretches


def test_sample_is_the_same_whatever_the_partitions(spark):
    rows = [(i, f"text {i} {k}") for i in range(40) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    a, b = (T.labelled_sample(docs.repartition(n), labels, "doc_id", "text", "toxic", 20) for n in (1, 7))
    assert a[0] == b[0] and a[1].tolist() == b[1].tolist() and all(t.endswith(" 0") for t in a[0])
    few = T.labelled_sample(docs, labels, "doc_id", "text", "toxic", 20, most_bytes=50)[0]
    assert few == a[0][: len(few)] and 0 < sum(map(len, few)) <= 50
