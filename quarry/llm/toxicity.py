"""Toxicity by a convolutional text classifier.

A word is the sum of hashed embeddings: of itself and of its first 4, 5 and 6
bytes, so that inflected forms share what they begin with. Filters of several
widths slide over the words, each filter's largest value over the whole text is
kept, and a logistic layer weighs them. It is trained here, in numpy, on a
bounded sample of labelled rows that aren't held out.

The threshold is calibrated for each language on labelled rows that the training
didn't see. A text's language is guessed from its own function words; the lang
column is no input. The score is the classifier's odds, moved so that the
language's threshold falls on ``cut_score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import tidy

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with as be by on are this from at have an they which or you not",
    "fr": "le la les de des du et un une que qui dans pour est par sur au ne pas plus avec ce il elle sont",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "es": "el la los las de que y en un una por con no para su se al lo como más pero sus le ya o este",
}
LANGUAGES = tuple(FUNCTION_WORDS)
PREFIXES = (4, 5, 6)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: ASCII letters, and every byte of a character beyond ASCII, make up words.
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


class Powers:
    """Powers of the hash's base and of its inverse, modulo 2**64, as many as a block of bytes needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, 1 << 16)
            cls.up = np.concatenate([[np.uint64(1)], np.full(m - 1, BASE)]).cumprod(dtype=np.uint64)
            cls.down = np.concatenate([[np.uint64(1)], np.full(m - 1, INVERSE)]).cumprod(dtype=np.uint64)
        return cls.up, cls.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of lower-case UTF-8: where each starts, its hash, and those of its prefixes (a row for each of PREFIXES; a
    prefix that is the whole word or more has hash zero)."""
    b = np.frombuffer(raw, np.uint8)
    is_letter = np.zeros(len(b) + 2, bool)
    is_letter[1:-1] = LETTER[b]
    edge = np.flatnonzero(is_letter[1:] != is_letter[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = Powers.upto(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(up[: len(b)] * (b.astype(np.uint64) + np.uint64(1)), out=total[1:])
    back = down[start]
    word = mixed((total[end] - total[start]) * back)
    parts = np.zeros((len(PREFIXES), len(start)), np.uint64)
    for k, n in enumerate(PREFIXES):
        long = end - start > n
        parts[k, long] = mixed((total[start[long] + n] - total[start[long]]) * back[long] + np.uint64(n))
    return start, word, parts


def _word(w: str) -> int:
    return int(word_hashes(w.encode())[1][0])


_STOP = sorted((_word(w), i) for i, lang in enumerate(LANGUAGES) for w in set(FUNCTION_WORDS[lang].split()))
STOP_HASH, STOP_LANG = np.array([h for h, _ in _STOP], np.uint64), np.array([i for _, i in _STOP])


@dataclass
class Texts:
    """Words of several texts, in stretches. buckets: a row for each word, 0 for no feature. pad: the empty places after a
    stretch; cut: places whose windows the text's next stretch has whole. stretch: which begins where; of: which text a stretch
    belongs to; lang: the texts' guessed languages."""

    buckets: np.ndarray
    pad: np.ndarray
    cut: np.ndarray
    stretch: np.ndarray
    of: np.ndarray
    lang: np.ndarray


def read(texts: list[str | None], buckets: int, room: int = 1 << 19, overlap: int = 0) -> Iterator[tuple[int, int, Texts]]:
    """Of texts in order, as many at a time as have room bytes together; a longer text comes alone, in stretches of so many
    bytes. Each stretch ends in ``overlap`` words without features, and a text's stretches share as many words."""
    low = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    at = 0
    while at < len(low):
        end, size = at + 1, len(low[at])
        while end < len(low) and size + len(low[end]) < room:
            size += len(low[end]) + 1
            end += 1
        yield at, end, _read(low[at:end], buckets, room, overlap)
        at = end


def _read(low: list[bytes], buckets: int, room: int, overlap: int) -> Texts:
    joined = b" ".join(low)
    ends = np.cumsum([len(t) + 1 for t in low])
    words, parts, doc, at = [], [], [], 0
    while at < len(joined) or not words:
        cut = min(len(joined), at + 2 * room)
        while cut < len(joined) and cut > at + room and LETTER[joined[cut - 1]]:
            cut -= 1
        start, w, p = word_hashes(joined[at:cut])
        words.append(w)
        parts.append(p)
        doc.append(np.searchsorted(ends, start + at, "right"))
        at = max(cut, at + 1)
    word, part, doc = np.concatenate(words), np.concatenate(parts, axis=1), np.concatenate(doc)
    feature = (np.vstack([word, part]) % np.uint64(buckets - 1)).astype(np.int32) + 1
    feature[1:][part == 0] = 0
    place = np.searchsorted(STOP_HASH, word)
    place[place == len(STOP_HASH)] = 0
    hit = STOP_HASH[place] == word
    # a word of several languages is there once for each; its neighbours in the sorted list are looked at too
    votes = np.zeros((len(low), len(LANGUAGES)), np.int64)
    for k in range(len(LANGUAGES)):
        near = np.minimum(place + k, len(STOP_HASH) - 1)
        same = hit & (place + k < len(STOP_HASH)) & (STOP_HASH[near] == word)
        np.add.at(votes, (doc[same], STOP_LANG[near[same]]), 1)
    lang = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), -1)
    # stretches: each text's words, cut where they are very many, with empty places after each
    n = np.bincount(doc, minlength=len(low))
    first = np.cumsum(n) - n
    most = max(room // 4, overlap + 1)
    if n.max(initial=0) <= most:
        of, begin, length = np.arange(len(low)), first, n
    else:
        of, begin, length = [], [], []
        for d in range(len(low)):
            for a in range(0, max(1, n[d] - overlap), most - overlap):
                of.append(d)
                begin.append(first[d] + a)
                length.append(min(n[d] - a, most))
        of, begin, length = np.array(of), np.array(begin), np.array(length)
    places = length + max(1, overlap)
    stretch = np.cumsum(places) - places
    out = np.zeros((int(places.sum()), len(PREFIXES) + 1), np.int32)
    k = np.repeat(np.arange(len(length)), length)
    inner = np.arange(len(k)) - np.repeat(np.cumsum(length) - length, length)
    out[stretch[k] + inner] = feature[:, begin[k] + inner].T
    pad = np.ones(len(out), bool)
    pad[stretch[k] + inner] = False
    goes_on = np.append(of[1:] == of[:-1], False)
    cut = (stretch[goes_on] + length[goes_on])[:, None] - 1 - np.arange(overlap)
    return Texts(out, pad, cut.ravel(), stretch, of, lang)


class Classifier:
    def __init__(self, buckets: int = 1 << 18, dims: int = 16, widths: tuple[int, ...] = (1, 2, 3), filters: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.words = np.zeros((buckets, dims), np.float32)  # what no training text has is nought, and says nothing
        self.conv = [(rng.standard_normal((w, dims, filters)) / np.sqrt(w * dims)).astype(np.float32) for w in widths]
        self.bias = [np.zeros(filters, np.float32) for _ in widths]
        self.out = rng.standard_normal(filters * len(widths)).astype(np.float32) * 0.3
        self.shift = np.float32(-1.0)
        self.limits = np.zeros(len(LANGUAGES) + 1, np.float32)  # in log odds; the last is for texts of no known language
        self.cut_score = 0.3

    @property
    def overlap(self) -> int:
        return max(self.widths) - 1

    def _pooled(self, t: Texts) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        x = self.words[t.buckets[:, 0]]
        for k in range(1, t.buckets.shape[1]):
            x += self.words[t.buckets[:, k]]
        maps, pooled = [], []
        for w, conv, bias in zip(self.widths, self.conv, self.bias, strict=True):
            z = x @ conv[0]
            for j in range(1, w):
                z[:-j] += x[j:] @ conv[j]
            z[t.pad] = 0
            z += bias
            z[t.cut] = -np.inf
            maps.append(z)
            pooled.append(np.maximum.reduceat(z, t.stretch, axis=0))
        return x, maps, np.concatenate(pooled, axis=1)

    def odds(self, t: Texts) -> np.ndarray:
        """Log odds of each text."""
        _, _, pooled = self._pooled(t)
        if len(t.of) > len(t.lang):
            pooled = np.maximum.reduceat(pooled, np.flatnonzero(np.append(True, t.of[1:] != t.of[:-1])), axis=0)
        return pooled @ self.out + self.shift

    def log_odds(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """And the guessed languages."""
        found = [(self.odds(t), t.lang) for _, _, t in read(texts, len(self.words), overlap=self.overlap)]
        return (np.concatenate([o for o, _ in found]), np.concatenate([g for _, g in found])) if found else (np.zeros(0), np.zeros(0, int))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z, lang = self.log_odds(texts)
        return 1 / (1 + np.exp(-np.clip(z - self.limits[lang] + np.log(self.cut_score / (1 - self.cut_score)), -40, 40)))

    def train(self, texts: list[str], labels: np.ndarray, epochs: int = 12, least_texts: int = 3, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> None:
        """By Adagrad on the logistic loss, both labels weighted alike. A feature of fewer than least_texts texts stays nought."""
        groups = [(a, t) for a, _, t in read(texts, len(self.words), room=1 << 16, overlap=self.overlap)]
        y, rng = np.asarray(labels, np.float32), np.random.default_rng(seed)
        seen = np.zeros((2, len(self.words)), np.int32)
        for a, t in groups:
            text = np.repeat(t.of, np.diff(np.append(t.stretch, len(t.buckets))))
            text, feature = np.divmod(np.unique(text[:, None].astype(np.int64) * len(self.words) + t.buckets), len(self.words))
            np.add.at(seen, (y[a + text].astype(int), feature), 1)
        known = seen.sum(axis=0) >= least_texts
        known[0] = False
        for _, t in groups:
            t.buckets[~known[t.buckets]] = 0
        # The first dimension starts as how far a feature is from being as frequent with either label, the others at random;
        # the narrowest filters start by looking for it. Training goes on from there.
        chance = seen.sum(axis=0) * y.mean()
        self.words[known] = rng.standard_normal((int(known.sum()), self.words.shape[1])) * 0.02
        self.words[known, 0] = np.clip((seen[1] - chance) / np.sqrt(chance + 0.5), -2, 8)[known] / 8
        self.conv[0][0, 0] = np.abs(self.conv[0][0, 0]) + 1
        self.out[: self.filters] = 6 / self.filters
        epochs = max(epochs, min(60, 400 // len(groups)))
        weight = np.where(y > 0, len(y) / 2 / max(1, y.sum()), len(y) / 2 / max(1, (1 - y).sum())).astype(np.float32)
        squares = [np.full_like(p, 1e-3) for p in self._parameters()]
        at_words = np.full(len(self.words), 1e-3, np.float32)
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                a, t = groups[g]
                x, maps, pooled = self._pooled(t)
                single = np.flatnonzero(np.append(True, t.of[1:] != t.of[:-1]))
                top = np.maximum.reduceat(pooled, single, axis=0)
                z = top @ self.out + self.shift
                own = slice(a, a + len(z))
                d = (1 / (1 + np.exp(-z)) - y[own]) * weight[own] / len(z)
                grads = [np.zeros_like(p) for p in self._parameters()]
                grads[-2], grads[-1] = d @ top, np.array(d.sum(), np.float32)
                dz = d[:, None] * self.out
                rows, dx = [], []
                for k, w in enumerate(self.widths):
                    for f in range(self.filters):
                        # the place where a text's filter is largest: the first of its best stretch
                        col, c = maps[k][:, f], k * self.filters + f
                        live = np.flatnonzero(dz[:, c])
                        if not len(live):
                            continue
                        for i in live:
                            s = single[i]
                            e = t.stretch[single[i + 1]] if i + 1 < len(single) else len(col)
                            p = int(t.stretch[s] + col[t.stretch[s] : e].argmax())
                            for j in range(0 if t.pad[p] else w):
                                grads[k][j, :, f] += dz[i, c] * x[p + j]
                                rows.append(p + j)
                                dx.append(dz[i, c] * self.conv[k][j, :, f])
                            grads[len(self.widths) + k][f] += dz[i, c]
                for p, q, dp in zip(self._parameters(), squares, grads, strict=True):
                    dp += decay * p
                    q += dp * dp
                    p -= rate * dp / np.sqrt(q)
                if rows:
                    features, dx = t.buckets[rows], np.array(dx)
                    ids, back = np.unique(features, return_inverse=True)
                    dw = np.zeros((len(ids), x.shape[1]), np.float32)
                    np.add.at(dw, back.reshape(features.shape), dx[:, None, :])
                    dw[ids == 0] = 0
                    at_words[ids] += (dw * dw).mean(axis=1)
                    self.words[ids] -= rate * dw / np.sqrt(at_words[ids])[:, None]
                    self.words[0] = 0

    def _parameters(self) -> list[np.ndarray]:
        self.shift = np.asarray(self.shift, np.float32).reshape(())
        return [*self.conv, *self.bias, self.out, self.shift]

    def calibrate(self, texts: list[str], labels: np.ndarray, cut_score: float = 0.3, least: int = 5, shrink: int = 20) -> None:
        """Each language's threshold: the middle of the gap in log odds at which F1 is best, drawn towards that of all languages
        together as if ``shrink`` toxic texts had voted for it. With fewer than ``least`` texts of either label, that one."""
        z, lang = self.log_odds(texts)
        y, self.cut_score = np.asarray(labels) > 0, cut_score
        self.limits[:] = every = best_cut(z, y)
        for k in range(len(LANGUAGES)):
            own = lang == k
            if min(y[own].sum(), (~y[own]).sum()) >= least:
                n = y[own].sum()
                self.limits[k] = (n * best_cut(z[own], y[own]) + shrink * every) / (n + shrink)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    if not y.any() or y.all():
        return 0.0 if not len(z) else float(z.max() + 1 if not y.any() else z.min() - 1)
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits, n = np.cumsum(y), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (n + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # no cut within ties
    k = int(np.flatnonzero(f1 == f1.max())[0])
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def held_out(id_col) -> F.Column:
    """Rows that nothing may learn from: crc32 of the identifier's text leaves 2 when divided by 4. A null identifier is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int = 1 << 26) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``most`` labelled rows that aren't held out, half of them for either label where there are as
    many; which, is settled by a hash of the identifier. Only identifiers are sorted; texts are read for the chosen ones, of which those
    stay that have ``most_bytes`` together, in the order of the hash. Of rows repeated with one identifier the least text counts."""
    usable = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    # at most ``most`` rows of two numbers, so this side may be broadcast
    chosen = usable.where("__y = 1").orderBy(F.xxhash64("__id"), "__id").limit(most // 2).unionByName(usable.where("__y = 0").orderBy(F.xxhash64("__id"), "__id").limit(most - most // 2))
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["__id"]).groupBy("__id").agg(F.min(text_col).alias("t"), F.first("__y").alias("y"))
    # a window over all of them: they are at most ``most``
    order = Window.orderBy(F.xxhash64("__id"), "__id")
    rows = rows.withColumn("n", F.sum(F.coalesce(F.octet_length("t"), F.lit(0)).cast("long")).over(order)).where(F.col("n") <= most_bytes).orderBy(F.xxhash64("__id"), "__id").collect()
    return [r.t or "" for r in rows], np.array([r.y for r in rows], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 3000, cut_score: float = 0.3, **sizes) -> Classifier:
    """Trained on four fifths of the sample of at most ``most`` labelled rows, calibrated on the rest. Without rows of both labels
    every text gets the score of no evidence, which lies below the cut."""
    texts, y = labelled_sample(docs, labels, id_col, text_col, label_col, most)
    model = Classifier(**sizes)
    model.cut_score = cut_score
    rest = np.arange(len(y)) % 5 == 4
    if len(set(y[~rest].tolist())) < 2:
        model.limits[:] = 1.0
        return model
    model.train([t for t, r in zip(texts, rest, strict=True) if not r], y[~rest])
    if len(set(y[rest].tolist())) < 2:
        rest[:] = True
    model.calibrate([t for t, r in zip(texts, rest, strict=True) if r], y[rest], cut_score)
    return model


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    A null text counts as the empty text, and an empty text has the score of no
    evidence. Texts are read whole, whatever their length. A null identifier
    counts as held out. Repeated rows each get the same score; other columns are
    ignored, and an empty table gives an empty result.
    """
    # the model's size is that of its tables, 16 MB, whatever the data
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                s = sent.value.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(s.astype(float)), pa.array((s >= sent.value.cut_score).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below the cut, with docs' columns. Nothing is shuffled: the rows pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield part.filter(pa.array(sent.value.scores(part.column(k).to_pylist()) < sent.value.cut_score))

    return docs.mapInArrow(tidy(run), docs.schema)
