"""Secrets in texts: fixed patterns, and character Markov models.

Two models of the next character given the two before it, one of random strings
and one of ordinary identifiers and words, are trained from labelled samples. A
candidate (a long run of token characters, but for numbers and runs of fewer than
six different ones) whose log-likelihood ratio per character passes a threshold,
set on the samples, is reported beside the spans of the patterns. Letters of one
case have a pair of models of their own.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tidy

#: The base patterns, and how long a match must be. ASCII letters of the first match in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs: as long ones as the pattern without a least length would find, and no shorter ones.
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = {c: k + 1 for k, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 1
TABLE = np.zeros(256, np.int64)
TABLE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, SIZE)

#: Words that ordinary identifiers are made of.
PARTS = (
    "get set user name index value count list data file path node edge query result score rank token field page text line word parse read write open close "
    "load save build make find first last next prev start stop begin end size length width height color image video audio time date hour minute second day "
    "month year server client request response header body error warning message status state event handler manager factory service controller model view "
    "config option default global local static public private internal external source target input output buffer stream reader writer cache memory disk "
    "table column row key map array vector matrix string number integer float double boolean object class method function module package version update"
).split()


def default_samples(n: int = 4000, seed: int = 11) -> list[tuple[int, str]]:
    """Labelled samples (1 random, 0 ordinary), n of either: strings drawn over the usual alphabets of keys; and identifiers,
    paths, numbered names and run-together words put together from PARTS."""
    rng, out = random.Random(seed), []
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET[:62] + "_-"]
    joins = ["_", "-", "/", "", "", "_"]
    for k in range(n):
        out.append((1, "".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(16, 64)))))
        parts = [rng.choice(PARTS) for _ in range(rng.randint(3, 7))]
        style = k % 5
        if style == 1:
            parts = [p.capitalize() for p in parts]
        if style == 2:
            parts = [parts[0], *(p.capitalize() for p in parts[1:])]
        if style == 3:
            parts = [p.upper() for p in parts]
        if k % 3 == 0:
            parts.append(str(rng.choice([1, 2, 3, 10, 64, 100, 2024, rng.randrange(100, 100_000)])))
        if k % 11 == 0:
            parts = [f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", *parts]
        out.append((0, rng.choice(joins).join(parts)))
    return out


def one_case_samples(n: int = 4000, seed: int = 12) -> list[tuple[int, str]]:
    """Labelled samples of letters in one case, or with a capital first: strings drawn at random, and words run together."""
    rng, out = random.Random(seed), []
    for k in range(n):
        letters = "abcdefghijklmnopqrstuvwxyz"
        out.append((1, "".join(rng.choices(letters.upper() if k % 2 else letters, k=rng.randint(16, 64)))))
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(3, 9)))
        out.append((0, (t, t.upper(), t.capitalize())[k % 3]))
    return out


class Markov:
    """Log-probabilities of a character after two others, smoothed over one and over none."""

    def __init__(self, texts: list[str], weight: float = 2.0):
        one, two, three = np.ones(SIZE), np.zeros((SIZE, SIZE)), np.zeros((SIZE, SIZE, SIZE))
        for t in texts:
            c = codes(t)
            np.add.at(one, c[2:], 1)
            np.add.at(two, (c[1:-1], c[2:]), 1)
            np.add.at(three, (c[:-2], c[1:-1], c[2:]), 1)
        p1 = one / one.sum()
        p2 = (two + weight * p1) / (two.sum(axis=1, keepdims=True) + weight)
        p3 = (three + weight * p2) / (three.sum(axis=2, keepdims=True) + weight)
        self.log = np.log(p3).astype(np.float32)


def codes(t: str) -> np.ndarray:
    """0 stands twice before the text, and for characters of no other number."""
    return np.concatenate([[0, 0], TABLE[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)]])


class Ratio:
    def __init__(self, samples: list[tuple[int, str]], least: int = 20, false_alarms: float = 0.001, lowest: float = 0.2):
        """least: the shortest candidate; false_alarms: the share of ordinary samples, not trained on, that may pass the threshold, which
        is no lower than ``lowest``."""
        self.least = least
        train, rest = [s for k, s in enumerate(samples) if k // 2 % 4], [s for k, s in enumerate(samples) if not k // 2 % 4]
        random_, ordinary = (Markov([t for y, t in train if y == label]) for label in (1, 0))
        self.ratio = random_.log - ordinary.log
        scores = np.sort([self.score(t) for y, t in rest if not y and len(t) >= least] or [0.0])[::-1]
        self.threshold = max(lowest, float(scores[min(len(scores) - 1, int(false_alarms * len(scores)))]) + 1e-6)

    def score(self, t: str) -> float:
        """Log-likelihood ratio per character."""
        c = codes(t)
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].sum()) / max(1, len(t))


class Model:
    """Two pairs of models: one for runs with digits or mixed case, one for letters of one case. Words of the languages that the second
    doesn't know score up to 2.2, so its threshold is higher."""

    def __init__(self, samples: list[tuple[int, str]], least: int = 20, one_case: list[tuple[int, str]] | None = None):
        self.least, self.mixed, self.one_case = least, Ratio(samples, least), Ratio(one_case if one_case is not None else one_case_samples(), least, lowest=2.5)

    def spans(self, text: str) -> list[tuple[int, int]]:
        out = []
        for m in CANDIDATE.finditer(text):
            t = m[0]
            if len(t) < self.least or t.isdigit() or len(set(t)) < 6:
                continue
            model = self.one_case if t.isalpha() and (t.islower() or t.isupper() or t.istitle()) else self.mixed
            if model.score(t) > model.threshold:
                out.append(m.span())
        return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' matches, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, samples: list[tuple[int, str]] | None = None, one_case: list[tuple[int, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then
    assign, access, hex, random. ``samples`` are labelled strings (1 random, 0
    ordinary) that the models are trained on, ``default_samples`` if none are
    given, and ``one_case`` those for letters of one case; their number is the
    caller's and doesn't grow with docs. Texts are read
    whole, whatever their length; a null text counts as empty. Repeated rows and
    null identifiers each appear; other columns are ignored, and an empty table
    gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(samples if samples is not None else default_samples(), least, one_case))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                every = [sorted(chain(s, ((a, 3, e) for a, e in m.spans(t)))) for s, t in zip(base, texts, strict=True)]
                counts = [pa.array([sum(k == n for _, k, _ in s) for s in base], pa.int64()) for n in range(3)]
                digest = pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, pa.array([joined(s) for s in every], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def labelled(df: DataFrame, label_col: str, text_col: str, most: int = 20_000) -> list[tuple[int, str]]:
    """Samples from a table of labelled strings: at most ``most`` of either label, chosen by a hash of the string."""
    pick = lambda y: df.where(F.col(label_col) == y).select(F.lit(y).alias("y"), F.col(text_col).alias("t")).where("t <> ''").orderBy(F.xxhash64("t"), "t").limit(most)
    pairs = zip(*([(r.y, r.t) for r in pick(y).collect()] for y in (1, 0)), strict=False)
    return [x for p in pairs for x in p]
