"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``seed`` words are compared.
Tiling covers the item with runs of words that the document has too, in any
order: the longest common runs of unmarked words are found by running Karp-Rabin
over windows, whose length is halved towards the longest that both have, and
marked from the longest on, so that no word is used twice. The share of the
item's words that lie in tiles is its coverage; a passage whose sentences were put
in another order is covered like the passage itself.

A benchmark whose texts fit ``broadcast_bytes`` is sent to the executors, and the
documents pass through once, without a shuffle. A larger one is joined on the
seeds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tidy, whole

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
FOUND = "coverage double, matched int, n_words int, n_tiles int, reordered boolean"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n ids, modulo 2**64."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = out * BASE + ids[k : k + len(out)]
    return out


class Runs:
    """Karp-Rabin hashes of the windows of a sequence, of any length: differences of running sums of word number * BASE**place."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        if len(Runs.up) < n:
            Runs.up = np.concatenate([[np.uint64(1)], np.full(2 * n, BASE)]).cumprod(dtype=np.uint64)
            Runs.down = np.concatenate([[np.uint64(1)], np.full(2 * n, INVERSE)]).cumprod(dtype=np.uint64)
        self.ids, self.free, self.sums = ids, ids > 0, np.zeros(n + 1, np.uint64)
        np.cumsum(self.up[:n] * ids, out=self.sums[1:])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all windows of n unmarked words."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[n:] == taken[: len(taken) - n])
        return at, (self.sums[at + n] - self.sums[at]) * self.down[at]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, place in item, place in doc) of the tiles, from the longest on, ties by the places. Both are arrays of word numbers
    (uint64); 0 is a word that matches nothing.

    The length of the longest common run of unmarked words is found by halving: runs of a length exist if windows of that length
    have a hash in common. Memory is linear in the texts, as no pairs of windows are written out; hashes only ever find, and each
    tile is confirmed word by word.
    """
    a, b, out = Runs(item), Runs(doc), []
    top = min(len(item), len(doc)) + 1  # no common run is as long
    while top > least:
        low = least - 1
        while top - low > 1:
            n = (low + top) // 2
            if np.isin(a.windows(n)[1], b.windows(n)[1]).any():
                low = n
            else:
                top = n
        if low < least:
            break
        out += _mark(a, b, low)
        top = low
    return out


def _mark(a: Runs, b: Runs, n: int) -> list[tuple[int, int, int]]:
    """Marks common runs of n words, by place in a and then in b. A window of b that is no longer free never is again, so the search
    among equal windows goes on from where the last one ended."""
    out, (at, left), (to, right) = [], a.windows(n), b.windows(n)
    order = np.argsort(right, kind="stable")
    to, right = to[order], right[order]
    first, after = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    reached: dict[int, int] = {}
    for i, start, end in zip(at.tolist(), first.tolist(), after.tolist(), strict=True):
        if start == end or not a.free[i : i + n].all():
            continue
        k, settled = reached.get(start, start), True
        while k < end:
            j = int(to[k])
            if len(taken := np.flatnonzero(~b.free[j : j + n])):
                k = max(k + 1, int(np.searchsorted(to[start:end], j + taken[-1], "right")) + start)
                if settled:
                    reached[start] = k
            elif (a.ids[i : i + n] == b.ids[j : j + n]).all():
                a.free[i : i + n] = b.free[j : j + n] = False
                out.append((n, i, j))
                break
            else:  # another run of the same hash, which may still be some window's
                k, settled = k + 1, False
    return out


def compare(item: list[str], doc: list[str], least: int) -> tuple[float, int, int, int, bool]:
    """coverage, matched, n_words, n_tiles, reordered (the tiles' order in the document isn't the item's)."""
    number = {w: k + 1 for k, w in enumerate(dict.fromkeys(item))}
    a = np.array([number[w] for w in item], np.uint64)
    b = np.fromiter(map(number.get, doc, repeat(0)), np.uint64, len(doc))
    found = sorted(tiles(a, b, min(least, len(item))), key=lambda t: t[1])
    matched = sum(t[0] for t in found)
    return matched / max(1, len(item)), matched, len(item), len(found), any(x[2] > y[2] for x, y in zip(found, found[1:], strict=False))


class Benchmark:
    """Items with their seeds: the runs of ``seed`` words, or all words of a shorter item."""

    def __init__(self, rows: list[tuple], seed: int):
        self.items = [(i, w) for i, t in rows if (w := words(t))]
        self.number = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for _, item in self.items for w in item))}
        self.seeds: dict[int, dict[int, list[int]]] = {}
        for k, (_, item) in enumerate(self.items):
            n = min(seed, len(item))
            for h in set(windows(self.ids(item), n).tolist()):
                self.seeds.setdefault(n, {}).setdefault(h, []).append(k)
        self.sorted = {n: np.sort(np.fromiter(s, np.uint64, len(s))) for n, s in self.seeds.items()}

    def ids(self, text: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, text, repeat(0)), np.uint64, len(text))

    def candidates(self, text: list[str]) -> list[int]:
        ids, out = self.ids(text), set()
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, hashes in self.sorted.items():
            if len(ids) < n or not len(at := np.flatnonzero(unknown[n:] == unknown[:-n])):
                continue
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * BASE + ids[at + k]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for x in np.unique(h[hashes[place] == h]).tolist():
                out.update(self.seeds[n][x])
        return sorted(out)

    def leaks(self, text: str | None, least: int, threshold: float) -> list[tuple]:
        doc = words(text)
        found = [(self.items[k][0], *compare(self.items[k][1], doc, least)) for k in self.candidates(doc)]
        return [f for f in found if f[1] >= threshold]


def _fits(benchmark: DataFrame, text_col: str, most: int) -> bool:
    return benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col) + 16), F.lit(0)).alias("n")).first().n <= most


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str, seed: int):
    rows = [tuple(r) for r in benchmark.select(item_col, text_col).distinct().orderBy(item_col, text_col).collect()]
    return benchmark.sparkSession.sparkContext.broadcast(Benchmark(rows, seed))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed: int = 5, least: int = 3, threshold: float = 0.8, broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """A row for each document and item whose coverage reaches ``threshold``: doc_id, item_id, coverage, matched, n_words, n_tiles, reordered.

    Words are runs of letters, digits and _ in lower case. Tiles have ``least``
    words or more; an item of fewer words is one tile or none, and an item of no
    words is never found. Null texts have no words. Repeated rows of docs are
    found as often as they stand there, null identifiers like any other, and items
    repeated are found once each. Either table may be empty; other columns are
    ignored. The whole of each text is compared, however long or repetitive; memory
    is linear in the two texts.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, {FOUND}"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if _fits(benchmark, item_text_col, broadcast_bytes):
        sent = _benchmark(benchmark, item_col, item_text_col, seed)

        kind = _item_type(benchmark, item_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(r, *f) for r, t in enumerate(b.column(1).to_pylist()) for f in sent.value.leaks(t, least, threshold)]
                if found:
                    at, item, *rest = zip(*found, strict=True)
                    yield _batch(b.column(0).take(pa.array(at)), pa.array(item, kind), rest)

        return rows.mapInArrow(tidy(run), schema)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    lengths = sorted({r.n for r in items.select("item_text").mapInArrow(tidy(_seed_lengths(seed)), "n int").distinct().collect()} | {seed})
    pairs = joined_candidates(rows, items, seed, lengths)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [compare(words(s), words(t), least) for t, s in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            at = [r for r, g in enumerate(got) if g[0] >= threshold]
            if at:
                yield _batch(b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), zip(*(got[r] for r in at), strict=True))

    return pairs.select("doc_id", "text", "item_id", "item_text").mapInArrow(tidy(verify), schema)


def _batch(doc_id: pa.Array, item_id: pa.Array, rest) -> pa.RecordBatch:
    kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([doc_id, item_id, *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], ["doc_id", "item_id", *(c.split()[0] for c in FOUND.split(", "))])


def _item_type(benchmark: DataFrame, item_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(benchmark.schema[item_col].dataType)


def _seed_lengths(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({min(seed, n) for t in b.column(0).to_pylist() if (n := len(words(t)))}), pa.int32())], ["n"])

    return run


def seeds_of(n: tuple[int, ...], shorter: bool):
    """Emits (key, seed) for each run of words, distinct within a row. shorter: a row of fewer words than the longest run is
    itself a run (items), else all runs of these lengths count (documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seeds = [], []
            for r, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                w = words(t)
                h = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in w], np.uint64)
                lengths = [min(max(n), len(w))] if shorter else [k for k in n if k <= len(w)]
                got = np.unique(np.concatenate([windows(h, k) + np.uint64(k) for k in lengths if k] or [np.zeros(0, np.uint64)]))
                rows.append(np.full(len(got), r))
                seeds.append(got)
            rows = pa.array(np.concatenate([*rows, np.zeros(0, int)]).astype(np.int64))
            keys = [b.column(k).take(rows) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([*seeds, np.zeros(0, np.uint64)]).view(np.int64))], [*b.schema.names[:-1], "seed"])

    return run


def joined_candidates(rows: DataFrame, items: DataFrame, seed: int, lengths: list[int], salts: int = 16) -> DataFrame:
    """Documents and items that share a seed, each pair of a text and an item once, with both texts. Joins on seeds, then on the
    texts' keys; nothing is collected. A seed may be in very many documents, so these are dealt over ``salts`` parts and the items'
    seeds go to each."""
    rows = rows.withColumn("key", F.xxhash64("doc_id", whole("text")))
    items = items.withColumn("item_key", F.xxhash64("item_id", whole("item_text")))
    of_items = items.select("item_key", "item_text").distinct().mapInArrow(tidy(seeds_of((seed,), True)), "item_key long, seed long")
    of_docs = rows.select("key", "text").mapInArrow(tidy(seeds_of(tuple(lengths), False)), "key long, seed long")
    of_docs = of_docs.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    of_items = of_items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = of_docs.join(of_items, ["seed", "salt"]).select("key", "item_key").distinct()
    return rows.join(pairs, "key").join(items.distinct(), "item_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = 5, least: int = 3, threshold: float = 0.8, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs in which no item is found, with docs' columns."""
    if _fits(benchmark, item_text_col, broadcast_bytes):
        sent, k = _benchmark(benchmark, item_col, item_text_col, seed), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not sent.value.leaks(t, least, threshold) for t in b.column(k).to_pylist()], pa.bool_()))

        return docs.mapInArrow(tidy(run), docs.schema)
    named = docs.withColumn("__text", F.sha2(whole(text_col), 256))
    once = named.select("__text", text_col).groupBy("__text").agg(F.first(text_col).alias("text"))
    bad = find_leaks(once, benchmark, "__text", "text", item_col, item_text_col, seed, least, threshold, broadcast_bytes).select(F.col("doc_id").alias("__text")).distinct()
    return named.join(bad, "__text", "left_anti").drop("__text")
