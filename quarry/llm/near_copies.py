"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, beside those that SimHash links.

A text's key is 64 bits of a hash: that two different texts share one is not to be
expected below some billions of texts, and would only leave one of them uncompared.

Three bits of one fingerprint are too few for such pairs, so candidates come from
min-wise hashes too: BANDS bands of ROWS hashes each. Two texts of similarity s
share a bucket with probability 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8. Every
candidate is confirmed on the whole shingle sets.

In a bucket all are first compared with its least text. What is then in one
component needs no more comparing, so a group of copies of one text costs about
as many comparisons as it has texts. The texts of buckets that still hold several
components often share a passage without being similar, and there may be very many
of them. These are joined exactly, on their rare shingles: with the shingles of
each text in order of how many of the texts have them, two similar texts have one
in common among their first, whose number follows from the similarity (prefix
filter), and their sizes and the place of the first common one must allow for the
similarity as well (length and positional filters). Shingles of a passage that
many texts share come last, and bring no pairs about.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, small_side, tidy, whole, without
from quarry.llm.components import connected_components
from quarry.llm.decontaminate import BASE, windows
from quarry.llm.simhash import SEED, fingerprint, fingerprint_links, homes

BANDS, ROWS = 20, 5
_random = np.random.default_rng(SEED)
MASK = _random.integers(0, 2**64, BANDS * ROWS, np.uint64)
FACTOR = _random.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles of a UTF-8 text; words as in a fingerprint. A text of fewer words is one shingle."""
    w = text.lower().split()
    h = xxhash.xxh64_intdigest
    return np.unique(windows(np.fromiter((h(x, SEED) for x in w), np.uint64, len(w)), min(words, len(w)))) if w else np.zeros(0, np.uint64)


def buckets(of: np.ndarray, block: int = 4096) -> np.ndarray:
    """One for each band; none for a text without words."""
    if not len(of):
        return of
    least = np.min([((of[at : at + block, None] ^ MASK) * FACTOR).min(axis=0) for at in range(0, len(of), block)], axis=0)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out * BASE) ^ (column >> np.uint64(29)) ^ column
    return out


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _marks(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                fps = np.array([fingerprint(t) for t in texts], np.uint64)
                found = [buckets(shingles(t, words)) for t in texts]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64)), pa.array(homes(fps)), lists], ["doc_id", "key", "fp", "home", "buckets"])

    return run


def _confirm(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                out = []
                for pair in zip(*(c.cast(pa.binary()).to_pylist() for c in b.slice(at, 500).columns), strict=True):
                    if similar(*(shingles(t, words) for t in pair), similarity):
                        out.append([fingerprint(t) for t in pair])
                fps = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fps[:, 0].copy()), pa.array(fps[:, 1].copy())], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) between fingerprints of those pairs (a, b) of text keys that are similar."""
    pairs = cut(pairs)
    named = cut(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
    texts = cut(texts.join(small_side(named), "key", "left_semi").dropDuplicates(["key"]))
    left, right = texts.select(F.col("key").alias("a"), F.col("text").alias("one")), texts.select(F.col("key").alias("b"), F.col("text").alias("other"))
    return cut(pairs.join(left, "a").join(right, "b").select("one", "other").mapInArrow(tidy(_confirm(words, similarity)), "a long, b long").distinct())


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                sets = [shingles(t, words) for t in part.column(1).cast(pa.binary()).to_pylist()]
                size = np.array([len(x) for x in sets])
                row = np.repeat(np.arange(len(sets)), size)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64))], ["key", "size", "shingle"])

    return run


def prefix_pairs(named: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """named (key, component), each key once, and texts (key, text). Pairs (a, b) of the named texts in different components, among
    which are all that are similar.

    A shingle's rank is how many of the texts have it, then its hash; those that one text has come first and need not be joined. A
    text's list is as long as the text; a shingle of very many texts is a skewed join, which Spark can split, and seldom in a prefix.
    """
    of = texts.join(small_side(named.select("key")), "key", "left_semi").dropDuplicates(["key"]).select("key", "text").mapInArrow(tidy(_sets(words)), "key long, size int, shingle long")
    counts = of.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    listed = of.join(counts, "shingle").groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    alone = F.col("size") - F.size("common")
    reach = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    listed = listed.withColumn("alone", alone).withColumn("common", F.slice("common", F.lit(1), F.greatest(F.lit(0), reach - alone).cast("int")))
    early = cut(listed.select("key", "size", F.col("alone").alias("alone"), F.posexplode("common").alias("at", "ranked")).join(named, "key").select(
        F.col("ranked.shingle").alias("shingle"), "key", "size", "component", (F.col("size") - F.col("alone") - F.col("at")).alias("rest")
    ))
    x, y = early.alias("x"), early.alias("y")
    enough = similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-9
    fits = (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & (F.least("x.rest", "y.rest") >= enough) & (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * similarity - 1e-9)
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & fits).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, threshold: int = 3) -> DataFrame:
    """(doc_id, component_id) for each row of docs: the smallest doc_id reachable over links between texts whose fingerprints differ
    in ``threshold`` bits or fewer, or whose shingles of ``words`` words are similar. Nulls and repeated rows as in
    simhash_components."""
    texts = docs.select(F.xxhash64(whole(text_col)).alias("key"), whole(text_col).cast("string").alias("text"))
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole(text_col)).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_marks(words)), "doc_id long, key long, fp long, home int, buckets array<long>"))
    each = rows.groupBy("fp", "home").agg(F.min("doc_id").alias("least"))
    linked = fingerprint_links(each.select("fp", "home"), threshold)

    there = rows.select("key", "fp", F.explode("buckets").alias("bucket"))
    shared = there.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("top")).where("a < top").select("bucket", "a")
    members = cut(there.join(shared, "bucket").select("bucket", "a", "key", "fp"))
    first = members.where("a <> key").select("a", F.col("key").alias("b")).distinct()
    found = connected_components(linked.unionByName(_confirmed(first, texts, words, similarity)))

    named = members.join(found, members["fp"] == found["node"], "left").select("bucket", "key", F.coalesce("component", "fp").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    left = cut(named.join(mixed, "bucket", "left_semi").select("key", "component").distinct())
    second = prefix_pairs(left, texts, words, similarity)
    more = _confirmed(second.join(first, ["a", "b"], "left_anti"), texts, words, similarity)
    if not more.isEmpty():
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = cut(each.join(found, each["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, threshold: int = 3) -> DataFrame:
    """The rows of docs with the smallest identifier of their component, with docs' columns; rows without an identifier stay if their component has none."""
    found = near_components(docs, id_col, text_col, words, similarity, threshold)
    return without(docs, found, id_col, F.col("doc_id").eqNullSafe(F.col("component_id")))
