"""Exact dedup by a tree merge of sorted digest runs.

Every input partition makes a run: its texts' digests, sorted, one row a digest
with the best identifier and the number of rows. The runs then meet in binomial
rounds (recursive halving, with ``fan_in`` partners a round instead of two). A
node's number and a digest's shard are both written in base ``fan_in``; in round
r a row moves to the node whose r-th digit is that of its shard, where the
sorted runs of ``fan_in`` partners are merged. After the last round node p holds
all of shard p and nothing else. No node ever holds more than its share, equal
texts are combined before they move, and what moves is digests, never texts.

Verified: a row of a run is (SHA-256, length, XXH64) of the text; two rows merge
only if all three agree, at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, shuffle_parts, tidy, whole

KEY = ("digest", "n_bytes", "check")
RUN = "node int, digest binary, n_bytes long, check long, keep_id long, group_size long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = whole(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check"),
    )


def _merge(t: pa.Table, keep: str) -> pa.Table:
    """One row for each stretch of equal keys of a sorted table. Nulls (rows without an identifier) lose."""
    n = t.num_rows
    if not n:
        return t
    new = np.zeros(n, bool)
    new[0] = True
    digest = np.frombuffer(b"".join(t["digest"].to_pylist()), np.uint8).reshape(n, 32)
    new[1:] = (digest[1:] != digest[:-1]).any(axis=1)
    for k in ("node", "n_bytes", "check"):
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new)
    ids, none = t["keep_id"].fill_null(0).to_numpy(), t["keep_id"].is_null().to_numpy()
    least = np.iinfo(np.int64).min if keep == "largest" else np.iinfo(np.int64).max
    ids = (np.maximum if keep == "largest" else np.minimum).reduceat(np.where(none, least, ids), at)
    none = np.logical_and.reduceat(none, at)
    out = t.take(pa.array(at))
    # the fields stay as they are, "not null" included: what a batch leaves over is joined to the next one
    out = out.set_column(4, t.field("keep_id"), pa.array(ids, pa.int64(), mask=none))
    return out.set_column(5, t.field("group_size"), pa.array(np.add.reduceat(t["group_size"].to_numpy(), at), pa.int64()))


def _merger(keep: str):
    """Merges sorted rows as they come; only the last stretch waits for the next batch."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = _merge((pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks(), keep)
            if t.num_rows:
                yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
                rest = t.slice(t.num_rows - 1)
        if rest is not None:
            yield from rest.combine_chunks().to_batches()

    return merge


def merged_runs(rows: DataFrame, keep: str = "largest", fan_in: int = 4, shards: int | None = None) -> DataFrame:
    """rows: (doc_id, digest, n_bytes, check). Returns a row for each text: KEY, keep_id, group_size."""
    if keep not in ("largest", "smallest") or fan_in < 2:
        raise ValueError("keep is largest or smallest, and fan_in 2 or more")
    shards, rounds = shards or shuffle_parts(rows.sparkSession), 1
    while fan_in**rounds < shards:
        rounds += 1
    n = fan_in**rounds
    # the first four bytes of a digest are as good as random
    shard = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % n
    merge = _merger(keep)
    runs = rows.select((F.spark_partition_id() % n).alias("node"), *KEY, F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    order = ("node", *KEY)
    runs = runs.sortWithinPartitions(*order).mapInArrow(tidy(merge), RUN)
    for r in range(rounds):
        digit = F.floor(shard / fan_in**r) % fan_in
        own = F.floor(F.col("node") / fan_in**r) % fan_in
        runs = runs.withColumn("node", (F.col("node") + (digit - own) * fan_in**r).cast("int"))
        runs = runs.repartition(n, "node").sortWithinPartitions(*order).mapInArrow(tidy(merge), RUN)
    return runs.drop("node")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 4, shards: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text. Of equal texts
    the row with the largest (or smallest) identifier stays. A null identifier
    loses to any other; in a group of null identifiers only, keep_id is null and
    the rows count as kept. Rows repeated with the same identifier and text all
    appear, and all count as kept; ``deduplicated`` returns one of them. An empty
    table gives an empty result. Other columns, whatever their names, are ignored.
    Identifiers are whole numbers, or read as such; others are an error.
    """
    rows = cut(digests(docs, id_col, text_col))
    runs = merged_runs(rows, keep, fan_in, shards)
    # A text with very many copies is one row of the runs; Spark splits its many rows on the other side.
    return rows.join(runs, list(KEY)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, one for each text, with docs' columns. Of rows repeated with identifier and text one stays."""
    kept = cut(exact_dedup(docs, id_col, text_col, keep).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count("*").alias("__n")))
    named = docs.withColumn("__sha", F.sha2(whole(text_col), 256))
    same = lambda k: named[id_col].eqNullSafe(k["__id"]) & (named["__sha"] == k["__sha"])
    more = kept.where("__n > 1")
    if more.isEmpty():
        return named.join(kept, same(kept), "left_semi").drop("__sha")
    once = named.join(k := kept.where("__n = 1"), same(k), "left_semi")
    return once.unionByName(named.join(more, same(more), "left_semi").dropDuplicates([id_col, "__sha"])).drop("__sha")
