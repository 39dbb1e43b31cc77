"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code: the product of two binary Golay codes
[23, 12], which are perfect with covering radius 3 each, over the upper 46 of 64
bits. So every fingerprint has a home anchor within radius 3 in either half, and
a fingerprint at distance t or less from another lies within radius 3 + t1 and
3 + t2 of that one's home, for some t1 + t2 <= t. Fingerprints are replicated to
every such anchor, and an anchor compares the fingerprints at home there with
all that came, on all 64 bits. Two links lead to the same pair (each may visit
the other's home); a fingerprint therefore only goes to the anchors up to half
way round the circle of anchor numbers from its home, which keeps one of them.

With more fingerprints than some 64 for each of the 2**24 anchors the code takes in
lower bits as well, each of their values a codeword of its own; a fingerprint then
visits the anchors of values that differ in so many bits as are left of t.

Distinct fingerprints are compared, not rows. An anchor with a large population
is dealt over slices of those at home; visitors go to each slice and pass by in
batches. What leaves an anchor is a spanning forest of its links and not the links
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, shuffle_parts, tidy, without
from quarry.llm.components import connected_components

SEED = 42
#: Generator polynomial of the cyclic Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY, BITS, RADIUS = 0b101011100011, 23, 3
HALF, CIRCLE = 1 << 23, 1 << 24
#: Bits below the code's; how many fingerprints an anchor is at home to before the code takes in some of them.
SPARE, PER_ANCHOR = 18, 64


def fingerprint(text: bytes, words: int = 3) -> int:
    """Of a UTF-8 text. A-Z are lower-cased; words are what stands between blanks and \\t to \\r."""
    w = text.lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate([[0], ends[: len(w) - k]]).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half of the hashes."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", words) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(homes(fps))], ["doc_id", "fp", "home"])

    return run


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables over the 2,048 syndromes of a half: syndromes of a byte at each of three places; the leader; where a syndrome's
    codewords start; these codewords' messages, nearest first; and how many of them lie within radius + 0, 1, 2, 3 of the leader."""

    def remainder(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for i in range(BITS - 1, 10, -1):
            v = np.where(v >> i & 1, v ^ (GOLAY << (i - 11)), v)
        return v

    place = np.stack([remainder(np.arange(256, dtype=np.int64) << s & (1 << BITS) - 1) for s in (0, 8, 16)])
    one = 1 << np.arange(BITS, dtype=np.int64)
    errors = [np.zeros(1, np.int64)]
    for w in range(1, RADIUS + 1):
        e = np.unique((errors[-1][:, None] | one[None, :]).ravel())
        errors.append(e[np.bitwise_count(e) == w])
    errors = np.concatenate(errors)
    leader = np.zeros(2048, np.int64)
    leader[remainder(errors)] = errors
    code = np.arange(4096, dtype=np.int64) << 11
    code ^= remainder(code)
    far = np.bitwise_count(leader[:, None] ^ code[None, :]).astype(np.int64)
    s, c = np.nonzero(far <= 2 * RADIUS)
    d = far[s, c]
    order = np.lexsort((c, d, s))
    s, c, d = s[order], c[order], d[order]
    within = np.stack([np.bincount(s[d <= RADIUS + e], minlength=2048) for e in range(4)])
    return place, leader, np.concatenate([[0], np.cumsum(within[3])[:-1]]), c, within


def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (fps >> np.uint64(41)).astype(np.int64), (fps >> np.uint64(18)).astype(np.int64) & (1 << BITS) - 1


def _decode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Syndrome and the home codeword's message."""
    place, leader, *_ = golay()
    s = place[0][v & 255] ^ place[1][v >> 8 & 255] ^ place[2][v >> 16]
    return s, (v ^ leader[s]) >> 11


def homes(fps: np.ndarray) -> np.ndarray:
    a, b = (_decode(v)[1] for v in halves(fps))
    return (a << 12 | b).astype(np.int32)


def anchors(fps: np.ndarray, extra: int) -> np.ndarray:
    """The home anchors in a code that takes in so many of the lower bits as well, each word of them a codeword of its own."""
    return homes(fps).astype(np.int64) << extra | _lower(fps, extra)


def _lower(fps: np.ndarray, extra: int) -> np.ndarray:
    return (fps >> np.uint64(SPARE - extra)).astype(np.int64) & (1 << extra) - 1


def visits(fps: np.ndarray, threshold: int = 3, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor that a fingerprint goes to, its home included."""
    *_, first, message, within = golay()
    (s1, m1), (s2, m2) = (_decode(v) for v in halves(fps))
    lower, which, found = _lower(fps, extra), [], []
    home = (m1 << 12 | m2) << extra | lower
    flips = np.arange(1 << extra)
    for t3 in range(min(threshold, extra) + 1):
        flip = flips[np.bitwise_count(flips) == t3]
        left = threshold - t3
        for e in range(left + 1):
            low = within[e - 1][s1] if e else np.zeros(len(fps), np.int64)
            n1, n2 = within[e][s1] - low, within[left - e][s2]
            i = np.repeat(np.arange(len(fps)), n1 * n2)
            k = np.arange(len(i)) - np.repeat(np.cumsum(n1 * n2) - n1 * n2, n1 * n2)
            a = m1[i] ^ message[first[s1[i]] + low[i] + k // n2[i]]
            b = m2[i] ^ message[first[s2[i]] + k % n2[i]]
            i, to = np.repeat(i, len(flip)), np.repeat(a << 12 | b, len(flip))
            to = to << extra | (lower[i] ^ np.tile(flip, len(to) // max(1, len(flip))))
            near = (to - home[i]) % (CIRCLE << extra) <= HALF << extra
            which.append(i[near])
            found.append(to[near])
    return np.concatenate(which), np.concatenate(found)


def _replicate(threshold: int, extra: int, room: int = 300_000):
    """As many fingerprints at a time as make about ``room`` visits."""
    block = max(50, room // (150 * (1 + extra)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), block):
                part = fps[at : at + block]
                i, anchor = visits(part.view(np.uint64), threshold, extra)
                visiting = anchor != anchors(part.view(np.uint64), extra)[i]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[i]), pa.array(visiting)], ["anchor", "fp", "visiting"])

    return run


def _links(fp: np.ndarray, host: np.ndarray, start: np.ndarray, threshold: int, small: int = 64, room: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links at the anchors whose rows begin at start: between those at home (host) and all there."""
    size = np.diff(np.append(start, len(fp)))
    group = np.repeat(np.arange(len(start)), size)
    h = np.flatnonzero(host & (size[group] > 1) & (size[group] <= small))
    out_a, out_b = [], []
    for part in np.array_split(h, len(h) * small // room + 1):
        n = size[group[part]]
        i = np.repeat(part, n)
        j = np.repeat(start[group[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= threshold) & (i != j)
        out_a.append(fp[i[near]])
        out_b.append(fp[j[near]])
    for g in np.flatnonzero(size > small):
        own = fp[start[g] : start[g] + size[g]]
        label = np.arange(len(own))
        for i in np.flatnonzero(host[start[g] : start[g] + size[g]]):
            near = np.bitwise_count(own ^ own[i]) <= threshold
            met = np.unique(label[near])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        joined = np.flatnonzero(label != np.arange(len(own)))
        out_a.append(own[joined])
        out_b.append(own[label[joined]])
    return np.concatenate([*out_a, np.zeros(0, np.uint64)]), np.concatenate([*out_b, np.zeros(0, np.uint64)])


def _compare(threshold: int, extra: int):
    """Rows come sorted by anchor and slice, those at home before visitors. Of an anchor that a batch breaks off only those at home wait
    for the next batch, so visitors may be any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if rest is not None:
                got = [np.concatenate(x) for x in zip(rest, got, strict=True)]
            anchor, fp, no, of, visiting = got
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (no[1:] != no[:-1])
            own = fp.view(np.uint64)
            a, b = _links(own, ~visiting & (slice_of(own, of) == no), np.flatnonzero(new), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            last = int(np.flatnonzero(new)[-1])
            rest = [x[last:][~visiting[last:]] for x in got]

    return run


def slice_of(fp: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """In the upper bits of a product: they depend on all bits of the fingerprint."""
    return (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % slices


def fingerprint_links(distinct: DataFrame, threshold: int = 3, slice_rows: int = 20_000, extra: int | None = None) -> DataFrame:
    """distinct (fp long, home int), each fingerprint once. Returns links (a, b) that connect all fingerprints within threshold.

    extra: how many of the 18 lower bits the code takes in, too. If not given, as many as keep about ``PER_ANCHOR`` fingerprints at home
    at an anchor, so anchors grow with the data and the comparisons of one don't.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("the code's tables reach up to three bits")
    if extra is None:
        n = distinct.count()
        extra = next((k for k in range(SPARE) if n <= (PER_ANCHOR * CIRCLE) << k), SPARE)
    home = F.shiftleft(F.col("home").cast("long"), extra).bitwiseOR(F.shiftright("fp", SPARE - extra).bitwiseAND(F.lit((1 << extra) - 1)))
    full = distinct.groupBy(home.alias("anchor")).count().where(F.col("count") > slice_rows).select("anchor", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    visit = distinct.select("fp").mapInArrow(tidy(_replicate(threshold, extra)), "anchor long, fp long, visiting boolean")
    if full.isEmpty():
        visit = visit.select("anchor", "fp", F.lit(0).alias("slice"), F.lit(1).alias("slices"), "visiting")
    else:
        visit = visit.join(full, "anchor", "left").select("anchor", "fp", F.coalesce("slices", F.lit(1)).alias("slices"), "visiting")
        visit = visit.select("anchor", "fp", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "slices", "visiting")
    dealt = visit.repartition(shuffle_parts(distinct.sparkSession), "anchor", "slice").sortWithinPartitions("anchor", "slice", "visiting")
    return dealt.select("anchor", "fp", "slice", "slices", "visiting").mapInArrow(tidy(_compare(threshold, extra)), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 3, slice_rows: int = 20_000) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most
    ``threshold`` bits. Null and empty texts, and those of white space only, have
    fingerprint zero and link like any other. A null doc_id is in its text's
    component, and never its smallest; a component of null identifiers only has a
    null component_id. Repeated rows each appear. Other columns are ignored.
    Identifiers are whole numbers, or read as such; others are an error.
    """
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_fingerprints(words)), "doc_id long, fp long, home int"))
    each = rows.groupBy("fp", "home").agg(F.min("doc_id").alias("least"))
    found = connected_components(fingerprint_links(each.select("fp", "home"), threshold, slice_rows))
    named = cut(each.join(found, each["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 3) -> DataFrame:
    """The rows of docs with the smallest identifier of their component, with docs' columns; rows without an identifier stay if their component has none."""
    found = simhash_components(docs, id_col, text_col, words, threshold)
    return without(docs, found, id_col, F.col("doc_id").eqNullSafe(F.col("component_id")))
