"""Token ids in files of directly addressable codes.

An id is split into chunks, the low bits first: a byte each here.
Level 0 has the first chunk of every id; a bitmap says which ids continue, and
level k holds the k-th chunk of those that reach it, in order. A rank directory
(ones before every 512-bit block of the bitmap) gives an id's place on the next
level: place = rank(bitmap, i). So any token is read by a few lookups and no
block is decoded.

A file, little-endian:

    "DACF", version u16, levels u16, documents u64, ids u64
    a level: width u16, codes u64, then three blocks: packed codes, bitmap, directory (u32)
    documents: doc_id i64 each, null flags u8 each, first id u64 each

Every block is preceded by its length in bytes (u64). Files hold documents in
ascending doc_id order, as do files among themselves; ``start`` of a document is
its file's first position plus its own in the file.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import Codec, packed, vocabulary
from quarry.llm.common import cut, new_folder, shuffle_parts, tidy

MAGIC, VERSION, WIDTHS, BLOCK = b"DACF", 1, (8, 8, 8, 8), 512
#: Pieces of ASCII and Latin letters, in UTF-8.
LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
MANIFEST = "part int, no int, path string, documents long, ids long"


def pack(codes: np.ndarray, width: int, step: int = 1 << 17) -> bytes:
    """step codes at a time: a multiple of eight, so each part ends on a byte."""
    if width == 8:
        return codes.astype(np.uint8).tobytes()
    out = []
    for at in range(0, len(codes), step):
        part = codes[at : at + step].astype("<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Codes at any places. packed has eight bytes to spare."""
    if width == 8:
        return packed[at].astype(np.int64)
    bit = at * width
    byte = bit >> 3
    v = np.zeros(len(at), np.uint64)
    for k in range((width + 14) // 8):
        v |= packed[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (v >> (bit & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.int64)


def dump(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, widths=WIDTHS) -> bytes:
    """A file of these documents; ids are theirs one after the other."""
    out = io.BytesIO()
    levels, rest = [], ids.astype(np.uint32)
    for k, w in enumerate(widths):
        more = rest >> w if w < 32 else np.zeros_like(rest)
        go_on = more > 0 if k + 1 < len(widths) else np.zeros(len(rest), bool)
        levels.append((w, rest & np.uint32((1 << w) - 1), go_on))
        rest = more[go_on]
        if not len(rest):
            break
    out.write(struct.pack("<4sHHQQ", MAGIC, VERSION, len(levels), len(doc_ids), len(ids)))

    def block(b: bytes) -> None:
        out.write(struct.pack("<Q", len(b)))
        out.write(b)

    for w, codes, go_on in levels:
        out.write(struct.pack("<HQ", w, len(codes)))
        block(pack(codes, w))
        bits = np.packbits(go_on, bitorder="little")
        block(bits.tobytes())
        ones = np.add.reduceat(np.bitwise_count(bits).astype(np.uint32), np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.zeros(0, np.uint32)
        block((np.cumsum(ones) - ones).astype("<u4").tobytes())
    block(np.array([i or 0 for i in doc_ids], "<i8").tobytes())
    block(np.array([i is None for i in doc_ids], np.uint8).tobytes())
    block((np.cumsum(counts) - counts).astype("<u8").tobytes())
    return out.getvalue()


class Reader:
    """Random access to a file's tokens."""

    def __init__(self, raw: bytes):
        magic, version, levels, self.n_docs, self.n_ids = struct.unpack_from("<4sHHQQ", raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of token ids")
        at, self.levels = 24, []

        def block() -> np.ndarray:
            nonlocal at
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8 + n
            return np.frombuffer(raw, np.uint8, n, at - n)

        for _ in range(levels):
            width, _codes = struct.unpack_from("<HQ", raw, at)
            at += 10
            packed, bits, ones = block(), block(), block().view("<u4")
            self.levels.append((width, np.concatenate([packed, np.zeros(8, np.uint8)]), bits, ones))
        ids, none, self.first = block().view("<i8"), block(), block().view("<u8").astype(np.int64)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), none.tolist(), strict=True)]

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of the level's bitmap: the directory, whole bytes after it, then the bits of the last byte."""
        _, _, bits, ones = self.levels[level]
        byte, start = at >> 3, at // BLOCK
        n = ones[start].astype(np.int64)
        for k in range(BLOCK // 8):
            b = start * (BLOCK // 8) + k
            if not (inside := b < byte).any():
                break
            n += np.where(inside, np.bitwise_count(bits[np.minimum(b, len(bits) - 1)]), 0)
        low = (1 << (at & 7)) - 1
        return n + np.bitwise_count(bits[byte] & low.astype(np.uint8))

    def get(self, at) -> np.ndarray:
        """The ids at these places, in any order."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n_ids):
            raise IndexError("no such token")
        out, which, shift = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        for k, (width, packed, bits, _) in enumerate(self.levels):
            out[which] |= unpack(packed, width, at) << shift
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            at, which, shift = self.rank(k, at[on]) if on.any() else at[:0], which[on], shift + width
            if not len(at):
                break
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end: one rank a level, then the bitmap's own order."""
        if not 0 <= start <= end <= self.n_ids:
            raise IndexError("no such tokens")
        out, which, shift = np.zeros(end - start, np.int64), None, 0
        for k, (width, packed, bits, _) in enumerate(self.levels):
            if start == end:
                break
            codes = packed[start:end] if width == 8 else unpack(packed, width, np.arange(start, end))
            if which is None:
                out |= codes
            else:
                out[which] |= codes.astype(np.int64) << shift
            on = np.flatnonzero(np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + end - start])
            start = int(self.rank(k, np.array([start]))[0]) if len(on) else 0
            which, shift, end = on if which is None else which[on], shift + width, start + len(on)
        return out

    def documents(self, ids: int = 1 << 16) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, as (number of the first, their ids), read so many ids at a time or a longer document alone."""
        ends, at = np.append(self.first[1:], self.n_ids), 0
        while at < self.n_docs:
            start = int(self.first[at])
            to = max(at + 1, int(np.searchsorted(ends, start + ids, "right")))
            yield at, np.split(self.slice(start, int(ends[to - 1])), self.first[at + 1 : to] - start)
            at = to

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.first[k]), int(self.first[k + 1]) if k + 1 < self.n_docs else self.n_ids)


def _store(uri: str):
    """(file system, path) of a folder or file of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def _put(folder: str, name: str, raw: bytes) -> str:
    """Written beside its place and then moved there: a task that runs again, because its executor was lost, replaces the file by the
    same one, also on file systems that don't move onto a file."""
    from pyarrow import fs

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(at := f"{root}/.{name}.{uuid.uuid4().hex}") as f:
        f.write(raw)
    if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{root}/{name}")
    store.move(at, f"{root}/{name}")
    return f"{folder}/{name}"


def _get(path: str) -> bytes:
    store, at = _store(path)
    with store.open_input_stream(at) as f:
        return f.read()


class LibraryCodec(Codec):
    """A codec whose pieces are encoded by the tokenizers library."""

    def __init__(self, source: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__(source, remembered)
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()

    def encode_pieces(self, pieces: list[bytes], together: int = 200) -> list[bytes]:
        """Most pieces are letters, with a blank before them or at a line's start. Those with a blank, one after the other, are a text
        that splits into just these pieces, and so are the others with line feeds between them; so one call encodes many. If the
        library should split them otherwise, they are encoded one by one."""
        found: dict[bytes, bytes] = {}
        words = [p for p in pieces if LETTERS.fullmatch(p)]
        for between, group in ((b"", [p for p in words if p[0] == 32]), (b"\n", [p for p in words if p[0] != 32])):
            for at in range(0, len(group), together):
                part = group[at : at + together]
                e = self.library.encode(between.join(part).decode(), add_special_tokens=False)
                raw = np.array(e.ids, "<u4").tobytes()
                edges = [0, *((np.flatnonzero(np.diff(np.array(e.word_ids))) + 1) * 4).tolist(), len(raw)]
                each = [raw[i:j] for i, j in zip(edges, edges[1:], strict=False)]
                if between:
                    each = each[::2] if len(each) == 2 * len(part) - 1 else []
                if len(each) == len(part):
                    found.update(zip(part, each, strict=True))
        return [found[p] if p in found else packed(self.library.encode(p.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids) for p in pieces]


_codecs: dict[str, Codec] = {}


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, most_ids: int = 1 << 20) -> DataFrame:
    """Encodes docs and writes their ids to files in folder, in ascending doc_id order. Returns the manifest: part, no, path,
    documents, ids, start (ids in the files before it), which is also in folder/manifest.

    Each text is encoded whole; null counts as empty, and ``end_id``, if given,
    ends each document. Null identifiers come first; rows with one identifier
    are ordered by their text's hash. An empty table gives an empty manifest. Texts are
    shuffled once, dealt over ``files`` ranges; a file ends at ``most_ids`` ids
    or with the document that passes them.
    """
    source = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if source.value not in _codecs:
            _codecs.clear()
            _codecs[source.value] = LibraryCodec(source.value)
        c = _codecs[source.value]
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        ids, raw, size, no = [], [], 0, 0

        def flush():
            counts = np.array([len(x) // 4 for x in raw], np.int64)
            at = _put(folder, f"{part:06d}-{no:06d}.dac", dump(ids, counts, np.frombuffer(b"".join(raw), "<u4")))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "no": pa.array([no], pa.int32()), "path": [at], "documents": [len(ids)], "ids": [int(counts.sum())]})

        part = 0
        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                for i, x in zip(some.column(0).to_pylist(), c.encode_all([t or "" for t in some.column(1).to_pylist()], 1 << 21), strict=True):
                    ids.append(i)
                    raw.append(x + end)
                    size += len(raw[-1]) // 4
                    if size >= most_ids:
                        yield flush()
                        ids, raw, size, no = [], [], 0, no + 1
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(files or shuffle_parts(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    written = cut(dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(tidy(run), MANIFEST))
    # files are added up within their range, and then the ranges, of which there are as many as partitions
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = written.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", before(Window.orderBy("part")).alias("__start"))
    manifest = written.withColumn("start", before(Window.partitionBy("part").orderBy("no"))).join(ranges, "part").withColumn("start", F.col("start") + F.col("__start")).drop("__start")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_documents(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """From the files: doc_id, start, n_tokens, and ids (array<long>), or with digest ids_crc32 instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = Reader(_get(path))
                for at, docs in r.documents():
                    to = at + len(docs)
                    last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in docs], pa.int64()) if digest else pa.array(docs, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.doc_ids[at:to], pa.int64()), pa.array(r.first[at:to] + start), pa.array([len(x) for x in docs], pa.int64()), last],
                        ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                    )

    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")
    n = shuffle_parts(manifest.sparkSession)
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(tidy(run), schema)


def stored(docs: DataFrame, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs' ids to a new folder beside the checkpoints and reads them back."""
    return read_documents(write_tokens(docs, new_folder(docs.sparkSession, "tokens"), path, end_id, id_col, text_col), digest=True)
