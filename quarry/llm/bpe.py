"""Byte-pair encoding and decoding.

A text is split into pieces by the vocabulary's pattern. A piece's bytes become a
doubly linked list of symbols, and a priority queue holds (rank, position) for
each adjacent pair that the vocabulary can merge. The least is taken; if its
symbols have changed since, the entry is stale and skipped; else the right symbol
leaves the list and the two new neighbour pairs enter the queue. Decoding
concatenates the vocabulary's strings, as bytes.

The vocabulary is read once by the driver and sent to the executors; it is the
file of the tokenizers library, whose results these are.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tidy

#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters alone (ASCII and Latin letters) are split by ``Split``, many at a time. Beyond ASCII all are letters.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ]")
SPACE, LETTER, DIGIT, MARK, END = range(5)
CLASS = np.array([END if b == 0 else LETTER if b > 127 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else SPACE if chr(b).isspace() else MARK for b in range(256)], np.uint8)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SHORT, HIGH = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64), np.uint64(1 << 63)
#: Where the letters and digits of the regex and tokenizers libraries agree, whatever Unicode version either has. A text with
#: any other character is split by the tokenizers library.
AGREED = re.compile("[^\0-\u052f\u2000-\u206f\u3000-\u9fff\uac00-\ud7a3]")
#: Pieces of more characters aren't remembered.
LONG = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for a byte in a vocabulary's strings: itself if it prints, else one of the letters from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


#: A blank between two characters that are neither white space nor part of an added token's string.
CUT = re.compile(r"(?<=\w) (?=\w)")


class Split:
    """The pieces of several texts of no characters that OTHER finds, by whole-array operations on their bytes.

    A run of letters, digits or marks is a piece, with the blank before it. White space before it is a piece up to its last
    character, and that one another unless it is the blank; at a text's end it is one piece. An apostrophe that no blank or mark
    precedes takes s, t, m, d, re, ve or ll with it.
    """

    up = down = np.ones(1, np.uint64)

    def __init__(self, texts: list[str]):
        raw = "\0".join(texts).encode() + b"\0"  # no text has the character
        b = np.frombuffer(raw, np.uint8)
        kind = CLASS[b]
        first = np.ones(len(b), bool)
        first[1:] = kind[1:] != kind[:-1]
        first |= kind == END
        blank = b == 32
        start = first.copy()
        start[1:] &= ~(blank[:-1] & (kind[1:] != END))
        start[1:-1] |= (kind[1:-1] == SPACE) & (kind[2:] != SPACE) & (kind[2:] != END)  # the last of a run before something
        if len(b) > 1 and kind[0] == SPACE:
            start[0] = True
        at = np.flatnonzero((b[:-1] == 39) & start[:-1] & (kind[1:] == LETTER)) if 39 in b else ()
        for i in at:
            k = 1 if raw[i + 1] in b"stmd" else 2 if raw[i + 1 : i + 3] in (b"re", b"ve", b"ll") else 0
            if k:
                start[i + 1], start[i + 1 + k] = False, True
        edge = np.flatnonzero(start)
        self.raw, own = raw, kind[edge] != END
        self.start, self.end = edge[own], np.append(edge[1:], len(b))[own]
        #: how many pieces come before each text's end
        self.texts = np.cumsum(own)[~own]
        if len(self.up) < len(b) + 1:
            n = len(b) + 1 + (1 << 16)
            Split.up = np.concatenate([[np.uint64(1)], np.full(n, BASE)]).cumprod(dtype=np.uint64)
            Split.down = np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]).cumprod(dtype=np.uint64)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.up[: len(b)] * b, out=total[1:])
        length = self.end - self.start
        h = (total[self.end] - total[self.start]) * self.down[self.start]
        # a piece of up to seven bytes is these and its length; a longer one has a hash with the highest bit set
        words = np.ndarray((len(b),), "<u8", raw + bytes(8), strides=(1,))
        short = length <= 7
        key = np.where(short, words[self.start] & SHORT[np.minimum(length, 7)] | length.astype(np.uint64) << np.uint64(56), h ^ h >> np.uint64(29) | HIGH)
        self.which, different = pd.factorize(key)
        at = np.empty(len(different), np.int64)
        at[self.which[::-1]] = np.arange(len(key))[::-1]  # where each comes first
        #: the different pieces; which: of these, the one that stands in each place
        self.pieces = [raw[i:j] for i, j in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]
        self._confirm(b, length, np.flatnonzero(~short & (at[self.which] != np.arange(len(length)))), at)

    def _confirm(self, b: np.ndarray, length: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Compares the bytes of these pieces with those of the pieces that their hashes make them equal to; one that differs is a piece
        of its own."""
        if not len(rows):
            return
        like, n = at[self.which[rows]], length[rows]
        before = np.cumsum(n) - n
        place = np.arange(int(n.sum())) + np.repeat(self.start[rows] - before, n)
        same = b[place] == b[np.minimum(place + np.repeat(self.start[like] - self.start[rows], n), len(b) - 1)]
        own: dict[bytes, int] = {}
        for i in rows[~(np.logical_and.reduceat(same, before) & (n == length[like]))].tolist():
            self.which[i] = own.setdefault(self.raw[self.start[i] : self.end[i]], len(self.pieces) + len(own))
        self.pieces += own

    def put(self, ids: list[bytes]) -> list[bytes]:
        """The texts' ids from those of ``pieces``."""
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) for x in ids], np.int64) // 4
        n = size[self.which]
        after = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(size) - size)[self.which] - after + n, n) + np.arange(after[-1] if len(after) else 0)].tobytes()
        edges = [0, *(np.append(0, after)[self.texts] * 4).tolist()]
        return [out[i:j] for i, j in zip(edges, edges[1:], strict=False)]


def cut_up(text: str, room: int) -> Iterator[str]:
    at = 0
    while len(text) - at > room and (m := CUT.search(text, at + room)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Codec:
    def __init__(self, source: str, remembered: int = 250_000):
        """source: the text of a tokenizers file with a byte-level BPE model. Of pieces that were met, about ``remembered`` are kept
        with their ids in each of two generations."""
        spec = json.loads(source)
        model, self.source = spec["model"], source
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without prefix space and normalizer is asked for")
        letters, vocab = byte_letters(), model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added, self.n = added, max([*vocab.values(), *added.values()]) + 1
        self.strings = [b""] * self.n
        for s, i in (vocab | added).items():
            self.strings[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        self.of_byte = [vocab.get(c, 0) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank, self.parts = {}, []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] * self.n + vocab[b]] = r
            self.parts.append((vocab[a], vocab[b], vocab[a + b]))
        self.pattern = regex.compile(PATTERN)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.remembered, self.known, self.older = remembered, {}, {}
        self._split = None

    def merge(self, piece: bytes) -> list[int]:
        symbols = [self.of_byte[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return symbols
        rank, parts, most = self.rank, self.parts, self.n
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [r * n + i for i in range(n - 1) if (r := rank.get(symbols[i] * most + symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            left, right, both = parts[r]
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = both, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(both * most + symbols[k])) is not None:
                    heapq.heappush(queue, r * n + i)
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] * most + both)) is not None:
                heapq.heappush(queue, r * n + h)
        return [s for s in symbols if s >= 0]

    def split(self, text: str) -> list[str]:
        if not AGREED.search(text):
            return self.pattern.findall(text)
        if self._split is None:
            from tokenizers import Tokenizer

            self._split = Tokenizer.from_str(self.source).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._split.pre_tokenize_str(text)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        return [packed(self.merge(p)) for p in pieces]

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces."""
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in missing:
            if (x := older.get(pieces[i])) is None:
                new.append(i)
            else:
                found[i] = known[pieces[i]] = x
        for i, x in zip(new, self.encode_pieces([pieces[i] for i in new]), strict=True):
            found[i] = x
            if len(pieces[i]) <= LONG:
                known[pieces[i]] = x
        return found

    def encode_all(self, texts: list[str], room: int = 1 << 18) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers. The strings of added tokens in a text are those tokens.
        About ``room`` characters are worked on at a time; a longer text is cut before single blanks, where pieces begin anyway."""
        out, group, size = [], [], 0
        for t in texts:
            if len(t) > room:
                out += [*self._group(group), b"".join(x for part in cut_up(t, room) for x in self._group([part]))]
                group, size = [], 0
                continue
            if size + len(t) > room:
                out += self._group(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if not OTHER.search(t) and not (self.special and self.special.search(t))]
        if plain:
            s = Split([texts[i] for i in plain])
            for i, x in zip(plain, s.put(self.look_up(s.pieces)), strict=True):
                out[i] = x
        for i in sorted({*range(len(texts))} - {*plain}):
            parts, at = [], 0
            for m in self.special.finditer(texts[i]) if self.special else ():
                parts += [self._some(texts[i][at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
                at = m.end()
            out[i] = b"".join([*parts, self._some(texts[i][at:])])
        return out

    def _some(self, text: str) -> bytes:
        parts = [p.encode("utf-8", "surrogatepass") for p in self.split(text)]
        each = list(dict.fromkeys(parts))
        ids = dict(zip(each, self.look_up(each), strict=True))
        return b"".join(map(ids.__getitem__, parts))

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(source: str) -> Codec:
    """One for each Python worker and vocabulary."""
    return Codec(source)


def vocabulary(df: DataFrame, path: str):
    """The file's text, for the executors: a few MB, bound by the vocabulary and not by the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _digest(raw: bytes, c: Codec) -> tuple[int, str, str]:
    text = c.decode(np.frombuffer(raw, "<u4").tolist())
    return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) for each row of docs; see ``digests``."""
    return _run(docs, path, id_col, text_col, True)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, encoded and decoded again.

    A null text counts as the empty text, which has no ids. Rows repeated appear
    as often; null identifiers are returned as they are; other columns are
    ignored. A text of any length is encoded whole; pieces without a break may be
    as long as the text.
    """
    return _run(docs, path, id_col, text_col, False)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, ids: bool) -> DataFrame:
    source = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                raw = c.encode_all([t or "" for t in part.column(1).to_pylist()])
                n, a, d = zip(*(_digest(x, c) for x in raw), strict=True)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null or no ids give the empty text, and bytes that aren't UTF-8 the replacement character."""
    source = vocabulary(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col), F.col(ids_col)).mapInArrow(tidy(run), f"doc_id {rows.schema[id_col].dataType.simpleString()}, text string")
