import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe
from quarry.llm.token_store import LibraryCodec

PATH = P.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "a", "The", "<|endoftext|>", "<|endof", "'s", "'S", "é", "ß", "7", "٣", "\x1c", "\x85", "​", "漢字", "한글", "😀", "\U00010400", "՘", "꟎", "!", "\t", "\x00"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, encoding="utf-8").read(), remembered=50)


def test_as_the_library(lib, codec):
    rng = random.Random(1)
    for k in range(3000):
        t = "".join(rng.choice(BITS) if rng.random() < 0.6 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(30)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        cut = ids[rng.randrange(3) :: rng.choice([1, 2])]
        assert codec.decode(cut) == lib.decode(cut, skip_special_tokens=False)


LATIN = [" ", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "a", "The", "é", "ß", "7", "00", "!", "_", "%%%", "s", "\r\n"]


def test_split_of_many_texts(lib):
    rng = random.Random(2)
    texts = ["".join(rng.choices(LATIN, k=rng.randrange(12))) for _ in range(20_000)] + ["", " ", "\n\n", "'", "'s", "x's", " 's", "!'s", "''s", "'ll", "'l"]
    s = bpe.Split(texts)
    got, at = [], 0
    for end in s.texts.tolist():
        got.append([s.pieces[k].decode() for k in s.which[at:end]])
        at = end
    pre = lib.pre_tokenizer
    assert got == [[t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)] for t in texts]


def test_long_texts_are_cut_where_pieces_begin(lib, codec):
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choices([*LATIN, "<|endoftext|>", "漢", "a b"], k=60))
        assert codec.encode_all([t, "x y", t], room=9)[0] == bpe.packed(lib.encode(t, add_special_tokens=False).ids), t


def thue_morse(n: int) -> str:
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("kind", [bpe.Codec, LibraryCodec])
def test_pieces_of_one_hash_stay_apart(lib, kind):
    """Two words whose hashes agree modulo 2**64, alone and with other texts between and around them."""
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    s = bpe.Split([f"{one}\n{other}"])
    assert sorted(s.pieces) == sorted([one.encode(), b"\n", other.encode()])
    texts = [f"{one}\n{other}", "plain words", other, f"x {one} y {other} {one}", "", f" {other}", one, "plain words", f"{other}\n{other} z"]
    c = kind(open(PATH, encoding="utf-8").read())
    for group in ([texts[0]], texts, texts[::-1]):
        got = c.encode_all(group)
        assert got == [bpe.packed(lib.encode(t, add_special_tokens=False).ids) for t in group]
        assert [c.decode(np.frombuffer(x, "<u4").tolist()) for x in got] == group


def test_long_piece_without_breaks(lib, codec):
    for t in ("a" * 20_000, "ab" * 5000, "=" * 9000, " " * 7000 + "x", "é" * 3000):
        assert codec.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_classes_agree_where_said(lib, codec):
    pre = lib.pre_tokenizer
    for lo, hi in ((0, 0x530), (0x2000, 0x2070), (0x3000, 0xA000), (0xAC00, 0xD7A4)):
        for c in range(lo, hi, 1 if hi < 0x2071 else 37):
            t = f"a{chr(c)}1 {chr(c)}b{chr(c) * 2}!"
            assert not bpe.AGREED.search(t)
            assert [t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)] == codec.split(t)


def test_frames(spark, lib):
    rows = [(1, "The the é 😀"), (2, None), (3, ""), (None, "x"), (1, "The the é 😀"), (4, "<|endoftext|> y"), (5, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = bpe.encode(df, PATH)
    out = {(r.doc_id, r.n_tokens): r for r in got.collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        r = out[i, len(ids)]
        assert r.ids == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r.doc_id, r.text) for r in bpe.decode(got.where("doc_id is not null"), PATH).collect()) == sorted((i, t or "") for i, t in rows if i)
    assert bpe.digests(df.limit(0), PATH).collect() == []
    assert bpe.digests(df, PATH).count() == len(rows)
