import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import token_store as S
from quarry.llm.common import new_folder

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 5000)), max_size=700), max_size=6))
def test_round_trip(docs):
    flat = np.array([x for d in docs for x in d], np.uint64)
    r = S.Reader(S.dump(list(range(len(docs))), np.array([len(d) for d in docs], np.int64), flat))
    assert [r.document(k).tolist() for k in range(len(docs))] == docs
    at = np.random.default_rng(0).integers(0, len(flat), 100) if len(flat) else np.zeros(0, np.int64)
    assert r.get(at).tolist() == flat[at].tolist()
    for k in range(0, len(flat), 97):
        assert r.slice(k, min(len(flat), k + 33)).tolist() == flat[k : k + 33].tolist()


def test_files(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-50, 500), " ".join(rng.choice(["the", "été", "zz9", "<|endoftext|>"]) for _ in range(rng.randrange(40)))) for _ in range(300)]
    rows += [(7, None), (7, ""), (None, "none"), rows[0], (600, "long text " * 20_000)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, start string").repartition(6)
    lib = Tokenizer.from_file(PATH)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    manifest = S.write_tokens(df, new_folder(spark, "t"), PATH, files=5, most_ids=900)
    assert manifest.count() > 5
    got = sorted(S.read_documents(manifest).collect(), key=lambda r: (r.start, r.n_tokens))
    at = 0
    ids = [lib.encode(t or "", add_special_tokens=False).ids + [2] for _, t in want]
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [i for i, _ in want]
    # within an identifier the order is that of a hash
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(((i, x) for (i, _), x in zip(want, ids, strict=True)), key=str)
    digest = {(r.start, r.ids_crc32) for r in S.read_documents(manifest, digest=True).collect()}
    assert digest == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_empty(spark):
    assert S.stored(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_any_widths():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 2**32, 700), rng.integers(0, 5000, 900)]).astype(np.uint64)
    for widths in ((12, 4, 8, 8), (16, 16), (5, 9, 18), (32,)):
        r = S.Reader(S.dump([1, 2], np.array([700, 900]), ids, widths))
        assert r.get(np.arange(len(ids))[::-1]).tolist() == ids[::-1].tolist()
        assert [x.tolist() for _, d in r.documents(50) for x in d] == [ids[:700].tolist(), ids[700:].tolist()]


def test_pieces_encoded_together():
    from quarry.llm.token_store import LibraryCodec

    rng = random.Random(4)
    lib, c = Tokenizer.from_file(PATH), LibraryCodec(open(PATH, encoding="utf-8").read())
    pieces = {rng.choice(["", " "]) + "".join(rng.choices("abcXYZéßÿœɏ×÷ªµ", k=rng.randint(1, 9))) for _ in range(3000)} | {" ", "  ", "\n", "12", " %%", "'s", "s", "漢"}
    pieces = [p.encode() for p in sorted(pieces)]
    want = [np.array(lib.encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
    assert c.encode_pieces(pieces) == want


def test_a_file_written_again_replaces_the_first(tmp_path):
    at = f"file:{tmp_path}/x"
    assert S._put(at, "a.dac", b"one") == S._put(at, "a.dac", b"two") and S._get(f"{at}/a.dac") == b"two"
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["a.dac"]
