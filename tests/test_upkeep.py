"""Registry, branches, history, sources bound to files, imports, chunk metadata, and the index that needs no text encoder."""

import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, graph, imports, metrics, registry, store, vectors
from quarry.plans import search as P
from quarry.sources import files as S
from tests.test_functions import _repository


def test_scopes(spark):
    assert [registry.scope(x) for x in ("", "repo", "all", " a, b ,", " , ", "All")] == [("repo", ()), ("repo", ()), ("all", ()), ("named", ("a", "b")), ("repo", ()), ("named", ("All",))]
    r = spark.createDataFrame([("a", "/w/a", ["main"], 1), ("b", "/w/a/b", [], 2), ("c", "/w/c", None, 3)], registry.PROJECTS)
    names = lambda df: sorted(x.project for x in df.collect())
    found, missing = registry.in_scope(r, "c, nosuch,/w/a", "/")
    assert names(found) == ["a", "c"] and missing == ["nosuch"]
    assert names(registry.in_scope(r, "repo", "/w/a/b/src")[0]) == ["b"] and names(registry.in_scope(r, "all", "/")[0]) == ["a", "b", "c"] and names(registry.in_scope(r, "", "/w/ab")[0]) == []
    new = spark.createDataFrame([("a", "/w/a", ["dev"], 9), ("a2", "/w/a", ["old"], 4), ("d", "/w/d", ["x"], 5)], registry.PROJECTS)
    got = {x.path: (x.project, x.branches, x.updated) for x in registry.upsert(r, new).collect()}
    assert got == {"/w/a": ("a", ["dev", "main"], 9), "/w/a/b": ("b", [], 2), "/w/c": ("c", None, 3), "/w/d": ("d", ["x"], 5)}
    assert names(registry.retain(r, spark.createDataFrame([("/w/c",)], "path string"))) == ["c"]


def test_what_a_build_must_do(spark):
    assert registry.dense_build("f", "f", True, True) == registry.DenseBuild(False, True)
    assert registry.dense_build("f", "g", True, True) == registry.DenseBuild(True, False) == registry.dense_build(None, "g", False, True)
    same, other = (spark.createDataFrame([("a", c)], "path string, change string") for c in ("same", "update"))
    ok = registry.dense_build("f", "f", True, True)
    assert [registry.nothing_to_build(*x) for x in ((same, ok, True), (other, ok, True), (same, ok, False), (same, registry.dense_build("f", "g", True, True), True))] == [True, False, False, False]
    h = registry.history_range
    assert h(None, None, None) is None and h("x", "x", 0) is None and h("x", "y", 0) is None and h(None, "y", None) == ("HEAD", 500)
    assert h("x", "y", 3) == ("x..HEAD", None) and h("x", "y", 501) == ("HEAD", 500) and h("gone", "y", None, 7) == ("HEAD", 7)


def test_history_follows(spark, tmp_path):
    hashes = _repository(tmp_path)
    none = spark.createDataFrame([], "hash string")
    rows, mark = registry.follow_history(spark, str(tmp_path), none, None)
    assert sorted(r["hash"] for r in rows.collect()) == sorted(hashes) and mark == hashes[-1]
    some = spark.createDataFrame([(hashes[0],), (hashes[1],)], "hash string")
    rows, _ = registry.follow_history(spark, str(tmp_path), some, hashes[1])
    assert {r["hash"] for r in rows.collect()} == set(hashes[2:])
    rows, _ = registry.follow_history(spark, str(tmp_path), none, hashes[0], bound=2)  # three behind: anew from the latest two
    assert {r["hash"] for r in rows.collect()} == set(hashes[2:])
    rows, mark = registry.follow_history(spark, str(tmp_path), none, hashes[-1])
    assert rows.collect() == [] and mark == hashes[-1]
    d = S.commit_detail(str(tmp_path), hashes[2], budget=40)
    assert (d["hash"], d["author"], d["ts"], d["message"], d["stat"]) == (hashes[2], "A B", 1_700_000_002, "change 2\n\nmore", [("a.py", 1, 0)]) and len(d["patch"]) == 40 and d["truncated"]
    assert S.upstream_status(str(tmp_path)) is None
    S.git(str(tmp_path), "branch", "other", hashes[1])
    S.git(str(tmp_path), "branch", "-q", "--set-upstream-to=other")
    assert S.upstream_status(str(tmp_path)) == ("other", 2, 0) and S.other_branches(str(tmp_path)) == [("other", 1_700_000_001)]


def test_branches(spark, tmp_path):
    b = registry.Branches(spark, str(tmp_path), ("chunks",), cap=2)
    live = lambda: sorted(r.x for r in spark.read.parquet(f"{tmp_path}/live/chunks").collect())
    put = lambda *x: spark.createDataFrame([(i,) for i in x], "x long").write.mode("overwrite").parquet(f"{tmp_path}/live/chunks")
    put(1)
    assert b.switch("main", "h1") == "first" and b.switch("main", "h1") == "unchanged"
    assert b.switch("dev", "h2") == "kept"  # main's rows are a snapshot now; the live ones are to be brought up to date
    put(1, 2)
    assert b.switch("main", "h1") == "restored" and live() == [1]
    assert b.switch("dev", "h2") == "kept"
    assert b.mirror("dev", "h2") == [] and {s[0] for s in b.snapshots()} == {b.key("main"), b.key("dev")}
    put(3)
    assert b.switch("feature/x", "h3") == "kept" and b.mirror("feature/x", "h3") == [b.key("main")] and len(b.snapshots()) == 2
    assert b.switch("main", "h1") == "kept"


def test_signals(spark, tmp_path):
    nodes, edges = spark.createDataFrame([(i,) for i in range(4)], "chunk_id long"), spark.createDataFrame([(0, 1), (2, 1)], "src long, dst long")
    kept = registry.keep_centrality(str(tmp_path), nodes, edges)
    assert {r.chunk_id: round(r.centrality, 9) for r in kept.collect()} == {r.chunk_id: round(r.centrality, 9) for r in graph.pagerank(nodes, edges).collect()}
    registry.keep_signals(str(tmp_path), notes=nodes)
    registry.keep_signals(str(tmp_path), notes=nodes.limit(1))
    assert registry.signal(spark, str(tmp_path), "notes").count() == 1


def test_import_resolution(spark):
    files = [
        ("src/main.rs", "use crate::config::Config;\nuse crate::search::{A, B};\nuse std::io;\nuse serde::X;\n", "rust"), ("src/config.rs", "use super::search::hybrid;\n", "rust"), ("src/search/mod.rs", "", "rust"), ("src/search/hybrid.rs", "use self::deep::X;\nuse super::super::config;\n", "rust"), ("src/search/deep.rs", "", "rust"),
        ("pkg/a.py", "import os\nfrom .b import x\nfrom ..top import y\nfrom pkg.sub import z\nfrom . import q\n", "python"), ("pkg/b.py", "", "python"), ("top.py", "", "python"), ("pkg/sub/__init__.py", "", "python"),
        ("web/app.ts", "import { a } from './util';\nimport x from '../lib/y.js';\nimport fs from 'fs';\nimport './style';\n", "typescript"), ("web/util/index.ts", "", "typescript"), ("lib/y.ts", "", "typescript"),
        ("cmd/main.go", 'import "fmt"\nimport (\n\t"example.com/m/internal/db"\n\tx "example.com/m/none"\n)\n', "go"), ("internal/db/db.go", "package db\n", "go"),
        ("src/main/java/a/B.java", "import a.C;\nimport static a.D;\nimport java.util.*;\n", "java"), ("src/main/java/a/C.java", "", "java"), ("src/main/java/a/D.java", "", "java"),
        ("c/x.c", '#include "y.h"\n#include <stdio.h>\n#include "z/z.h"\n', "c"), ("c/y.h", "", "c"), ("include/z/z.h", "", "c"),
        ("lib/p.dart", "import 'dart:io';\nimport 'package:app/q.dart';\nexport '../bin/r.dart';\n", "dart"), ("lib/q.dart", "", "dart"), ("bin/r.dart", "", "dart"),
        ("App.cs", "using System.Text;\nusing App.Core;\nusing static App.X;\nusing Y = App.Core;\n", "csharp"), ("App/Core.cs", "", "csharp"), ("n.txt", None, None),
    ]
    got = {(r.importer, r.imported) for r in imports.resolve(spark.createDataFrame(files, "path string, content string, language string")).collect()}
    assert got == {
        ("src/main.rs", "src/config.rs"), ("src/main.rs", "src/search/mod.rs"), ("src/config.rs", "src/search/hybrid.rs"), ("src/search/hybrid.rs", "src/search/deep.rs"), ("src/search/hybrid.rs", "src/config.rs"),
        ("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "top.py"), ("pkg/a.py", "pkg/sub/__init__.py"), ("web/app.ts", "web/util/index.ts"), ("web/app.ts", "lib/y.ts"), ("cmd/main.go", "internal/db"),
        ("src/main/java/a/B.java", "src/main/java/a/C.java"), ("src/main/java/a/B.java", "src/main/java/a/D.java"), ("c/x.c", "c/y.h"), ("c/x.c", "include/z/z.h"), ("lib/p.dart", "lib/q.dart"), ("lib/p.dart", "bin/r.dart"), ("App.cs", "App/Core.cs"),
    }


RUST = '''/// Opens it.
pub fn open(path: &str, mode: Mode) -> Result<Store> {
    let mut s = Store::new(path); // a brace } in a comment
    if path.is_empty() || mode.bad() { return Err("}"); }
    self.state = 1;
    s
}

pub struct Store { inner: Inner, n: u32 }
type Alias = u32;
impl Reader for Store {
    fn read(&self) -> Vec<u8> { vec![] }
}
'''


def test_metadata_of_other_languages():
    d = {x["name"]: x for x in chunking.other_definitions(RUST, "rust")}
    o = d["open"]
    assert (o["start_line"], o["end_line"], o["complexity"], o["docstring"], o["returns"]) == (2, 7, 3, "Opens it.", "Result<Store>")
    assert o["locals"] == ["s"] and o["mutations"] == ["self.state"] and "Store::new" in o["calls"] and o["params"] == ["path", "mode"]
    assert [(t["context"], t["name"]) for t in o["type_refs"]] == [("param", "Mode"), ("return", "Store")]
    assert (d["Store"]["start_line"], d["Store"]["end_line"]) == (9, 9) and d["Alias"]["end_line"] == 10 and d["read"]["end_line"] == 12
    assert chunking.implementations(RUST) == [("Store", "Reader")]
    java = chunking.other_definitions("public class A<T> extends B<T> implements C, D {\n  void f() { g(); }\n}\nclass E { }\n", "java")
    assert [(x["name"], x["start_line"], x["end_line"], x["bases"], x["calls"]) for x in java] == [("A", 1, 3, ["B", "C", "D"], ["f", "g"]), ("E", 4, 4, [], [])]
    ruby = chunking.other_definitions("class A < Base\n  def f(x)\n    if x\n      y\n    end\n  end\nend\n", "ruby")
    assert [(x["name"], x["start_line"], x["end_line"], x["bases"]) for x in ruby] == [("A", 1, 7, ["Base"]), ("f", 2, 6, [])]
    py = chunking.python_definitions("class A:\n    x: Thing = 1\n    def f(self, a: 'Item', b: list[Other]) -> pkg.Res:\n        y = a\n        self.z = y\n        return y\n")
    assert [(t["context"], t["name"]) for t in py[0]["type_refs"]] == [("field", "Thing")] and py[1]["returns"] == "pkg.Res" and py[1]["locals"] == ["y"] and py[1]["mutations"] == ["self.z"]
    assert [(t["context"], t["name"]) for t in py[1]["type_refs"]] == [("param", "Item"), ("param", "Other"), ("return", "pkg.Res")]


def test_doc_tags(spark):
    google = "Does.\n\nArgs:\n    a (int): first\n        more\n    b: second\nReturns:\n    the sum\n    of both\nRaises:\n    ValueError: no\n"
    rust = "Does.\n# Arguments\n* `x` - the x\n# Errors\nWhen it fails.\n"
    js = " * Does.\n * @param {string} name - who\n * @returns it\n * @deprecated"
    rows = [(1, google, "python"), (2, rust, "rust"), (3, js, "javascript"), (4, None, "python")]
    got = [(r.chunk_id, r.tag, r.name, r.text) for r in chunking.doc_tags(spark.createDataFrame(rows, "chunk_id long, docstring string, language string")).orderBy("chunk_id").collect()]
    assert got == [
        (1, "param", "a", "first more"), (1, "param", "b", "second"), (1, "returns", None, "the sum of both"), (1, "throws", None, "ValueError: no"), (2, "param", "x", "the x"), (2, "errors", None, "When it fails."),
        (3, "param", "name", "who"), (3, "returns", None, "it"), (3, "deprecated", None, ""),
    ]


def pdf(*streams: tuple[bytes, bool]) -> bytes:
    out = b"%PDF-1.4\n"
    for k, (raw, packed) in enumerate(streams):
        body = zlib.compress(raw) if packed else raw
        out += b"%d 0 obj << /Length %d %s>>\nstream\n%s\nendstream\nendobj\n" % (k, len(body), b"/Filter /FlateDecode " if packed else b"", body)
    return out


def test_pdf_and_numpy_files(spark, tmp_path):
    shown = rb"BT /F1 12 Tf (Hello \(PDF\)) Tj 0 -14 Td [(wor) -20 (ld\041)] TJ T* <4142> Tj ET"
    assert S.pdf_text(pdf((shown, True), (b"q 1 0 0 1 0 0 cm", False))) == "Hello (PDF)\nworld!\nAB"
    files = [("a.pdf", pdf((shown, False))), ("b.pdf", b"%PDF-1.4 broken"), ("c.txt", b"BT (x) Tj ET"), ("d.pdf", None), ("e.pdf", pdf((b"BT (x) Tj ET", True))[:-60])]
    got = {r.path: r.content for r in S.pdf_texts(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["a.pdf"] == "Hello (PDF)\nworld!\nAB" and set(got) <= {"a.pdf", "e.pdf"}
    c = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "cid int, vector array<double>")
    S.save_centroids(c, str(tmp_path / "c.npy"))
    assert np.load(tmp_path / "c.npy").tolist() == [[1, 2], [3, 4]] and np.load(tmp_path / "c.npy").dtype == np.float32
    assert sorted((r.cid, r.vector) for r in S.load_centroids(spark, str(tmp_path / "c.npy")).collect()) == [(0, [1, 2]), (1, [3, 4])]
    with pytest.raises(ValueError, match="more than"):
        S.save_centroids(c, str(tmp_path / "d.npy"), most=1)


def test_index_without_a_text_encoder(spark, tmp_path):
    rng = np.random.default_rng(5)
    table = {i: rng.standard_normal(6) for i in range(12)}
    t = spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], "token_id long, vector array<double>")
    ids = {1: [0, 3, 99, 5, 7], 2: [98], 3: [97, 2]}
    tokens = spark.createDataFrame([(c, p, x) for c, xs in ids.items() for p, x in enumerate(xs)], "chunk_id long, pos int, token_id long")
    w = [0.1, 0.2, 1.0, 0.3, 0.05]
    unit = lambda x: x / np.linalg.norm(x)
    want = {}
    for c, xs in ids.items():
        for p in range(len(xs)):
            near = [table.get(xs[q]) if 0 <= q < len(xs) else None for q in range(p - 2, p + 3)]
            have = [v for k, v in enumerate(near) if v is not None and k != 2]
            if near[2] is not None:
                want[c, p] = unit(sum(k * v for k, v in zip(w, near, strict=True) if v is not None))
            elif have:
                want[c, p] = unit(sum(have) / len(have))
    got = {(r.chunk_id, r.pos): r.vector for r in vectors.encode(tokens, t, w).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k].tolist()) for k in want)
    assert (2, 0) not in got and (3, 0) in got
    same = {(r.chunk_id, r.pos): r.vector for r in vectors.encode(tokens, t, w, np.zeros((9, 6)), np.eye(6)).collect()}
    assert all(same[k] == pytest.approx(got[k]) for k in got)
    cents = rng.standard_normal((5, 6))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cents)], "cid int, vector array<double>")
    vec, lists = vectors.build_codes(tokens, t, c, w, str(tmp_path / "codes"), m=5)
    assert {(r.chunk_id, r.pos): r.cid for r in vec.collect()} == {k: int((cents @ v).argmax()) for k, v in want.items()} and lists.where("token_id is not null").count() == 60


def test_mixer_learns():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 9, 4))
    y = x[:, 4] + 0.8 * np.tanh(x[:, 3]) @ rng.standard_normal((4, 4))
    taps, projection, losses = store.train_mixer(x, y, steps=300)
    assert losses[-1] < 0.5 * losses[0] and taps.shape == (9, 4) and projection.shape == (4, 4)
    again = store.train_mixer(x, y, steps=300)
    assert np.array_equal(taps, again[0])


def test_bootstrap_as_resampling(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(0.3, 1.0, 400)
    df = spark.createDataFrame([(i, 0.0, float(x)) for i, x in enumerate(d)], "item long, a double, b double")
    r = metrics.bootstrap(df, 4000).first()
    means = d[rng.integers(0, 400, (4000, 400))].mean(axis=1)
    assert r["mean"] == pytest.approx(d.mean()) and [r.low, r.high] == pytest.approx(np.percentile(means, [2.5, 97.5]).tolist(), abs=0.02)
    assert tuple(r) == pytest.approx(tuple(metrics.bootstrap(df.repartition(7), 4000).first()))
    w = metrics._poisson(np.arange(2000, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15), np.arange(50, dtype=np.uint64)[None, :])
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.05)


def test_formats_and_cache(spark):
    chunks = spark.createDataFrame([(1, "a.py", 1, 3, "def f():\n    pass\n", "f"), (2, "b.py", 5, 6, "def g(): f()", "g")], "chunk_id long, file_path string, start_line int, end_line int, content string, name string")
    walk = spark.createDataFrame([("f", "caller", 2), ("f", "callee", 1)], "symbol string, relation string, chunk_id long")
    assert P.formatted_graph(walk, chunks).first().text == "callee (1)\n  f  a.py:1\ncaller (1)\n  g  b.py:5"
    ranked = chunks.select(F.lit(7).alias("query_id"), F.col("chunk_id").cast("int").alias("rank"), "file_path", "start_line", "end_line", "content")
    assert P.formatted_blocks(ranked, full=1).first().text == "### a.py:1-3\ndef f():\n    pass\n\n### b.py:5-6\ndef g(): f()\n"
    assert P.formatted_blocks(ranked, budget=20).first().text.startswith("### a.py") and "b.py" not in P.formatted_blocks(ranked, budget=20).first().text
    index = P.Index(chunks)
    spec = P.SearchSpec(graph=False, adaptive=False)
    cache = spark.createDataFrame([], "cached_id int, vector array<double>, stamp string, results array<struct<rank:int,chunk_id:long,score:double>>")
    q = spark.createDataFrame([(1, "f", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    first, cache = P.cached_search(index, q, cache, "s1", spec)
    rows = sorted(map(tuple, first.collect()))
    assert rows and cache.count() == 1
    near = spark.createDataFrame([(9, "other words", [0.9, 0.1])], q.schema)
    again, kept = P.cached_search(index, near, cache, "s1", spec)
    assert [r[1:] for r in sorted(map(tuple, again.collect()))] == [r[1:] for r in rows] and kept.count() == 1
    assert P.cached_search(index, near, cache, "s2", spec)[0].count() == 0  # another stamp: nothing is known, and no text has these words
