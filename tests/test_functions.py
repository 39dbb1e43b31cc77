import pytest
from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.functions import text as T
from quarry.functions.stem import decompose, expand_queries, facets, hashed_vector, stem, synonym_table
from quarry.sources import files as S


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("getUserById", ["get", "user", "by", "id", "getuserbyid", "get_user", "user_by", "by_id"]), ("XMLParser", ["xml", "parser", "xmlparser", "xml_parser"]), ("OAuth", ["oauth"]),
        ("max_retry a", ["max", "retry", "maxretry", "max_retry", "a"]), ("std::io::Read", ["std", "io", "read"]), ("", []), (None, []), ("Привет мир 日本語", ["привет", "мир", "日本語"]), ("a a", ["a", "a"]),
    ],
)
def test_tokens(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.tokens("t").alias("x")).first().x == want


@pytest.mark.parametrize(
    ("query", "kind"),
    [("", "keyword"), ("parse", "keyword"), ("parse_file", "identifier"), ("HTTP", "identifier"), ("a.b", "identifier"), ("a..b", "keyword"), ("std::io", "identifier"), ("fooBar baz_x", "identifier"), ("fooBar baz", "mixed"), ("how is it", "semantic"), ("how is fooBar baz", "semantic"), ("call fooBar bazX now", "mixed"), ("12", "identifier")],
)
def test_query_type(spark, query, kind):
    assert one(spark, T.query_type("q"), q=query) == kind


@pytest.mark.parametrize(
    ("query", "route"),
    [("*.py", "file_pattern"), (r"foo\b", "regex"), ("a[0-9]", "regex"), ("getUser", "exact_symbol"), ("system architecture please", "architecture"), ("how do i add a route", "feature_planning"), ("who calls parse", "structural"), ("why does it fail", "deep"), ("most complex file", "analytical"), ("list all handlers there", "exhaustive"), ("lines containing todo marks", "regex"), ("token refresh handling", "semantic")],
)
def test_route(spark, query, route):
    assert one(spark, T.route("q"), q=query) == route


@pytest.mark.parametrize(
    ("path", "want"), [("src/a.rs", 1.0), ("src/tests/a.rs", 0.3), ("a_test.go", 0.3), ("test_a.py", 0.3), ("x.d.ts", 0.7), ("src/mod.rs", 0.5), ("examples/legacy/b.py", 0.09), ("tests.rs", 1.0), ("tests/test_a.py", 0.09)]
)
def test_path_penalty(spark, path, want):
    assert one(spark, T.path_penalty("p"), p=path) == pytest.approx(want)


def test_path_signals(spark):
    assert one(spark, T.penalty_applies("q"), q="attestation of keys") and not one(spark, T.penalty_applies("q"), q="the test, please")
    assert one(spark, T.stem_boost(F.lit("a/user_store.py"), F.array(F.lit("store")))) == 0.4
    assert one(spark, T.stem_boost(F.lit("a/userstore.py"), F.array(F.lit("user")))) == 0.2
    assert one(spark, T.file_role(F.lit("src/services/x.py"))) == "service"
    assert one(spark, T.file_role(F.lit("src/x.py"), F.array(F.lit("import pytest")))) == "test"
    assert [one(spark, f("p"), p="a/b/c.PY") for f in (T.top_dir, T.parent_dir, T.extension)] == ["a", "a/b", "py"]
    assert one(spark, T.strip_module("p"), p="a::b.c") == "b.c" and one(spark, T.strip_module("p"), p="a.b") == "b"
    assert one(spark, T.tags(F.array(F.lit(" B"), F.lit("a"), F.lit("b "), F.lit("")))) == "a,b"
    assert one(spark, T.merge_pattern("q", F.lit(r"foo\w+\(bar")), q="find foo") == "find foo bar"
    assert one(spark, T.first_sentences("q", 2), q="A. B! C?") == "A. B!"


def test_numbers(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, N.cosine(v(1, 0), v(0, 1))) == 0 and one(spark, N.cosine(v(0, 0), v(1, 1))) == 0 and one(spark, N.cosine(v(1), v(1, 2))) == 0
    assert one(spark, N.l2(v(0, 0), v(3, 4))) == 5 and one(spark, N.dot(v(1, 2), v(3, 4))) == 11
    assert one(spark, N.int8(v(1, -1, 0.5), N.int8_scale(v(1, -1, 0.5)))) == [127, -127, 64]
    assert one(spark, N.gelu(F.lit(0.0))) == 0 and one(spark, N.gelu(F.lit(3.0))) == pytest.approx(2.9964, abs=1e-3)
    assert one(spark, N.date_seconds("d"), d="2024-01-02") == 1704153600 and one(spark, N.date_seconds("d"), d="2024-1-2") is None and one(spark, N.date_seconds("d"), d="2024-13-40") is None
    assert one(spark, N.age(F.lit(7200))) == "2h ago"


def test_stems_and_synonyms(spark):
    for w, s in {"running": "run", "happiness": "happi", "relational": "relat", "skies": "sky", "generously": "generous", "hopping": "hop", "ties": "tie", "sensibility": "sensibl", "is": "is"}.items():
        assert stem(w) == s
    q = spark.createDataFrame([(1, "user logins"), (2, "nothing here"), (3, "rate limits"), (4, "")], "query_id long, query string")
    got = {r.query_id: r.query for r in expand_queries(q, synonym_table(spark)).collect()}
    assert got == {1: "user logins account authentication session", 2: "nothing here", 3: "rate limits throttle", 4: ""}


def test_questions():
    assert decompose("how does the parser use the cache?") == ["how does the parser use the cache?", "the parser", "the cache"]
    assert decompose("plain") == ["plain"]
    assert facets("list all routes, models and jobs") == ["routes", "models", "jobs", "list all routes, models and jobs"]


def test_hashed_vectors_agree_for_equal_tokens(spark):
    a = one(spark, hashed_vector(F.array(F.lit("x"), F.lit("y"))))
    assert a == one(spark, hashed_vector(F.array(F.lit("y"), F.lit("x")))) and sum(abs(x) for x in a) in (0, 2)


def test_files(spark, tmp_path):
    for name, body in {"a.py": b"x = 1\n", "b/c.rs": b"fn f() {}\n", "b/bin.dat": b"\0\1", ".hidden/x.py": b"1", "Cargo.lock": b"l", "out/gen.py": b"2", "keep/gen.py": b"3"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got = [r.path for r in S.scan(spark, str(tmp_path), ["# no", "out/"]).collect()]
    assert got == ["a.py", "b/c.rs", "keep/gen.py"]
    df = spark.createDataFrame([(p,) for p in ("a.py", "src/x.rs", "src/deep/y.rs", "Makefile", "n.unknown")], "path string")
    assert [r.t for r in df.select(S.file_type("path").alias("t")).collect()] == ["python", "rust", "rust", "makefile", "unknown"]
    assert [r.path for r in S.glob_files(df, "src/*.rs")[0].collect()] == ["src/x.rs"] and S.glob_files(df, "*.rs")[1] == 2
    assert [r.path for r in df.where(S.extension_filter("path", ["rs"], None)).collect()] == ["src/x.rs", "src/deep/y.rs"]
    assert one(spark, S.changed_files(F.lit("--- a/x\n+++ b/x.py\n@@\n+++ b/d/y.py\n"))) == ["d/y.py", "x.py"]
    chunks = spark.createDataFrame([("f.py", 10, "one Two\nthree")], "file_path string, start_line int, content string")
    assert [(r.line, r.text) for r in S.lines_matching(chunks, "two").collect()] == [(10, "one Two")] and S.lines_matching(chunks, "TWO").collect() == []


def _repository(at) -> list[str]:
    """A small repository of its own; the hashes of its commits in order."""
    import os
    import subprocess

    env = os.environ | {f"GIT_{who}_{what}": v for who in ("AUTHOR", "COMMITTER") for what, v in (("NAME", "A B"), ("EMAIL", "a@b.c"))}
    env |= {"GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull}
    run = lambda *a: subprocess.run(["git", "-C", str(at), *a], env=env, capture_output=True, text=True, check=True).stdout.strip()
    run("init", "-q", ".")
    out = []
    for k, (name, text) in enumerate([("a.py", "x = 1\n"), ("b.py", "y = 2\n"), ("a.py", "x = 1\nz = 3\n"), ("d/c.py", "q\n")]):
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_text(text)
        run("add", "-A")
        env["GIT_AUTHOR_DATE"] = env["GIT_COMMITTER_DATE"] = f"{1_700_000_000 + k} +0000"
        run("commit", "-q", "-m", f"change {k}\n\nmore")
        out.append(run("rev-parse", "HEAD"))
    return out


def test_git_source(spark, tmp_path):
    hashes = _repository(tmp_path)
    spark.dataSource.register(S.GitLog)
    read = lambda **o: [tuple(r) for r in spark.read.format("git_log").options(**o).load(str(tmp_path)).collect()]
    files = [["a.py"], ["b.py"], ["a.py"], ["d/c.py"]]
    want = [(h, "A B", 1_700_000_000 + k, f"change {k}\n\nmore", f) for k, (h, f) in enumerate(zip(hashes, files, strict=True))]
    assert read() == want and read(most="3") == want[1:] and read(range=f"{hashes[1]}..HEAD") == want[2:]
    with pytest.raises(Exception, match="unknown revision|bad revision"):
        read(range="nosuch")
    assert S.parse_blame("a" * 40 + " 1 7 2\nauthor x\n\tline\n" + "b" * 40 + " 3 8\n\tline2") == [(7, "a" * 40), (8, "b" * 40)]


def test_lines_and_summaries(spark):
    assert [one(spark, T.signature_line("q"), q=q) for q in ("  pub(crate) async fn x()", "def f():", "x = def", "export default class A {")] == [True, True, False, True]
    assert one(spark, T.matching_lines("q", F.array(F.lit("foo"), F.lit("bar")), 2), q="foo\nnothing\nbar Foo\nbar") == ["bar Foo", "foo"]
    s = "function f; calls a, b; called by c; complexity 2; Does it."
    c = one(spark, T.graph_context("q"), q=s)
    assert (c.calls, c.called_by) == (["a", "b"], ["c"]) and one(spark, T.clean_summary("q"), q=s) == "function f; Does it." and one(spark, T.clean_summary("q"), q="calls a") is None
    assert [one(spark, T.symbol_in("q"), q=q) for q in ("who calls `parse`?", "where is getUser and put_item?", "nothing here")] == ["parse", "put_item", None]
    assert one(spark, T.files_in("q"), q="src/a.py:3-4  0.1\n  b/c.rs:9\nsrc/a.py:7\nnot one") == ["src/a.py", "b/c.rs"]
    t = one(spark, T.truncated("q", 3), q="abcd")
    assert (t.text, t.cut) == ("abc", True)
