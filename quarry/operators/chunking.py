"""From files to chunks: text windows, definitions, and what is known of them."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

WINDOW, OVERLAP = 2048, 512
CHUNK = "file_path string, start_line int, end_line int, content string, chunk_kind string, name string, ast_kind string, language string, window_index int"
META = (
    "params array<string>, calls array<string>, docstring string, complexity int, bases array<string>, imports array<string>, returns string, locals array<string>, mutations array<string>, "
    "type_refs array<struct<context:string,name:string>>"
)


def windows(content: str, size: int = WINDOW, overlap: int = OVERLAP, drop_contained: bool = False) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of windows of size bytes, each ending after the last newline of its last overlap bytes if
    there is one; the next begins overlap bytes before that end, or size - overlap bytes on. Blank windows are left out. A last
    window of over size - overlap bytes is followed by one that it contains, unless drop_contained."""
    raw = content.encode()
    if not content.strip():
        return []
    if len(raw) <= size:
        return [(1, content.rstrip("\n").count("\n") + 1, content)]

    def whole(k: int) -> int:
        while 0 < k < len(raw) and raw[k] & 0xC0 == 0x80:
            k -= 1
        return k

    out, at = [], 0
    while at < len(raw):
        end = whole(min(at + size, len(raw)))
        if end < len(raw):
            line = raw.rfind(b"\n", whole(max(at, end - overlap)), end)
            end = line + 1 if line >= 0 else end
        text = raw[at:end].decode("utf-8", "replace")
        if text.strip():
            first = raw.count(b"\n", 0, at) + 1
            out.append((first, first + text.rstrip("\n").count("\n"), text))
        if end >= len(raw) and (drop_contained or end - at <= size - overlap):
            break
        step = end - overlap if end > at + size - overlap else at + size - overlap
        nxt = whole(step)
        at = nxt if nxt > at else end
    return out


def _calls(node: ast.AST) -> list[str]:
    return list(dict.fromkeys(ast.unparse(n.func) for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute)))


def _named_types(node: ast.AST | None, context: str) -> list[dict]:
    """Type names of an annotation, in quotes or not, that aren't built in or a container's."""
    if node is None:
        return []
    found = []
    for n in ast.walk(node):
        name = ast.unparse(n) if isinstance(n, ast.Name | ast.Attribute) else n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else ""
        if is_user_type(name):
            found.append({"context": context, "name": name})
    return found


def is_user_type(name: str) -> bool:
    return name not in T.PRIMITIVES and name not in T.CONTAINERS and (name[:1].isupper() or "::" in name or "." in name)


def _once(rows: list) -> list:
    return [dict(x) for x in dict.fromkeys(tuple(r.items()) for r in rows)]


def _flow(node: ast.AST) -> tuple[list[str], list[str]]:
    """Local names in order of their first assignment, and attributes of an object that are assigned to."""
    names, changed = [], []
    for n in ast.walk(node):
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
            names.append((n.lineno, n.col_offset, n.id))
        if isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Store):
            changed.append((n.lineno, n.col_offset, ast.unparse(n)))
    return ([x for _, _, x in sorted(names)], [x for _, _, x in sorted(changed)])


def python_definitions(source: str) -> list[dict]:
    """Outermost functions and classes of Python source, and the methods of classes, with what is known of each."""
    tree, lines, out = ast.parse(source), source.split("\n"), []
    imports = [ast.unparse(n) for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom)]

    def add(node, prefix=""):
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if prefix else "function"
        branches = sum(isinstance(n, ast.If | ast.For | ast.While | ast.AsyncFor | ast.ExceptHandler | ast.IfExp | ast.BoolOp | ast.comprehension) for n in ast.walk(node))
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        names, changed = _flow(node)
        if kind == "class":
            types, returns, params = [t for n in node.body if isinstance(n, ast.AnnAssign) for t in _named_types(n.annotation, "field")], None, []
        else:
            args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
            types = [t for a in args for t in _named_types(a.annotation, "param")] + _named_types(node.returns, "return")
            returns, params = ast.unparse(node.returns) if node.returns else None, [a.arg for a in node.args.args]
        out.append({
            "start_line": first, "end_line": node.end_lineno, "content": "\n".join(lines[first - 1 : node.end_lineno]), "name": node.name, "ast_kind": kind,
            "params": params, "calls": _calls(node), "docstring": ast.get_docstring(node), "complexity": branches + 1,
            "bases": [ast.unparse(b) for b in node.bases] if kind == "class" else [], "imports": imports,
            "returns": returns, "locals": list(dict.fromkeys(names)), "mutations": list(dict.fromkeys(changed)), "type_refs": _once(types),
        })
        if kind == "class":
            for n in node.body:
                if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                    add(n, node.name)

    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            add(node)
    return out


#: Definitions of other languages by their first line.
DEFINITION = {
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait|type)\s+(\w+)", "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?(\w+)", "java": r"^\s*(?:public|private|protected|static|final|abstract|\s)*\b(class|interface|enum)\s+(\w+)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s*\*?\s*(\w+)", "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface|type|enum)\s*\*?\s*(\w+)",
    "ruby": r"^\s*(def|class|module)\s+([\w.?!]+)", "c": r"^[\w*\s]+?\b(struct|enum)\s+(\w+)\s*\{", "cpp": r"^\s*(class|struct|enum|namespace)\s+(\w+)",
}


NOT_CALLS = frozenset("if for while switch catch return match loop sizeof new else do try fn func function def class struct enum impl where and or not in assert throw await async super".split())
CALL = re.compile(r"\b([A-Za-z_][\w]*(?:(?:::|\.|->)[A-Za-z_]\w*)*)!?\s*\(")
BRANCH = re.compile(r"\b(?:if|for|while|loop|case|catch|match|elsif|rescue|when)\b|&&|\|\|")
TYPE_NAME = re.compile(r"\b[A-Z]\w*(?:(?:::|\.)[A-Z]\w*)*")
#: What a type is said to extend or implement, by language.
PARENTS = {
    "java": r"\b(?:extends|implements)\s+([\w.<>, ]+?)(?=\b(?:implements|extends)\b|\{)", "typescript": r"\b(?:extends|implements)\s+([\w.<>, ]+?)(?=\b(?:implements|extends)\b|\{)",
    "javascript": r"\bextends\s+([\w.]+)", "cpp": r"^\s*(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*([^{]+)", "ruby": r"^\s*class\s+\w+\s*<\s*([\w:]+)",
}


def block_end(lines: list[str], start: int) -> int:
    """The line that closes the braces which a definition opens, or, if a semicolon comes first, that line. Braces in strings and
    comments don't count."""
    depth, seen, quote, comment = 0, False, "", False
    for k in range(start, len(lines)):
        line, i = lines[k], 0
        while i < len(line):
            two, c = line[i : i + 2], line[i]
            if comment:
                comment = two != "*/"
                i += 1 if comment else 2
                continue
            if quote:
                i += 2 if c == "\\" else 1
                quote = "" if c == quote else quote
                continue
            if two == "//":
                break
            if two == "/*":
                comment = True
            elif c in "\"`" or c == "'" and re.match(r"'(\\.|[^\\'])'", line[i:]):
                quote = c
            elif c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
                if seen and depth <= 0:
                    return k
            elif c == ";" and not seen:
                return k
            i += 1
        if quote != "`":
            quote = ""
    return len(lines) - 1


def indented_end(lines: list[str], start: int) -> int:
    """For languages whose definitions are closed by "end" at the same depth."""
    depth = re.match(r"\s*", lines[start])[0]
    return next((k for k in range(start + 1, len(lines)) if re.match(re.escape(depth) + r"end\b", lines[k])), len(lines) - 1)


def other_definitions(source: str, language: str) -> list[dict]:
    """Definitions of other languages: found by their first line, as long as their braces, with what patterns tell of them."""
    lines, out = source.split("\n"), []
    for i, line in enumerate(lines):
        if not (m := re.match(DEFINITION[language], line)):
            continue
        end = indented_end(lines, i) if language == "ruby" else block_end(lines, i)
        text = "\n".join(lines[i : end + 1])
        head, _, body = text.partition("{") if language != "ruby" else text.partition("\n")
        doc = []
        for above in reversed(lines[:i]):
            t = above.strip()
            if not t.startswith(("///", "//", "*", "/*", "#", "@")) or t.startswith("#["):
                break
            doc.insert(0, re.sub(r"^(///?!?|/\*\*?|\*/?|#)\s?", "", t))
        parents = [re.sub(r"^(public|private|protected|virtual)\s+", "", p.strip()).split("<")[0] for g in re.findall(PARENTS.get(language, r"(?!)"), head + "{") for p in g.split(",")]
        params, _, after = head.partition("(")[2].partition(")")
        returns = re.search(r"->\s*([^{;]+)" if language == "rust" else r":\s*([^{;=]+)" if language == "typescript" else r"^\s*([^{;]+)" if language == "go" else r"(?!)", after)
        types = [{"context": c, "name": n} for c, part in (("param", params), ("return", returns[1] if returns else ""), ("field", body if m[1] in ("struct", "class", "interface") else "")) for n in TYPE_NAME.findall(part) if is_user_type(n)]
        out.append({
            "start_line": i + 1, "end_line": end + 1, "content": text, "name": m[2], "ast_kind": m[1], "calls": list(dict.fromkeys(c for c in CALL.findall(body) if c not in NOT_CALLS)),
            "complexity": len(BRANCH.findall(body)) + 1, "bases": [p for p in parents if p], "docstring": "\n".join(doc).strip() or None, "returns": returns[1].strip() if returns else None,
            "params": [p for x in params.split(",") if (p := re.sub(r"[:=].*$", "", x.strip()).split(" ")[0 if language in ("rust", "go", "typescript", "javascript", "ruby") else -1])],
            "locals": list(dict.fromkeys(re.findall(r"\b(?:let|var|const|val)\s+(?:mut\s+)?(\w+)|\b(\w+)\s*:=", body) and [a or b for a, b in re.findall(r"\b(?:let|var|const|val)\s+(?:mut\s+)?(\w+)|\b(\w+)\s*:=", body)])),
            "mutations": list(dict.fromkeys(re.findall(r"((?:self|this)\.\w+|\w+->\w+)\s*[+\-*/|&]?=(?!=)", body))), "type_refs": _once(types),
        })
    return out


def implementations(source: str) -> list[tuple[str, str]]:
    """(type, trait) of Rust's impl ... for ... blocks."""
    return [(t.split("<")[0], tr.split("<")[0]) for tr, t in re.findall(r"(?m)^\s*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+([\w:<>, ]+?)\s+for\s+([\w:]+(?:<[^{]*?>)?)", source)]


def chunk_file(path: str, source: str, language: str) -> list[dict]:
    empty = ("params", "calls", "bases", "imports", "locals", "mutations", "type_refs")
    blank = dict.fromkeys(("name", "ast_kind", "docstring", "window_index", "returns")) | {k: [] for k in empty} | {"complexity": 1}
    base, found = {"file_path": path, "language": language}, []
    if language == "python":
        try:
            found = python_definitions(source)
        except (SyntaxError, ValueError, RecursionError):
            found = []
    elif language in DEFINITION:
        found = other_definitions(source, language)
    out = []
    for d in found:
        parts = windows(d["content"]) if len(d["content"].encode()) > 4 * WINDOW else [(1, d["end_line"] - d["start_line"] + 1, d["content"])]
        out += [blank | d | base | {"start_line": d["start_line"] + a - 1, "end_line": d["start_line"] + b - 1, "content": t, "chunk_kind": "ast"} for a, b, t in parts]
    covered = {n for d in found for n in range(d["start_line"], d["end_line"] + 1)}
    gap: list[tuple[int, str]] = []
    for n, x in [*enumerate(source.split("\n"), 1), (0, "")]:
        if n and n not in covered:
            gap.append((n, x))
            continue
        if gap:
            out += [blank | base | {"start_line": gap[0][0] + a - 1, "end_line": gap[0][0] + b - 1, "content": t, "chunk_kind": "text", "window_index": i} for i, (a, b, t) in enumerate(windows("\n".join(x for _, x in gap)))]
        gap = []
    return sorted(out, key=lambda c: (c["start_line"], c["end_line"]))


def chunk_files(files: DataFrame) -> DataFrame:
    """files (path, content binary or string, language) to chunks with what is known of each. A file at a time, whole."""
    columns = [c.split()[0] for c in f"{CHUNK}, {META}".split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content, language in f.itertuples(index=False):
                text = bytes(content).decode("utf-8", "replace") if isinstance(content, bytes | bytearray) else content or ""
                rows += chunk_file(path, text, language)
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content", "language").mapInPandas(run, f"{CHUNK}, {META}")


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id from 1, dense, in order of path and line: files are numbered apart and then offset, so no window spans all chunks."""
    from pyspark.sql import Window

    own = Window.partitionBy("file_path").orderBy("start_line", "end_line", "content")
    n = chunks.groupBy("file_path").agg(F.count("*").alias("n"))
    # one row a file
    n = n.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return chunks.withColumn("__k", F.row_number().over(own)).join(n, "file_path").withColumn("chunk_id", F.col("__before") + F.col("__k")).drop("__k", "__before")


def _calls_and_definitions(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_path, name, src) of calls by the last part of the called name, and (file_path, name, dst) of definitions, each row once."""
    c = chunks.select("file_path", F.col("chunk_id").alias("src"), F.explode("calls").alias("call")).select("file_path", F.substring_index("call", ".", -1).alias("name"), "src")
    d = chunks.select("file_path", "name", F.col("chunk_id").alias("dst"))
    return (x.where("file_path is not null and name is not null").distinct() for x in (c, d))


def _blocks(rows: DataFrame, id_: str, most: int) -> DataFrame:
    """(file_path, name, id_): the ids of a file's name as arrays of about ``most``."""
    n = rows.groupBy("file_path", "name").agg(F.count("*").alias("__n"))
    x = rows.join(n, ["file_path", "name"]).withColumn("__slice", F.pmod(F.xxhash64(id_), F.ceil(F.col("__n") / most)))
    return x.groupBy("file_path", "name", "__slice").agg(F.collect_list(id_).alias(id_)).drop("__slice")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of two arrays each pair of an element of the first and a different one of the second."""
    for b in batches:
        for i in range(b.num_rows):
            src, dst = (b.column(k)[i].values for k in (0, 1))
            for at in range(0, len(src), step := max(1, 100_000 // len(dst))):
                part = src.slice(at, step)
                x = pa.RecordBatch.from_arrays([part.take(pa.array(np.repeat(np.arange(len(part)), len(dst)))), dst.take(pa.array(np.tile(np.arange(len(dst)), len(part))))], ["src", "dst"])
                yield x.filter(pc.not_equal(x.column(0), x.column(1)))


def call_edges(chunks: DataFrame, block: int = 1000) -> DataFrame:
    """(src, dst): calls within a file by the last part of the called name, no chunk to itself.

    A name that many chunks call and many define has as many pairs as the product of both. So blocks of ids meet instead of ids, are
    dealt out evenly, and become pairs where they lie: pairs are not sorted, gathered or moved. Only a chunk_id that stands for
    several names or files can give a pair twice; its pairs alone are made distinct.
    """
    c, d = _calls_and_definitions(chunks)
    kind = dict(c.dtypes) | dict(d.dtypes)
    conf, sc = chunks.sparkSession.conf, chunks.sparkSession.sparkContext
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), 4 * sc.defaultParallelism)

    def pairs(d: DataFrame) -> DataFrame:
        met = _blocks(c.where("src is not null"), "src", block).join(_blocks(d.where("dst is not null"), "dst", block), ["file_path", "name"])
        return met.select("src", "dst").repartition(tasks).mapInArrow(_products, f"src {kind['src']}, dst {kind['dst']}")

    several = d.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    if several.isEmpty():
        return pairs(d)
    return pairs(d.join(several, "dst", "left_anti")).unionByName(pairs(d.join(several, "dst", "left_semi")).distinct())


def called_by(chunks: DataFrame) -> DataFrame:
    """(chunk_id, called_by): the names of the chunks that call it by call_edges, sorted. Of the callers of a file's name that have
    one name, the least and the largest id tell whether one of them is another chunk than the called; so no pairs are made."""
    c, d = _calls_and_definitions(chunks)
    names = chunks.select(F.col("chunk_id").alias("src"), F.col("name").alias("caller")).distinct()
    callers = c.join(names, "src").groupBy("file_path", "name", "caller").agg(F.min("src").alias("low"), F.max("src").alias("high"))
    x = d.join(callers, ["file_path", "name"]).where("low <> dst or high <> dst")
    return x.groupBy(F.col("dst").alias("chunk_id")).agg(F.array_sort(F.collect_set("caller")).alias("called_by"))


#: Semantic roles in order, each with what the name's words have somewhere in them, what the name itself has, and how the
#: name begins.
ROLES = (
    ("sanitizer", ("sanitiz", "redact", "mask pii", "strip pii", "clean pii", "scrub"), ("sanitize", "redact", "scrub"), ()),
    ("error_handler", ("error handler", "catch error", "recover", "fallback", "retry"), (), ("on_error", "handle_error")),
    ("middleware", ("intercept", "middlewar", "guard request", "before request", "after request"), ("interceptor", "middleware"), ()),
    ("constructor", (), ("new", "create", "init", "build", "make", "setup"), ("create_", "build_", "new_", "from_")),
    ("destructor", ("close", "dispos", "shutdown", "shut down", "destroy", "cleanup", "clean up", "teardown", "tear down"), (), ("drop_",)),
    ("validator", ("validat", "verif", "is valid"), (), ("check_", "ensure_", "assert_")),
    ("transformer", ("convert", "transform", "serializ", "deserializ", "encod", "decod"), (), ("to_", "into_", "parse_", "format_")),
    ("fetcher", ("fetch", "retriev", "lookup", "look up"), (), ("get_", "load_", "read_", "find_")),
    ("persister", ("persist", "upsert"), ("save", "store", "write", "insert", "delete", "persist", "upsert"), ("save_", "store_", "write_", "insert_", "delete_", "put_")),
    ("handler", ("handl", "dispatch"), (), ("process_", "on_")),
    ("orchestrator", ("orchestrat", "coordinat", "pipeline", "workflow"), (), ()),
)


def semantic_role(name, calls) -> Column:
    e, n = T.words_of(name), F.lower(T._c(name))
    out = F
    for role, words, parts, starts in ROLES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(e, F.lit(w))
        for p in parts:
            hit = hit | F.contains(n, F.lit(p))
        for p in starts:
            hit = hit | F.startswith(n, F.lit(p))
        if role == "destructor":
            hit = hit | (n == "drop")
        if role == "orchestrator":
            hit = hit | (n.rlike("^(run|execute)(_|$)") & (F.size(T._c(calls)) >= 3))
        out = out.when(hit, role)
    return out


def annotation(docstring, kind, name, returns, role, calls, called_by, most: int = 8) -> Column:
    """What a definition is for, in words, a line each: its first sentence, purpose, role, calls that say something, callers."""
    first = T.first_sentences(docstring, 1)
    first = F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(T._c(docstring)), F.lit("")))
    told = F.when(F.length(F.trim(T._c(returns))).between(1, 80), F.concat(F.lit(" \u2014 returns "), F.trim(T._c(returns)))).otherwise("")
    some = F.transform(F.slice(F.filter(T._c(calls), lambda c: ~T.trivial_call(c)), 1, most), T.words_of)
    by = F.transform(F.slice(T._c(called_by), 1, most), T.words_of)
    return F.concat_ws(
        "\n", F.when(F.length(first) <= 200, first), F.when(T._c(name).isNotNull(), F.concat(F.lit("purpose: "), T._c(kind), F.lit(" "), T.words_of(name), told)),
        F.when(T._c(role).isNotNull(), F.concat(F.lit("role: "), T._c(role))), F.when(F.size(some) > 0, F.concat(F.lit("calls: "), F.array_join(some, ", "))),
        F.when(F.size(by) > 0, F.concat(F.lit("called by: "), F.array_join(by, ", "))),
    )


def summary(chunks: DataFrame) -> Column:
    """What is known of a chunk, as parts joined by "; "."""
    part = lambda label, column: F.when(F.size(column) > 0, F.concat(F.lit(label), F.array_join(column, ", ")))
    return F.concat_ws("; ", F.when(F.col("name").isNotNull(), F.concat_ws(" ", "ast_kind", "name")), part("params ", "params"), part("calls ", "calls"), F.when(F.col("complexity") > 1, F.concat(F.lit("complexity "), "complexity")), F.element_at(F.split("docstring", "\n"), 1))


def index_text(chunks: DataFrame) -> Column:
    """What BM25 indexes of a chunk: expanded identifiers, summary, content."""
    return F.concat_ws("\n", F.nullif(T.expansion("content"), F.lit("")), F.nullif(summary(chunks), F.lit("")), "content")


def mine_patterns(chunks: DataFrame, catalog: list[tuple[str, str, list[str], list[str]]]) -> DataFrame:
    """(chunk_id, pattern): catalog entries (language, name, required, forbidden) all of whose required strings a chunk of the
    language has, and none of the forbidden. The catalog is the caller's, a few dozen entries, tested in one pass without a join."""
    hits = []
    for language, name, required, forbidden in catalog:
        ok = F.col("language") == language
        for r in required:
            ok = ok & F.contains("content", F.lit(r))
        for f in forbidden:
            ok = ok & ~F.contains("content", F.lit(f))
        hits.append(F.when(ok, F.lit(name)))
    return chunks.select("chunk_id", F.explode(F.array_compact(F.array(*hits))).alias("pattern"))


#: Headings of sections in docstrings and their tags, for Python and Rust.
SECTIONS = {
    "Args:": "param", "Arguments:": "param", "Parameters:": "param", "Returns:": "returns", "Return:": "returns", "Raises:": "throws", "Except:": "throws", "Exceptions:": "throws", "Yields:": "yields",
    "Yield:": "yields", "Note:": "note", "Notes:": "note", "Example:": "example", "Examples:": "example", "# Arguments": "param", "# Params": "param", "# Parameters": "param", "# Returns": "returns",
    "# Return": "returns", "# Errors": "errors", "# Panics": "panics", "# Safety": "safety", "# Examples": "example", "# Example": "example",
}


def tags_of(docstring: str, language: str = "") -> list[dict]:
    """Tags (tag, name, text) of a docstring: lines with @tag, and sections under headings, whose entries are parameters with a name or else
    one text."""
    out, section, depth = [], None, 0
    for line in docstring.split("\n"):
        plain = re.sub(r"^\s*(\*/?|///?!?|# (?=@))?\s?", "", line)
        if m := re.match(r"@(\w+)\s*(.*)", plain):
            tag, rest, name = m[1].lower(), m[2].strip(), None
            if tag in ("param", "arg", "argument"):
                tag, (name, rest) = "param", re.match(r"(?:\{[^}]*\}\s*)?(\S*)\s*(?:- )?(.*)", rest).groups()
            out.append({"tag": tag, "name": name, "text": rest})
            section = None
            continue
        heading = SECTIONS.get(line.strip())
        if heading and (line.strip()[0] == "#") == (language == "rust") and language in ("python", "rust"):
            section, depth, first = heading, None, True
            continue
        if section is None or not line.strip():
            continue
        inside = line[:1] in " \t" if language == "python" else not line.startswith("#")
        if not inside:
            section = None
            continue
        own = len(line) - len(line.lstrip())
        depth = own if depth is None else depth
        text = line.strip()
        if section == "param" and own <= depth:
            name, _, rest = re.sub(r"^[*-]\s+", "", text).partition(":") if language == "python" else re.sub(r"^[*-]\s+", "", text).partition(" - ")
            out.append({"tag": "param", "name": name.split("(")[0].strip().strip("`"), "text": rest.strip()})
        elif first and section != "param":
            out.append({"tag": section, "name": None, "text": text})
        elif out:
            out[-1]["text"] = f"{out[-1]['text']} {text}".strip()
        first = False
    return out


def doc_tags(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tag, name, text) of chunks (chunk_id, docstring, language)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, t["tag"], t["name"], t["text"]) for i, d, g in f.itertuples(index=False) for t in tags_of(d, g or "")]
            yield pd.DataFrame(rows, columns=["chunk_id", "tag", "name", "text"])

    return chunks.where("docstring is not null").select("chunk_id", "docstring", "language").mapInPandas(run, "chunk_id long, tag string, name string, text string")


def python_import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, imported): statements (importer, module, level) resolved to files: module.py, else the package's __init__.py."""
    base = F.when(F.col("level") > 0, T.parent_dir("importer")).otherwise("")
    stem = F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(F.replace("module", F.lit("."), F.lit("/")), F.lit("")))
    c = imports.select("importer", F.posexplode(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))).alias("priority", "imported"))
    found = c.join(files.select(F.col("path").alias("imported")), "imported", "left_semi")
    return found.groupBy("importer", F.regexp_replace("imported", r"(/__init__)?\.py$", "").alias("m")).agg(F.min_by("imported", "priority").alias("imported")).drop("m")
