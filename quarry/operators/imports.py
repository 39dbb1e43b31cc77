"""Import statements of source files, and the files of the project that they mean."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

#: How a language writes an import: each match is one statement.
STATEMENT = {
    "rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(use\s[^;]+;)", "python": r"(?m)^(import\s+[^\n]+|from\s+\S+\s+import\s+(?:\([^)]*\)|[^\n]+))", "java": r"(?m)^\s*(import\s+[^;]+;)",
    "javascript": r"(?m)^\s*(import\s[^;]*?[\"'][^\"']+[\"'])", "c": r"(?m)^\s*(#\s*include\s*[<\"][^>\"]+[>\"])", "dart": r"(?m)^\s*((?:import|export)\s+[\"'][^\"']+[\"'])", "csharp": r"(?m)^\s*(using\s+[^;({]+;)",
}
SAME = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "cpp": "c", "c_sharp": "csharp"}
GO = re.compile(r"(?m)^import\s+(?:\w+\s+)?(\"[^\"]+\")|^import\s*\(([^)]*)\)")


def statements(source: str, language: str) -> list[str]:
    language = SAME.get(language, language)
    if language == "go":
        return [x for m in GO.finditer(source) for x in ([m[1]] if m[1] else re.findall(r'"[^"]+"', m[2]))]
    return [m.strip() for m in re.findall(STATEMENT[language], source)] if language in STATEMENT else []


def _quoted(statement: str) -> str | None:
    m = re.search(r"\"([^\"]*)\"|'([^']*)'", statement)
    return m and (m[1] if m[1] is not None else m[2])


def _under(base: str, *parts: str) -> str:
    return posixpath.normpath(posixpath.join(base, *parts)).removeprefix("./")


def _prefixes(base: str, parts: list[str], ending: str, package: str) -> list[str]:
    """A module path's file, or its package's, from the whole path to its first part: the last parts may be names in a module."""
    return [p for n in range(len(parts), 0, -1) for p in (_under(base, *parts[:n]) + ending, _under(base, *parts[:n], package))]


def _rust(statement: str, importer: str) -> list[str]:
    path = re.sub(r"^use\s+", "", statement.strip()).rstrip(";").strip()
    path = re.sub(r"(::)?\{[\s\S]*$", "", path).strip()
    head, _, rest = path.partition("::")
    folder = posixpath.dirname(importer)
    if head == "crate":
        parts = importer.split("/")
        if "src" not in parts[:-1]:
            return []
        base = "/".join(parts[: parts.index("src") + 1])
    elif head == "self":
        base = folder
    elif head == "super":
        base = folder
        while rest.startswith("super::"):
            if not base:
                return []
            base, rest = posixpath.dirname(base), rest.removeprefix("super::")
    else:
        return []
    return _prefixes(base, [p for p in rest.split("::") if p], ".rs", "mod.rs")


def _python(statement: str, importer: str) -> list[str]:
    words = statement.split()
    if len(words) < 2:
        return []
    module = words[1].rstrip(",")
    dots = len(module) - len(module.lstrip("."))
    base = posixpath.dirname(importer) if words[0] == "from" and dots else ""
    for _ in range(dots - 1):
        if not base:
            return []
        base = posixpath.dirname(base)
    return _prefixes(base, [p for p in module[dots:].split(".") if p], ".py", "__init__.py")


def _javascript(statement: str, importer: str) -> list[str]:
    name = _quoted(statement)
    if not name or not name.startswith(("./", "../")):
        return []
    base = _under(posixpath.dirname(importer), name)
    stem, ending = posixpath.splitext(base)
    source = [stem + e for e in (".ts", ".tsx")] if ending in (".js", ".jsx", ".mjs", ".cjs") else []
    return [base, *source, *(base + e for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")), *(f"{base}/index{e}" for e in (".ts", ".tsx", ".js", ".jsx"))]


def _go(statement: str, importer: str) -> list[str]:
    """Folders: the longest end of the path that is a folder with Go files."""
    parts = (_quoted(statement) or "").split("/")
    return ["/".join(parts[k:]) for k in range(len(parts))] if len(parts) > 1 else []


def _java(statement: str, importer: str) -> list[str]:
    name = re.sub(r"^import\s+(static\s+)?", "", statement.strip()).rstrip(";").strip()
    return [] if name.endswith(".*") else [prefix + name.replace(".", "/") + ".java" for prefix in ("", "src/main/java/", "src/")]


def _c(statement: str, importer: str) -> list[str]:
    name = _quoted(statement) if "<" not in statement else None
    return [_under(posixpath.dirname(importer), name), *(p + name for p in ("", "include/", "src/"))] if name else []


def _dart(statement: str, importer: str) -> list[str]:
    name = _quoted(statement) or ""
    if name.startswith("package:"):
        return ["lib/" + name.partition("/")[2]] if "/" in name else []
    return [] if not name or name.startswith("dart:") else [_under(posixpath.dirname(importer), name)]


def _csharp(statement: str, importer: str) -> list[str]:
    name = re.sub(r"^using\s+", "", statement.strip()).rstrip(";").strip()
    return [] if name.startswith(("static ", "System")) or "=" in name else [name.replace(".", "/") + ".cs"]


CANDIDATES = {"rust": _rust, "python": _python, "javascript": _javascript, "go": _go, "java": _java, "c": _c, "dart": _dart, "csharp": _csharp}


def candidates(statement: str, language: str, importer: str) -> list[str]:
    """The files that a statement may mean, likeliest first; none for what lies outside the project."""
    f = CANDIDATES.get(SAME.get(language, language))
    return list(dict.fromkeys(f(statement, importer))) if f else []


def extract(files: DataFrame) -> DataFrame:
    """(importer, language, statement, priority, imported): for each import of the files (path, content, language) the candidates."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content, language in f.itertuples(index=False):
                for s in dict.fromkeys(statements(content or "", language or "")):
                    rows += [(path, language, s, k, c) for k, c in enumerate(candidates(s, language, path))]
            yield pd.DataFrame(rows, columns=["importer", "language", "statement", "priority", "imported"])

    return files.select("path", F.col("content").cast("string"), "language").mapInPandas(run, "importer string, language string, statement string, priority int, imported string")


def resolve(files: DataFrame) -> DataFrame:
    """(importer, imported): each import's likeliest candidate that is there, a file or, in Go, a folder with Go files. Candidates are
    joined with the project's paths; nothing is collected."""
    folders = files.where("language = 'go'").select(T.parent_dir("path").alias("imported")).distinct()
    # a folder is there if it or one below it has Go files
    above = folders.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("imported", "/"))), lambda n: F.array_join(F.slice(F.split("imported", "/"), 1, n), "/"))).alias("imported")).distinct()
    c = extract(files)
    found = c.where("language <> 'go'").join(files.select(F.col("path").alias("imported")), "imported", "left_semi").unionByName(c.where("language = 'go'").join(above, "imported", "left_semi"))
    return found.groupBy("importer", "statement").agg(F.min_by("imported", "priority").alias("imported")).select("importer", "imported").distinct()
