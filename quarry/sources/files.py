"""Source trees: files, their types and hashes, the git log."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions import text as T

#: The type of a file by its extension, and whether definitions are looked for; files known by their name; what isn't code;
#: lock files.
TYPES = {
    "py": ("python", True), "rs": ("rust", True), "js": ("javascript", True), "jsx": ("javascript", True), "mjs": ("javascript", True), "ts": ("typescript", True), "tsx": ("typescript", True),
    "go": ("go", True), "java": ("java", True), "kt": ("kotlin", True), "scala": ("scala", True), "c": ("c", True), "h": ("c", True), "cc": ("cpp", True), "cpp": ("cpp", True), "hpp": ("cpp", True),
    "cs": ("csharp", True), "rb": ("ruby", True), "php": ("php", True), "swift": ("swift", True), "dart": ("dart", True), "sh": ("shell", False), "sql": ("sql", False), "md": ("markdown", False),
    "txt": ("text", False), "json": ("json", False), "yaml": ("yaml", False), "yml": ("yaml", False), "toml": ("toml", False), "html": ("html", False), "css": ("css", False), "pdf": ("pdf", False),
}
SPECIAL = {"dockerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake", "gemfile": "ruby", "rakefile": "ruby"}
NOT_CODE = ("md", "txt", "json", "yaml", "yml", "toml", "html", "css", "pdf", "lock", "csv", "xml", "svg")
LOCKS = ("cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "go.sum", "composer.lock", "gemfile.lock", "uv.lock")


def glob_regex(glob: str) -> str:
    """* within a folder, ** across folders, ? one character; without a slash the name alone is matched."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return ("^" if "/" in glob else "(^|/)") + out + "$"


def ignored(path, patterns: list[str]) -> Column:
    """By the lines of an ignore file, the last that fits counting; ! takes back, a trailing slash means a folder and all in it."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        rooted, folder = line.startswith("/"), line.endswith("/")
        body = glob_regex("**/" + line.strip("/") if not rooted and "/" in line.strip("/") else line.strip("/")).rstrip("$")
        if rooted:
            body = "^" + body.removeprefix("(^|/)").removeprefix("^")
        out = F.when(path.rlike(body + ("/" if folder else "(/|$)")), F.lit(not keep)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, most_bytes: int = 1 << 20, most_files: int = 50_000) -> DataFrame:
    """(path, content binary, size, mtime) of a tree's files in order of path: none that are hidden, ignored, locks, binary or too
    large, and at most ``most_files``, the first by path, which is the operator's limit."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", "^file:/+", "/")
    prefix = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    f = f.where(F.col("length") <= most_bytes).select(F.regexp_replace(base, "^" + re.escape(prefix).replace("\\-", "-"), "").alias("path"), "content", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    f = f.where(~F.col("path").rlike(r"(^|/)\.")).where(~F.lower(T.file_name("path")).isin(*LOCKS))
    f = f.where((T.extension("path") == "pdf") | ~binary("content"))
    if ignore:
        f = f.where(~ignored(F.col("path"), ignore))
    return f.orderBy("path").limit(most_files)


def binary(content) -> Column:
    """A NUL among the first 8 KiB."""
    return F.contains(F.hex(F.substring(content, 1, 8192)), F.lit("00")) & F.hex(F.substring(content, 1, 8192)).rlike("^(..)*00")


def file_type(path) -> Column:
    types = F.create_map(*[x for e, (t, _) in TYPES.items() for x in (F.lit(e), F.lit(t))])
    special = F.create_map(*[x for n, t in SPECIAL.items() for x in (F.lit(n), F.lit(t))])
    return F.coalesce(F.try_element_at(special, F.lower(T.file_name(path))), F.try_element_at(types, T.extension(path)), F.lit("unknown"))


def has_definitions(path) -> Column:
    return T.extension(path).isin([e for e, (_, yes) in TYPES.items() if yes])


def extension_filter(path, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    e, out = T.extension(path), F.lit(True)
    if include:
        out = out & e.isin([x.lower().lstrip(".") for x in include])
    if exclude:
        out = out & ~e.isin([x.lower().lstrip(".") for x in exclude])
    return out


def glob_files(files: DataFrame, pattern: str, shown: int = 50) -> tuple[DataFrame, int]:
    """The first ``shown`` of the files whose path fits, in order, and how many there are."""
    found = files.where(F.col("path").rlike(glob_regex(pattern)))
    return found.select("path").orderBy("path").limit(shown), found.count()


def lines_matching(chunks: DataFrame, query: str, most: int = 100) -> DataFrame:
    """(file_path, line, text): one word is looked for as it stands, in either case unless it has a capital; several words, any of them."""
    words = query.split()
    pattern = ("" if any(c.isupper() for c in query) else "(?i)") + re.escape(words[0]) if len(words) == 1 else "(?i)" + "|".join(re.escape(w) for w in words)
    x = chunks.select("file_path", "start_line", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return x.where(F.col("text").rlike(pattern)).select("file_path", (F.col("start_line") + F.col("i")).alias("line"), "text").orderBy("file_path", "line").limit(most)


def changed_files(patch) -> Column:
    """Files that a unified diff names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/(.+)$"), 1)))


def git(repository: str, *args: str, check: bool = True) -> str:
    """What git says; an error with its own message, or nothing if check is off."""
    import subprocess

    done = subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True)
    if done.returncode and check:
        raise RuntimeError(f"git {args[0]} of {repository} failed: {done.stderr.strip()}")
    return "" if done.returncode else done.stdout


class GitLog(DataSource):
    """Commits of a repository: spark.read.format("git_log").load(path). One partition, as git's log is one stream."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "hash string, author string, ts long, message string, files array<string>"

    def reader(self, schema):
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range, self.most = options.get("path"), options.get("range", "HEAD"), options.get("most")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        out = git(self.path, "log", "--reverse", "--name-only", "--relative", "--format=%x01%H%x00%an%x00%ct%x00%B%x02", *(["-n", self.most] if self.most else []), self.range)
        for block in out.split("\x01")[1:]:
            head, _, files = block.partition("\x02")
            h, author, ts, message = head.split("\0", 3)
            yield h, author, int(ts), message.strip(), [f for f in files.split("\n") if f]


def parse_blame(porcelain: str) -> list[tuple[int, str]]:
    """(line, commit) of git blame --porcelain."""
    return [(int(m[2]), m[1]) for m in re.finditer(r"(?m)^([0-9a-f]{40}) \d+ (\d+)(?: \d+)?$", porcelain)]


def commit_detail(repository: str, sha: str, budget: int = 8000) -> dict:
    """A commit's hash, author, ts, message, files with lines added and removed, and its patch up to so many characters."""
    h, author, ts, message = git(repository, "show", "-s", "--format=%H%x00%an%x00%ct%x00%B", sha).split("\0", 3)
    stat = [line.split("\t") for line in git(repository, "show", "--numstat", "--format=", sha).splitlines() if line]
    patch = git(repository, "show", "--patch", "--format=", sha)
    number = lambda x: int(x) if x.isdigit() else None  # noqa: E731  binary files have none
    return {"hash": h, "author": author, "ts": int(ts), "message": message.strip(), "stat": [(f, number(a), number(d)) for a, d, f in stat], "patch": patch[:budget], "truncated": len(patch) > budget}


def upstream_status(repository: str) -> tuple[str, int, int] | None:
    """(upstream, ahead, behind) of the branch that is checked out, None if it follows none."""
    name = git(repository, "rev-parse", "--abbrev-ref", "--symbolic-full-name", "@{u}", check=False).strip()
    if not name:
        return None
    behind, ahead = git(repository, "rev-list", "--left-right", "--count", "@{u}...HEAD").split()
    return name, int(ahead), int(behind)


def other_branches(repository: str, most: int = 10) -> list[tuple[str, int]]:
    """(branch, time of its last commit) of the branches that aren't checked out, newest first."""
    here = git(repository, "branch", "--show-current").strip()
    rows = [line.rsplit(" ", 1) for line in git(repository, "for-each-ref", "--sort=-committerdate", "--format=%(refname:short) %(committerdate:unix)", "refs/heads").splitlines()]
    return [(name, int(ts)) for name, ts in rows if name != here][:most]


def save_centroids(centroids: DataFrame, path: str, most: int = 65_536) -> None:
    """(cid, vector), in order of cid, as a NumPy file; more than ``most`` are an error."""
    import numpy as np
    from pyarrow import fs

    rows = centroids.select("cid", "vector").orderBy("cid").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centroids")
    store, at = fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else "file://" + path)
    with store.open_output_stream(at) as f:
        np.lib.format.write_array(f, np.array([r.vector for r in rows], np.float32).reshape(len(rows), -1))


def load_centroids(spark: SparkSession, path: str) -> DataFrame:
    import io

    import numpy as np
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else "file://" + path)
    with store.open_input_stream(at) as f:
        m = np.load(io.BytesIO(f.read()), allow_pickle=False)
    return spark.createDataFrame([(i, v) for i, v in enumerate(m.astype(float).tolist())], "cid int, vector array<double>")


def pdf_text(content: bytes) -> str:
    """The text that a PDF's content streams show, as far as its fonts use plain single-byte codes; streams that can't be read give none."""
    import zlib

    out = []
    for m in re.finditer(rb"<<((?:(?!>>\s*stream).)*)>>\s*stream\r?\n", content, re.DOTALL):
        end = content.find(b"endstream", m.end())
        raw = content[m.end() : end if end >= 0 else len(content)]
        if b"FlateDecode" in m[1]:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", raw, re.DOTALL):
            line = []
            for shown in re.finditer(rb"(\[(?:[^\]\\(]|\\.|\((?:[^\\()]|\\.)*\))*\]|\((?:[^\\()]|\\.)*\)|<[0-9A-Fa-f\s]*>)\s*(TJ|Tj|'|\")|(?<!\w)(T\*|Td|TD)(?!\w)", block, re.DOTALL):
                if shown[3] or shown[2] in (b"'", b'"'):
                    line.append("\n")
                if shown[1]:
                    line += [_pdf_string(x) for x in re.findall(rb"\((?:[^\\()]|\\.)*\)|<[0-9A-Fa-f\s]*>", shown[1], re.DOTALL)]
            out.append(re.sub(r"\n+", "\n", "".join(line)).strip("\n"))
    return "\n".join(x for x in out if x.strip())


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else plain.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL).decode("latin-1")


def pdf_texts(files: DataFrame) -> DataFrame:
    """(path, content string) of PDF files (path, content binary); a file that has no text, or can't be read, gives no row."""

    def run(frames):
        for f in frames:
            rows = [(p, t) for p, c in zip(f["path"], f["content"], strict=True) if c is not None and bytes(c[:5]) == b"%PDF-" and (t := pdf_text(bytes(c))).strip()]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return files.where(T.extension("path") == "pdf").select("path", "content").mapInPandas(run, "path string, content string")
