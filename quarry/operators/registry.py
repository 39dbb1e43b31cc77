"""Projects and their indexes: the registry, scopes, branches, what a rebuild must do, and signals that are kept for later searches.

All state is in small tables that the driver may read whole: a row a project, branch or signal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROJECTS = "project string, path string, branches array<string>, updated long"
BRANCHES = "branch_key string, branch string, head_commit string, synced long"


def upsert(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """registry with the entries (PROJECTS) in place of those of the same path, of entries of one path the latest; branches of both stay."""
    w = Window.partitionBy("path").orderBy(F.desc("updated"), "project")
    new = entries.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    old = registry.select("path", F.col("branches").alias("was"))
    none = F.array().cast("array<string>")
    merged = new.join(old, "path", "left").withColumn("branches", F.array_sort(F.array_distinct(F.concat(F.coalesce("branches", none), F.coalesce("was", none))))).select(*registry.columns)
    return registry.join(new.select("path"), "path", "left_anti").select(*registry.columns).unionByName(merged)


def retain(registry: DataFrame, present: DataFrame) -> DataFrame:
    """The projects whose path is still there (path)."""
    return registry.join(present.select("path"), "path", "left_semi").select(*registry.columns)


def scope(text: str) -> tuple[str, tuple[str, ...]]:
    """(repo, ()), (all, ()) or (named, names) of a scope as it is written: names are parted by commas. A name that no project has is
    still a name, so a search can say that it was skipped."""
    if text in ("", "repo"):
        return "repo", ()
    if text == "all":
        return "all", ()
    names = tuple(n for part in text.split(",") if (n := part.strip()))
    return ("named", names) if names else ("repo", ())


def in_scope(registry: DataFrame, text: str, here: str) -> tuple[DataFrame, list[str]]:
    """The projects that a scope means, seen from the folder ``here``, and the names that none has."""
    kind, names = scope(text)
    if kind == "all":
        return registry, []
    if kind == "repo":
        # of nested projects the innermost
        own = registry.where((F.lit(here) == F.col("path")) | F.startswith(F.lit(here), F.concat(F.col("path"), F.lit("/"))))
        return own.orderBy(F.desc(F.length("path"))).limit(1), []
    found = registry.where(F.col("project").isin(*names) | F.col("path").isin(*names))
    known = {x for r in found.select("project", "path").collect() for x in r}
    return found, [n for n in names if n not in known]


@dataclass(frozen=True)
class DenseBuild:
    full: bool
    nothing_owed: bool


def dense_build(active: str | None, current: str, store_there: bool, resolved_there: bool) -> DenseBuild:
    """A vector store is built anew unless the one in use is of the current encoder's fingerprint and is whole."""
    same = active == current and store_there
    return DenseBuild(not same, resolved_there and same)


def nothing_to_build(changes: DataFrame, dense: DenseBuild, meta_current: bool) -> bool:
    """No file changed (path, change), no vectors owed, and the index says what built it."""
    return dense.nothing_owed and meta_current and changes.where("change <> 'same'").isEmpty()


def history_range(last: str | None, head: str | None, behind: int | None, bound: int = 500) -> tuple[str, int | None] | None:
    """(range, at most so many) of the commits to read, or None if there are none. behind: how many commits head is after the last one
    stored, None if that one is no longer there. More than ``bound`` behind, history starts anew from the latest."""
    if head is None or last == head or behind == 0 and last is not None:
        return None
    if last is None or behind is None or behind > bound:
        return "HEAD", bound
    return f"{last}..HEAD", None


def follow_history(spark: SparkSession, repository: str, stored: DataFrame, last: str | None, bound: int = 500) -> tuple[DataFrame, str | None]:
    """(commits that stored (hash, ...) hasn't, the new watermark) of a git repository."""
    from quarry.sources.files import GitLog, git

    head = git(repository, "rev-parse", "--verify", "-q", "HEAD", check=False).strip() or None
    behind = None
    if last and git(repository, "cat-file", "-t", last, check=False).strip() == "commit":
        behind = int(git(repository, "rev-list", "--count", f"{last}..HEAD").strip())
    spark.dataSource.register(GitLog)
    what = history_range(last, head, behind, bound)
    if what is None:
        return spark.createDataFrame([], GitLog({}).schema()), head or last
    options = {"range": what[0]} | ({"most": str(what[1])} if what[1] else {})
    rows = spark.read.format("git_log").options(**options).load(repository)
    return rows.join(stored.select("hash"), "hash", "left_anti"), head


class Branches:
    """Snapshots of an index for each branch, beside the tables in use. Tables are folders of Parquet below ``folder``/live; a snapshot
    is their copy below ``folder``/branches/<key>; which branch the live ones are of, and which snapshots there are, is in ``folder``/state.
    Copies are written whole before the state names them."""

    def __init__(self, spark: SparkSession, folder: str, tables: tuple[str, ...], cap: int = 5):
        self.spark, self.folder, self.tables, self.cap = spark, folder.rstrip("/"), tables, cap

    @staticmethod
    def key(branch: str) -> str:
        import hashlib

        return f"{re.sub('[^A-Za-z0-9._-]', '_', branch)}-{hashlib.sha256(branch.encode()).hexdigest()[:8]}"

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _state(self) -> list:
        at = f"{self.folder}/state"
        return self.spark.read.parquet(at).orderBy("version").collect() if self._exists(at) else []

    def _note(self, live: str | None, head: str | None, snapshots: list[tuple[str, str | None, int]]) -> None:
        rows = self._state()
        version = (rows[-1].version if rows else 0) + 1
        self.spark.createDataFrame([(version, live, head, snapshots)], "version long, live string, head string, snapshots array<struct<key string, head string, at long>>").coalesce(1).write.mode("append").parquet(f"{self.folder}/state")

    def snapshots(self) -> list[tuple[str, str | None, int]]:
        rows = self._state()
        return [tuple(s) for s in rows[-1].snapshots] if rows else []

    def _copy(self, source: str, target: str) -> None:
        for t in self.tables:
            self.spark.read.parquet(f"{source}/{t}").write.mode("overwrite").parquet(f"{target}/{t}")

    def mirror(self, branch: str, head: str | None) -> list[str]:
        """Keeps the live tables as the branch's snapshot; of snapshots beyond the cap the oldest are forgotten, and named."""
        key, rows = self.key(branch), self._state()
        at = (rows[-1].version if rows else 0) + 1
        self._copy(f"{self.folder}/live", f"{self.folder}/branches/{key}")
        kept = sorted([(key, head, at), *(s for s in self.snapshots() if s[0] != key)], key=lambda s: -s[2])
        self._note(key, head, kept[: self.cap])
        return [s[0] for s in kept[self.cap :]]

    def switch(self, branch: str, head: str | None = None) -> str:
        """first, unchanged, restored (from the branch's snapshot) or kept (the old branch's tables as a snapshot, unless it has one of the
        same commit; the live ones are to be brought up to date)."""
        key, rows = self.key(branch), self._state()
        if not rows or rows[-1].live is None:
            self._note(key, head, self.snapshots())
            return "first"
        state, there = rows[-1], {s[0]: s for s in self.snapshots()}
        if state.live == key:
            return "unchanged"
        if key in there:
            self._copy(f"{self.folder}/branches/{key}", f"{self.folder}/live")
            self._note(key, there[key][1], list(there.values()))
            return "restored"
        old, snapshots = there.get(state.live), list(there.values())
        if not (old and old[1] is not None and old[1] == state.head):
            self._copy(f"{self.folder}/live", f"{self.folder}/branches/{state.live}")
            snapshots = [(state.live, state.head, state.version + 1), *(s for s in snapshots if s[0] != state.live)]
        self._note(key, head, sorted(snapshots, key=lambda s: -s[2])[: self.cap])
        return "kept"


def keep_signals(folder: str, **tables: DataFrame) -> None:
    """Annotations, patterns, centrality and the like, written for later searches; a signal written again is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def signal(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def keep_centrality(folder: str, nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """PageRank, computed once at build time and kept; returns what was kept."""
    from quarry.operators.graph import pagerank

    keep_signals(folder, centrality=pagerank(nodes, edges, **options))
    return signal(nodes.sparkSession, folder, "centrality")
