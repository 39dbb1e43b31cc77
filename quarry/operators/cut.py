"""How much of a ranking is shown: thresholds, caps, budgets, diversity. Rankings are (query_id, chunk_id, score, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least share of the top score, and least and largest number of results, by query type.
MIN_SCORE = {"identifier": 0.08, "keyword": 0.15, "semantic": 0.10, "mixed": 0.10}
SIZES = {"identifier": (3, 15), "keyword": (3, 15), "semantic": (3, 15), "mixed": (5, 15)}
EXHAUSTIVE_SIZE = (5, 25)


def of_query():
    return Window.partitionBy("query_id")


def by_score():
    return of_query().orderBy(F.desc("score"), "chunk_id")


def by_type(values: dict, default, column: str = "query_type") -> Column:
    w = F
    for t, v in values.items():
        w = w.when(F.col(column) == t, v)
    return w.otherwise(default)


def confidence_threshold(scored: DataFrame, share: float | Column) -> DataFrame:
    x = scored.withColumn("__top", F.max("score").over(of_query()))
    return x.where((F.col("__top") <= 0) | (F.col("score") >= F.col("__top") * share)).drop("__top")


def file_dedup(scored: DataFrame, gap: float = 0.1) -> DataFrame:
    """Chunks less than ``gap`` below their file's best."""
    return scored.withColumn("__best", F.max("score").over(Window.partitionBy("query_id", "file_path"))).where(F.col("__best") - F.col("score") < gap).drop("__best")


def elbow(scored: DataFrame, low: int | Column, high: int | Column, requested: int, least_drop: float | Column = 0.02) -> DataFrame:
    """(query_id, keep): how many results stand before the largest relative drop between ``low`` and ``high``, the first of equal
    ones; ``high`` if no drop is large enough."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    x = scored.withColumns({"__i": F.row_number().over(by_score()) - 1, "__n": F.count("*").over(of_query()), "__top": F.max("score").over(of_query())})
    x = x.withColumns({"__lo": lo, "__hi": hi, "__least": least_drop if isinstance(least_drop, Column) else F.lit(least_drop)})
    drop = (F.lag("score").over(by_score()) - F.col("score")) / F.nullif(F.col("__top"), F.lit(0.0))
    x = x.withColumn("__drop", F.when((F.col("__i") >= F.greatest("__lo", F.lit(1))) & (F.col("__i") < F.least("__n", "__hi")), drop))
    best = F.max(F.when(F.col("__drop") > 0, F.struct(F.col("__drop").alias("d"), (-F.col("__i")).alias("i"))))
    g = x.groupBy("query_id").agg(best.alias("best"), *(F.first(c).alias(c) for c in ("__n", "__top", "__lo", "__hi", "__least")))
    at = F.when(F.coalesce(F.col("best.d"), F.lit(0.0)) < F.col("__least"), F.least("__n", "__hi")).otherwise(-F.col("best.i"))
    keep = (
        F.when(F.col("__n") <= F.col("__lo"), F.col("__n")).when(F.col("__top") <= 0, F.least("__lo", "__n")).otherwise(F.least(F.greatest("__lo", F.least("__hi", at)), F.col("__n")))
    )
    return g.select("query_id", F.least(keep, F.lit(requested)).cast("long").alias("keep"))


def take(scored: DataFrame, keep: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(by_score())).join(keep, "query_id").where(F.col("rank") <= F.col("keep")).drop("keep")


def adaptive(scored: DataFrame, requested: int = 15, gap: float = 0.1, exhaustive: bool = False) -> DataFrame:
    """Threshold, one file's chunks, elbow. scored has query_type and file_path.

    For identifiers the elbow is looked for among the files' best scores first, and
    used if it leaves two thirds of the files or fewer; else the largest size counts.
    """
    share = by_type(MIN_SCORE, 0.10) * (0.5 if exhaustive else 1.0)
    x = confidence_threshold(scored, share)
    if exhaustive:
        return take(x, elbow(x, *EXHAUSTIVE_SIZE, requested, F.when(F.col("query_type") == "identifier", 0.005).otherwise(0.02)))
    x = file_dedup(x, gap)
    others = x.where("query_type <> 'identifier'")
    lo, hi = (by_type({t: v[i] for t, v in SIZES.items()}, SIZES["semantic"][i]) for i in (0, 1))
    out = take(others, elbow(others, lo, hi, requested))
    own = x.where("query_type = 'identifier'")
    files = own.groupBy("query_id", F.col("file_path").alias("chunk_id")).agg(F.max("score").alias("score"))
    n = files.groupBy("query_id").agg(F.count("*").alias("files"))
    keep = elbow(files, *SIZES["identifier"], requested, 0.005).join(n, "query_id").withColumn("precise", F.col("keep") * 3 <= F.col("files") * 2)
    ranked = files.withColumn("__rank", F.row_number().over(by_score())).select("query_id", F.col("chunk_id").alias("file_path"), "__rank")
    own = own.join(ranked, ["query_id", "file_path"]).join(keep, "query_id").withColumn("rank", F.row_number().over(by_score()))
    own = own.where(F.when(F.col("precise"), F.col("__rank") <= F.col("keep")).otherwise(F.col("rank") <= min(requested, SIZES["identifier"][1])))
    return out.unionByName(own.drop("__rank", "keep", "files", "precise").withColumn("rank", F.row_number().over(by_score())))


def per_file_cap(scored: DataFrame, each: int = 3, total: int = 40) -> DataFrame:
    x = scored.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(F.desc("score"), "chunk_id"))).where(F.col("__r") <= each).drop("__r")
    return x.withColumn("rank", F.row_number().over(by_score())).where(F.col("rank") <= total)


def byte_budget(ranked: DataFrame, size: str, budget: int = 32_768) -> DataFrame:
    """Results in order of rank until one would pass the budget; the first stays whatever its size."""
    w = of_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(size).over(w)).where((F.col("used") <= budget) | (F.col("rank") == 1))


def best_per(scored: DataFrame, *key: str) -> DataFrame:
    w = Window.partitionBy("query_id", *key).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def dedup_range(scored: DataFrame, most: int = 4) -> DataFrame:
    """Chunks of the same lines of a file once, with the other ones' names (sorted, at most ``most``)."""
    key = ("query_id", "file_path", "start_line", "end_line")
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "chunk_id")
    x = scored.withColumn("__r", F.row_number().over(w))
    others = x.where("__r > 1").groupBy(*key).agg(F.slice(F.array_sort(F.collect_set("name")), 1, most).alias("also"))
    return x.where("__r = 1").drop("__r").join(others, list(key), "left").withColumn("also", F.coalesce("also", F.array().cast("array<string>")))


def union_diversify(lists: DataFrame, each: int = 3, total: int = 40) -> DataFrame:
    """Several lists of (query_id, file_path, start_line, chunk_id, score): of one place the best, then the caps."""
    return per_file_cap(best_per(lists, "file_path", "start_line"), each, total)


def mmr(ranked: DataFrame, vectors: DataFrame, weight: float = 0.7, k: int = 50) -> DataFrame:
    """Maximal marginal relevance over each query's first k (rank, score): greedy, so one small group of at most k rows a query is
    worked on at a time. A query with a chunk that has no vector keeps its order."""
    head = ranked.where(F.col("rank") <= k).join(vectors.select("chunk_id", "vector"), "chunk_id", "left")
    schema = "query_id long, chunk_id long, score double, rank int"

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = g.sort_values(["rank"]).reset_index(drop=True)
        order = list(range(len(g)))
        if not g["vector"].isna().any():
            v = np.array(g["vector"].tolist(), float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(n > 0, v / np.where(n > 0, n, 1), 0)
            sim, score, left, order, worst = v @ v.T, g["score"].to_numpy(), list(range(len(g))), [], np.zeros(len(g))
            top = score.max() if score.max() > 0 else 1.0
            while left:
                i = max(left, key=lambda j: (weight * score[j] / top - (1 - weight) * (worst[j] if order else 0), -j))
                order.append(i)
                left.remove(i)
                worst = np.maximum(worst, sim[i]) if len(order) > 1 else sim[i].copy()
        g = g.iloc[order]
        return pd.DataFrame({"query_id": g["query_id"], "chunk_id": g["chunk_id"], "score": g["score"], "rank": range(1, len(g) + 1)})

    return head.select("query_id", "chunk_id", "score", "rank", "vector").groupBy("query_id").applyInPandas(pick, schema)


def triage_cap(score: float) -> int:
    """How many results a deep search reads, by its confidence."""
    return 5 if score > 0.7 else 8 if score > 0.3 else 14


def triage(ranked: DataFrame, floor: float = 0.08, each: int = 3, most: int = 14, rescued: int = 1) -> DataFrame:
    """Results over the floor, at most ``each`` of a file, none whose lines overlap by more than half with one taken before. Where no
    result passes, the first ``rescued`` are taken all the same. Greedy over each query's ranking of at most a few hundred rows."""
    schema = "query_id long, chunk_id long, rank int"

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        taken, files = [], {}
        for r in g.sort_values("rank").itertuples():
            own = files.setdefault(r.file_path, [])
            lines = r.end_line - r.start_line + 1
            over = any(min(b, r.end_line) - max(a, r.start_line) + 1 > lines / 2 for a, b in own)
            if r.score >= floor and len(own) < each and not over and len(taken) < most:
                own.append((r.start_line, r.end_line))
                taken.append((r.query_id, r.chunk_id))
        if not taken:
            taken = [(r.query_id, r.chunk_id) for r in g.sort_values("rank").head(rescued).itertuples()]
        return pd.DataFrame([(q, c, i + 1) for i, (q, c) in enumerate(taken)], columns=["query_id", "chunk_id", "rank"])

    head = ranked.where(F.col("rank") <= 500)
    return head.select("query_id", "chunk_id", "score", "rank", "file_path", "start_line", "end_line").groupBy("query_id").applyInPandas(pick, schema)
