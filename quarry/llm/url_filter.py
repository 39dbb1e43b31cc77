"""URL rules by host-suffix and path-prefix expressions.

A rule (action, host, path) fits its host and all subdomains where the URL's path
begins with the rule's. A URL is expanded into the expressions host suffix + path
prefix of the shapes that rules have (labels in the host, characters in the
path), so the expansion is bound by the rules and not by the URL. Expressions are
joined with the rules on the first 32 bits of their SHA-256; the full digests
then confirm. Of several rules the longest wins, then the one with the longer
host, then a block.

All of it is DataFrame functions. Only distinct (host, path) are expanded and
joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the registered query, as (action, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """host: after the first "://" up to /, ?, # or the end, A-Z in lower case; path: from there up to ?, # or the end. Both are
    empty where url is null or has no "://"."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.regexp_replace(url, r"^[\s\S]*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")


def rule_table(spark, rules) -> DataFrame:
    """(action, r_host, r_path, rule, prefix, digest). Hosts in lower case; rules repeated count once, and a block wins over an allow of the same rule."""
    rows = [(a, h.translate(str.maketrans(UPPER, LOWER)), p) for a, h, p in rules]
    if any(a not in ("allow", "block") or not h or "/" in h or p and p[0] != "/" for a, h, p in rows):
        raise ValueError("a rule is (allow or block, host, path that is empty or begins with /)")
    df = spark.createDataFrame(rows, "action string, r_host string, r_path string").groupBy("r_host", "r_path").agg(F.max("action").alias("action"))
    df = df.withColumn("rule", F.concat("r_host", "r_path"))
    return df.withColumn("digest", _digest(F.col("rule"))).withColumn("prefix", _prefix(F.col("digest")))


def url_verdicts(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_sent: int = 100_000) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict.

    rule is that of the longest rule that fits, as host + path, else null; verdict
    is its action, else ``default``. A null url, or one without "://", has neither
    host nor path, and no rule fits it. Repeated rows each appear, and so do null
    identifiers; very long URLs are expanded no further than rules reach. Other
    columns are ignored; an empty table, or no rules, is fine.
    """
    spark, rules = pages.sparkSession, tuple(rules)
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    labels = F.size(F.split("host", r"\."))
    expressions = [
        F.when((labels >= k) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -k), F.left("path", F.lit(n)))) for k, n in shapes
    ]
    each = parsed.where("host <> ''").select("host", "path").distinct()
    each = each.select("host", "path", F.explode(F.array_compact(F.array(*expressions))).alias("expression"))
    each = each.withColumn("own", _digest(F.col("expression"))).withColumn("prefix", _prefix(F.col("own"))).drop("expression")
    # a list that the caller holds in memory: sent to every task, so a suffix that most hosts have is no join key
    table = rule_table(spark, rules)
    hits = each.join(F.broadcast(table) if len(rules) <= most_sent else table, "prefix").where("own = digest")
    # the largest of (length, host's length, block before allow): each rule is there once, so no ties remain
    best = F.max(F.struct(F.length("rule"), F.length("r_host"), "action", "rule"))
    found = hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    return parsed.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
