"""English stemming by the Porter2 rules, and expansion of queries by synonyms."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words that the rules don't apply to.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {
    w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _after(w: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(w, start)
    return m.end() if m else len(w)


def _regions(w: str) -> tuple[int, int]:
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            break
    else:
        r1 = _after(w, 0)
    return r1, _after(w, r1)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", w)) or bool(re.fullmatch(rf"[{VOWELS}][^{VOWELS}]", w))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = w.lstrip("'")
    w = re.sub(rf"(^|[{VOWELS}])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", w[:-1]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    for s in ("eedly", "eed"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if re.search(f"[{VOWELS}]", w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif _short_end(w) and r1 >= len(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for s in sorted(STEP2, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + STEP2[s]
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for s in sorted([*STEP3, "ative"], key=len, reverse=True):
        if w.endswith(s):
            if s == "ative":
                if len(w) - 5 >= r2:
                    w = w[:-5]
            elif len(w) - len(s) >= r1:
                w = w[: -len(s)] + STEP3[s]
            break
    for s in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(ArrayType(StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: [stem(x) for x in t] if t is not None else None)


#: General programming synonyms, of our own choosing.
SYNONYMS = {
    "auth": ("authentication", "login"), "login": ("authentication", "session"), "config": ("configuration", "settings"), "db": ("database",), "delete": ("remove",), "remove": ("delete",), "error": ("exception", "failure"),
    "fetch": ("get", "load"), "init": ("initialize", "setup"), "log": ("logging", "logger"), "parse": ("parser", "decode"), "store": ("save", "persist"), "test": ("spec",), "user": ("account",), "cache": ("memoize",),
    "error handling": ("exception", "retry"), "rate limit": ("throttle",), "single sign on": ("sso",), "unit test": ("spec",),
}


def synonym_table(spark) -> DataFrame:
    return spark.createDataFrame([(" ".join(stem(w) for w in k.split()), list(v)) for k, v in SYNONYMS.items()], "key string, words array<string>")


def _run(n: int):
    return lambda i: F.array_join(F.slice("s", i, n), " ")


def expand_queries(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, query): each query with the synonyms of its words, and of its runs of two and three words, sorted, after it."""
    w = F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    x = queries.select("query_id", "query", stems(w).alias("s"))
    runs = [F.when(F.size("s") >= n, F.transform(F.sequence(F.lit(1), F.size("s") - (n - 1)), _run(n))) for n in (1, 2, 3)]
    keys = x.select("query_id", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*runs))))).alias("key"))
    more = keys.join(synonyms, "key").select("query_id", F.explode("words").alias("word")).groupBy("query_id").agg(F.array_sort(F.collect_set("word")).alias("more"))
    return queries.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "query", F.array_join("more", " ")).alias("query"))


def decompose(query: str) -> list[str]:
    """A question about two things as the questions about each, or itself."""
    q = query.strip().rstrip("?")
    for pattern in (r"(?i)how (?:does|do) (.+?) (?:use|call|work with|interact with|talk to) (.+)", r"(?i)(?:difference|relationship|interaction) between (.+?) and (.+)", r"(?i)(?:connection|flow) from (.+?) to (.+)"):
        if m := re.fullmatch(pattern, q):
            return [query, m[1].strip(), m[2].strip()]
    if m := re.fullmatch(r"(?i)(?:how (?:do|can) i |i want to )?add (.+?)(?: to (.+))?", q):
        return [query, *(g.strip() for g in m.groups() if g)]
    return [query]


def facets(query: str, most: int = 6) -> list[str]:
    """The items of a question that lists several, and the whole question."""
    q = re.sub(r"(?i)^\s*(list|find|show( me)?|enumerate|what are|where are)\s+(all|every)?\s*(the\s+)?", "", query.strip().rstrip("?"))
    parts = [p.strip() for p in re.split(r",|;|\band\b|\bor\b", q)]
    parts = [p for p in parts if len(p) > 2 and p.lower() not in ("the", "other", "others", "more", "etc")]
    return [*dict.fromkeys(parts[:most]), query] if len(parts) > 1 else [query]


def hashed_vector(tokens: Column, dims: int = 64) -> Column:
    """Signed hashed counts of tokens: a deterministic stand-in where a text encoder would be."""
    slot = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dims)).alias("d"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(slot, lambda x: x["d"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
