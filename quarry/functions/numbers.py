"""Functions of numbers, vectors and times, of one Column or several. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import _c


def doubles(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def total(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a, b) -> Column:
    """0 for a vector of length zero and for vectors of different sizes."""
    n = norm(a) * norm(b)
    return F.when((F.size(_c(a)) == F.size(_c(b))) & (n > 0), dot(a, b) / n).otherwise(0.0)


def l2(a, b) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def normalized(v) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def int8_scale(v) -> Column:
    return F.greatest(F.array_max(F.transform(doubles(v), F.abs)) / 127.0, F.lit(1e-8))


def int8(v, scale) -> Column:
    return F.transform(doubles(v), lambda x: F.least(F.greatest(F.round(x / _c(scale)), F.lit(-127.0)), F.lit(127.0)).cast("tinyint"))


def dequantized(q, scale) -> Column:
    return F.transform(_c(q), lambda x: x.cast("double") * _c(scale))


def gelu(x) -> Column:
    x = _c(x)
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def confidence_zone(score) -> Column:
    return F.when(_c(score) >= 0.5, "high").when(_c(score) >= 0.25, "medium").otherwise("low")


def date_seconds(text) -> Column:
    """Seconds of YYYY-MM-DD at midnight UTC; null for any other shape."""
    return F.when(_c(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_seconds(F.to_timestamp(F.try_to_timestamp(_c(text), F.lit("yyyy-MM-dd")))))


def age(seconds_ago) -> Column:
    s = _c(seconds_ago)
    say = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "just now").when(s < 3600, say(60, "m ago")).when(s < 86400, say(3600, "h ago")).when(s < 604800, say(86400, "d ago")).when(s < 2592000, say(604800, "w ago")).when(s < 31536000, say(2592000, "mo ago")).otherwise(say(31536000, "y ago"))


def response_confidence(top, second) -> Column:
    """none, low, medium or high: of a ranking's best score and how far the second lies below it."""
    gap = _c(top) - F.coalesce(_c(second), F.lit(0.0))
    return F.when(_c(top).isNull(), "none").when((_c(top) > 0.5) & (gap > 0.15), "high").when(_c(top) > 0.25, "medium").otherwise("low")


def yes_no_score(logits, yes: int, no: int) -> Column:
    """The share of yes between two of a re-ranker's logits; null where the list is too short."""
    a, b = F.get(_c(logits), F.lit(yes)), F.get(_c(logits), F.lit(no))
    m = F.greatest(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), F.exp(a - m) / (F.exp(a - m) + F.exp(b - m)))


def classifier_score(logits) -> Column:
    """The last logit; null where there is none."""
    return F.try_element_at(_c(logits), F.lit(-1))
