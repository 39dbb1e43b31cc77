import random

import pytest
from quarry.llm.url_filter import RULES, url_verdicts

URLS = [
    None, "", "no scheme", "http://A.Example.ORG/es/x", "https://example.org", "http://org", "http://org/", "http://xorg/", "ftp://a.b.example.org/en/12?x", "//x.org/", "http://www.x.com/fr/1#://z",
    "http://x.com/FR/", "http://x.com/de/", "http://x.com?/de/", "http://x.com/de", "a://b://c.org/", "http:///path", "http://u@x.org:80/", "http://.org/", "http://com/fr/", "x\ny://new.org/\nline", "http://É.org/é",
    "http://a.org/" + "p/" * 50_000, "http://" + "a." * 3000 + "org/q",
]


def slow(url, rules, default):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        k = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


MORE = (*RULES, ("block", "org", "/"), ("block", "a.b", ""), ("allow", "b", "/xx"), ("block", "x.com", "/d"), ("allow", "x.com", "/d"))


@pytest.mark.parametrize(("rules", "default"), [(RULES, "allow"), (MORE, "block"), ((), "block")])
def test_as_brute_force(spark, rules, default):
    rng = random.Random(1)
    urls = URLS + [f"http://{'.'.join(rng.choices(['a', 'b', 'x', 'com', 'org', 'example'], k=rng.randint(1, 4)))}{rng.choice(['', '/', '/es/', '/en/1', '/fr/', '/de/q', '/d', '/xx'])}" for _ in range(300)]
    df = spark.createDataFrame([(i if i % 9 else None, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = sorted((tuple(r) for r in url_verdicts(df, rules, default).collect()), key=str)
    assert got == sorted(((i if i % 9 else None, *slow(u, rules, default)) for i, u in enumerate(urls)), key=str)


def test_empty_and_wrong_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_verdicts(df).collect() == []
    with pytest.raises(ValueError):
        url_verdicts(df, [("allow", "a/b", "/")])


def test_oracle(spark, sf):
    from quarry.llm.queries import ORACLE_SQL, QUERIES
    from tests.oracle import assert_same, duck

    assert assert_same(QUERIES["op3_url_rules"](spark, sf), duck(sf), ORACLE_SQL["op3_url_rules"]) == 50
