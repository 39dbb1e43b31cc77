import random
from collections import defaultdict

import pytest
from quarry.llm.chat import END, START, format_chats

SCHEMA = "conv_id long, turn int, role string, text string, part string"


def slow(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    last = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    turns = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda t: (last(t[0]), text(t[1]), text(t[2])))) for c, v in by.items()}
    out = []
    for c, v in turns.items():
        same = [d for d, w in turns.items() if w == v]
        ids = [d for d in same if d is not None]
        if (min(ids) if ids else None) != c or any(len(w) > len(v) and w[: len(v)] == v for w in turns.values()):
            continue
        out.append((c, len(v), len(same), "".join(f"{START}{'user' if r is None else r}\n{x or ''}{END}\n" for r, x in v)))
    return sorted(out, key=str)


def joined(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id, r.n_turns, r.copies].append((r.part, r.text))
    for v in by.values():
        assert sorted(p for p, _ in v) == list(range(len(v)))
    return sorted(((*k, "".join(t for _, t in sorted(v))) for k, v in by.items()), key=str)


@pytest.mark.parametrize("stretch", [2, 1024])
def test_as_brute_force(spark, stretch):
    rng, rows, c = random.Random(2), [], 0
    for _ in range(60):
        full = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "long " * 50])) for _ in range(rng.randint(1, 7))]
        for n in rng.sample(range(1, len(full) + 1), rng.randint(1, len(full))):
            rows += [(c, k, r, x) for k, (r, x) in enumerate(full[:n])]
            c += 1
    rows += [(900, 0, "user", "tie"), (900, 0, "user", "tie"), (900, 0, "assistant", "tie"), (901, None, "user", "first"), (901, 5, "user", "then"), (902, -3000, "user", "far"), (902, 3000, "user", "apart")]
    rows += [(None, 0, "user", "nobody's"), (None, 1, None, None), (903, 7, "user", "nobody's"), (903, 9, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "p") for r in rows], SCHEMA).repartition(5)
    assert joined(format_chats(df, stretch).collect()) == slow(rows)


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_oracle(spark, sf):
    from quarry.llm.queries import ORACLE_SQL, QUERIES
    from tests.oracle import assert_same, duck

    assert assert_same(QUERIES["op10_chat"](spark, sf), duck(sf), ORACLE_SQL["op10_chat"]) > 10


def test_one_turn_number_over_and_over(spark):
    """Very many turns of one number, or of none, are dealt over parts of a bounded size."""
    rows = [(1, 4, "user", f"text {k % 700:03d}") for k in range(5000)] + [(2, None, "user", "again")] * 3000 + [(3, None, "user", "again")] * 2999
    got = format_chats(spark.createDataFrame([(*r, "p") for r in rows], SCHEMA), 100).collect()
    assert joined(got) == slow(rows) and {r.conv_id: len([x for x in got if x.conv_id == r.conv_id]) for r in got} == {1: 50, 2: 30}
    assert all(r.text.count(START) == 100 for r in got)


def test_plan(spark, sf):
    """No Python, and texts are shuffled no more than to be placed and to be put together."""
    plan = format_chats(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "InArrow", "InPandas", "Scan parquet"))
    assert plan.count("Exchange hashpartitioning") == 1
