import itertools
import random
from collections import Counter

import pytest

from tilewright.llm.fpgrowth import class_rules


def brute(rows, ranks, least):
    total, hits = Counter(), Counter()
    for items, classes in rows:
        known = sorted({i for i in items or () if i in ranks})
        for left in [(i,) for i in known] + list(itertools.combinations(known, 2)):
            total[left] += 1
            for c in set(classes or ()):
                hits[left, c] += 1
    return sorted((list(left), c, n, total[left]) for (left, c), n in hits.items() if total[left] >= least)


def frame(spark, rows):
    return spark.createDataFrame(rows, "items array<string>, classes array<string>, path string")


@pytest.mark.parametrize("seed,least", [(1, 1), (2, 3)])
def test_rules_of_one_and_two_items(spark, seed, least):
    r = random.Random(seed)
    rows = [([r.choice("abcdefgh") for _ in range(r.randint(0, 7))], r.sample(["x", "y", "z"], r.randint(0, 2))) for _ in range(400)]
    rows += [(None, ["x"]), (["a", None, "b"], ["x"]), (["a"], None), (["b", "q"], ["x", "x"])]
    support = Counter(i for items, _ in rows for i in set(items or ()))
    ranks = {i: k for k, i in enumerate(sorted((i for i in support if i not in ("q", None)), key=lambda i: (-support[i], i)))}
    got = sorted((list(x["left"]), x["class"], x.freq, x.total) for x in class_rules(frame(spark, [(*x, "p") for x in rows]), ranks, least).collect())
    assert got == brute(rows, ranks, least)


def test_kept_rules_and_empty(spark):
    rows = frame(spark, [(["a", "b"], ["x"], None)] * 3)
    got = class_rules(rows, {"a": 0, "b": 1}, 1, lambda left, c, freq, total: len(left) == 2).collect()
    assert [(list(x["left"]), x["class"], x.freq, x.total) for x in got] == [(["a", "b"], "x", 3, 3)]
    assert class_rules(rows.limit(0), {"a": 0}, 1).count() == 0 and class_rules(rows, {}, 1).count() == 0


@pytest.mark.parametrize("seed,least", [(3, 1), (4, 5)])
def test_every_rule_by_cases(spark, seed, least):
    r = random.Random(seed)
    rows = [(r.choice([None, *"CDEFGHIJKLMNOP"]), r.sample("abcdefg", r.randint(0, 6)), r.sample(["x", "y"], r.randint(0, 2))) for _ in range(150)]
    holds: dict = {}
    for k, (case, items, classes) in enumerate(rows):
        for n in range(1, len(items) + 1):
            for left in itertools.combinations(sorted(items), n):
                for c in (None, *classes):
                    holds.setdefault((left, c), set()).add(case or k)
    want = sorted((list(left), c, len(s), len(holds[left, None])) for (left, c), s in holds.items() if c and len(holds[left, None]) >= least)
    data = spark.createDataFrame(rows, "case_id string, items array<string>, classes array<string>")
    got = class_rules(data, {i: k for k, i in enumerate("abcdefg")}, least, longest=None).collect()
    got = [(list(x["left"]), x["class"], x.freq, x.total) for x in got]
    assert len(got) == len({(*r[0], r[1]) for r in got}) and all(r in want for r in got) and max(len(r[0]) for r in got) > 2
    # each set is there, or a longer one that says the same
    assert all(r in got or len(r[0]) > 2 and any(g[1:] == r[1:] and set(g[0]) > set(r[0]) for g in got) for r in want)


def test_long_transactions_repeated(spark):
    items = [f"i{k:02}" for k in range(40)]
    rows = spark.createDataFrame([(c, items, ["x"]) for c in "ab"], "case_id string, items array<string>, classes array<string>")
    got = class_rules(rows, {i: k for k, i in enumerate(items)}, 2, longest=None).collect()
    assert {len(x["left"]) for x in got} >= {1, 2, 40} and len(got) < 1000
