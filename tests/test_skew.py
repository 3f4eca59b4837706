import math
import random
from collections import Counter

import pytest

from tilewright.operators import skew


def brute(rows, ps):
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    out = {}
    for k, vs in by.items():
        known = sorted(v for v in vs if v is not None)
        c = Counter(known)
        mode = min(c, key=lambda v: (-c[v], v)) if c else None
        pct = [known[max(1, math.ceil(p * len(known))) - 1] if known else None for p in ps]
        out[k] = (len(vs), len(c), mode, c[mode] if c else 0, *pct)
    return out


@pytest.mark.parametrize("n,values", [(3000, 50), (3000, 100000)])
def test_key_statistics(spark, n, values):
    r = random.Random(n + values)
    rows = [(r.choice([1, 1, 1, 1, 1, 2, 3, None]), r.choice([None, *range(9), r.randrange(values)])) for _ in range(n)]
    ps = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = skew.key_statistics(spark.createDataFrame(rows, "k int, v long"), ["k"], "v", ps)
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == brute(rows, ps)


def test_distinct_counts_empty_and_all_null(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 2, 3), (1, 2, 3), (None, 1, 1)], "k int, a int, b int")
    got = {r.k: (r.n, r.n_distinct) for r in skew.distinct_counts(df, ["k"], ["a", "b"]).collect()}
    assert got == {1: (3, 1), None: (1, 1)}
    assert skew.distinct_counts(df.limit(0), ["k"], ["a"]).count() == 0
    only_null = spark.createDataFrame([(1, None)], "k int, v long")
    assert [tuple(r) for r in skew.key_statistics(only_null, ["k"], "v", (0.5,)).collect()] == [(1, 1, 0, None, 0, None)]
    assert skew.key_statistics(only_null.limit(0), ["k"], "v", (0.5,)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 5)], "n int, mode int")
    assert skew.key_statistics(df, ["n"], "mode").columns == ["n", "n", "n_distinct", "mode", "mode_n"]
