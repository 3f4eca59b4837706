import math
import random

import numpy as np
import pytest

from tilewright.llm import percentiles as P

PROBS = (0.0, 0.5, 0.9, 0.99, 1.0)


def nearest(xs, p):
    return sorted(xs)[max(1, math.ceil(p * len(xs))) - 1]


def groups(rows):
    by = {}
    for k, v in rows:
        if v is not None and not (isinstance(v, float) and math.isnan(v)):
            by.setdefault(k, []).append(v)
    return by


def run(spark, rows, kind, **kw):
    df = spark.createDataFrame(rows, f"k int, x {kind}")
    names = [P.percentile_name(p) for p in PROBS]
    return {r.k: (r.n, *[r[n] for n in names]) for r in P.percentiles(df, ["k"], "x", PROBS, **kw).collect()}


@pytest.mark.parametrize("kind", ["long", "double"])
def test_exact(spark, kind):
    r = random.Random(3)
    make = (lambda: r.choice([r.randrange(10**9), 5, 5, -7])) if kind == "long" else (lambda: r.choice([r.gauss(0, 1e6), 1e-300 * r.random(), float("nan"), 2.5]))
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([make(), make(), None])) for _ in range(2000)]
    by = groups(rows)
    assert run(spark, rows, kind) == {k: (len(v), *[float(nearest(v, p)) for p in PROBS]) for k, v in by.items()}
    lin = run(spark, rows, kind, interpolate=True)
    for k, v in by.items():
        assert np.allclose(lin[k][1:], np.quantile(v, PROBS), rtol=1e-12)


def test_extreme_values(spark):
    big = 2**63 - 1
    rows = [(1, x) for x in (-big, big, 0, big - 1, -big + 1)] + [(2, big), (2, big - 1), (2, big - 2)]
    got = run(spark, rows, "long")
    assert got[1][2] == 0.0 and got[2][2] == float(big - 1)
    inf = [(1, float("inf")), (1, float("-inf")), (1, 1.0), (1, 2.0), (1, 3.0)]
    assert run(spark, inf, "double")[1] == (5, float("-inf"), 2.0, float("inf"), float("inf"), float("inf"))


def test_stated_error(spark):
    r = random.Random(4)
    rows = [(1, r.lognormvariate(8, 3)) for _ in range(3000)]
    got = run(spark, rows, "double", rel_error=0.01)[1]
    for p, v in zip(PROBS, got[1:]):
        true = nearest([x for _, x in rows], p)
        assert abs(v - true) <= 0.0101 * true


def test_many_groups_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_STATE", 3)
    rows = [(i % 7, (i * 37) % 1001) for i in range(700)]
    by = groups(rows)
    assert run(spark, rows, "long") == {k: (len(v), *[float(nearest(v, p)) for p in PROBS]) for k, v in by.items()}


def test_empty_and_all_null(spark):
    assert run(spark, [], "long") == {}
    assert run(spark, [(1, None)], "double") == {}


def test_summaries_combine(spark):
    r = random.Random(5)
    rows = [(d, r.choice([1, 2]), r.choice([r.randrange(1, 10**10), r.randrange(-500, 500)])) for d in range(3) for _ in range(800)]
    df = spark.createDataFrame(rows, "day int, k int, x long")
    parts = [P.summarise(df.where(f"day = {d}"), ["k"], "x") for d in range(3)]
    summed = P.combine(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["k"])
    for row in P.percentiles_of(summed, ["k"], (0.5, 0.9)).collect():
        xs = [x for _, k, x in rows if k == row.k]
        assert row.n == len(xs)
        for p, cell in ((0.5, row.p50), (0.9, row.p90)):
            true = nearest(xs, p)
            assert abs(true - cell) <= abs(true) / 2**7


def test_cell_of_the_least_long(spark):
    from pyspark.sql import functions as F

    from tilewright.llm.percentiles import grid_cell

    rows = spark.createDataFrame([(-(2**63),), (-(2**63) + 1,), (2**63 - 1,), (0,), (-5,)], "x long")
    cells = [r.c for r in rows.select(grid_cell(F.col("x"), 7).alias("c")).collect()]
    assert cells[0] == cells[1] == -cells[2] == -(255 << 55) and cells[3:] == [0, -5]
