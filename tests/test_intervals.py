import random

import pytest

from tilewright.operators import intervals

SCHEMA = "f long, k int, start long, end long, note string"


def brute(rows):
    by = {}
    for f, k, s, e, _ in rows:
        if s is not None and e is not None and s < e:
            by.setdefault((f, k), []).append((s, e))
    periods, gaps = [], []
    for key, ivs in by.items():
        ivs.sort()
        lo, hi, n = ivs[0][0], ivs[0][1], 0
        for s, e in ivs:
            if s > hi:
                periods.append((*key, lo, hi, n))
                gaps.append((*key, hi, s))
                lo, hi, n = s, e, 0
            hi, n = max(hi, e), n + 1
        periods.append((*key, lo, hi, n))
    return sorted(periods, key=str), sorted(gaps, key=str)


def both(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [sorted((tuple(r) for r in f(df, ["f", "k"], **kw).collect()), key=str) for f in (intervals.busy_periods, intervals.gaps)]
    return got[0], got[1]


def make_rows(seed, n, spread, longest):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        f = r.choice([1, 1, 1, 1, 2, 3])  # one entity holds two thirds
        s = r.randrange(spread)
        rows.append((f, r.choice([7, 7, 7, 8]), s, s + r.choice([1, 2, 5, r.randrange(1, longest)]), "x"))
    return rows


@pytest.fixture(params=["1", "4", "37"])
def shards(spark, request):
    """The same results from any number of shards."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("seed,n,spread,longest", [(1, 900, 20000, 30), (2, 900, 3000, 2000), (3, 900, 100000, 40)])
def test_against_brute_force(spark, seed, n, spread, longest, shards):
    rows = make_rows(seed, n, spread, longest)
    assert both(spark, rows) == brute(rows)


def test_small_batches(spark, shards):
    rows = make_rows(4, 300, 3000, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert both(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_huge_entity_with_ties_and_cover(spark, shards):
    # one interval covers most shards, many begin at one instant
    rows = [(1, 1, 0, 5000, None)] + [(1, 1, 100, 101, None)] * 400 + [(1, 1, 6000 + 3 * i, 6001 + 3 * i, None) for i in range(600)]
    assert both(spark, rows) == brute(rows)


def test_nulls_repeats_empty(spark):
    rows = [(1, None, 5, 9, None), (1, None, 9, 12, None), (1, None, 9, 12, None), (1, None, 20, 21, None), (1, 1, None, 4, None), (1, 1, 4, None, None), (1, 1, 4, 4, None), (None, 1, 1, 2, None)]
    assert both(spark, rows) == brute(rows)
    assert both(spark, []) == ([], [])


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, 9, 0, 0)], "gap_start long, s long, e long, _s long, _before long")
    assert intervals.gaps(df, ["gap_start"], "s", "e").columns == ["gap_start", "gap_start", "gap_end"]
    assert intervals.busy_periods(df, ["gap_start"], "s", "e").count() == 1
