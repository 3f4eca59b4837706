import random

import pytest

from tilewright.llm.runs import collapse_runs

SCHEMA = "f long, k int, y int, z int, t long, r long, n string"


def brute(rows, gap):
    seqs = {}
    for f, k, y, z, t, r, _ in set(rows):
        if None not in (f, k, y, z, t, r):
            seqs.setdefault((f, k), []).append((t, r, y, z))
    out = []
    for key, s in seqs.items():
        s.sort()
        run = [s[0]]
        for a, b in zip(s, s[1:] + [None]):
            if b is not None and a[2:] == b[2:] and (gap is None or b[0] - a[0] <= gap):
                run.append(b)
                continue
            out.append((*key, *run[0][2:], run[0][1], run[-1][1], run[0][0], run[-1][0], len(run), run[-1][0] - run[0][0]))
            run = [b]
    return sorted(out)


def got(spark, rows, gap, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in collapse_runs(df, ["f", "k"], ["y", "z"], "t", "r", gap, **kw).collect())


def make_rows(seed, n, symbols=2):
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += r.choice([0, 1, 1, 2, 9])
        y = r.randrange(symbols) if r.random() < 0.3 else (rows[-1][2] if rows else 0)
        rows.append((r.choice([1, 1, 1, 2]), r.choice([1, 1, 1, 2]), y, 0, t, i, None))
    return rows + rows[::5]


@pytest.fixture(params=["1", "4", "31"])
def ranges(spark, request):
    """The same results from any number of ranges."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("gap", [5, None])
def test_against_brute_force(spark, gap, ranges):
    rows = make_rows(7, 900)
    everything = brute(rows, gap)
    assert got(spark, rows, gap) == everything
    assert got(spark, rows, gap, min_run=3) == [x for x in everything if x[8] >= 3]


@pytest.mark.parametrize("size", ["1", "3", "50"])
def test_runs_across_batches(spark, size):
    rows = make_rows(8, 300, 1) + [(5, 5, 3, 1, 10 + i, i, None) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert got(spark, rows, 5) == brute(rows, 5)
        assert got(spark, rows, 5, min_run=3) == [x for x in brute(rows, 5) if x[8] >= 3]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_run_over_all_ranges(spark, ranges):
    rows = [(1, 1, 4, 2, 1000 + 10 * i, i, None) for i in range(2500)]
    assert got(spark, rows, 10) == [(1, 1, 4, 2, 0, 2499, 1000, 25990, 2500, 24990)]


def test_more_symbols_than_code_points(spark, monkeypatch):
    from tilewright.llm import runs

    monkeypatch.setattr(runs, "MAX_SYMBOLS", 3)
    rows = [(1, 1, i // 4, 0, i, i, None) for i in range(100)]
    assert got(spark, rows, 5) == brute(rows, 5)


def test_nulls_ties_empty_and_names(spark):
    rows = [(None, 1, 0, 0, 1, 1, "n"), (1, None, 0, 0, 1, 1, "n"), (1, 1, None, 0, 1, 1, "n"), (1, 1, 0, 0, None, 1, "n"), (1, 1, 0, 0, 1, None, "n"), (1, 1, 0, 0, 1, 2, "n"), (1, 1, 0, 0, 1, 1, "n")]
    assert got(spark, rows, 5) == [(1, 1, 0, 0, 1, 2, 1, 1, 2, 0)]
    assert got(spark, [], 5) == []
