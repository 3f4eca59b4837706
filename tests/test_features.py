import random

import pytest

from tilewright.operators.features import feature_cells, feature_table

SCHEMA = "f long, k int, y int, z int, t long, r long, v long, n_events string"


def make_rows(seed, n):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 2, 3]), r.choice([0, 0, 1]), r.randrange(4), r.randrange(2), r.randrange(1, 500), i, r.choice([None, 1, 7]), "x") for i in range(n)]
    return rows + rows[:: 7]  # delivered twice


def brute(rows):
    out = {}
    for f, k, y, z, t, r, v, _ in {x for x in rows}:
        if None in (f, k, y, z, t):
            continue
        e = out.setdefault((f, k), {"n": 0, "a": t, "b": t, "types": {}})
        e["n"], e["a"], e["b"] = e["n"] + 1, min(e["a"], t), max(e["b"], t)
        c = e["types"].setdefault((y, z), [0, t, t, 0])
        c[0], c[1], c[2], c[3] = c[0] + 1, min(c[1], t), max(c[2], t), c[3] + (v or 0)
    return out


def check(spark, rows, **kw):
    table = feature_table(spark.createDataFrame(rows, SCHEMA), ["f", "k"], ["y", "z"], "t", totals=["v"], record=["r"], **kw)
    expected = brute(rows)
    got = table.df.collect()
    assert len(got) == len(expected)
    for r in got:
        e = expected[r["f"], r["k"]]
        assert (r["n_events"], r["first_time"], r["last_time"]) == (e["n"], e["a"], e["b"])
        for y, names in table.columns.items():
            n, a, b, s = e["types"].get(y, [0, None, None, None])
            assert (r[names["n"]], r[names["first"]], r[names["last"]], r[names["sum_v"]]) == (n, a, b, s)
    return table


@pytest.fixture(params=["1", "4", "29"])
def ranges(spark, request):
    """The same results from any number of ranges."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_against_brute_force(spark, ranges):
    check(spark, make_rows(3, 1500))


def test_cells(spark, ranges):
    rows = make_rows(6, 600)
    cells = feature_cells(spark.createDataFrame(rows, SCHEMA), ["f", "k"], ["y", "z"], "t", totals=["v"], record=["r"])
    assert cells.columns == ["f", "k", "y", "z", "n", "first", "last", "sum_v"]
    expected = [(*e, *y, *c) for e, x in brute(rows).items() for y, c in x["types"].items()]
    assert sorted(tuple(r) for r in cells.collect()) == sorted(expected)


def test_wide_slices(spark, monkeypatch):
    from tilewright.operators import features

    monkeypatch.setattr(features, "_CELLS", 1)
    check(spark, make_rows(8, 100))


@pytest.mark.parametrize("rows", [10**6, 10**12])
def test_no_task_holds_more_than_a_range(rows):
    from tilewright.plans.ranges import RANGE_BYTES, ranges_for

    size = rows * 48
    assert size / ranges_for(size, 200) <= RANGE_BYTES


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, make_rows(4, 400))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_and_empty(spark):
    rows = [(1, 1, 0, 0, None, 1, 1, None), (None, 1, 0, 0, 5, 2, 1, None), (1, None, 0, 0, 5, 3, 1, None), (1, 1, None, 0, 5, 4, 1, None), (1, 1, 0, 0, 5, None, None, None), (1, 1, 0, 0, 5, None, None, None)]
    check(spark, rows)
    empty = feature_table(spark.createDataFrame([], SCHEMA), ["f", "k"], ["y", "z"], "t", types=[(1, 2)])
    assert empty.df.count() == 0 and "e1_2_n" in empty.df.columns


def test_types_outside_the_list_count_in_the_row(spark):
    rows = make_rows(5, 50)
    table = feature_table(spark.createDataFrame(rows, SCHEMA), ["f", "k"], ["y", "z"], "t", record=["r"], types=[(0, 0)], parts=("n",))
    expected = brute(rows)
    assert {(r.f, r.k): r.n_events for r in table.df.collect()} == {k: e["n"] for k, e in expected.items()}
