"""Trace tables on small hand-made traces."""

import datetime as dt

from tilewright.operators import trace_tables as tt
from tilewright.sources import trace

AT = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """Rows are (rpos, evtno, kind, kid, date, d0, d1, d2, d3[, name]) of file 1."""
    full = [(1, r[0], *r[1:9], r[9] if len(r) > 9 else None, AT) for r in rows]
    return spark.createDataFrame(full, trace.EVENT_SCHEMA)


def lookups(spark):
    formats = spark.createDataFrame([(5, " gemm\n", None), (5, None, "#fff"), (0, "none", None)], "fmtid long, name string, color string")
    procs = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "kid int, ptype int")
    return formats, procs


def test_tasks(spark):
    formats, procs = lookups(spark)
    e = events(spark, [
        (0, 2, 0, 1, 10, 77, 5, 0, 0), (1, 2, 2, 1, 20, 77, 5, 0, 0), (2, 2, 3, 1, 30, 77, 5, 0, 8), (2, 2, 3, 1, 30, 77, 5, 0, 8),
        (3, 2, 0, 1, 40, 77, 6, 0, 0), (4, 2, 3, 2, 50, 77, 6, 0, 9),  # the id again, start lost, unknown format
        (5, 2, 2, 1, 20, 78, 5, 0, 0), (6, 2, 3, 1, 30, 78, 5, 0, 1),  # no push
        (7, 2, 0, 3, 60, 79, 5, 0, 0),  # no end
        (8, 2, 0, None, 60, 80, 5, 0, 0), (9, 2, 3, 1, 0, 80, 5, 0, 0),
    ])
    got = sorted((r.resource, r.type, r.name, round(r.push * 1e9), r.start and round(r.start * 1e9), round(r.end * 1e9), round(r.duration * 1e9)) for r in tt.tasks(e, formats, procs).collect())
    assert got == [(1, "CPU", "gemm", 10, 20, 30, 8), (1, "CPU", "unkown", 40, None, 50, 9)]
    assert tt.tasks(e, formats, procs, only=[6]).count() == 1
    assert tt.tasks(e.limit(0), formats, procs).count() == 0


def test_kernels_and_copies(spark):
    formats, procs = lookups(spark)
    e = events(spark, [
        (0, 8, 0, 2, 10, 1, 77, 5, 3), (1, 8, 1, 2, 11, 1, None, None, None), (2, 8, 2, 2, 12, 1, 4, None, None),
        (3, 8, 1, 2, 21, 2, None, None, None), (4, 8, 2, 2, 22, 2, 4, None, None),  # begin without push
        (5, 8, 2, 2, 31, 3, 4, None, None),  # end alone
        (6, 7, 0, 2, 10, 1, (4 << 32) + 2, 64, 0x0301), (7, 7, 1, 2, 11, 1, None, None, None), (8, 7, 2, 2, 12, 1, 9, None, None),
        (9, 7, 0, 99, 10, 5, 0, 64, 0), (10, 7, 2, 99, 12, 5, 9, None, None),  # unknown processor
    ])
    k = sorted((r.task_id, r.stream, round(r.push * 1e9), r.name, r.resource) for r in tt.kernels(e, formats, procs).collect())
    assert k == [(1, 3, 10, "gemm", 2), (2, None, 0, "unkown", 2)]
    c = [(r.stream, r.dir, r.direction, r.size, r.source, r.target) for r in tt.copies(e, procs).collect()]
    assert c == [(3, 1, "H2D", 64, 2, 4)]


def test_processors_and_calls(spark):
    e = events(spark, [
        (0, 0, 0, 1, 5, 1, 0, 0, 0), (1, 0, 0, 1, 6, 2, 0, 0, 0), (2, 0, 1, 1, 90, 1, 0, 0, 0), (3, 0, 1, 4, 90, 1, 0, 0, 0),
        (4, 13, 0, 1, 10, 0, 1, 2, 3, "zgemm_long"), (5, 13, 2, 1, 11, 4, 5, 6, 7), (6, 13, 0, 1, 12, 0, 9, 9, 9, "b"),
        (7, 9, 0, 1, 13, 0, 0, 0, 0), (8, 9, 1, 1, 20, 0, 0, 0, 0), (9, 13, 0, 1, 30, 0, 1, 1, 1, "open"),
    ])
    p = [(r.resource, r.type, r.name, round(r.start * 1e9), round(r.end * 1e9)) for r in tt.processors_alive(e).collect()]
    assert p == [(1, "CUDA", "CUDA-1", 5, 90)]
    c = sorted((r.level, r.name, r.nparam, r.param0, r.param3, r.param6, r.param7, round(r.end * 1e9)) for r in tt.calls(e).collect())
    assert c == [(0, "zgemm_l", 7, 1, 4, 7, 0, 20), (1, "b", 3, 9, 0, 0, 0, 20)]


def test_intervals(spark):
    e = events(spark, [
        (0, 2, 2, 1, 10, 7, 0, 0, 0), (1, 2, 3, 1, 20, 7, 5, 0, 0), (1, 2, 3, 1, 20, 7, 5, 0, 0),
        (2, 2, 2, 1, 10, 8, 0, 0, 0), (3, 2, 3, 1, 10, 8, 5, 0, 0),  # the end is not above the start
        (4, 2, 2, 1, 10, 9, 0, 0, 0), (5, 2, 3, 2, 20, 9, 5, 0, 0),  # another processor
        (6, 8, 1, 1, 30, 7, 0, 0, 0), (7, 8, 2, 1, 31, 7, 0, 0, 0), (8, 7, 0, 1, 30, 7, 0, 0, 0), (9, 7, 2, 1, 31, 7, 0, 0, 0),
    ])
    got = sorted(tuple(r) for r in trace.intervals(e).collect())
    assert got == [(1, 1, 2, 7, 10, 20, 5), (1, 1, 8, 7, 30, 31, 0)]


def test_intervals_of_an_id_used_again(spark):
    """Every start with every later end, as in the queries' SQL."""
    rows = [
        (0, 2, 3, 1, 5, 7, 4, 0, 0),  # an end before all starts
        (1, 2, 2, 1, 10, 7, 0, 0, 0), (2, 2, 3, 1, 20, 7, 5, 0, 0), (3, 2, 2, 1, 30, 7, 0, 0, 0), (4, 2, 3, 1, 40, 7, 6, 0, 0),
        (5, 2, 2, 1, 30, 7, 0, 0, 0),  # another record of the same date
    ]
    got = sorted(tuple(r)[4:] for r in trace.intervals(events(spark, rows + rows[1:4])).collect())
    assert got == [(10, 20, 5), (10, 40, 6), (30, 40, 6), (30, 40, 6)]


def test_statistics_and_csv(spark, tmp_path):
    formats, procs = lookups(spark)
    e = events(spark, [(0, 2, 0, 1, 10, 77, 5, 0, 0), (1, 2, 3, 1, 30, 77, 5, 0, 8), (2, 2, 0, 2, 10, 78, 5, 0, 0), (3, 2, 3, 2, 30, 78, 5, 0, 9)])
    table = tt.tasks(e, formats, procs)
    stats = {(r.resource, r.name): (r.n, r.time_ns) for r in tt.exit_statistics(table).collect()}
    assert stats == {(1, "gemm"): (1, 8), (2, "gemm"): (1, 9), (1, None): (1, 8), (2, None): (1, 9), (None, "gemm"): (2, 17), (None, None): (2, 17)}
    tt.write_csv({"task": table}, str(tmp_path))
    made = spark.read.csv(f"{tmp_path}/task.csv", header=True)
    assert made.count() == 2 and made.columns == ["Resource", "Type", "Push", "Start", "End", "Duration", "Name", "TaskId"]
    costs = spark.createDataFrame([("gemm", 80.0, 8.0), ("other", 1.0, 1.0)], "name string, flops double, bytes double")
    total = next(r for r in tt.exit_statistics(table, costs).collect() if r.resource is None and r.name is None)
    assert (total.n, total.flops, total.ai, total.mean_ai) == (2, 160.0, 20.0, 10.0)
