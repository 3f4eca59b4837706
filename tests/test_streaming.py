import datetime as dt

from tilewright.sources import trace
from tilewright.streaming import trace_stream


def test_intervals_equal_the_batch_operator(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        rows.append((1, 2 * i, 2, 2, 1, 100 + i, i, 9, 0, 0, None, at))
        rows.append((1, 2 * i + 1, 2, 3, 1, (100 + i if i % 10 == 0 else 150 + i), i, 5 if i % 7 else None, 0, 0, None, at))
    rows += rows[::9] + [(1, 500, 8, 1, 1, 5, 1, 0, 0, 0, None, at), (1, 501, 7, 2, None, 5, 1, 0, 0, 0, None, at)]
    # a start and an end that arrive days apart are still one interval, and one start has no end
    rows += [(2, 0, 2, 2, 1, 5, 1, 0, 0, 0, None, at), (2, 2, 2, 2, 1, 5, 2, 0, 0, 0, None, at)]
    late = [(2, 1, 2, 3, 1, 9, 1, 4, 0, 0, None, at + dt.timedelta(days=3)), (2, 3, 2, 3, 1, 30, 1, 5, 0, 0, None, at - dt.timedelta(days=3))]
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(rows, trace.EVENT_SCHEMA)
    df.orderBy("rpos").limit(50).coalesce(1).write.mode("append").parquet(folder)
    df.orderBy("rpos").offset(50).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame(late, trace.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = trace_stream.intervals(trace_stream.read_events(spark, folder, 1), None)
    q = stream.writeStream.format("memory").queryName("found_intervals").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    found = spark.table("found_intervals").where("status = 'interval'").drop("status")
    got = sorted(map(str, found.collect()))
    whole = df.unionByName(spark.createDataFrame(late, trace.EVENT_SCHEMA))
    assert got == sorted(map(str, trace.intervals(whole).collect())) and len(got) == 56


def test_what_stays_alone_is_given_when_an_id_is_closed():
    import pandas as pd

    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.get, self.exists = value, True

        def setTimeoutDuration(self, ms):
            self.ms = ms

        def remove(self):
            self.exists = False

    def rows(*records):
        return iter([pd.DataFrame(records, columns=["is_start", "date", "rpos", "d1"])])

    def run(frames, state):
        frames = [f.astype(object).where(f.notna(), None) for f in trace_stream._pairs((1, 1, 2, 7), frames, state, 1000)]
        return [tuple(r)[4:] for f in frames for r in f.itertuples(index=False)]

    state, plain = State(), lambda side, names: tuple(dict(zip(names, r)) for r in side)
    assert run(rows((True, 10, 0, None), (True, 50, 1, None), (False, 5, 2, 3)), state) == [] and state.ms == 1000
    again = lambda: setattr(state, "get", (plain(state.get[0], ("date", "rpos", "paired")), plain(state.get[1], ("date", "rpos", "d1", "paired"))))
    again()
    assert run(rows((False, 20, 3, 8), (False, 20, 3, 8)), state) == [(10, 20, 8, "interval")]
    again()
    state.hasTimedOut = True
    assert run(iter(()), state) == [(50, None, None, "start"), (None, 5, 3, "end")] and not state.exists


def test_settings(spark):
    import pytest

    from tilewright.plans.matrix import Matrix
    from tilewright.plans.settings import Settings, keep, release, sync

    s = Settings.from_environment({"TILEWRIGHT_TILE": "64", "TILEWRIGHT_THRESHOLD": "2.5"})
    assert (s.tile, s.devices, s.threshold, s.threshold_of("trsm")) == (64, 8, 2.5, 2.5)
    assert s.with_devices(99, 4).devices == 4 and s.with_tile(0).tile == 0
    for bad in (lambda: s.with_devices(0, 4), lambda: s.with_tile(-1)):
        with pytest.raises(ValueError):
            bad()
    m = Matrix(spark.createDataFrame([(0, 0, 1.0)], "i long, j long, v double"), 1, 1)
    (done,) = sync(m)
    kept = keep(done)
    assert kept.df.count() == 1
    release(kept, m.df)
