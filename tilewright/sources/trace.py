"""Decoded trace records: which are valid, and how starts and ends pair up.

A record is known by (file_id, rpos) and may be delivered several times;
deliveries agree in all but their arrival and name.  A record is valid when
its kid is not null and its date is above 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK, COPY, KERNEL = 2, 7, 8

#: The records of a table of trace events, decoded.
EVENT_SCHEMA = (
    "file_id long, rpos long, evtno int, kind int, kid int, date long, d0 long, d1 long, d2 long, d3 long,"
    " name string, recv_ts timestamp"
)


def is_valid() -> Column:
    return F.col("kid").isNotNull() & (F.col("date") > 0)


def valid_records(events: DataFrame, *columns: str) -> DataFrame:
    """Valid deliveries, only the named columns (pushed to the scan); repeats are kept."""
    return events.where(is_valid()).select(*columns)


def fmtid() -> Column:
    """Format of a record: of tasks d1, of pushed kernels d2, of all others 0."""
    return (
        F.when(F.col("evtno") == TASK, F.col("d1"))
        .when((F.col("evtno") == KERNEL) & (F.col("kind") == 0), F.coalesce(F.col("d2"), F.lit(0)))
        .otherwise(F.lit(0))
        .cast("long")
    )


def intervals(events: DataFrame, evtnos: tuple[int, ...] = (TASK, COPY, KERNEL)) -> DataFrame:
    """(file_id, kid, evtno, d0, start, end, end_d1) of each interval.

    Start and end are valid records of one (file_id, kid) with equal evtno and
    equal non-null d0: tasks from kind 2 to kind 3, copies and kernels from
    kind 1 to kind 2, the end's date above the start's.  Where d0 occurs again
    for the same kid, every start is paired with every later end.  Repeated
    deliveries fall together in the sets of records, so no separate pass
    removes them, and Spark combines before the shuffle.  The key holds d0, so
    no key is large unless one id is used again and again within a file.
    """
    starts, ends = [], []
    for e in evtnos:
        first = 2 if e == TASK else 1
        starts.append((F.col("evtno") == e) & (F.col("kind") == first))
        ends.append((F.col("evtno") == e) & (F.col("kind") == first + 1))

    def any_of(conditions: list[Column]) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out = out | c
        return out

    is_start, is_end = any_of(starts), any_of(ends)
    keys = ("file_id", "kid", "evtno", "d0")
    return (
        events.where(is_valid() & F.col("d0").isNotNull() & F.col("evtno").isin(*evtnos) & (is_start | is_end))
        .groupBy(*keys)
        .agg(
            F.collect_set(F.when(is_start, F.struct("date", "rpos"))).alias("_starts"),
            F.collect_set(F.when(is_end, F.struct("date", "rpos", "d1"))).alias("_ends"),
        )
        .where((F.size("_starts") > 0) & (F.size("_ends") > 0))
        .select(*keys, F.explode("_starts").alias("_s"), "_ends")
        .select(*keys, F.col("_s.date").alias("start"), F.explode("_ends").alias("_e"))
        .select(*keys, "start", F.col("_e.date").alias("end"), F.col("_e.d1").alias("end_d1"))
        .where(F.col("start") < F.col("end"))
    )
