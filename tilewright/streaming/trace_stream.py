"""Intervals of a trace as its records arrive.

Records come in any order, several times, and late.  What is known of one
task, copy or kernel is kept as state under its id; an interval leaves in the
batch in which its second record arrives, once.  No record is dropped for
being late.  An id about which nothing arrives for ``idle`` is closed: its
state is given up, and records that found no partner leave as rows of their
own (``status`` start or end), so that what could not be paired is seen.  State
is thus bounded by the ids of which something arrived within ``idle``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.trace import COPY, EVENT_SCHEMA, KERNEL, TASK, is_valid

_KEYS = ("file_id", "kid", "evtno", "d0")
_OUT = "file_id long, kid int, evtno int, d0 long, start long, end long, end_d1 long, status string"
_STATE = "starts array<struct<date:long,rpos:long,paired:boolean>>, ends array<struct<date:long,rpos:long,d1:long,paired:boolean>>"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the trace record files that appear in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _pairs(key: tuple, frames: Iterator[pd.DataFrame], state, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    """New intervals of one id: every start with every later end, as in the batch form."""
    kept = state.get if state.exists else ((), ())
    starts, ends = ([dict(r.asDict() if hasattr(r, "asDict") else r) for r in side or ()] for side in kept)
    out = []
    if state.hasTimedOut:
        out += [(*key, s["date"], None, None, "start") for s in starts if not s["paired"]]
        out += [(*key, None, e["date"], e["d1"], "end") for e in ends if not e["paired"]]
        state.remove()
    else:
        seen = {r["rpos"] for r in (*starts, *ends)}
        for frame in frames:
            for is_start, date, rpos, d1 in zip(frame["is_start"].tolist(), frame["date"].tolist(), frame["rpos"].tolist(), frame["d1"].astype(object).tolist()):
                if rpos in seen:
                    continue
                seen.add(rpos)
                d1 = None if d1 is None or d1 != d1 else int(d1)
                new = {"date": int(date), "rpos": int(rpos), "paired": False} | ({} if is_start else {"d1": d1})
                for other in ends if is_start else starts:
                    s, e = (new, other) if is_start else (other, new)
                    if s["date"] < e["date"]:
                        s["paired"] = e["paired"] = True
                        out.append((*key, s["date"], e["date"], e["d1"], "interval"))
                (starts if is_start else ends).append(new)
        state.update(([(s["date"], s["rpos"], s["paired"]) for s in starts], [(e["date"], e["rpos"], e["d1"], e["paired"]) for e in ends]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
    columns = [*_KEYS, "start", "end", "end_d1", "status"]
    frame = pd.DataFrame(out, columns=columns)
    yield frame.astype({c: "Int64" for c in (*_KEYS, "start", "end", "end_d1")})


def intervals(events: DataFrame, idle_minutes: float | None = 60.0) -> DataFrame:
    """(file_id, kid, evtno, d0, start, end, end_d1, status), in append mode.

    ``status`` is interval, or start or end for a record that stayed alone.  With
    ``idle_minutes`` None no id is ever closed, which suits a stream that ends
    (``availableNow``); ids are closed by the clock, so a stream with a time
    goes on until it is stopped.
    """
    first = F.when(F.col("evtno") == TASK, 2).otherwise(1)
    is_start, is_end = F.col("kind") == first, F.col("kind") == first + 1
    rows = events.where(is_valid() & F.col("d0").isNotNull() & F.col("evtno").isin(TASK, COPY, KERNEL) & (is_start | is_end))
    rows = rows.select(*_KEYS, "rpos", "date", "d1", is_start.alias("is_start"))
    idle = None if idle_minutes is None else int(idle_minutes * 60_000)
    timeout = "NoTimeout" if idle is None else "ProcessingTimeTimeout"
    return rows.groupBy(*_KEYS).applyInPandasWithState(
        lambda key, frames, state: _pairs(key, frames, state, idle), _OUT, _STATE, "append", timeout
    )
