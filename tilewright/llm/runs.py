"""Runs of consecutive equal events, collapsed into one event each.

Canonical events (the ``symbol`` columns; the payload is left out, so
near-identical events are equal) become Unicode code points.  Each sequence
is a string of them, and a regular expression with a backreference matches
every stretch of one repeated symbol; the spans are mapped back to places
and times.  A change of entity or a step of more than ``max_gap`` in time
flips a plane bit of the code point, so no match can run across it.

Sequences are cut by ranges of (entity, time, record) (``plans.ranges``), so
one of any size lies over as many tasks as it needs.  Only the first and the
last run of a range can go on in a neighbour; these, two a range, are stitched
afterwards.

Defined results.  Rows with a null in an entity, symbol, time or record
column are no events.  Equal deliveries of one record (same entity, time and
``record`` columns) count once, as the first of them by symbol.  Order is by time, then ``record``; a
``max_gap`` of None never splits.  A sequence of one event is one run of one.
An empty table gives no runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranges import in_ranges, range_number
from ..plans.storage import materialize

_PLANE = 0x80000  # the bit that flips; symbols stay below it and outside the surrogates
_BASE = 0xE000
#: Symbols are numbered batch by batch; batches of more rows are cut, so any number of symbols can occur.
MAX_SYMBOLS = _PLANE - _BASE


def collapse_runs(
    df: DataFrame,
    entity: list[str],
    symbol: list[str],
    time: str,
    record: str,
    max_gap: int | None = None,
    min_run: int = 1,
) -> DataFrame:
    """(entity, symbol, first_<record>, last_<record>, first_time, last_time, n, duration) per run.

    ``min_run`` keeps runs of at least that many events; 1 gives the whole
    collapsed sequence.
    """
    e, y = [f"_e{i}" for i in range(len(entity))], [f"_y{i}" for i in range(len(symbol))]
    cols = [F.col(c).cast("long").alias(n) for c, n in zip([*entity, *symbol, time, record], [*e, *y, "_time", "_rec"])]
    rows = df.select(*cols).dropna().select(*e, "_time", "_rec", *y)
    out_schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in [*e, *y, "_range", "_r0", "_r1", "_t0", "_t1", "n"]]
        + [T.StructField("_head", T.BooleanType()), T.StructField("_tail", T.BooleanType())]
    )
    found = _Runs(len(e), len(y), max_gap, min_run)
    local = materialize(in_ranges(rows, [*e, "_time", "_rec"], y).mapInArrow(found, out_schema), "runs")
    at_edge = F.col("_head") | F.col("_tail")
    w = W.partitionBy(*e).orderBy("_range", "_t0", "_r0")
    joins = F.lag("_tail").over(w) & F.col("_head") & (F.lag("_range").over(w) != F.col("_range"))
    for s in y:
        joins = joins & (F.lag(s).over(w) == F.col(s))
    if max_gap is not None:
        joins = joins & (F.col("_t0") - F.lag("_t1").over(w) <= max_gap)
    stitched = (
        local.where(at_edge)
        .withColumn("_opens", (~F.coalesce(joins, F.lit(False))).cast("int"))
        .withColumn("_run", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*e, *y, "_run")
        .agg(
            F.min_by("_r0", F.struct("_t0", "_r0")).alias("_r0"),
            F.max_by("_r1", F.struct("_t1", "_r1")).alias("_r1"),
            F.min("_t0").alias("_t0"),
            F.max("_t1").alias("_t1"),
            F.sum("n").alias("n"),
        )
        .where(F.col("n") >= min_run)
    )
    names = [*e, *y, "_r0", "_r1", "_t0", "_t1", "n"]
    out = local.where(~at_edge).select(*names).unionByName(stitched.select(*names))
    back = [F.col(x).cast(df.schema[c].dataType).alias(c) for x, c in zip([*e, *y], [*entity, *symbol])]
    return out.select(
        *back,
        F.col("_r0").alias(f"first_{record}"),
        F.col("_r1").alias(f"last_{record}"),
        F.col("_t0").alias("first_time"),
        F.col("_t1").alias("last_time"),
        "n",
        (F.col("_t1") - F.col("_t0")).alias("duration"),
    )


class _Runs:
    """Finds the runs of a range's sorted sequences, Arrow batch by Arrow batch.

    The last run of a batch stays open as (ends, count), however long it grows,
    and is joined with the first run of the next batch.  The first and the last
    run of the range are given whatever their length, marked as head and tail.
    """

    def __init__(self, n_keys: int, n_symbols: int, max_gap: int | None, least: int):
        self.n_keys, self.n_symbols, self.max_gap, self.least = n_keys, n_symbols, max_gap, least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nk, at_range = self.n_keys, range_number()
        last = None  # identity of the last delivery
        tail = None  # the open run: [keys, symbols, r0, r1, t0, t1, n, head]
        pattern = re.compile(r"(.)\1*" if self.least < 2 else r"(.)\1+", re.S)
        for b in (whole.slice(lo, MAX_SYMBOLS) for whole in batches for lo in range(0, whole.num_rows, MAX_SYMBOLS)):
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            fresh = np.zeros(b.num_rows, bool)
            for x in cols[: nk + 2]:
                fresh[1:] |= x[1:] != x[:-1]
            fresh[0] = last is None or any(x[0] != v for x, v in zip(cols, last))
            last = [x[-1] for x in cols[: nk + 2]]
            if not fresh.all():
                cols = [x[fresh] for x in cols]
            n = len(cols[0])
            if not n:
                continue
            keys, time, rec, sym = cols[:nk], cols[nk], cols[nk + 1], cols[nk + 2 :]
            breaks = np.zeros(n, bool)
            for x in keys:
                breaks[1:] |= x[1:] != x[:-1]
            if self.max_gap is not None:
                breaks[1:] |= time[1:] - time[:-1] > self.max_gap
            _, code = np.unique(np.stack(sym, 1), axis=0, return_inverse=True)
            points = code.reshape(-1).astype(np.uint32) + _BASE
            points += (np.cumsum(breaks) % 2 * _PLANE).astype(np.uint32)
            text = points.astype("<u4").tobytes().decode("utf-32-le")
            spans = np.array([m.span() for m in pattern.finditer(text)], np.int64).reshape(-1, 2)
            starts = np.flatnonzero(np.append(True, points[1:] != points[:-1]))
            lead, trail = int(starts[1]) if len(starts) > 1 else n, int(starts[-1])  # end of the first run, start of the last
            done = 0  # rows of the batch that belong to a run already given
            if tail is None:
                if lead < n:
                    yield self._rows(keys, sym, rec, time, np.array([0]), np.array([lead]), at_range, head=True)
                    done = lead
            else:
                joined = (
                    all(x[0] == v for x, v in zip(keys, tail[0]))
                    and all(x[0] == v for x, v in zip(sym, tail[1]))
                    and (self.max_gap is None or time[0] - tail[5] <= self.max_gap)
                )
                if joined:
                    tail[3], tail[5], tail[6] = rec[lead - 1], time[lead - 1], tail[6] + lead
                    if lead == n:
                        continue
                    done = lead
                yield from self._open(tail, at_range, False)
            s = spans[(spans[:, 1] <= trail) & (spans[:, 0] >= done)]
            s = s[s[:, 1] - s[:, 0] >= self.least]
            if len(s):
                yield self._rows(keys, sym, rec, time, s[:, 0], s[:, 1], at_range)
            head = tail is None and done == 0
            tail = [[x[trail] for x in keys], [x[trail] for x in sym], rec[trail], rec[-1], time[trail], time[-1], n - trail, head]
        if tail is not None:
            yield from self._open(tail, at_range, True)

    def _open(self, t: list, at_range: int, is_tail: bool) -> Iterator[pa.RecordBatch]:
        """The run that was open, if it is long enough or at an end of the range."""
        if t[6] >= self.least or t[7] or is_tail:
            one = lambda v: np.array([v])
            yield self._batch([one(v) for v in t[0]], [one(v) for v in t[1]], *[one(v) for v in t[2:7]], at_range, t[7], is_tail)

    def _rows(self, keys, sym, rec, time, a, z, at_range: int, head: bool = False) -> pa.RecordBatch:
        """The runs from rows ``a`` up to rows ``z``."""
        return self._batch([x[a] for x in keys], [x[a] for x in sym], rec[a], rec[z - 1], time[a], time[z - 1], z - a, at_range, head, False)

    def _batch(self, keys, sym, r0, r1, t0, t1, n, at_range: int, head: bool, tail: bool) -> pa.RecordBatch:
        m = len(r0)
        names = [f"_e{i}" for i in range(len(keys))] + [f"_y{i}" for i in range(len(sym))]
        arrays = [*keys, *sym, np.full(m, at_range), r0, r1, t0, t1, np.asarray(n, np.int64), np.full(m, head), np.full(m, tail)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [*names, "_range", "_r0", "_r1", "_t0", "_t1", "n", "_head", "_tail"])
