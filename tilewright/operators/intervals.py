"""Overlapping, nested and gapped intervals per entity.

``busy_periods`` merges the intervals of each entity into continuous periods
(periods that touch are one) and ``gaps`` lists what lies between two
successive periods.  Both are two-level: intervals, ordered by entity and
start, are cut into shards (``plans.ranges``), so that an entity of any size
lies over as many shards as it needs.  Each shard is merged locally.  What
reaches over a shard's end is clipped to the shards it covers, as one coverage
per entity and shard, and stitched: local periods that the coverage touches
coalesce.  Only the first and last entity of a shard can have such
coverage, so there are at most two summaries a shard.

Defined results.  An interval with a null entity column belongs to the
entity of that null; one with a null start or end, or an end not above its
start, gives nothing.  Repeated intervals change nothing but ``n_intervals``.
Start and end are whole numbers.  An empty table gives an empty result.
Columns other than the entity, start and end are ignored, so clashing names
cannot occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranges import in_ranges, range_number
from ..plans.storage import materialize


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before in some column; nulls are equal to each other."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        other = pc.if_else(pc.is_null(pc.not_equal(a, b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
        out[1:] |= other.to_numpy(zero_copy_only=False)
    return out


def running_max(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Greatest value so far within each stretch that a True of ``new`` opens."""
    order = np.sort(x)
    key = np.cumsum(new) * len(x) + np.searchsorted(order, x)
    return order[np.maximum.accumulate(key) - np.cumsum(new) * len(x)]


class _Merge:
    """Merges the ordered intervals of a shard, batch by batch.

    The last period of a batch stays open and goes before the next batch as one
    interval.  Rows: (keys, start, end, intervals, end of the period before it
    in this shard, shard, False) for a period, and (keys, least start, greatest
    end, ..., True) for the first and the last entity of the shard.
    """

    def __init__(self, n_keys: int):
        self.n_keys = n_keys

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, shard = self.n_keys, range_number()
        held = None  # the open period as one row: [keys..., start, end, n, before]
        first = None  # summary of the shard's first entity, until it ends: [keys, lo, hi]
        last = None  # [keys, lo, hi] of the entity at hand
        for b in batches:
            if not b.num_rows:
                continue
            cols = list(b.columns)
            n = np.ones(b.num_rows, np.int64)
            before0 = None
            if held is not None:
                cols = [pa.concat_arrays([h, c]) for h, c in zip(held[0], cols)]
                n = np.concatenate([[held[1]], n])
                before0 = held[2]
            keys, s, t = cols[:k], cols[k].to_numpy(), cols[k + 1].to_numpy()
            new = changes(keys) if k else np.zeros(len(s), bool)
            if held is None:
                new[0] = True
            begins = new.copy()
            begins[0] = True
            upto = running_max(t, begins)
            opens = begins.copy()
            opens[1:] |= upto[:-1] < s[1:]
            at = np.flatnonzero(opens)
            start, end, count = s[at], np.maximum.reduceat(t, at), np.add.reduceat(n, at)
            fresh = new[at]
            before = np.empty(len(at), np.int64)
            before[1:] = end[:-1]
            before[0] = before0 if before0 is not None else 0
            known = ~fresh
            known[0] = before0 is not None and not fresh[0]
            # the entities of this batch, in order
            e = np.flatnonzero(begins)
            lo, hi = s[e], np.maximum.reduceat(t, e)
            for x in range(len(e)) if len(e) < 3 else (0, len(e) - 1):
                row = [c.slice(int(e[x]), 1) for c in keys]
                if last is not None and x == 0 and not new[0]:
                    last[2] = max(last[2], hi[0])
                else:
                    if last is not None and first is None:
                        first = last
                    last = [row, lo[x], hi[x]]
            if len(at) > 1:
                yield self._rows([c.take(pa.array(at[:-1])) for c in keys], start[:-1], end[:-1], count[:-1], before[:-1], known[:-1], shard, False)
            z = len(at) - 1
            one = [c.slice(int(at[z]), 1) for c in keys]
            held = ([*one, pa.array(start[z:]), pa.array(end[z:])], int(count[z]), int(before[z]) if known[z] else None)
        if held is not None:
            zero = np.array([0 if held[2] is None else held[2]])
            row, s, t = held[0][:k], held[0][k].to_numpy(), held[0][k + 1].to_numpy()
            yield self._rows(row, s, t, np.array([held[1]]), zero, np.array([held[2] is not None]), shard, False)
            for side in (first, last):
                if side is not None:
                    yield self._rows(side[0], np.array([side[1]]), np.array([side[2]]), np.array([0]), np.array([0]), np.array([False]), shard, True)

    def _rows(self, keys, s, t, n, before, known, shard: int, summary: bool) -> pa.RecordBatch:
        m = len(s)
        arrays = [*keys, pa.array(s), pa.array(t), pa.array(n), pa.array(before, mask=~known), pa.array(np.full(m, shard)), pa.array(np.full(m, summary))]
        return pa.RecordBatch.from_arrays(arrays, [*[f"_e{i}" for i in range(self.n_keys)], "_s", "_t", "_n", "_before", "_shard", "_summary"])


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = left["_shard"] == right["_shard_"]
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"{k}_"])
    return on


def _merged(df: DataFrame, entity: list[str], start: str, end: str) -> tuple[DataFrame, list[str]]:
    """Local periods, each with the clipped coverage of its shard.

    ``_cover`` is how far intervals of earlier shards cover this one (null: not
    at all), ``_last`` the greatest end in the shard where the entity lies over
    several shards (null otherwise).
    """
    keys = [f"_e{i}" for i in range(len(entity))]
    rows = df.select(*[F.col(e).alias(k) for e, k in zip(entity, keys)], F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_t"))
    rows = rows.where(F.col("_s") < F.col("_t"))
    longs = [T.StructField(c, T.LongType()) for c in ("_s", "_t", "_n", "_before", "_shard")]
    schema = T.StructType([*[rows.schema[k] for k in keys], *longs, T.StructField("_summary", T.BooleanType())])
    local = materialize(in_ranges(rows, [*keys, "_s", "_t"]).mapInArrow(_Merge(len(keys)), schema), "periods")
    # at most two rows a shard, so also what is broadcast below
    order = W.partitionBy(*keys).orderBy("_shard")
    ends = local.where("_summary").groupBy(*keys, "_shard").agg(F.max("_t").alias("_t"))
    ends = ends.withColumn("_reach", F.max("_t").over(order.rowsBetween(W.unboundedPreceding, -1)))
    ends = ends.withColumn("_shards", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("_shards") > 1)
    clipped = F.when(F.col("_reach").isNotNull(), F.least("_reach", "_t"))
    split = ends.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_shard").alias("_shard_"), F.col("_reach"), clipped.alias("_cover"), F.col("_t").alias("_last"))
    periods = local.where(~F.col("_summary"))
    return periods.join(F.broadcast(split), _same(periods, split, keys), "left").drop(*[f"{k}_" for k in keys], "_shard_"), keys


def _named(df: DataFrame, entity: list[str], keys: list[str], **names: str) -> DataFrame:
    return df.select(*[F.col(k).alias(e) for e, k in zip(entity, keys)], *[F.col(c).alias(n) for c, n in names.items()])


def gaps(df: DataFrame, entity: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(entity, gap_start, gap_end) between successive busy periods."""
    periods, keys = _merged(df, entity, start, end)
    covered = F.greatest("_before", "_reach")  # of what is known
    found = periods.withColumn("_from", covered).where(F.col("_from") < F.col("_s"))
    return _named(found, entity, keys, _from="gap_start", _s="gap_end")


def busy_periods(df: DataFrame, entity: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(entity, period_start, period_end, n_intervals), one row per busy period."""
    periods, keys = _merged(df, entity, start, end)
    names = {"_s": "period_start", "_t": "period_end", "_n": "n_intervals"}
    under = F.coalesce(F.col("_s") <= F.col("_cover"), F.lit(False))
    edge = under | F.coalesce(F.col("_t") == F.col("_last"), F.lit(False))
    marked = periods.withColumn("_under", under).withColumn("_edge", edge)
    # what the coverage touches is one period, and so is the one that reaches furthest: two rows a shard at most
    touched = marked.where("_edge").groupBy(*keys, "_shard", "_under").agg(F.min("_s").alias("_s"), F.max("_t").alias("_t"), F.sum("_n").alias("_n"))
    chain = W.partitionBy(*keys).orderBy("_s", "_t")
    joined = (
        touched.withColumn("_upto", F.max("_t").over(chain.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_opens", (F.col("_upto").isNull() | (F.col("_upto") < F.col("_s"))).cast("int"))
        .withColumn("_island", F.sum("_opens").over(chain.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min("_s").alias("_s"), F.max("_t").alias("_t"), F.sum("_n").alias("_n"))
    )
    inner = marked.where(~F.col("_edge"))
    return _named(inner, entity, keys, **names).unionByName(_named(joined, entity, keys, **names))
