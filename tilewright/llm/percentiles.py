"""Medians and other percentiles per group by bisection on value intervals.

``percentiles`` keeps, for every group and wanted rank, an interval of values
that holds the value of that rank, and how many values lie below it.  Each
pass counts the rows below 127 midpoints of the interval at once (seven
halvings), the rank picks one part, and the part's own least and greatest
value become the next interval, until they are equal (exact) or within the
stated relative error.

``summarise``, ``combine`` and ``percentiles_of`` do the same on one fixed
dyadic grid: a summary of each file or day is a table of counts per grid
cell, summaries add up, and every percentile of the sum is within
``2**-bits`` of the true one.

Counting is one aggregate per pass, combined before the shuffle, so a group
of any size sends at most 128 counts per rank and task.  After the first
pass only rows inside some open interval are read again.  Intervals reach
the rows by broadcast up to ``BROADCAST_STATE`` state rows and by a join
salted ``SALT`` ways beyond it.

Defined results.  Null and NaN values are left out; a group without any
other value gives no row.  A null key is a group of its own.  Repeated values
all count.  An empty table gives an empty result.  ``interpolate`` takes the
linear point between the two neighbouring ranks, otherwise the value at the
ceiling rank is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import discard, materialize

BROADCAST_STATE = 200_000
SALT = 32
PARTS = 128
_MAX_PASSES = 200


def percentile_name(p: float) -> str:
    return "p" + f"{100 * p:g}".replace(".", "_")


def _part(x: Column, lo: Column, hi: Column, integers: bool) -> Column:
    """Which of the 128 parts of [lo, hi] holds ``x``: a monotone function that
    separates lo from hi, also where the width overflows or is infinite."""
    half = lambda c: c.cast("double") / 2
    share = (half(x) - half(lo)) / F.nullif(half(hi) - half(lo), F.lit(0.0))
    if integers:
        width = F.try_subtract(hi, lo)
        share = F.when(width.isNotNull(), F.try_subtract(x, lo).cast("double") / F.nullif(width.cast("double"), F.lit(0.0))).otherwise(share)
    ends = F.when(x <= lo, 0).when(x >= hi, PARTS - 1)
    odd = share.isNull() | F.isnan(share) | (F.abs(half(hi) - half(lo)) == F.lit(float("inf")))
    inner = F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), F.floor(share * PARTS).cast("int")))
    return ends.otherwise(F.when(odd, F.lit(1)).otherwise(inner)).cast("int")


def _attach(data: DataFrame, state: DataFrame, by: list[str], n_state: int) -> DataFrame:
    """Rows with each open interval of their group that holds them."""
    names = {b: f"{b}s" for b in by}
    state = state.select(*[F.col(b).alias(names[b]) for b in by], *[c for c in state.columns if c not in by])
    on = F.lit(True)
    for b in by:
        on = on & data[b].eqNullSafe(state[names[b]])
    if n_state <= BROADCAST_STATE:
        joined = data.join(F.broadcast(state), on)
    else:
        data = data.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
        state = state.withColumn("_saltS", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        on = data["_salt"] == state["_saltS"]
        for b in by:
            on = on & data[b].eqNullSafe(state[names[b]])
        joined = data.join(state.hint("shuffle_hash"), on).drop("_salt", "_saltS")
    return joined.drop(*names.values()).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))


def percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: tuple[float, ...] = (0.5,),
    rel_error: float = 0.0,
    interpolate: bool = False,
) -> DataFrame:
    """(keys, n, p50, p90, ...) as doubles, one row per group."""
    by = [f"_k{i}" for i in range(len(keys))]
    kind = df.schema[value].dataType.simpleString()
    integers = kind in ("tinyint", "smallint", "int", "bigint")
    data = df.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.col(value).cast("long" if integers else "double").alias("_x"))
    data = data.where(F.col("_x").isNotNull() & ~F.isnan(F.col("_x").cast("double")))
    data = materialize(data, "values")
    sizes = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = lambda p: (F.lit(p) * (F.col("_n") - 1))
    wanted = []
    for i, p in enumerate(probs):
        if interpolate:
            wanted += [F.struct(F.lit(2 * i + k).alias("_t"), f(place(p)).cast("long").alias("_rank")) for k, f in enumerate((F.floor, F.ceil))]
        else:
            wanted.append(F.struct(F.lit(2 * i).alias("_t"), (F.greatest(F.ceil(F.lit(p) * F.col("_n")), F.lit(1)) - 1).cast("long").alias("_rank")))
    # a row per interval with the ranks that lie in it: at first one interval per group
    state = sizes.select(*by, "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.array(*wanted).alias("_want"))
    state = materialize(state, "state")
    width = F.col("_hi").cast("double") - F.col("_lo").cast("double")
    is_open = (F.col("_lo") < F.col("_hi")) & ~(F.coalesce(width <= rel_error * F.abs(F.col("_lo").cast("double")), F.lit(False)) & F.lit(rel_error > 0))
    done: DataFrame | None = None
    for turn in range(_MAX_PASSES):
        n_open = state.where(is_open).count()
        finished = state.where(~is_open)
        done = finished if done is None else done.unionByName(finished)
        if not n_open:
            break
        state = state.where(is_open)
        if turn == 1:  # what lies in no open interval is done with
            spans = state.groupBy(*by).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
            everything, data = data, materialize(_attach(data, spans, by, n_open).select(*by, "_x"), "inside")
            discard(everything)
        counts = (
            _attach(data, state, by, n_open)
            .groupBy(*by, "_n", "_below", "_want", _part(F.col("_x"), F.col("_lo"), F.col("_hi"), integers).alias("_part"))
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        )
        upto = F.sum("_c").over(W.partitionBy(*by, "_below").orderBy("_part").rowsBetween(W.unboundedPreceding, 0))
        inside = F.filter("_want", lambda w: (F.col("_upto") - F.col("_c") <= w["_rank"]) & (w["_rank"] < F.col("_upto")))
        state = materialize(
            counts.withColumn("_upto", F.col("_below") + upto)
            .withColumn("_want", inside)
            .where(F.size("_want") > 0)
            .select(*by, "_n", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_below"), "_want"),
            "state",
        )
    else:
        raise RuntimeError("the bisection did not end")
    done = done.select(*by, "_n", "_lo", F.explode("_want").alias("_w")).select(*by, "_n", "_lo", "_w._t")
    at = lambda t: F.max(F.when(F.col("_t") == t, F.col("_lo").cast("double")))
    cells = done.groupBy(*by).agg(F.max("_n").alias("n"), *[at(t).alias(f"_v{t}") for i in range(len(probs)) for t in (2 * i, 2 * i + 1)[: 1 + interpolate]])
    out = []
    for i, p in enumerate(probs):
        v = F.col(f"_v{2 * i}")
        if interpolate:
            share = F.lit(p) * (F.col("n") - 1)
            v = v + (F.col(f"_v{2 * i + 1}") - v) * (share - F.floor(share))
        out.append(v.alias(percentile_name(p)))
    return cells.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], "n", *out)


def grid_cell(x: Column, bits: int) -> Column:
    """Lower end (towards 0) of the dyadic cell of a long: all but its leading ``bits`` + 1 bits cleared."""
    # the least long has no positive counterpart; it shares the cell of the next one
    size = F.abs(F.greatest(x, F.lit(-(2**63) + 1)))
    shift = F.greatest(F.length(F.bin(size)) - (bits + 1), F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)
    return F.when(x < 0, -low).otherwise(low)


def summarise(df: DataFrame, keys: list[str], value: str, bits: int = 7) -> DataFrame:
    """(keys, cell, n): a mergeable summary of integer values, at most
    64 * 2**bits cells per sign and group whatever the number of rows."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys, grid_cell(F.col(value).cast("long"), bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def combine(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of summaries (of files, days, partitions) made with equal ``bits``."""
    return summaries.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))


def percentiles_of(summary: DataFrame, keys: list[str], probs: tuple[float, ...]) -> DataFrame:
    """(keys, n, p50, ...): the grid cell of each ceiling rank.

    The true value is within a factor 1 + 2**-bits of the cell given.
    """
    order = W.partitionBy(*keys).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    marked = summary.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(W.partitionBy(*keys)))
    rank = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("_all")), F.lit(1))
    cells = [F.min(F.when(F.col("_upto") >= rank(p), F.col("cell"))).alias(percentile_name(p)) for p in probs]
    return marked.groupBy(*keys).agg(F.sum("n").alias("n"), *cells)
