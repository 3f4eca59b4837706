"""Per-key results when a few keys hold most rows.

Value-frequency compression: rows are grouped by key *and* value before they
are grouped by key.  The first grouping spreads a hot key over all tasks and
leaves one weighted row per distinct (key, value); row counts, exact distinct
counts and modes then follow from an aggregate whose partial results are
combined before the second, tiny shuffle, and percentiles from prefix sums of
the weights over a range-partitioned table.  No task ever holds a key.

Defined results.  A null key is a key.  A null value is counted in ``n`` but
is no value: it adds nothing to distinct counts, modes and percentiles, which
are 0 or null for keys without any value.  Ties of the mode go to the
smallest value.  An empty table gives no rows.  Input columns other than key
and value are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import materialize


def value_frequencies(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values, n): the distinct (key, value) rows and how often each occurs."""
    return df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, n, n_distinct): rows and exact distinct combinations of ``values`` per key."""
    known = F.lit(True)
    for v in values:
        known = known & F.col(v).isNotNull()
    return (
        value_frequencies(df, keys, values)
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.sum(known.cast("long")).alias("n_distinct"))
    )


def key_statistics(
    df: DataFrame, keys: list[str], value: str, percentiles: tuple[float, ...] = ()
) -> DataFrame:
    """(keys, n, n_distinct, mode, mode_n[, percentile columns p50, p90, …]).

    Percentiles are nearest-rank, exact, over the non-null values.
    """
    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    by = [f"_k{i}" for i in range(len(keys))]
    freq = df.select(*cols, F.col(value).alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if percentiles:
        freq = _ranged(freq, by)
    known = F.col("_v").isNotNull()
    # the least struct is the most frequent value, of equals the smallest
    best = F.min(F.when(known, F.struct((-F.col("_n")).alias("c"), F.col("_v").alias("v"))))
    stats = freq.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum(known.cast("long")).alias("n_distinct"), best.alias("_best")
    )
    stats = stats.withColumn("mode", F.col("_best.v")).withColumn("mode_n", F.coalesce(-F.col("_best.c"), F.lit(0)))
    stats = stats.drop("_best")
    if percentiles:
        stats = _join(stats, _percentiles(freq.where(known), by, percentiles), by)
    return stats.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[c for c in stats.columns if c not in by])


def percentile_name(p: float) -> str:
    return "p" + f"{100 * p:g}".replace(".", "_")


def _join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    right = right.select(*[F.col(b).alias(f"{b}r") for b in by], *[c for c in right.columns if c not in by])
    on: Column = F.lit(True)
    for b in by:
        on = on & left[b].eqNullSafe(right[f"{b}r"])
    return left.join(right, on, "left").drop(*[f"{b}r" for b in by])


def _ranged(freq: DataFrame, by: list[str]) -> DataFrame:
    """Weighted rows in key and value order, written with the number of their
    range: a hot key lies over several ranges, each of bounded size."""
    return materialize(
        freq.repartitionByRange(*[F.col(b) for b in by], F.col("_v")).withColumn("_pid", F.spark_partition_id()), "ranged"
    )


def _percentiles(freq: DataFrame, by: list[str], percentiles: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles by weighted prefix sums, per range then within.

    The sums per (key, range) are at most keys + ranges rows.  Only ranges
    that hold a target rank are looked into.
    """
    sums = freq.groupBy(*by, "_pid").agg(F.sum("_n").alias("_m"))
    order = W.partitionBy(*by).orderBy("_pid")
    total = W.partitionBy(*by)
    places = sums.select(
        *by,
        "_pid",
        (F.sum("_m").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_m")).alias("_off"),
        "_m",
        F.sum("_m").over(total).alias("_total"),
    )
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(percentiles)])
    wanted = (
        places.select("*", F.explode(targets).alias("_t"))
        .withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_t.p") * F.col("_total"))).cast("long"))
        .where((F.col("_off") < F.col("_rank")) & (F.col("_rank") <= F.col("_off") + F.col("_m")))
        .groupBy(*by, "_pid", "_off")
        .agg(F.collect_list(F.struct(F.col("_t.i").alias("i"), F.col("_rank").alias("r"))).alias("_want"))
    )
    wanted = wanted.select(*[F.col(b).alias(f"{b}w") for b in by], F.col("_pid").alias("_pidw"), "_off", "_want")
    on = freq["_pid"] == wanted["_pidw"]
    for b in by:
        on = on & freq[b].eqNullSafe(wanted[f"{b}w"])
    within = W.partitionBy(*by, "_pid").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    found = (
        freq.join(wanted, on)
        .withColumn("_upto", F.col("_off") + F.sum("_n").over(within))
        .select(*by, "_v", "_n", "_upto", F.explode("_want").alias("_w"))
        .where((F.col("_upto") - F.col("_n") < F.col("_w.r")) & (F.col("_w.r") <= F.col("_upto")))
    )
    return found.groupBy(*by).agg(
        *[F.max(F.when(F.col("_w.i") == i, F.col("_v"))).alias(percentile_name(p)) for i, p in enumerate(percentiles)]
    )
