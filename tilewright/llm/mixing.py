"""Mixing sources to target weights, small ones repeated up to a cap.

Of each source ``min(share * total, max_repeats * size)`` is wanted, so every
document of it has the same expected number of copies.  Systematic sampling
turns expectations into whole copies: documents of a source are laid on a
line, each as long as its expected copies, one random offset is added, and a
copy is emitted for each integer boundary a document crosses.  A source thus
gets its expected number of documents to within one, and no document more
than ``ceil`` of its expectation.

The prefix sums are two-level: documents of the wanted sources are partitioned
by ranges of source and id, numbered within their range, and written; counts
per (source, range) are added up over at most sources + ranges rows, and each
range continues from its own start, so a source that holds most documents lies
over many tasks and there is one shuffle.

Defined results.  Sources are compared without case and without blanks
around.  Documents without a target's source, or with a null one, are not
emitted but count in the total.  Documents of size 0 take part like others;
a source of total size 0, or without documents, gets nothing.  Null sizes are
0.  Duplicate document ids are separate documents, ordered by size.  A null
share or cap is 0.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranges import in_ranges
from ..plans.storage import materialize


def source_key(source: Column) -> Column:
    """A source's name without case and without blanks around."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def source_plan(sized: DataFrame, targets: DataFrame, size: str = "n_tokens") -> DataFrame:
    """(source, target_share, max_repeats, n_docs, size, total, copies, short), a row per target.

    ``copies`` is the expected number of copies of each document; ``short``
    tells that even ``max_repeats`` of every document miss the target.
    ``sized`` has ``source`` and the size column.
    """
    known = F.coalesce(F.col(size).cast("long"), F.lit(0))
    have = sized.groupBy(source_key(F.col("source")).alias("_s")).agg(F.count(F.lit(1)).alias("_docs"), F.sum(known).alias("_size"))
    have = materialize(have, "sources")  # as many rows as there are names; read three times
    total = have.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("total"))
    share, cap = F.coalesce(F.col("target_share"), F.lit(0.0)), F.coalesce(F.col("max_repeats"), F.lit(0))
    plan = (
        targets.select(F.col("source"), source_key(F.col("source")).alias("_t"), share.alias("target_share"), cap.alias("max_repeats"))
        .join(have, F.col("_t") == F.col("_s"), "left")
        .join(F.broadcast(total))
        .withColumn("n_docs", F.coalesce("_docs", F.lit(0)))
        .withColumn("size", F.coalesce("_size", F.lit(0)))
    )
    wanted = F.col("target_share") * F.col("total")
    room = F.col("max_repeats") * F.col("size")
    copies = F.when(F.col("size") > 0, F.least(wanted / F.nullif(F.col("size"), F.lit(0)), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return plan.select("source", "target_share", "max_repeats", "n_docs", "size", "total", copies.alias("copies"), (wanted > room).alias("short"))


def offset_of(source: Column, seed: int) -> Column:
    """One offset per source in [0, 1), from the seed and the name alone: 40 bits of a digest."""
    digest = F.substring(F.md5(F.concat(source, F.lit(f"#{seed}"))), 1, 10)
    return F.conv(digest, 16, 10).cast("double") / (1 << 40)


def mix(
    sized: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    size: str = "n_tokens",
    seed: int = 0,
    plan: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, source, size, copies): the documents of the mix, each with how often it occurs."""
    plan = source_plan(sized, targets, size) if plan is None else plan
    plan = plan.select(source_key(F.col("source")).alias("_t"), "copies").where(F.col("copies") > 0)
    docs = sized.select(F.col(doc_id).alias("_d"), source_key(F.col("source")).alias("_s"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_n"))
    # only documents of a target are moved; Spark broadcasts the plan if it is small
    docs = docs.join(plan.select("_t"), F.col("_s") == F.col("_t"), "left_semi")
    # consecutive numbers within a range: the lower 33 bits, above them the range
    numbered = in_ranges(docs, ["_s", "_d", "_n"]).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialize(numbered, "ranged").withColumn("_range", F.shiftright("_id", 33))
    sums = ranged.groupBy("_s", "_range").agg(F.count(F.lit(1)).alias("_c"), F.min("_id").alias("_first"))
    before = W.partitionBy("_s").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("_s").alias("_s2"), F.col("_range").alias("_range2"), (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    starts = starts.join(plan, F.col("_s2") == F.col("_t")).withColumn("_u", offset_of(F.col("_s2"), seed)).drop("_t")
    # at most targets + ranges rows
    placed = ranged.join(F.broadcast(starts), (F.col("_s") == F.col("_s2")) & (F.col("_range") == F.col("_range2")))
    k = F.col("_id") + F.col("_shift") + 1  # place among the source's documents, from 1
    crossed = F.floor(k * F.col("copies") + F.col("_u")) - F.floor((k - 1) * F.col("copies") + F.col("_u"))
    return placed.select(F.col("_d").alias(doc_id), F.col("_s").alias("source"), F.col("_n").alias(size), crossed.cast("int").alias("copies")).where(F.col("copies") > 0)


def actual_shares(mixed: DataFrame, plan: DataFrame, size: str = "n_tokens") -> DataFrame:
    """(source, target_share, max_repeats, short, docs, copies, tokens, actual_share) of a mix.

    ``short`` is read off the mix: every document of the source came out
    ``max_repeats`` times (or there was nothing to come out), and still its
    tokens miss the share of the total.
    """
    got = mixed.groupBy(F.col("source").alias("_g")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("_copies"), F.sum(F.col(size) * F.col("copies")).alias("tokens")
    )
    joined = plan.drop("copies", "short").join(got, source_key(F.col("source")) == F.col("_g"), "left")
    tokens, copies = F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("_copies"), F.lit(0))
    everything = F.sum(tokens).over(W.partitionBy())  # a row per target
    used_up = (copies == F.col("max_repeats") * F.col("n_docs")) | (F.col("size") == 0)
    return joined.select(
        "source", "target_share", "max_repeats", (used_up & (F.col("target_share") * F.col("total") > tokens)).alias("short"),
        F.coalesce("docs", F.lit(0)).alias("docs"), copies.alias("copies"), tokens.alias("tokens"),
        (tokens / F.nullif(everything, F.lit(0))).alias("actual_share"),
    )
