"""Rows of all entities in one order, cut into ranges of like size.

Operators per entity need its rows in order.  Partitioned by a hash of the
entity, the rows of one that holds a third of the table all meet in one task.
Here rows are partitioned by ranges of (entity, order) instead: Spark samples
the keys, so ranges are of like size whatever the entities' sizes are, a huge
entity lies over as many of them as its rows need, and nothing is counted,
capped or switched.  A task streams its range in order and finishes every
entity but the first and the last one, which may go on in a neighbour; of
these it leaves a summary, and a second, small step stitches at most two
summaries a range.  What the first step makes is written to the shared folder
before it is read twice, so that both readers see the same ranges.

``ranges_for`` chooses how many: at least as many as the session shuffles to,
and more where the tables that are read are so large that a range would exceed
``RANGE_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

RANGE_BYTES = 512 << 20
MAX_RANGES = 200_000
_UNKNOWN = 1 << 60


def ranges_for(size_bytes: int, at_least: int) -> int:
    """Number of ranges for a table of that size."""
    return max(1, at_least, min(MAX_RANGES, -(-size_bytes // RANGE_BYTES)))


def estimated_bytes(df: DataFrame) -> int:
    """Size of the tables a plan reads, as Catalyst knows it without running anything; 0 for tables of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < _UNKNOWN)


def in_ranges(df: DataFrame, keys: list[str], then: list[str] = ()) -> DataFrame:
    """``df`` partitioned by ranges of ``keys`` and sorted within them by ``keys``, then ``then``.

    Rows of equal ``keys`` lie in one range.  The number of ranges is fixed, so
    that Spark neither joins nor splits them and a partition's number is its
    place in the order.
    """
    lanes = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = ranges_for(estimated_bytes(df), lanes)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys, *then)


def range_number() -> int:
    """In a task: the place of its range."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId() if task else 0
