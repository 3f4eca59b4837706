"""Where tiles go: block-cyclic maps, placement, and results brought back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.matrix import Matrix, upper_letter

# fixed values: the codes of the triangles
ALL, UPPER, LOWER = 0, 121, 122


def tile_grid(spark, nrows: int, ncols: int, mb: int, nb: int) -> DataFrame:
    """(ti, tj, rows, cols, pos): every tile of a matrix, the last ones ragged."""
    mt, nt = -(-nrows // mb), -(-ncols // nb)
    grid = spark.range(mt * nt).select(F.expr(f"id div {max(nt, 1)}").alias("ti"), F.expr(f"id % {max(nt, 1)}").alias("tj"))
    return grid.select(
        "ti", "tj",
        F.least(F.lit(mb), F.lit(nrows) - F.col("ti") * mb).cast("int").alias("rows"),
        F.least(F.lit(nb), F.lit(ncols) - F.col("tj") * nb).cast("int").alias("cols"),
        (F.col("ti") * nt + F.col("tj")).alias("pos"),
    )


def block_cyclic_2d(ti: Column, tj: Column, bp: int, bq: int, gp: int, gq: int, count: int) -> Column:
    """Device of tile (ti, tj) with blocks of bp x bq tiles over a gp x gq grid."""
    return ((F.floor(ti / bp) % gp) * gq + F.floor(tj / bq) % gq) % count


def block_cyclic_1d(ti: Column, tj: Column, block: int, devices: int, by_row: bool, count: int) -> Column:
    return block_cyclic_2d(ti, tj, block, 1, devices, 1, count) if by_row else block_cyclic_2d(ti, tj, 1, block, 1, devices, count)


def cyclic(ti: Column, tj: Column, nt: int, count: int) -> Column:
    return (ti * nt + tj) % count


def diagonal_cyclic(ti: Column, tj: Column, count: int) -> Column:
    return (ti + tj) % count


def single(ti: Column, tj: Column, device: int, count: int) -> Column:
    """Every tile on one device."""
    if not 0 <= device < count:
        raise ValueError(f"no device {device} among {count}")
    return F.lit(device).cast("long")


def auto_grid(devices: int) -> tuple[int, int]:
    """The grid for a number of devices: its largest divisor not above floor(sqrt) + 1, and the rest."""
    if devices < 1:
        raise ValueError("at least one device is needed")
    rows = next(g for g in range(int(devices**0.5) + 1, 0, -1) if devices % g == 0)
    return rows, devices // rows


def assign(tiles: DataFrame, device: Column, force: bool = True, name: str = "pid") -> DataFrame:
    """Tiles with their device; without ``force``, tiles that have one keep it."""
    if name in tiles.columns and not force:
        device = F.coalesce(F.col(name), device)
    return tiles.withColumn(name, device.cast("int"))


def distribute(tiles: DataFrame, count: int, name: str = "pid") -> DataFrame:
    """Tiles of device k in partition k, and of no other; without a device, in partition 0."""
    return tiles.repartitionById(count, F.col(name).cast("int"))


def coherent(m: Matrix, mb: int, nb: int, uplo: int | str = ALL, invalidate: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(entries of the tiles brought back, entries of the tiles dropped if ``invalidate``)."""
    if uplo in (ALL, "0"):
        return m.df, (m.df.limit(0) if invalidate else None)
    u = "U" if uplo == UPPER else "L" if uplo == LOWER else upper_letter("coherent", "uplo", uplo, "LU", -1)
    ti, tj = F.floor(F.col("i") / mb), F.floor(F.col("j") / nb)
    keep = ti <= tj if u == "U" else ti >= tj
    return m.df.where(keep), (m.df.where(~keep) if invalidate else None)


def load_statistics(queue: DataFrame, device: str = "device", load: str = "load") -> DataFrame:
    """(min, max, avg, deviation, busiest, n_idle) of pending work over devices."""
    q = queue.select(F.col(device).alias("_d"), F.col(load).cast("double").alias("_l")).where(F.col("_l").isNotNull())
    sums = q.agg(F.min("_l").alias("min_load"), F.max("_l").alias("max_load"), F.avg("_l").alias("avg_load"), F.sum((F.col("_l") == 0).cast("long")).alias("n_idle"))
    joined = q.join(F.broadcast(sums))  # one row
    return joined.groupBy("min_load", "max_load", "avg_load", "n_idle").agg(
        F.sum(F.abs(F.col("_l") - F.col("avg_load"))).alias("deviation"),
        F.sort_array(F.collect_list(F.when(F.col("_l") == F.col("max_load"), F.col("_d")))).alias("busiest"),
    )


def affinity(replicas: DataFrame, devices: DataFrame) -> DataFrame:
    """(task, device, local, same_kind, other): the best device of each task.

    ``replicas``: (task, device, kind, bytes, readwrite) of each valid replica of
    an operand; bytes count twice where it is read and written.  ``devices``:
    (device, kind), the candidates.  Scores compare in the order local, same
    kind, other; of equals the lowest device wins.  Replicas of an unknown kind
    count as other.

    A device without a replica of the task scores by its kind alone, so of each
    kind only the lowest such device can win: candidates are the devices that hold
    something and the first of each kind that does not, never all pairs.
    """
    weight = F.col("bytes") * F.when(F.col("readwrite"), 2).otherwise(1)
    held = replicas.groupBy("task", F.col("device").alias("_at"), F.col("kind").alias("_kind")).agg(F.sum(weight).alias("_w"))
    sums = held.groupBy("task", "_kind").agg(F.sum("_w").alias("_wk"), F.collect_set("_at").alias("_holders"))
    per_task = sums.groupBy("task").agg(F.sum("_wk").alias("_all"), F.map_from_entries(F.collect_list(F.when(F.col("_kind").isNotNull(), F.struct("_kind", "_wk")))).alias("_by"), F.flatten(F.collect_list("_holders")).alias("_on"))
    # the devices of a kind in order: one short list per kind
    kinds = devices.groupBy("kind").agg(F.sort_array(F.collect_set("device")).alias("_devices"))
    lists = kinds.agg(F.collect_list(F.struct("kind", "_devices")).alias("_kinds"))  # one row
    local = held.join(devices.select(F.col("device").alias("_d"), F.col("kind").alias("_dk")), F.col("_at") == F.col("_d"))
    local = local.groupBy("task", F.col("_at").alias("device"), F.col("_dk").alias("kind")).agg(
        F.sum("_w").alias("local"), F.sum(F.when(F.col("_kind") == F.col("_dk"), F.col("_w")).otherwise(0)).alias("_mine")
    )
    rest = per_task.join(F.broadcast(lists)).select(
        "task", F.explode(F.transform("_kinds", lambda k: F.struct(k["kind"].alias("kind"), F.get(F.array_except(k["_devices"], F.col("_on")), F.lit(0)).alias("device")))).alias("_c")
    ).select("task", "_c.device", "_c.kind", F.lit(0).cast("long").alias("local"), F.lit(0).cast("long").alias("_mine"))
    scored = local.unionByName(rest.where(F.col("device").isNotNull())).join(per_task.select("task", "_all", "_by"), "task")
    kind = F.coalesce(F.try_element_at("_by", F.col("kind")), F.lit(0)) - F.col("_mine")
    scored = scored.withColumn("same_kind", kind).withColumn("other", F.col("_all") - F.col("local") - F.col("same_kind"))
    best = F.max(F.struct("local", "same_kind", "other", (-F.col("device")).alias("_d"))).alias("b")
    return scored.groupBy("task").agg(best).select("task", (-F.col("b._d")).alias("device"), "b.local", "b.same_kind", "b.other")


def task_graph(spark, operator: str, mt: int, nt: int, kt: int) -> DataFrame:
    """(task, m, n, k, after): the tile tasks of a product and what each waits for.

    Tasks on one output tile form a chain over k; ``after`` is null for the first.
    """
    total = mt * nt * kt
    t = spark.range(total).select(
        F.expr(f"id div {max(nt * kt, 1)}").alias("m"), F.expr(f"(id div {max(kt, 1)}) % {max(nt, 1)}").alias("n"), F.expr(f"id % {max(kt, 1)}").alias("k")
    )
    name = lambda k: F.concat_ws("_", F.lit(operator), "m", "n", k.cast("string"))
    return t.select(name(F.col("k")).alias("task"), "m", "n", "k", F.when(F.col("k") > 0, name(F.col("k") - 1)).alias("after"))


def to_dot(graph: DataFrame) -> DataFrame:
    """(line): the edges of a task graph in DOT; wrap with ``digraph g { ... }``."""
    edges = graph.where(F.col("after").isNotNull())
    return edges.select(F.concat(F.lit('"'), "after", F.lit('" -> "'), "task", F.lit('";')).alias("line"))
