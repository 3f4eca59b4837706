"""Tables of a decoded trace: tasks, kernels, copies, processors and calls.

Records are taken once each and by date within a file.  A start without push,
an end without start and the like follow the rules stated at each operator.
Keys hold the id of one task, copy or kernel, so no key is large; calls are
grouped per (file_id, kid), on the rare call and sync records only.
Times are seconds as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import trace

UNKNOWN_NAME = "unkown"
# fixed values: the types of processors, the directions of copies, the numbers of events
PROCESSOR_TYPES = ("CPU", "CUDA", "HIP", "INT")
DIRECTIONS = ("H2H", "H2D", "D2H", "D2D")
EVENT_NAMES = (
    "KPROC", "KPROC_INFO", "TASK_EXEC", "TASK_INFO", "TASK_USERATTR", "SCHED", "STEAL_REQUEST", "OFFLOAD_CPY",
    "OFFLOAD_KERN", "TASKSYNC", "PERFCOUNTER", "TASK_PERFCOUNTER", "PERF_UNCORE", "CALL", "LOOP", "ENERGY",
)
MAX_PARAMS = 16
# fixed values: the names of the software counters; numbers 26 and 27 are not used
COUNTER_NAMES = (
    "WORK_CPU", "WORK_GPU", "TIDLE", "TINF", "TASKSPAWN", "TASKSTARTEXEC", "TASKEXEC", "TASKSTEAL", "STEALREQ", "STEALREQOK",
    "STEALOP", "SYNCINST", "ALLOC_GPU", "FREE_GPU", "CPYH2H_BYTES", "CPYH2D_BYTES", "CPYD2H_BYTES", "CPYD2D_BYTES", "CACHE_HIT", "CACHE_MISS",
    "CACHE_HIT_BYTES", "CACHE_MISS_BYTES", "FLOPS_CPU", "DFLOPS_CPU", "FLOPS_GPU", "DFLOPS_GPU", None, None, "REORDER_HIT", "REORDER_MISS",
    "REORDER_MISS_LEN", "LOCAL_READ", "LOCAL_WRITE", "REMOTE_READ", "REMOTE_WRITE", "DFGBUILD",
)
# fixed values: the columns of the files that are written
CSV_COLUMNS = {
    "task": ("Resource", "Type", "Push", "Start", "End", "Duration", "Name", "TaskId"),
    "kern": ("Resource", "Type", "Stream", "Push", "Start", "End", "Duration", "Name", "TaskId"),
    "cpy": ("Resource", "Type", "Stream", "Push", "Start", "End", "Duration", "Size", "Dir"),
    "parallel": ("Resource", "Type", "Start", "End", "Duration", "Name"),
    "call": ("Resource", "Level", "Start", "End", "Duration", "Name", "NParam", *(f"Param{k}" for k in range(MAX_PARAMS))),
}


def seconds(ns: Column) -> Column:
    return ns.cast("double") * 1e-9


def byte_of(x: Column, k: int) -> Column:
    """Byte ``k`` of a 64-bit field, the lowest being 0."""
    return F.call_function("shiftright", x, F.lit(8 * k)).bitwiseAND(F.lit(255)).cast("int")


def half_of(x: Column, k: int) -> Column:
    """32-bit half ``k`` of a 64-bit field."""
    return F.call_function("shiftright", x, F.lit(32 * k)).bitwiseAND(F.lit(0xFFFFFFFF)).cast("long")


def _pick(names: tuple[str, ...], k: Column) -> Column:
    """Entry ``k`` of a short list of names; null outside it."""
    return F.when(k.between(0, len(names) - 1), F.element_at(F.array(*[F.lit(n) for n in names]), k.cast("int") + 1))


def _deliveries(events: DataFrame, evtno: tuple[int, ...], columns: tuple[str, ...]) -> DataFrame:
    """Valid deliveries of records of some events, repeats among them."""
    found = events.where(trace.is_valid() & F.col("evtno").isin(*evtno))
    return found.select("file_id", "rpos", "evtno", "kind", "kid", "date", *columns)


def records(events: DataFrame, evtno: tuple[int, ...], columns: tuple[str, ...]) -> DataFrame:
    """Valid records of some events, each once however often it was delivered; of
    several names, in which deliveries may differ, the alphabetically first."""
    rows = _deliveries(events, evtno, columns)
    if "name" not in columns:
        return rows.distinct()
    return rows.groupBy(*[c for c in rows.columns if c != "name"]).agg(F.min("name").alias("name"))


def _by_id(events: DataFrame, evtno: int, columns: tuple[str, ...]) -> DataFrame:
    """Valid records with an id, each once, by one shuffle: deliveries of a record
    share file and id, so repeats are neighbours within the id's own order."""
    w = W.partitionBy("file_id", "d0").orderBy("date", "rpos")
    rows = _deliveries(events, (evtno,), columns).where(F.col("d0").isNotNull())
    again = (F.lag("rpos").over(w) == F.col("rpos")) & (F.lag("date").over(w) == F.col("date"))
    return rows.withColumn("_again", F.coalesce(again, F.lit(False))).where(~F.col("_again")).drop("_again")


def format_names(formats: DataFrame) -> DataFrame:
    """(fmtid, name): the alphabetically first name of each format, blanks around removed; format 0 is none."""
    name = F.trim(F.regexp_replace(F.col("name"), r"\s+", " "))
    return formats.where(F.col("fmtid").isNotNull() & (F.col("fmtid") != 0)).groupBy("fmtid").agg(F.min(name).alias("name"))


def _named(df: DataFrame, formats: DataFrame) -> DataFrame:
    names = format_names(formats).withColumnRenamed("fmtid", "_f")
    return df.join(names, F.col("fmtid") == F.col("_f"), "left").withColumn("name", F.coalesce("name", F.lit(UNKNOWN_NAME))).drop("_f")


def _typed(df: DataFrame, processors: DataFrame, how: str = "left") -> DataFrame:
    kinds = processors.where(F.col("kid").isNotNull()).groupBy(F.col("kid").alias("_k")).agg(F.min("ptype").alias("_p"))
    return df.join(kinds, F.col("kid") == F.col("_k"), how).withColumn("type", _pick(PROCESSOR_TYPES, F.col("_p"))).drop("_k", "_p")


def _occurrences(df: DataFrame, opens: Column) -> DataFrame:
    """Number of the life of each id: ids may be used again after their end."""
    w = W.partitionBy("file_id", "d0").orderBy("date", "rpos").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("life", F.sum(opens.cast("long")).over(w))


def _at(kind: int, column: str = "date") -> Column:
    return F.min(F.when(F.col("kind") == kind, F.col(column)))


def tasks(events: DataFrame, formats: DataFrame, processors: DataFrame, only: list[int] | None = None) -> DataFrame:
    """A row per task that was pushed and ended after it: (file_id, resource, type,
    push, start, end, duration, name, task_id).

    Resource and format are the push record's, the duration is the recorded
    delay; a start later than the end, or a lost one, is null.  ``only`` keeps
    some formats.
    """
    rows = _occurrences(_by_id(events, trace.TASK, ("d0", "d1", "d3")), F.col("kind") == 0)
    lives = rows.groupBy("file_id", "d0", "life").agg(
        _at(0).alias("push"), _at(2).alias("start"), _at(3).alias("end"), _at(3, "d3").alias("delay"), _at(0, "d1").alias("fmtid"), _at(0, "kid").alias("kid")
    )
    done = lives.where((F.col("life") > 0) & (F.col("push") <= F.col("end")))
    if only is not None:
        done = done.where(F.col("fmtid").isin(*only))
    start = F.when(F.col("start") <= F.col("end"), F.col("start"))
    return _typed(_named(done, formats), processors).select(
        "file_id", F.col("kid").alias("resource"), "type", seconds(F.col("push")).alias("push"), seconds(start).alias("start"),
        seconds(F.col("end")).alias("end"), seconds(F.col("delay")).alias("duration"), "name", F.col("d0").alias("task_id"),
    )


def copies(events: DataFrame, processors: DataFrame) -> DataFrame:
    """A row per copy that was pushed and ended, on a known processor: (file_id, resource, type,
    stream, push, start, end, duration, size, dir, direction, source, target)."""
    rows = _occurrences(_by_id(events, trace.COPY, ("d0", "d1", "d2", "d3")), F.col("kind") == 0)
    lives = rows.groupBy("file_id", "d0", "life").agg(
        _at(0).alias("push"), _at(1).alias("start"), _at(2).alias("end"), _at(2, "d1").alias("delay"),
        _at(0, "d1").alias("ends"), _at(0, "d2").alias("size"), _at(0, "d3").alias("how"), _at(0, "kid").alias("kid"),
    )
    done = lives.where((F.col("life") > 0) & (F.col("push") <= F.col("end")))
    way = byte_of(F.col("how"), 0)
    return _typed(done, processors, "inner").select(
        "file_id", F.col("kid").alias("resource"), "type", byte_of(F.col("how"), 1).alias("stream"), seconds(F.col("push")).alias("push"),
        seconds(F.when(F.col("start") <= F.col("end"), F.col("start"))).alias("start"), seconds(F.col("end")).alias("end"),
        seconds(F.col("delay")).alias("duration"), "size", way.alias("dir"), _pick(DIRECTIONS, way).alias("direction"),
        half_of(F.col("ends"), 0).alias("source"), half_of(F.col("ends"), 1).alias("target"),
    )


def kernels(events: DataFrame, formats: DataFrame, processors: DataFrame) -> DataFrame:
    """A row per kernel that ended after its push or begin: (file_id, resource, type, stream,
    push, start, end, duration, name, task_id).

    A kernel without push has push 0, the processor of its begin and no format.
    """
    rows = _by_id(events, trace.KERNEL, ("d0", "d1", "d2", "d3"))
    w = W.partitionBy("file_id", "d0").orderBy("date", "rpos")
    # a life opens with a push, or with a begin that follows no push or a past end
    opens = (F.col("kind") == 0) & ~F.coalesce(F.lag("kind").over(w) == 0, F.lit(False))
    opens = opens | ((F.col("kind") == 1) & F.coalesce(F.lag("kind").over(w) == 2, F.lit(True)))
    rows = rows.withColumn("_open", opens)
    rows = rows.withColumn("life", F.sum(F.col("_open").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lives = rows.groupBy("file_id", "d0", "life").agg(
        _at(0).alias("push"), _at(1).alias("start"), _at(2).alias("end"), _at(2, "d1").alias("delay"), _at(0, "d2").alias("fmtid"),
        _at(0, "d3").alias("how"), F.coalesce(_at(0, "kid"), _at(1, "kid")).alias("kid"),
    )
    opened = F.least(F.col("push"), F.col("start"))
    done = lives.where((F.col("life") > 0) & (opened <= F.col("end")))
    inside = lambda c: F.when(F.col(c) <= F.col("end"), F.col(c))
    return _typed(_named(done, formats), processors).select(
        "file_id", F.col("kid").alias("resource"), "type", byte_of(F.col("how"), 0).alias("stream"), seconds(F.coalesce(inside("push"), F.lit(0))).alias("push"),
        seconds(inside("start")).alias("start"), seconds(F.col("end")).alias("end"), seconds(F.col("delay")).alias("duration"), "name", F.col("d0").alias("task_id"),
    )


def processors_alive(events: DataFrame) -> DataFrame:
    """A row per stop of a processor that had started: (file_id, resource, type, start, end, duration, name)."""
    rows = records(events, (0,), ("d0",)).where(F.col("d0").between(0, 3))
    started = rows.where(F.col("kind") == 0).groupBy(F.col("file_id").alias("_f"), F.col("kid").alias("_k")).agg(
        F.min(F.struct("date", "rpos", "d0")).alias("s")
    )
    stops = rows.where(F.col("kind") == 1)
    joined = stops.join(started, (F.col("file_id") == F.col("_f")) & (F.col("kid") == F.col("_k"))).where(F.col("s.date") <= F.col("date"))
    kind = _pick(PROCESSOR_TYPES, F.col("s.d0"))
    return joined.select(
        "file_id", F.col("kid").alias("resource"), kind.alias("type"), seconds(F.col("s.date")).alias("start"), seconds(F.col("date")).alias("end"),
        seconds(F.col("date") - F.col("s.date")).alias("duration"), F.concat_ws("-", kind, F.col("kid").cast("string")).alias("name"),
    )


def calls(events: DataFrame) -> DataFrame:
    """A row per call closed by the next end of a sync on its processor: (file_id, resource,
    level, start, end, duration, name, nparam, param0 ... param15).

    ``level`` is the call's place among those the sync closes.  A call has
    three parameters, each information record that follows it adds four;
    absent ones are 0, names are cut to seven characters.
    """
    rows = records(events, (9, 13), ("d0", "d1", "d2", "d3", "name"))
    rows = rows.where((F.col("evtno") == 13) & F.col("kind").isin(0, 2, 3) | (F.col("evtno") == 9) & (F.col("kind") == 1))
    w = W.partitionBy("file_id", "kid").orderBy("date", "rpos")
    sync, begin = F.col("evtno") == 9, (F.col("evtno") == 13) & (F.col("kind") == 0)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    marked = rows.withColumn("_sync", F.coalesce(F.sum(sync.cast("long")).over(before), F.lit(0))).withColumn("_call", F.sum(begin.cast("long")).over(upto))
    closing = F.min(F.when(sync, F.col("date"))).over(W.partitionBy("file_id", "kid", "_sync"))
    first = F.min(F.when(begin, F.col("_call"))).over(W.partitionBy("file_id", "kid", "_sync"))
    marked = marked.withColumn("_end", closing).withColumn("_first", first).where(~sync & F.col("_end").isNotNull())
    # only the records that can fill a parameter are gathered
    nth = F.sum((~begin).cast("long")).over(W.partitionBy("file_id", "kid", "_call").orderBy("date", "rpos").rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("_nth", nth).where(begin | (F.col("_nth") <= -(-(MAX_PARAMS - 3) // 4)))
    info = F.when(~begin, F.struct("date", "rpos", "d0", "d1", "d2", "d3"))
    made = marked.groupBy("file_id", "kid", "_sync", "_call").agg(
        F.min(F.when(begin, F.struct("date", "name", "d1", "d2", "d3"))).alias("b"),
        F.min("_end").alias("_end"), F.min("_first").alias("_first"), F.sort_array(F.collect_list(info)).alias("infos"),
    ).where(F.col("b").isNotNull())
    extra = F.flatten(F.transform("infos", lambda x: F.array(x["d0"], x["d1"], x["d2"], x["d3"])))
    params = F.slice(F.concat(F.array("b.d1", "b.d2", "b.d3"), extra), 1, MAX_PARAMS)
    made = made.withColumn("_p", params)
    return made.select(
        "file_id", F.col("kid").alias("resource"), (F.col("_call") - F.col("_first")).cast("int").alias("level"), seconds(F.col("b.date")).alias("start"),
        seconds(F.col("_end")).alias("end"), seconds(F.col("_end") - F.col("b.date")).alias("duration"), F.substring("b.name", 1, 7).alias("name"),
        F.size("_p").alias("nparam"), *[F.coalesce(F.get("_p", F.lit(k)), F.lit(0)).alias(f"param{k}") for k in range(MAX_PARAMS)],
    )


def decoded(events: DataFrame) -> DataFrame:
    """Every record once with its event's name: (file_id, rpos, date as text, kid, evtno, kind, event)."""
    rows = events.select("file_id", "rpos", F.col("date").cast("string").alias("date"), "kid", "evtno", "kind").dropDuplicates(["file_id", "rpos"])
    name = F.coalesce(_pick(EVENT_NAMES, F.col("evtno")), F.concat(F.lit("EVENT_"), F.col("evtno").cast("string")))
    return rows.withColumn("event", name)


def exit_statistics(task_table: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """(resource, name, n, time_ns[, flops, ai, mean_ai]): tasks and recorded time per processor and
    format, with the sums per processor (name null), per format (resource null) and of all (both null).

    ``costs``: (name, flops, bytes) of one task of a format.  A task's intensity is its
    operations per byte; ``ai`` is their sum and ``mean_ai`` their mean over all tasks.
    Formats without a known cost count as 0.
    """
    spent = F.sum(F.round(F.col("duration") * 1e9).cast("long")).alias("time_ns")
    rows, more = task_table.select("resource", "name", "duration"), []
    if costs is not None:
        each = costs.groupBy(F.col("name").alias("_n")).agg(F.max("flops").alias("_flops"), F.max("bytes").alias("_bytes"))
        rows = rows.join(each, F.col("name") == F.col("_n"), "left").withColumn("_ai", F.coalesce(F.col("_flops") / F.nullif(F.col("_bytes"), F.lit(0.0)), F.lit(0.0)))
        more = [F.sum(F.coalesce("_flops", F.lit(0.0))).alias("flops"), F.sum("_ai").alias("ai"), F.avg("_ai").alias("mean_ai")]
    sets = rows.groupingSets([["resource", "name"], ["resource"], ["name"], []], "resource", "name")
    return sets.agg(F.count(F.lit(1)).alias("n"), spent, *more)


def counters(events: DataFrame) -> DataFrame:
    """(kid, counter, name, n, last): readings of each software counter per processor and the latest one."""
    rows = records(events, (10,), ("d0", "d1")).where(F.col("d0").isNotNull())
    made = rows.groupBy("kid", F.col("d0").alias("counter")).agg(F.count(F.lit(1)).alias("n"), F.max_by("d1", F.struct("date", "file_id", "rpos")).alias("last"))
    return made.select("kid", "counter", _pick(COUNTER_NAMES, F.col("counter")).alias("name"), "n", "last")


def csv_table(name: str, df: DataFrame) -> DataFrame:
    """The columns of a trace table as its CSV file names them; times with 15 places."""

    def cell(c: str):
        own = {"taskid": "task_id"}.get(c.lower(), c.lower())
        value = F.col(own)
        if own in ("push", "start", "end", "duration"):
            value = F.when(value.isNotNull(), F.format_string("%.15f", value))
        return value.alias(c)

    return df.select(*[cell(c) for c in CSV_COLUMNS[name]])


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table (``task``, ``kern``, ``cpy``, ``parallel``, ``call``) as a CSV folder
    ``<folder>/<name>.csv`` with its header; other tables as they are."""
    for name, df in tables.items():
        made = csv_table(name, df) if name in CSV_COLUMNS else df
        made.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
