"""Queries of the trace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost
from ..operators import trace_tables as tt
from ..sources.tables import read_table


def _t(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, sf, n) for n in names]


def trace_task(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks with push, start, end, delay and name."""
    return tt.tasks(*_t(spark, sf, "kaapi_event", "fmttrace_def", "kproc"))


def trace_task_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of some formats."""
    return tt.tasks(*_t(spark, sf, "kaapi_event", "fmttrace_def", "kproc"), only=[62298, 878, 563])


def trace_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Copies with their stream, size and direction."""
    return tt.copies(*_t(spark, sf, "kaapi_event", "kproc"))


def trace_kernel(spark: SparkSession, sf: str) -> DataFrame:
    """Kernels with their stream and name."""
    return tt.kernels(*_t(spark, sf, "kaapi_event", "fmttrace_def", "kproc"))


def trace_parallel(spark: SparkSession, sf: str) -> DataFrame:
    """Lifetimes of processors."""
    return tt.processors_alive(*_t(spark, sf, "kaapi_event"))


def trace_call(spark: SparkSession, sf: str) -> DataFrame:
    """Calls grouped by the sync that closes them."""
    return tt.calls(*_t(spark, sf, "kaapi_event"))


def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    """All records with the names of their events."""
    return tt.decoded(*_t(spark, sf, "kaapi_event"))


def trace_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The header texts of all files."""
    return read_table(spark, sf, "event_file").select("file_id", "fileset_id", "file_name", "header").distinct()


def trace_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks and recorded time per processor and format, with sums."""
    return tt.exit_statistics(trace_task(spark, sf))


def trace_costs(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics with operations and intensity; a format's tile order is taken from its number."""
    order = F.col("fmtid") % 256 + 1
    names = tt.format_names(read_table(spark, sf, "fmttrace_def")).where(F.col("name").rlike("^[sdcz]?gemm"))
    costs = names.select("name", cost.flops_gemm(order, order, order).alias("flops"), cost.bytes_gemm(order, order, order).alias("bytes"))
    found = tt.exit_statistics(trace_task(spark, sf), costs)
    return found.select("resource", "name", "n", "time_ns", "flops", F.round("ai", 6).alias("ai"), F.round("mean_ai", 6).alias("mean_ai"))


def trace_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks as the CSV file holds them, times read back from their text."""
    made = tt.csv_table("task", trace_task(spark, sf))
    read = {c: F.col(c).cast("double") for c in ("Push", "Start", "End")}
    return made.withColumns(read | {"Duration": F.round(F.col("Duration").cast("double"), 12)})


def trace_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of the software counters."""
    return tt.counters(*_t(spark, sf, "kaapi_event"))


def _valid(*evtnos: int) -> str:
    return f"""v AS (SELECT DISTINCT file_id, rpos, evtno, kind, kid, date, d0, d1, d2, d3 FROM kaapi_event
 WHERE kid IS NOT NULL AND date > 0 AND evtno IN ({', '.join(map(str, evtnos))}))"""


_NAMES = """names AS (SELECT fmtid AS f, min(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS name FROM fmttrace_def
 WHERE fmtid IS NOT NULL AND fmtid <> 0 GROUP BY 1)"""
_KINDS = """kinds AS (SELECT kid AS k, CASE min(ptype) WHEN 0 THEN 'CPU' WHEN 1 THEN 'CUDA' WHEN 2 THEN 'HIP' WHEN 3 THEN 'INT' END AS type
 FROM kproc WHERE kid IS NOT NULL GROUP BY 1)"""


def _s(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE) * 1e-9"


_LIVES = """l AS (SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, d0 ORDER BY date, rpos ROWS UNBOUNDED PRECEDING) AS life
 FROM v WHERE d0 IS NOT NULL)"""
SQL_TASK = f"""WITH {_valid(2)}, {_LIVES}, {_NAMES}, {_KINDS},
 g AS (SELECT file_id, d0, life, min(date) FILTER (kind = 0) AS push, min(date) FILTER (kind = 2) AS start, min(date) FILTER (kind = 3) AS stop,
  min(d3) FILTER (kind = 3) AS delay, min(d1) FILTER (kind = 0) AS fmtid, min(kid) FILTER (kind = 0) AS kid FROM l WHERE life > 0 GROUP BY 1, 2, 3)
SELECT file_id, kid AS resource, type, {_s('push')} AS push, {_s('CASE WHEN start <= stop THEN start END')} AS start, {_s('stop')} AS "end",
 {_s('delay')} AS duration, coalesce(name, 'unkown') AS name, d0 AS task_id
FROM g LEFT JOIN names ON fmtid = f LEFT JOIN kinds ON kid = k WHERE push <= stop"""
SQL_TASK_FILTERED = SQL_TASK + " AND fmtid IN (62298, 878, 563)"
SQL_COPY = f"""WITH {_valid(7)}, {_LIVES}, {_KINDS},
 g AS (SELECT file_id, d0, life, min(date) FILTER (kind = 0) AS push, min(date) FILTER (kind = 1) AS start, min(date) FILTER (kind = 2) AS stop,
  min(d1) FILTER (kind = 2) AS delay, min(d1) FILTER (kind = 0) AS ends, min(d2) FILTER (kind = 0) AS size, min(d3) FILTER (kind = 0) AS how,
  min(kid) FILTER (kind = 0) AS kid FROM l WHERE life > 0 GROUP BY 1, 2, 3)
SELECT file_id, kid AS resource, type, CAST((how >> 8) & 255 AS INT) AS stream, {_s('push')} AS push, {_s('CASE WHEN start <= stop THEN start END')} AS start,
 {_s('stop')} AS "end", {_s('delay')} AS duration, size, CAST(how & 255 AS INT) AS dir,
 CASE how & 255 WHEN 0 THEN 'H2H' WHEN 1 THEN 'H2D' WHEN 2 THEN 'D2H' WHEN 3 THEN 'D2D' END AS direction, ends & 4294967295 AS source, (ends >> 32) & 4294967295 AS target
FROM g JOIN kinds ON kid = k WHERE push <= stop"""
SQL_KERNEL = f"""WITH {_valid(8)}, {_NAMES}, {_KINDS},
 o AS (SELECT *, lag(kind) OVER (PARTITION BY file_id, d0 ORDER BY date, rpos) AS was FROM v WHERE d0 IS NOT NULL),
 l AS (SELECT *, sum(CASE WHEN (kind = 0 AND (was IS NULL OR was <> 0)) OR (kind = 1 AND (was IS NULL OR was = 2)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY file_id, d0 ORDER BY date, rpos ROWS UNBOUNDED PRECEDING) AS life FROM o),
 g AS (SELECT file_id, d0, life, min(date) FILTER (kind = 0) AS push, min(date) FILTER (kind = 1) AS start, min(date) FILTER (kind = 2) AS stop,
  min(d1) FILTER (kind = 2) AS delay, min(d2) FILTER (kind = 0) AS fmtid, min(d3) FILTER (kind = 0) AS how,
  coalesce(min(kid) FILTER (kind = 0), min(kid) FILTER (kind = 1)) AS kid FROM l WHERE life > 0 GROUP BY 1, 2, 3)
SELECT file_id, kid AS resource, type, CAST(how & 255 AS INT) AS stream, {_s('coalesce(CASE WHEN push <= stop THEN push END, 0)')} AS push,
 {_s('CASE WHEN start <= stop THEN start END')} AS start, {_s('stop')} AS "end", {_s('delay')} AS duration, coalesce(name, 'unkown') AS name, d0 AS task_id
FROM g LEFT JOIN names ON fmtid = f LEFT JOIN kinds ON kid = k WHERE least(push, start) <= stop"""
SQL_PARALLEL = f"""WITH {_valid(0)}, r AS (SELECT * FROM v WHERE d0 BETWEEN 0 AND 3),
 s AS (SELECT file_id, kid, date, d0, row_number() OVER (PARTITION BY file_id, kid ORDER BY date, rpos) AS n FROM r WHERE kind = 0),
 j AS (SELECT r.file_id, r.kid, s.date AS a, r.date AS z, CASE s.d0 WHEN 0 THEN 'CPU' WHEN 1 THEN 'CUDA' WHEN 2 THEN 'HIP' ELSE 'INT' END AS type
  FROM r JOIN s ON r.file_id = s.file_id AND r.kid = s.kid AND s.n = 1 WHERE r.kind = 1 AND s.date <= r.date)
SELECT file_id, kid AS resource, type, {_s('a')} AS start, {_s('z')} AS "end", {_s('z - a')} AS duration, type || '-' || kid AS name FROM j"""
SQL_CALL = f"""WITH u AS (SELECT file_id, rpos, evtno, kind, kid, date, d0, d1, d2, d3, min(name) AS name FROM kaapi_event
  WHERE kid IS NOT NULL AND date > 0 AND ((evtno = 13 AND kind IN (0, 2, 3)) OR (evtno = 9 AND kind = 1)) GROUP BY ALL),
 m AS (SELECT *, coalesce(sum(CASE WHEN evtno = 9 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, kid ORDER BY date, rpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  sum(CASE WHEN evtno = 13 AND kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, kid ORDER BY date, rpos ROWS UNBOUNDED PRECEDING) AS c FROM u),
 q AS (SELECT file_id, kid, s, min(date) AS z FROM m WHERE evtno = 9 GROUP BY 1, 2, 3),
 b AS (SELECT m.*, z, row_number() OVER (PARTITION BY m.file_id, m.kid, m.s ORDER BY m.date, m.rpos) - 1 AS level
  FROM m JOIN q ON m.file_id = q.file_id AND m.kid = q.kid AND m.s = q.s WHERE evtno = 13 AND kind = 0),
 i AS (SELECT file_id, kid, s, c, flatten(list([d0, d1, d2, d3] ORDER BY date, rpos)) AS x FROM m WHERE evtno = 13 AND kind > 0 GROUP BY 1, 2, 3, 4),
 p AS (SELECT b.*, (CASE WHEN i.x IS NULL THEN [b.d1, b.d2, b.d3] ELSE list_concat([b.d1, b.d2, b.d3], i.x) END)[1:16] AS a
  FROM b LEFT JOIN i ON b.file_id = i.file_id AND b.kid = i.kid AND b.s = i.s AND b.c = i.c)
SELECT file_id, kid AS resource, CAST(level AS INT) AS level, {_s('date')} AS start, {_s('z')} AS "end", {_s('z - date')} AS duration, substr(name, 1, 7) AS name,
 CAST(len(a) AS INT) AS nparam, {', '.join(f'coalesce(a[{k + 1}], 0) AS param{k}' for k in range(16))} FROM p"""
SQL_EVENTS = f"""SELECT DISTINCT file_id, rpos, CAST(date AS VARCHAR) AS date, kid, evtno, kind,
 CASE {' '.join(f"WHEN evtno = {k} THEN '{n}'" for k, n in enumerate(tt.EVENT_NAMES))} ELSE 'EVENT_' || evtno END AS event FROM kaapi_event"""
SQL_HEADERS = "SELECT DISTINCT file_id, fileset_id, file_name, header FROM event_file"
SQL_STATISTICS = f"""SELECT resource, name, count(*) AS n, CAST(sum(CAST(round(duration * 1e9) AS BIGINT)) AS BIGINT) AS time_ns
FROM ({SQL_TASK}) GROUP BY GROUPING SETS ((resource, name), (resource), (name), ())"""
_O = "CAST(fmtid % 256 + 1 AS DOUBLE)"
SQL_COSTS = f"""WITH costs AS (SELECT name AS cn, max(2 * {_O} * {_O} * {_O}) AS f, max(8 * 3 * {_O} * {_O}) AS b FROM
  (SELECT fmtid, min(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS name FROM fmttrace_def WHERE fmtid IS NOT NULL AND fmtid <> 0 GROUP BY 1)
  WHERE regexp_matches(name, '^[sdcz]?gemm') GROUP BY 1)
SELECT resource, name, count(*) AS n, CAST(sum(CAST(round(duration * 1e9) AS BIGINT)) AS BIGINT) AS time_ns, sum(coalesce(f, 0.0)) AS flops,
 round(sum(coalesce(f / b, 0.0)), 6) AS ai, round(avg(coalesce(f / b, 0.0)), 6) AS mean_ai
FROM ({SQL_TASK}) LEFT JOIN costs ON name = cn GROUP BY GROUPING SETS ((resource, name), (resource), (name), ())"""
SQL_CSV = f"""SELECT resource AS "Resource", type AS "Type", push AS "Push", start AS "Start", "end" AS "End", round(duration, 12) AS "Duration", name AS "Name", task_id AS "TaskId" FROM ({SQL_TASK})"""
_COUNTERS = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(tt.COUNTER_NAMES) if n)
SQL_COUNTERS = f"""WITH {_valid(10)} SELECT kid, d0 AS counter, CASE d0 {_COUNTERS} END AS name, count(*) AS n, arg_max(d1, (date, file_id, rpos)) AS last FROM v WHERE d0 IS NOT NULL GROUP BY 1, 2, 3"""

QUERIES = {
    "trace_task": trace_task,
    "trace_task_filtered": trace_task_filtered,
    "trace_copy": trace_copy,
    "trace_kernel": trace_kernel,
    "trace_parallel": trace_parallel,
    "trace_call": trace_call,
    "trace_events": trace_events,
    "trace_headers": trace_headers,
    "trace_statistics": trace_statistics,
    "trace_counters": trace_counters,
    "trace_costs": trace_costs,
    "trace_csv": trace_csv,
}
SQL = {
    "trace_task": SQL_TASK,
    "trace_task_filtered": SQL_TASK_FILTERED,
    "trace_copy": SQL_COPY,
    "trace_kernel": SQL_KERNEL,
    "trace_parallel": SQL_PARALLEL,
    "trace_call": SQL_CALL,
    "trace_events": SQL_EVENTS,
    "trace_headers": SQL_HEADERS,
    "trace_statistics": SQL_STATISTICS,
    "trace_counters": SQL_COUNTERS,
    "trace_costs": SQL_COSTS,
    "trace_csv": SQL_CSV,
}
