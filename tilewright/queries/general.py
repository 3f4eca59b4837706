"""Queries of the general data-processing operators (p2, p4, p5, p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, intervals, schema_drift, skew
from ..plans.storage import materialize
from ..sources import trace
from ..sources.tables import read_table

# -- problem 2: schemas that drift between files


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of a section's fields from file to file of a fileset."""
    return schema_drift.schema_changes(read_table(spark, sf, "event_file")).select("file_id", "section", "field", "change")


def p2_table(spark: SparkSession, sf: str) -> DataFrame:
    """All three sections of all files as one table, a renamed field in one column."""
    return schema_drift.consistent_table(read_table(spark, sf, "event_file"))


def p2_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same table as a row per file and field."""
    return schema_drift.consistent_cells(read_table(spark, sf, "event_file"))


# -- problem 4: per-entity feature table

P4_MIN = 5


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Event numbers seen at least five times, only in the first half of a sequence."""
    rows = trace.valid_records(read_table(spark, sf, "kaapi_event"), "file_id", "kid", "evtno", "date", "rpos")
    table = features.feature_table(
        rows, ["file_id", "kid"], ["evtno"], "date", record=["rpos"], parts=("n", "last")
    )
    cells = F.array(
        *[
            F.struct(F.lit(y[0]).alias("evtno"), F.col(c["n"]).alias("n"), F.col(c["last"]).alias("last"))
            for y, c in table.columns.items()
        ]
    )
    half = F.col("last_time") - F.col("first_time")
    early = F.filter(
        cells, lambda c: (c["n"] >= P4_MIN) & (2 * (c["last"] - F.col("first_time")) < half)
    )
    return table.df.select("file_id", "kid", F.explode(early).alias("c")).select("file_id", "kid", F.col("c.evtno").alias("evtno"))


def p4_features(spark: SparkSession, sf: str) -> DataFrame:
    """The whole feature table: per (file_id, kid), four columns for each (evtno, kind)."""
    rows = trace.valid_records(
        read_table(spark, sf, "kaapi_event"), "file_id", "kid", "evtno", "kind", "date", "rpos", "d2"
    )
    return features.feature_table(rows, ["file_id", "kid"], ["evtno", "kind"], "date", totals=["d2"], record=["rpos"]).df


def p4_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same table as a row per (file_id, kid) and type."""
    rows = trace.valid_records(read_table(spark, sf, "kaapi_event"), "file_id", "kid", "evtno", "kind", "date", "rpos", "d2")
    return features.feature_cells(rows, ["file_id", "kid"], ["evtno", "kind"], "date", totals=["d2"], record=["rpos"])


SQL_VALID = """valid AS (SELECT DISTINCT file_id, rpos, evtno, kind, kid, date, d0, d1, d2, d3
 FROM kaapi_event WHERE kid IS NOT NULL AND date > 0)"""

SQL_P4 = f"""WITH {SQL_VALID},
 seq AS (SELECT file_id, kid, min(date) AS a, max(date) AS b FROM valid GROUP BY 1, 2),
 one AS (SELECT file_id, kid, evtno, count(*) AS n, max(date) AS z FROM valid GROUP BY 1, 2, 3)
SELECT one.file_id, one.kid, one.evtno FROM one JOIN seq ON one.file_id = seq.file_id AND one.kid = seq.kid
WHERE n >= {P4_MIN} AND 2 * (z - a) < b - a"""

SQL_P4_CELLS = f"""WITH {SQL_VALID} SELECT file_id, kid, evtno, kind, count(*) AS n, min(date) AS first, max(date) AS last,
 CAST(sum(coalesce(d2, 0)) AS BIGINT) AS sum_d2 FROM valid GROUP BY 1, 2, 3, 4"""

# -- problem 5: busy periods and gaps


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between successive busy periods of each (file_id, kid)."""
    return intervals.gaps(trace.intervals(read_table(spark, sf, "kaapi_event")), ["file_id", "kid"])


def p5_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Busy periods of each (file_id, kid) and how many intervals each holds."""
    return intervals.busy_periods(trace.intervals(read_table(spark, sf, "kaapi_event")), ["file_id", "kid"])


SQL_INTERVALS = f"""{SQL_VALID},
 iv AS (SELECT s.file_id, s.kid, s.evtno, s.d0, s.date AS s, e.date AS t, e.d1 AS end_d1 FROM valid s JOIN valid e
  ON s.file_id = e.file_id AND s.kid = e.kid AND s.evtno = e.evtno AND s.d0 = e.d0 AND e.kind = s.kind + 1 AND s.date < e.date
  WHERE (s.evtno = 2 AND s.kind = 2) OR (s.evtno IN (7, 8) AND s.kind = 1))"""
_SQL_MARKED = f"""WITH {SQL_INTERVALS},
 m AS (SELECT *, max(t) OVER (PARTITION BY file_id, kid ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv)"""
SQL_P5_GAPS = f"{_SQL_MARKED} SELECT file_id, kid, before AS gap_start, s AS gap_end FROM m WHERE before < s"
SQL_P5_PERIODS = f"""{_SQL_MARKED},
 k AS (SELECT *, sum(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END)
  OVER (PARTITION BY file_id, kid ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT file_id, kid, min(s) AS period_start, max(t) AS period_end, count(*) AS n_intervals FROM k GROUP BY file_id, kid, g"""

# -- problem 6: a few keys hold most records

P6_SHARE = 200


def _keyed(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    events = read_table(spark, sf, "kaapi_event").where(trace.is_valid())
    return events.select("evtno", trace.fmtid().alias("fmtid"), *columns)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys (evtno, fmtid) with at least one in 200 of all valid records."""
    counts = skew.distinct_counts(_keyed(spark, sf, "file_id", "rpos"), ["evtno", "fmtid"], ["file_id", "rpos"])
    counts = materialize(counts, "keys")  # a row per key, read twice
    total = counts.agg(F.sum("n_distinct").alias("total"))  # one row
    return (
        counts.join(F.broadcast(total))
        .where(F.col("fmtid").isNotNull() & (F.col("n_distinct") * P6_SHARE >= F.col("total")))
        .select("evtno", "fmtid")
    )


def p6_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Valid records, distinct kids, modal kid and percentiles of kid per (evtno, fmtid)."""
    records = _keyed(spark, sf, "file_id", "rpos", "kid").dropDuplicates(["file_id", "rpos"])
    return skew.key_statistics(records, ["evtno", "fmtid"], "kid", (0.5, 0.9))


_SQL_FMTID = "CASE WHEN evtno = 2 THEN d1 WHEN evtno = 8 AND kind = 0 THEN coalesce(d2, 0) ELSE 0 END"
SQL_P6 = f"""WITH {SQL_VALID}, k AS (SELECT evtno, {_SQL_FMTID} AS fmtid FROM valid)
SELECT evtno, fmtid FROM k WHERE fmtid IS NOT NULL GROUP BY evtno, fmtid
HAVING count(*) * {P6_SHARE} >= (SELECT count(*) FROM k)"""
SQL_P6_STATISTICS = f"""WITH {SQL_VALID}, k AS (SELECT evtno, {_SQL_FMTID} AS fmtid, kid FROM valid),
 f AS (SELECT evtno, fmtid, kid, count(*) AS c FROM k GROUP BY 1, 2, 3),
 m AS (SELECT *, row_number() OVER (PARTITION BY evtno, fmtid ORDER BY c DESC, kid) AS r FROM f)
SELECT k.evtno, k.fmtid, count(*) AS n, count(DISTINCT k.kid) AS n_distinct, max(m.kid) AS mode, max(m.c) AS mode_n,
 quantile_disc(k.kid, 0.5) AS p50, quantile_disc(k.kid, 0.9) AS p90
FROM k JOIN m ON k.evtno = m.evtno AND k.fmtid IS NOT DISTINCT FROM m.fmtid AND m.r = 1 GROUP BY k.evtno, k.fmtid"""

QUERIES = {
    "p2_found": p2_found,
    "p2_table": p2_table,
    "p2_cells": p2_cells,
    "p4_found": p4_found,
    "p4_features": p4_features,
    "p4_cells": p4_cells,
    "p5_found": p5_found,
    "p5_periods": p5_periods,
    "p6_found": p6_found,
    "p6_statistics": p6_statistics,
}
SQL = {
    "p4_found": SQL_P4,
    "p4_cells": SQL_P4_CELLS,
    "p5_found": SQL_P5_GAPS,
    "p5_periods": SQL_P5_PERIODS,
    "p6_found": SQL_P6,
    "p6_statistics": SQL_P6_STATISTICS,
}
