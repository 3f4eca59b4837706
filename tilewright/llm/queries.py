"""Queries of the corpus operators (p1, p3, p7, p8, p9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialize
from ..queries.general import SQL_INTERVALS, SQL_VALID
from ..sources import trace
from ..sources.tables import read_table
from . import encode, mixing, percentiles, runs, subjects

# -- problem 1: repeated consecutive events

P1_GAP_NS = 200_000


def _runs(spark: SparkSession, sf: str, least: int) -> DataFrame:
    rows = trace.valid_records(read_table(spark, sf, "kaapi_event"), "file_id", "kid", "evtno", "kind", "date", "rpos")
    return runs.collapse_runs(rows, ["file_id", "kid"], ["evtno", "kind"], "date", "rpos", P1_GAP_NS, least)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of at least three equal events at close dates."""
    return _runs(spark, sf, 3).select("file_id", "first_rpos", "last_rpos")


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Every sequence with each run as one event, its count and duration."""
    return _runs(spark, sf, 1)


_SQL_RUNS = f"""WITH {SQL_VALID},
 m AS (SELECT *, CASE WHEN evtno = lag(evtno) OVER w AND kind = lag(kind) OVER w AND date - lag(date) OVER w <= {P1_GAP_NS}
   THEN 0 ELSE 1 END AS o FROM valid WINDOW w AS (PARTITION BY file_id, kid ORDER BY date, rpos)),
 g AS (SELECT *, sum(o) OVER (PARTITION BY file_id, kid ORDER BY date, rpos ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT file_id, kid, any_value(evtno) AS evtno, any_value(kind) AS kind, arg_min(rpos, (date, rpos)) AS first_rpos,
 arg_max(rpos, (date, rpos)) AS last_rpos, min(date) AS first_time, max(date) AS last_time, count(*) AS n, max(date) - min(date) AS duration
FROM g GROUP BY file_id, kid, run"""
SQL_P1 = f"SELECT file_id, first_rpos, last_rpos FROM ({_SQL_RUNS}) WHERE n >= 3"

# -- problem 3: percentiles of task durations

P3_MIN, P3_TIMES = 20, 8


def _durations(spark: SparkSession, sf: str) -> DataFrame:
    tasks = trace.intervals(read_table(spark, sf, "kaapi_event"), (trace.TASK,))
    return tasks.where(F.col("end_d1").isNotNull()).select(
        "file_id", F.col("end_d1").alias("fmtid"), "kid", (F.col("end") - F.col("start")).alias("duration")
    )


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact median, 90th and 99th percentile of task durations per (fmtid, kid)."""
    return percentiles.percentiles(_durations(spark, sf), ["fmtid", "kid"], "duration", (0.5, 0.9, 0.99))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of at least 20 durations whose 90th percentile is above 8 medians."""
    found = percentiles.percentiles(_durations(spark, sf), ["fmtid", "kid"], "duration", (0.5, 0.9), interpolate=True)
    return found.where((F.col("n") >= P3_MIN) & (F.col("p90") > P3_TIMES * F.col("p50"))).select("fmtid", "kid")


def p3_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles from the sum of one summary per file, within 2**-7."""
    parts = percentiles.summarise(_durations(spark, sf), ["file_id", "fmtid", "kid"], "duration")
    return percentiles.percentiles_of(percentiles.combine(parts, ["fmtid", "kid"]), ["fmtid", "kid"], (0.5, 0.9))


_SQL_DURATIONS = f"""WITH {SQL_INTERVALS},
 d AS (SELECT end_d1 AS fmtid, kid, t - s AS x FROM iv WHERE evtno = 2 AND end_d1 IS NOT NULL)"""
_SQL_CELL = "((x >> greatest(length(bin(x)) - 8, 0)::INT) << greatest(length(bin(x)) - 8, 0)::INT)"
SQL_P3_PERCENTILES = f"""{_SQL_DURATIONS} SELECT fmtid, kid, count(*) AS n, CAST(quantile_disc(x, 0.5) AS DOUBLE) AS p50,
 CAST(quantile_disc(x, 0.9) AS DOUBLE) AS p90, CAST(quantile_disc(x, 0.99) AS DOUBLE) AS p99 FROM d GROUP BY fmtid, kid"""
SQL_P3_FOUND = f"""{_SQL_DURATIONS} SELECT fmtid, kid FROM d GROUP BY fmtid, kid
HAVING count(*) >= {P3_MIN} AND quantile_cont(x, 0.9) > {P3_TIMES} * quantile_cont(x, 0.5)"""
SQL_P3_COMBINED = f"""{_SQL_DURATIONS}, c AS (SELECT fmtid, kid, {_SQL_CELL} AS cell FROM d)
SELECT fmtid, kid, count(*) AS n, quantile_disc(cell, 0.5) AS p50, quantile_disc(cell, 0.9) AS p90 FROM c GROUP BY fmtid, kid"""

# -- problem 7: token ids of the whole corpus


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document by the byte-level vocabulary of 50k."""
    return encode.encode(read_table(spark, sf, "documents"), ["doc_id"])


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Every text once through ids and back."""
    return encode.decode(p7_ids(spark, sf), ["doc_id"])


def p7_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Of every text, where its first token begins and its last one ends, in characters."""
    spans = encode.encode_with_offsets(read_table(spark, sf, "documents"), ["doc_id"])
    return spans.select("doc_id", F.get("starts", F.lit(0)).alias("begins"), F.try_element_at("ends", F.lit(-1)).alias("ends"))


SQL_P7_OFFSETS = """SELECT doc_id, CAST(CASE WHEN text <> '' THEN 0 END AS INT) AS begins, CAST(CASE WHEN text <> '' THEN length(text) END AS INT) AS ends FROM documents"""
SQL_P7_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

# -- problem 8: mixing sources to target weights


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return encode.count_tokens(read_table(spark, sf, "documents"), ["doc_id", "source"])


def _shares(sized: DataFrame, targets: DataFrame, size: str = "n_tokens") -> DataFrame:
    plan = materialize(mixing.source_plan(sized, targets, size), "plan")
    return mixing.actual_shares(mixing.mix(sized, targets, size=size, plan=plan), plan, size)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that miss their share in the mix even when repeated as often as allowed."""
    return p8_shares(spark, sf).where(F.col("short")).select("source")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix and how often each occurs."""
    sized = materialize(_sized(spark, sf), "sized")
    return mixing.mix(sized, read_table(spark, sf, "mix_target"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return _shares(materialize(_sized(spark, sf), "sized"), read_table(spark, sf, "mix_target"))


def _by_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def p8_mix_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """The mix with documents sized in bytes, which SQL can count."""
    return mixing.mix(_by_bytes(spark, sf), read_table(spark, sf, "mix_target"), size="n_bytes")


def p8_shares_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of that mix."""
    return _shares(_by_bytes(spark, sf), read_table(spark, sf, "mix_target"), "n_bytes")


_SQL_MIX = r"""WITH k AS (SELECT doc_id, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS s, coalesce(strlen(text), 0) AS n FROM documents),
 have AS (SELECT s, count(*) AS docs, sum(n) AS size FROM k GROUP BY s), total AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM k),
 p AS (SELECT source, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS t, target_share, max_repeats, coalesce(docs, 0) AS docs, coalesce(size, 0) AS size, total,
  CASE WHEN size > 0 THEN least(target_share * total / CAST(size AS DOUBLE), CAST(max_repeats AS DOUBLE)) ELSE 0.0 END AS copies
  FROM mix_target LEFT JOIN have ON lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) = s, total),
 r AS (SELECT k.*, copies, row_number() OVER (PARTITION BY s ORDER BY doc_id, n) AS place, CAST(('0x' || md5(s || '#0')[1:10]) AS BIGINT) / 1099511627776.0::DOUBLE AS u FROM k JOIN p ON s = t),
 m AS (SELECT doc_id, s AS source, CAST(n AS BIGINT) AS n_bytes, CAST(floor(place * copies + u) - floor((place - 1) * copies + u) AS INT) AS copies FROM r)"""
SQL_P8_MIX_BYTES = f"{_SQL_MIX} SELECT * FROM m WHERE copies > 0"
SQL_P8_SHARES_BYTES = f"""{_SQL_MIX}, g AS (SELECT source AS g, count(*) AS docs, CAST(sum(copies) AS BIGINT) AS copies, CAST(sum(n_bytes * copies) AS BIGINT) AS tokens FROM m WHERE copies > 0 GROUP BY 1)
SELECT source, target_share, max_repeats, target_share * total > CAST(max_repeats AS DOUBLE) * size AS short, coalesce(g.docs, 0) AS docs, coalesce(g.copies, 0) AS copies,
 coalesce(tokens, 0) AS tokens, coalesce(tokens, 0) / CAST(sum(coalesce(tokens, 0)) OVER () AS DOUBLE) AS actual_share FROM p LEFT JOIN g ON t = g"""

# -- problem 9: subject area of each document


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """The areas each document's dispute is about."""
    documents = read_table(spark, sf, "documents")
    return subjects.subject_areas(documents, subjects.fit(documents, read_table(spark, sf, "doc_label")))


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus by area."""
    found = materialize(p9_found(spark, sf), "subjects")
    return subjects.composition(found, read_table(spark, sf, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p3_found": p3_found,
    "p3_percentiles": p3_percentiles,
    "p3_combined": p3_combined,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p7_offsets": p7_offsets,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_mix_bytes": p8_mix_bytes,
    "p8_shares_bytes": p8_shares_bytes,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}
SQL = {
    "p1_found": SQL_P1,
    "p1_collapsed": _SQL_RUNS,
    "p3_found": SQL_P3_FOUND,
    "p3_percentiles": SQL_P3_PERCENTILES,
    "p3_combined": SQL_P3_COMBINED,
    "p7_decoded": SQL_P7_DECODED,
    "p7_offsets": SQL_P7_OFFSETS,
    "p8_mix_bytes": SQL_P8_MIX_BYTES,
    "p8_shares_bytes": SQL_P8_SHARES_BYTES,
}
