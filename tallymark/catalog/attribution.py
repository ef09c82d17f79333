"""Queries: log events to spans, references to parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog import inputs
from tallymark.operators import attribution as a, results


def attribute_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, spans = inputs.log_events(spark, sf_dir), inputs.spans(spark, sf_dir)
    found = a.attribute_by_window(events, spans, id_columns={"trace_id": "trace_id"})
    return found.select("event_id", "span_id")


def attribute_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = a.attribute_cascade(inputs.log_events(spark, sf_dir), inputs.broken_spans(spark, sf_dir), "default-run")
    return found.select("event_id", "span_id", "match_kind")


def attribute_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = {"name": "name", "trace_id": "trace_id"}
    found = a.attribute_by_ids(inputs.log_events(spark, sf_dir), inputs.spans(spark, sf_dir), ids)
    return found.select("event_id", "span_id", "match_kind")


def repair_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = a.repair_bounds(inputs.broken_spans(spark, sf_dir), inputs.log_events(spark, sf_dir))
    return repaired.select("span_id", "name", F.col("start").alias("start_ts"), F.col("end").alias("end_ts"), "known_start")


def _orders_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "orders").filter("o_totalprice > 20000")


def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return a.missing_parents(lines, _orders_left(spark, sf_dir), {"l_orderkey": "o_orderkey"})


def null_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return results.null_orphans(lines, _orders_left(spark, sf_dir), "l_orderkey", "o_orderkey")


_EVENTS_SPANS = f"WITH {inputs.LOG_EVENTS}, {inputs.SPANS}"

_REPAIRED = f"""{inputs.BROKEN_SPANS},
mentions AS (
  SELECT b.name, min(e.ts) AS first_ts, max(e.ts) AS last_ts
  FROM (SELECT DISTINCT name FROM broken WHERE start_ts IS NULL OR end_ts IS NULL) b
  JOIN log_events e ON e.name = b.name OR contains(lower(e.message), lower(b.name))
  GROUP BY b.name
), repaired AS (
  SELECT span_id, b.name, start_ts IS NOT NULL AS known_start,
         coalesce(start_ts, first_ts, end_ts - INTERVAL 10 MINUTE, TIMESTAMP '2000-01-01') AS start_ts,
         coalesce(end_ts, last_ts,
                  coalesce(start_ts, first_ts, end_ts - INTERVAL 10 MINUTE, TIMESTAMP '2000-01-01') + INTERVAL 10 MINUTE) AS end_ts
  FROM broken b LEFT JOIN mentions m ON m.name = b.name
)"""

QUERIES = {
    "attribute_by_window": (attribute_by_window, f"""{_EVENTS_SPANS}, hits AS (
  SELECT e.event_id, s.span_id,
         row_number() OVER (PARTITION BY e.event_id ORDER BY s.start_ts, s.span_id) AS rn
  FROM log_events e JOIN spans s
    ON (e.ts BETWEEN s.start_ts - INTERVAL 30 SECOND AND s.end_ts + INTERVAL 30 SECOND
        AND (e.name IS NULL OR e.name = s.name))
    OR e.trace_id = s.trace_id)
SELECT e.event_id, h.span_id FROM log_events e LEFT JOIN hits h ON h.event_id = e.event_id AND h.rn = 1"""),
    "attribute_cascade": (attribute_cascade, f"""{_EVENTS_SPANS}, {_REPAIRED}, hits AS (
  SELECT e.event_id, s.span_id,
         CASE WHEN e.name = s.name THEN 'name'
              WHEN e.ts BETWEEN s.start_ts - INTERVAL 30 SECOND AND s.end_ts + INTERVAL 30 SECOND THEN 'time'
              ELSE 'message' END AS match_kind,
         row_number() OVER (PARTITION BY e.event_id ORDER BY s.known_start, s.start_ts, s.span_id) AS rn
  FROM log_events e JOIN repaired s
    ON e.name = s.name
    OR e.ts BETWEEN s.start_ts - INTERVAL 30 SECOND AND s.end_ts + INTERVAL 30 SECOND
    OR contains(lower(e.message), lower(s.name)))
SELECT e.event_id, coalesce(CAST(h.span_id AS VARCHAR), 'default-run') AS span_id, coalesce(h.match_kind, 'default') AS match_kind
FROM log_events e LEFT JOIN hits h ON h.event_id = e.event_id AND h.rn = 1"""),
    "attribute_by_ids": (attribute_by_ids, f"""{_EVENTS_SPANS}, hits AS (
  SELECT e.event_id, e.ts, s.span_id, row_number() OVER (PARTITION BY e.event_id ORDER BY s.start_ts, s.span_id) AS rn
  FROM log_events e JOIN spans s ON e.name = s.name OR e.trace_id = s.trace_id),
first_hits AS (SELECT event_id, ts, span_id FROM hits WHERE rn = 1),
ranges AS (
  SELECT span_id, min(ts) - INTERVAL 10 SECOND AS lo, max(ts) + INTERVAL 10 SECOND AS hi FROM first_hits GROUP BY span_id),
near AS (
  SELECT e.event_id, r.span_id, row_number() OVER (PARTITION BY e.event_id ORDER BY r.lo, r.span_id) AS rn
  FROM log_events e JOIN ranges r ON e.ts BETWEEN r.lo AND r.hi)
SELECT e.event_id,
       coalesce(CAST(f.span_id AS VARCHAR), CAST(n.span_id AS VARCHAR), 'fallback-' || strftime(e.ts, '%Y-%m-%d %H:%M')) AS span_id,
       CASE WHEN f.span_id IS NOT NULL THEN 'id' WHEN n.span_id IS NOT NULL THEN 'proximity' ELSE 'minute' END AS match_kind
FROM log_events e LEFT JOIN first_hits f ON f.event_id = e.event_id
LEFT JOIN near n ON n.event_id = e.event_id AND n.rn = 1"""),
    "repair_bounds": (repair_bounds, f"""{_EVENTS_SPANS}, {_REPAIRED}
SELECT span_id, name, start_ts, end_ts, known_start FROM repaired"""),
    "missing_parents": (missing_parents, """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_totalprice > 20000)"""),
    "null_orphans": (null_orphans, """SELECT o.o_orderkey AS l_orderkey, l.l_linenumber, l.l_quantity
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_totalprice > 20000"""),
}
