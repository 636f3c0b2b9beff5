"""Streams over the events table, held against batch queries."""

from __future__ import annotations

from marketloom.plans.base import Book
from marketloom.streaming import market as S

Q = Book()
QUERIES, SQL = Q.queries, Q.sql


@Q.add("S1_tumbling_counts", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL", views=False)
def s1(v):
    return S.run_to_end(S.tumbling_counts(S.event_stream(v.spark, v.sf_dir)), "tumbling", "complete")


@Q.add("S2_sessions", """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""", views=False)
def s2(v):
    return S.run_to_end(S.sessions(S.event_stream(v.spark, v.sf_dir)), "sessions", "complete")


@Q.add("S3_first_alerts", "SELECT DISTINCT event_id, user_id, event_type, value FROM events WHERE value > 100", views=False)
def s3(v):
    return S.run_to_end(S.first_alerts(S.event_stream(v.spark, v.sf_dir), 100.0), "alerts")


@Q.add("S4_value_changes", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, count(*) AS n, max(value) FILTER (WHERE k = 2) AS before, max(value) FILTER (WHERE k = 1) AS now FROM r GROUP BY ALL""", views=False)
def s4(v):
    return S.run_to_end(S.value_changes(S.event_stream(v.spark, v.sf_dir)), "changes", "update", ("user_id", "event_type"))
