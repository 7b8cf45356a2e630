"""Windowed and session reports over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminar.queries import query
from laminar.sources.views import read
from laminar.streaming import running


@query("event_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS largest FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    found = running.windowed(read(spark, sf_dir, "events"))
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("largest", 6).alias("largest"))


@query("event_sessions", """SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events)) GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    found = running.sessions(read(spark, sf_dir, "events"))
    return found.select("user_id", "n", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"))
