"""Batch twins of the streaming statistics, over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import views as V
from ..streaming import statistics as S


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("double"))
    w = S.windowed_statistics(e, "ts", "value", "event_type").drop("mean")
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.sessions(V.table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {
    "stream_windowed_statistics": (windowed, "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2"),
    "stream_sessions": (sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"),
}
