"""Extension beyond the batch engine: event streams with watermarks, windows, sessions, late data and running means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.sources.shared import load

DELAY = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Count and mean value per type and window; rows later than DELAY behind the newest are dropped."""
    w = F.window("ts", size)
    return _agg(events.withWatermark("ts", DELAY).groupBy(w.alias("w"), "event_type"))


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return _agg(events.withWatermark("ts", DELAY).groupBy(F.window("ts", size, step).alias("w"), "event_type"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    g = events.withWatermark("ts", DELAY).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "user_id", "n")


def unique_events(events: DataFrame) -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"])


def running_mean(events: DataFrame) -> DataFrame:
    """Count and mean of value per type so far (complete mode)."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("mean_value"))


def _agg(grouped) -> DataFrame:
    g = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("mean_value"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "mean_value")


def x01_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling query over the whole table at once; the same plan runs as a stream."""
    return tumbling(load(spark, sf_dir, "events"))


def x02_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(load(spark, sf_dir, "events"))


def x03_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(load(spark, sf_dir, "events"))


def a48_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_mean(load(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (x01_tumbling, x02_sliding, x03_sessions, a48_running_mean)}
ORACLE = {
    "x01_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(avg(value), 8) AS mean_value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3",
    "x02_sliding": "SELECT time_bucket(INTERVAL 1 HOUR, ts) - s * INTERVAL 1 HOUR AS window_start, time_bucket(INTERVAL 1 HOUR, ts) - s * INTERVAL 1 HOUR + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n, round(avg(value), 8) AS mean_value FROM events, (VALUES (0), (1)) v(s) WHERE ts IS NOT NULL GROUP BY 1, 2, 3",
    "x03_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        g AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM g GROUP BY user_id, s""",
    "a48_running_mean": "SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean_value FROM events GROUP BY 1",
}
