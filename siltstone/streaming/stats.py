"""Statistics and deduplication over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.registry import query

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Tumbling hours per key; an hour is final when the newest event is ``late`` ahead of it."""
    w = events.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), F.col("event_type").alias("key"))
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("hour"), "key", "n", "mean")


def daily(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Days per key, closed by the watermark rather than by the next day's first event."""
    w = events.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), F.col("event_type").alias("key"))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "key", "n", "total")


def unseen(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Events whose id wasn't seen within the watermark: a membership service with bounded state."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process what is there and return the sink's table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS key, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def streaming_hourly(spark, d):
    """Hourly aggregation of the event stream, all of it processed."""
    import uuid

    source = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("at", F.col("ts").cast("timestamp"))
    out = run_once(hourly(source), f"hourly_{uuid.uuid4().hex}")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "key", "n", F.round("mean", 6).alias("mean"))
