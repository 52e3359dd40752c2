"""Live views of traces: events are files that keep coming, results are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import TRACE

#: Events later than this after the newest one are left out of windows.
LATE = "10 minutes"


def events(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Events of a folder of trace files, with their time, as they come."""
    found = spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_a_batch).json(path)
    return found.withColumn("time", F.to_timestamp("timestamp"))


def latest_by_stage(stream: DataFrame) -> DataFrame:
    """The newest event of each named stage (by its time, then its text); state is a row for each stage. For complete or update mode."""
    named = stream.where("stage_name is not null and stage_name <> ''")
    last = named.groupBy("stage_name").agg(F.max(F.struct("time", "latency_ms", "meta")).alias("e"), F.count("*").alias("events"))
    return last.select("stage_name", "e.time", "e.latency_ms", "e.meta", "events")


def latency(stream: DataFrame, window: str = "1 minute") -> DataFrame:
    """Events, mean and most milliseconds of each stage in each window; a window is final when events of LATE after it have come."""
    timed = stream.where("time is not null").withWatermark("time", LATE)
    return timed.groupBy(F.window("time", window).alias("w"), "stage_name").agg(F.count("*").alias("events"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("most_ms")).select(F.col("w.start").alias("start"), "stage_name", "events", "mean_ms", "most_ms")
