"""The journal as a stream: append once, and the latest fact of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def append_once(stream: DataFrame, *keys: str, time: str = "ts", within: str = "1 day") -> DataFrame:
    """The first arrival of each key. Repeats are told for ``within`` after the first by the column ``time``: keys are
    forgotten once the watermark has passed that, so the state stays bounded."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def latest(stream: DataFrame, *keys: str) -> DataFrame:
    """Running last value of each key by seq, whatever order events arrive in (output mode complete or update)."""
    return stream.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))
