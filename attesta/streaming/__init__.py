"""Streams: operators that need no state run as they are; one windowed count shows the stateful side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.noise import NoiseRates, apply_noise
from ..operators.validate import grammar_errors


def read_stream(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def noised_stream(records: DataFrame, rates: NoiseRates, seed: int) -> DataFrame:
    """Noise depends on seed and record alone, so a stream gets the same rows as a batch."""
    return apply_noise(records, rates, seed)


def grammar_error_stream(events: DataFrame) -> DataFrame:
    """Faults of events as they arrive."""
    return grammar_errors(events)


def event_windows(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n): counts in tumbling windows; rows later than the watermark are left out."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), kind, "n")
