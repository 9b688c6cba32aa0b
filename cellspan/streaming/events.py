"""Windows over frame metrics and events; each function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of a folder to which a Parquet file is added for each frame."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, keys: list[str], value: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Number and sum by key and window; windows overlap if slide is given."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = late(df, ts, delay).groupBy(win.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    out = late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n")


def distinct_events(df: DataFrame, ts: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """One row for each key: in a stream, within the watermark."""
    return late(df, ts, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
