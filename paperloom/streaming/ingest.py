"""Incremental ingest: streams of records or events without repeats, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(stream: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first arrival of each key within the watermark; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, kind: str, at: str = "ts", size: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Rows of each kind in each window; ``late`` None keeps the watermark that the stream has."""
    w = F.window(at, size)
    return (stream if late is None else stream.withWatermark(at, late)).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Drive a stream through what has arrived and stop; the result is the in-memory table ``name``: for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def to_table(df: DataFrame, path: str, checkpoint: str):
    """Append a stream to a table, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
