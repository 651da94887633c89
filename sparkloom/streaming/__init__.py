"""Structured Streaming over the same bucket as DATE_BIN: an extension, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import parse_interval


def bucketed(stream: DataFrame, time: str, stride: str, late: str, keys: list[str] | None = None, value: str | None = None) -> DataFrame:
    """bucket, keys, n and, of value, sum and mean: event-time windows of a stride from the epoch. Rows later than late are dropped by the watermark."""
    seconds = parse_interval(stride) / 1e6
    df = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{parse_interval(late) // 1_000_000} seconds")
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(F.col(value).cast("double")).alias("total"), F.avg(value).alias("mean")] if value else [])
    out = df.groupBy(F.window(time, f"{seconds} seconds").alias("w"), *(keys or [])).agg(*aggs)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), *(keys or []), *[c for c in out.columns if c in ("n", "total", "mean")])


def sessions(stream: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """start, end, keys and n of runs of events with no gap that long."""
    df = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{parse_interval(late) // 1_000_000} seconds")
    out = df.groupBy(F.session_window(time, f"{parse_interval(gap) / 1e6} seconds").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n")
