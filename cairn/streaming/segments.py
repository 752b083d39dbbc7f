"""Streams: runs of equal values, sessions, windows with late data, first-wins with bounded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, most: int) -> DataFrame:
    """Add segment (from 1): a new one where the value changes, and after `most` rows of a run.

    `by` deals the rows out; each of its groups is one receiver or user, in order.
    """
    own = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(own).eqNullSafe(F.col(value)) & (F.row_number().over(own) > 1), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(own))
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*order)) - 1
    cut = marked.withColumn("_cut", (place % most == 0).cast("int"))
    return cut.withColumn("segment", F.sum("_cut").over(own)).drop("_new", "_run", "_cut")


def sessions(events: DataFrame, key: str, time: str, gap: str, value: str) -> DataFrame:
    """Sessions of each key: begin, last event, number and sum; also on streams with a watermark."""
    return events.groupBy(key, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")).select(key, "first_ts", "last_ts", "events", "total")


def tumbling(events: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """Counts by window and keys; also on streams with a watermark."""
    return events.groupBy(F.window(time, width).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("_w.start").alias("window_start"), *keys, "events")


def sliding(events: DataFrame, time: str, width: str, step: str, *keys: str) -> DataFrame:
    """Counts by overlapping windows and keys; also on streams with a watermark."""
    return events.groupBy(F.window(time, width, step).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("_w.start").alias("window_start"), *keys, "events")


def first_seen(events: DataFrame, keys: Sequence[str], time: str, within: str) -> DataFrame:
    """Rows whose key was not seen before, remembered for `within` after the watermark. On streams only."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def late(events: DataFrame, time: str, order: str, delay: Column, by: Sequence[str]) -> DataFrame:
    """Rows that come more than `delay` after the latest time seen before them, in order of arrival."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_seen", F.max(time).over(before)).where(F.col(time) < F.col("_seen") - delay).drop("_seen")
