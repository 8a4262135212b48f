"""Contacts as they arrive: spans of uninterrupted contact and counts per window of time, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_time(contacts: DataFrame, epoch: str = "1970-01-01 00:00:00") -> DataFrame:
    """Adds `at`: simulation time in femtoseconds as a timestamp of as many milliseconds after the epoch (watermarks count in milliseconds)."""
    return contacts.withColumn("at", F.timestamp_millis(F.unix_millis(F.lit(epoch).cast("timestamp")) + F.col("t_fs").cast("long")))


def contact_spans(stream: DataFrame, ids: list[str], gap: str, late: str) -> DataFrame:
    """(ids, first, last, n): each contact's spans, parted where it is not seen for `gap`; a span is given out when the watermark has passed it.

    stream: (ids, at, ...) streaming or not. State is one open span per contact, and rows later than `late` are dropped.
    """
    s = stream.withWatermark("at", late).groupBy(F.session_window("at", gap), *ids)
    return s.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).drop("session_window")


def contact_counts(stream: DataFrame, width: str, slide: str, late: str, *keys: str) -> DataFrame:
    """(keys, begins, ends, n): contacts per sliding window of time."""
    s = stream.withWatermark("at", late).groupBy(F.window("at", width, slide), *keys).agg(F.count("*").alias("n"))
    return s.select(*keys, F.col("window.start").alias("begins"), F.col("window.end").alias("ends"), "n")
