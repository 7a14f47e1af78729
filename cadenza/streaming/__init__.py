"""Frame operators on streams: those that need no more of a recording than a watermark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import gate


def gated(frames: DataFrame, **limits: float) -> DataFrame:
    """Confidence and range gates, row by row; the same function as in batch."""
    return gate(frames, **limits)


def voiced_share(frames: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """frames(rec, ts, midi, ...): the voiced share and mean pitch of each recording by window, closed when the watermark has passed."""
    windowed = frames.withWatermark("ts", late).groupBy(F.window("ts", every), "rec")
    return windowed.agg(F.count("*").alias("n"), F.avg(F.col("midi").isNotNull().cast("int")).alias("voiced"), F.avg("midi").alias("pitch")).select("rec", F.col("window.start").alias("since"), "n", "voiced", "pitch")
