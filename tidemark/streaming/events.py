"""Streaming read-outs of the job queue and of dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(jobs: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Jobs by window and status; rows later than the watermark are left out, and so is their state."""
    return (
        jobs.withWatermark("updated_at", late).groupBy(F.window("updated_at", window), "status").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("since"), "status", "n")
    )


def failed(outcomes: DataFrame) -> DataFrame:
    """The dead-letter side of a stream of outcomes."""
    return outcomes.where("outcome = 'failed'")
