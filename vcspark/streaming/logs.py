"""Log and ingest streams: summaries by event time, segments by gaps, upserts by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def level_counts(logs: DataFrame, at: str = "ts", level: str = "event_type", late: str = "10 minutes", width: str = "1 hour", slide: str = "1 hour") -> DataFrame:
    """Rows by level and window; those later than ``late`` are dropped."""
    return logs.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), level).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), level, "n")


def sessions(rows: DataFrame, key: str, at: str = "ts", gap: str = "1500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Segments whose times are at most ``gap`` apart, as session windows."""
    return rows.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("end")).drop("w")


def batch_writer(path: str, partition: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch has a folder of its own that a repeated call writes again, so a retried batch isn't doubled."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/batch={number}")

    return write
