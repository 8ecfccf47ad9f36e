"""Evidence as a stream: observations arrive, candidates are appended, nothing is rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def accepted(observations: DataFrame, regions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of observations (report_id, region_id, text, status, ts) of known regions, each once within the delay.

    regions is a static table; the join is stateless, and the state of the duplicates' filter is bounded by the watermark.
    """
    once = observations.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["report_id", "region_id", "text", "status"])
    known = regions.select("report_id", "region_id").distinct()
    return once.join(known, ["report_id", "region_id"]).withColumns({"source": F.lit("vlm"), "confidence": F.lit(None).cast("double"), "needs_review": F.lit(True)})


def rejected(observations: DataFrame, regions: DataFrame) -> DataFrame:
    known = regions.select("report_id", "region_id").distinct()
    return observations.join(known, ["report_id", "region_id"], "left_anti").withColumn("reason", F.lit("unknown_region"))


def append(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An append-only table of candidates; a restart goes on from its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def review_counts(stream: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Candidates by window and status of a stream that has its watermark."""
    return stream.groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("candidates")).select(F.col("window.start").alias("start"), "status", "candidates")
