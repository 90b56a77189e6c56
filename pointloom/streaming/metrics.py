"""Metric histories and frame windows as streams; an extension, equal to the batch forms when all rows have come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "ts", name: str = "event_type", value: str = "value") -> DataFrame:
    """(start, end, name, n, avg, max) per window; rows later than the watermark are left out."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = events.withWatermark(at, late).groupBy(w.alias("w"), name)
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max")).select("w.start", "w.end", name, "n", "avg", "max")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", at: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, end, n): runs of events without a longer gap."""
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def fused(left: DataFrame, right: DataFrame, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Frames of one stream with those of another of the same sequence up to ``within`` before: the state is bounded by both watermarks."""
    a = left.select(F.col("sequence"), F.col("ts"), F.col("value")).withWatermark("ts", late)
    b = right.select(F.col("sequence").alias("sequence_2"), F.col("ts").alias("ts_2"), F.col("value").alias("value_2")).withWatermark("ts_2", late)
    return a.join(b, F.expr(f"sequence = sequence_2 AND ts_2 <= ts AND ts_2 >= ts - INTERVAL {within}")).drop("sequence_2")


def running_means(events: DataFrame, name: str = "event_type", value: str = "value") -> DataFrame:
    """(name, n, avg) over all that has come: a complete-mode aggregate with one row per name."""
    return events.groupBy(name).agg(F.count("*").alias("n"), F.avg(value).alias("avg"))


def to_tables(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each batch as one Parquet folder named by its number, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={epoch}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
