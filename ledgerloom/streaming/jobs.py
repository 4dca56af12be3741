"""Structured Streaming jobs: windowed counters, delivery dedup, sessions, late roll-ups and cooldown alerts.

``ts`` comes from Parquet without a zone and a watermark needs one, so every job casts it first (session zone UTC).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the files of ``path``; the schema comes from one read of it."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counters(events: DataFrame, limit: int = 3, late: str = "2 hours") -> DataFrame:
    """Hits per user and hour and whether they are within the limit; windows are final once the watermark passes."""
    hits = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("hits"))
    return hits.select("user_id", F.col("w.start").alias("start"), "hits", (F.col("hits") <= limit).alias("allowed"))


def deliveries(events: DataFrame, keep: str = "24 hours") -> DataFrame:
    """The first delivery of each id; ids are forgotten when the watermark passes, which bounds the state."""
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["event_id"])


def bursts(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """One row per user and burst, when the burst has been quiet for ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


def daily_rollup(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Cents per workspace and day; an update repeats a day's row, and the sink keeps the last."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), (F.col("user_id") % 10).alias("workspace"))
    return rows.agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select("workspace", F.to_date("w.start").alias("day"), "cents")


def upsert_days(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: overwrite just the days that a batch has, so that a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "workspace").parquet(path)

    return write


def cooldown_alerts(events: DataFrame, above: float = 80.0, cooldown_s: int = 12 * 3600, late: str = "1 hour") -> DataFrame:
    """Alerts at least ``cooldown_s`` after the user's last fired one; the state is one time per user, dropped once it can block nothing."""

    def fire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else -(1 << 62)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        kept = []
        for at in rows["at"]:
            kept.append(at - last >= cooldown_s)
            last = at if kept[-1] else last
        state.update((int(last),))
        state.setTimeoutTimestamp(max((int(last) + cooldown_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[kept, ["user_id", "event_id"]]

    hot = events.withWatermark("ts", late).where(F.col("value") > above).select("user_id", "event_id", "ts", F.unix_timestamp("ts").alias("at"))
    return hot.groupBy("user_id").applyInPandasWithState(fire, "user_id long, event_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
