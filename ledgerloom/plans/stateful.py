"""Windowed counters, limits, sessions and cooldowns: the batch forms of what ``ledgerloom.streaming`` runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import cache_replay
from ledgerloom.plans.registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS hits, count(*) <= 3 AS allowed FROM events GROUP BY 1, 2")
def fixed_window_counter(spark, sf_dir):
    hits = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour").start.alias("start")).agg(F.count("*").alias("hits"))
    return hits.withColumn("allowed", F.col("hits") <= 3)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hits FROM events")
def sliding_window_log(spark, sf_dir):
    trailing = Window.partitionBy("user_id").orderBy(F.col("at")).rangeBetween(-3600, 0)
    return _events(spark, sf_dir).select("event_id", F.count("*").over(trailing).alias("hits"))


@query("SELECT event_id, greatest(0, 60 - floor(epoch(ts))::BIGINT % 60)::BIGINT AS retry_after, row_number() OVER (PARTITION BY user_id, floor(floor(epoch(ts))::BIGINT / 60) ORDER BY ts, event_id) > 1 AS denied FROM events")
def inbound_limiter(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id", F.floor(F.col("at") / 60)).orderBy("ts", "event_id"))
    return _events(spark, sf_dir).select("event_id", (60 - F.col("at") % 60).alias("retry_after"), (n > 1).alias("denied"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def delivery_dedup(spark, sf_dir):
    """First delivery of each key per day: the batch form of dropping duplicates within a day's watermark."""
    k = F.row_number().over(Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("k", k).where("k = 1").select("event_id")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def burst_sessions(spark, sf_dir):
    """One reconcile per burst: sessions that end after six quiet hours."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE value > 80) WHERE before IS NULL OR ts - before >= INTERVAL 12 HOUR")
def quiet_period_alerts(spark, sf_dir):
    """Alerts that no other candidate of the user came shortly before."""
    hot = table(spark, sf_dir, "events").where("value > 80")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return hot.withColumn("before", before).where("before IS NULL OR ts - before >= INTERVAL '12' HOUR").select("user_id", "event_id")


@query("""WITH RECURSIVE c AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events WHERE value > 80), f AS (SELECT user_id, arg_min(event_id, (s, event_id)) AS event_id, min(s) AS s FROM c GROUP BY 1
 UNION ALL SELECT f.user_id, arg_min(c.event_id, (c.s, c.event_id)), min(c.s) FROM f JOIN c ON c.user_id = f.user_id AND c.s >= f.s + 43200 GROUP BY f.user_id) SELECT user_id, event_id FROM f""")
def cooldown_alerts(spark, sf_dir):
    """Alerts at least twelve hours after the user's last fired one: a sorted stream that keeps one time, whatever a user's events."""

    def fire(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, last = None, -(1 << 62)
        for rows in batches:
            kept = []
            for u, at in zip(rows["user_id"], rows["at"]):
                if u != user:
                    user, last = u, -(1 << 62)
                kept.append(at - last >= 12 * 3600)
                last = at if kept[-1] else last
            yield rows.loc[kept, ["user_id", "event_id"]]

    hot = _events(spark, sf_dir).where("value > 80").select("user_id", "event_id", "at")
    return hot.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(fire, "user_id long, event_id long")


@query()
def semantic_cache_replay(spark, sf_dir):
    """Each label's vectors in id order against those it stored before: hit at cosine 0.92 or more, else stored."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("scope"), "embedding")
    return cache_replay(rows, 0.92)


@query("SELECT event_id, event_type FROM events WHERE md5(event_id::VARCHAR) < '028f5c28f5c28f5c28f5c28f5c28f5c2'")
def hashed_sample(spark, sf_dir):
    """The one percent of events whose hash says so; the same rows on every run."""
    return table(spark, sf_dir, "events").where(F.md5(F.col("event_id").cast("string")) < "028f5c28f5c28f5c28f5c28f5c28f5c2").select("event_id", "event_type")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR)) AS k FROM events) WHERE k <= 20")
def count_limited_sample(spark, sf_dir):
    """Twenty events of each type, the smallest by hash: picked in 64 parts of a type, then among these."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.md5(F.col("event_id").cast("string")).alias("h"))
    rows = rows.withColumn("part", F.substring("h", 31, 2))
    for keys in (["event_type", "part"], ["event_type"]):
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where("k <= 20")
    return rows.select("event_type", "event_id")


@query("SELECT user_id, strftime(ts, '%Y-%m') AS month, sum(round(value * 100)::BIGINT)::BIGINT AS reserved, (sum(round(value * 100)::BIGINT) FILTER (WHERE event_type <> 'error'))::BIGINT AS settled FROM events GROUP BY 1, 2")
def budget_reservations(spark, sf_dir):
    """Monthly reservations; those of failed calls are refunded."""
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum(cents).alias("reserved"), F.sum(F.when(F.col("event_type") != "error", cents)).alias("settled"))


@query("WITH c AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN coalesce(n, 0) <> o_custkey % 5 + 2 THEN 'superseded' WHEN parts < n OR o_orderstatus = 'P' THEN 'source-moved' ELSE 'accepted' END AS outcome FROM orders LEFT JOIN c ON k = o_orderkey")
def version_resolution(spark, sf_dir):
    """A pending change is accepted only if the version it was made for (here: lines of an order) is the current one and its source stands."""
    current = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))
    pending = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 5 + 2).alias("expected"))
    moved = (F.col("parts") < F.col("n")) | (F.col("o_orderstatus") == "P")
    outcome = F.when(F.coalesce("n", F.lit(0)) != F.col("expected"), "superseded").when(moved, "source-moved").otherwise("accepted")
    return pending.join(current, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", outcome.alias("outcome"))
