"""Limits with feedback over the events: the sorted-stream forms of what ``ledgerloom.streaming.limits`` also runs as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.registry import query, table
from ledgerloom.streaming import limits

#: Three admitted hits in 24 hours; an allowance of 120,000 cents a month, reservations kept for 12 hours.
MOST, DAY, CAP, KEEP = 3, 86_400_000, 120_000, 43_200_000


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


@query(f"""WITH RECURSIVE h AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events), s AS (
 SELECT user_id, n, event_id, ms, [ms] AS times, true AS allowed, {MOST - 1}::BIGINT AS remaining, 0::BIGINT AS retry_after FROM h WHERE n = 1
 UNION ALL SELECT user_id, n, event_id, ms, CASE WHEN len(kept) < {MOST} THEN list_append(kept, ms) ELSE kept END, len(kept) < {MOST}, CASE WHEN len(kept) < {MOST} THEN {MOST - 1} - len(kept) ELSE 0 END, CASE WHEN len(kept) < {MOST} THEN 0 ELSE greatest(1, kept[1] + {DAY} - ms) END
 FROM (SELECT h.user_id, h.n, h.event_id, h.ms, list_filter(s.times, lambda x: x > h.ms - {DAY}) AS kept FROM s JOIN h ON h.user_id = s.user_id AND h.n = s.n + 1))
 SELECT event_id, allowed, remaining, retry_after FROM s""")
def sliding_limiter(spark, sf_dir):
    """A sliding-window limiter: denied hits are not recorded, and say when to try again."""
    return limits.admitted(hits(spark, sf_dir), MOST, DAY)


#: Calls reserve at their event, and are closed 10 to 1,000 minutes later: settled at none, half or all of the reservation, errors refunded;
#: every seventh is never closed, every fifth is closed again an hour later.
OPS = """ops AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, 'reserve' AS op, event_id AS call, 0 AS seq, round(value * 100)::BIGINT AS tokens FROM events
 UNION ALL SELECT user_id, epoch_us(ts) // 1000 + ((props->>'$.k')::BIGINT + 1) * 600000 + seq * 3600000, CASE WHEN event_type = 'error' THEN 'refund' ELSE 'settle' END, event_id, 1 + seq, round(value * 100)::BIGINT * (event_id % 3) // 2
 FROM events, (SELECT unnest([0, 1]) AS seq) WHERE event_id % 7 <> 0 AND (seq = 0 OR event_id % 5 = 0))"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("call"), F.round(F.col("value") * 100).cast("long").alias("cents"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    first = F.struct(F.col("at").alias("at"), F.lit("reserve").alias("op"), F.lit(0).alias("seq"), F.col("cents").alias("tokens"))
    kind = F.when(F.col("event_type") == "error", "refund").otherwise("settle")
    close = [F.struct((F.col("at") + (F.col("k") + 1) * 600_000 + again * 3_600_000).alias("at"), kind.alias("op"), F.lit(1 + again).alias("seq"), F.floor(F.col("cents") * (F.col("call") % 3) / 2).alias("tokens")) for again in (0, 1)]
    each = F.when(F.col("call") % 7 == 0, F.array(first)).when(F.col("call") % 5 == 0, F.array(first, *close)).otherwise(F.array(first, close[0]))
    rows = events.select("user_id", "call", F.explode(each).alias("o")).select("user_id", "call", "o.*")
    return rows.withColumn("ts", F.timestamp_millis("at")).withColumn("month", F.date_format("ts", "yyyy-MM"))


@query(f"""WITH RECURSIVE {OPS}, h AS (SELECT *, strftime(epoch_ms(ms), '%Y-%m') AS month, row_number() OVER (PARTITION BY user_id ORDER BY ms, call, seq) AS n FROM ops), s AS (
 SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS call, 0 AS seq, '' AS month, '' AS outcome, 0::BIGINT AS used, 0::BIGINT AS calls, []::STRUCT(call BIGINT, tokens BIGINT, until BIGINT)[] AS held FROM h WHERE n = 1
 UNION ALL SELECT user_id, n, call, seq, month, outcome,
  CASE outcome WHEN 'reserved' THEN used + tokens WHEN 'settled' THEN used + tokens - mine[1].tokens WHEN 'refunded' THEN used - mine[1].tokens ELSE used END,
  CASE outcome WHEN 'reserved' THEN calls + 1 WHEN 'refunded' THEN calls - 1 ELSE calls END,
  CASE WHEN outcome = 'reserved' THEN list_append(live, {{'call': call, 'tokens': tokens, 'until': ms + {KEEP}}}) WHEN outcome IN ('settled', 'refunded') THEN list_filter(live, lambda x: x.call <> mine[1].call) ELSE live END
 FROM (SELECT *, CASE WHEN op = 'reserve' THEN CASE WHEN len(mine) > 0 THEN 'repeated' WHEN used + tokens > {CAP} THEN 'exceeded' ELSE 'reserved' END WHEN len(mine) = 0 THEN 'unknown' WHEN op = 'refund' THEN 'refunded' ELSE 'settled' END AS outcome
  FROM (SELECT *, list_filter(live, lambda x: x.call = this.call) AS mine FROM (SELECT h.user_id, h.n, h.call, h.seq, h.month, h.op, h.ms, h.tokens, {{'call': h.call}} AS this,
    CASE WHEN h.month = s.month THEN list_filter(s.held, lambda x: x.until > h.ms) ELSE [] END AS live,
    CASE WHEN h.month = s.month THEN s.used - coalesce(list_sum(list_transform(list_filter(s.held, lambda x: x.until <= h.ms), lambda x: x.tokens)), 0)::BIGINT ELSE 0 END AS used,
    CASE WHEN h.month = s.month THEN s.calls - len(list_filter(s.held, lambda x: x.until <= h.ms)) ELSE 0 END AS calls
   FROM s JOIN h ON h.user_id = s.user_id AND h.n = s.n + 1))))
 SELECT call, seq, outcome, used, calls FROM s WHERE n > 0""")
def budget_ledger(spark, sf_dir):
    """Reservations held by call until they are settled, refunded or expire; every operation with its outcome and the month's figures after it."""
    return limits.reservations(operations(spark, sf_dir), CAP, KEEP)
