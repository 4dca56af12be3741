"""Usage-ledger operators: roll-ups, gap filling, trend, projection, back-test, budgets and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, WEIGHT = 0.3, 0.5


def usage(events: DataFrame) -> DataFrame:
    """The ledger view of ``events``: workspace, UTC day, whole cents, and a row that may be unpriced."""
    cents = F.round(F.col("value") * 100).cast("long")
    return events.select(
        "event_id", "ts", "user_id", "event_type", "props", (F.col("user_id") % 10).alias("workspace"), F.to_date("ts").alias("day"), cents.alias("cents"),
        F.when(F.col("event_type") != "error", cents).alias("priced_cents"),
    )


def null_aware_sum(priced: Column) -> Column:
    """0 without rows, null if no row is priced, else the sum."""
    return F.when(F.count("*") == 0, F.lit(0).cast("long")).when(F.count(priced) == 0, F.lit(None).cast("long")).otherwise(F.sum(priced))


def daily(rows: DataFrame, *keys: str, amount: str = "cents") -> DataFrame:
    return rows.groupBy(*keys, "day").agg(F.sum(amount).alias("cents"))


def fill_days(days: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Every day from start to end for every key, absent ones as 0. The calendar is generated per key."""
    calendar = days.select(*keys).distinct() if keys else days.sparkSession.range(1).select()
    calendar = calendar.withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return calendar.join(days, [*keys, "day"], "left").select(*keys, "day", F.coalesce("cents", F.lit(0).cast("long")).alias("cents"))


def series(days: DataFrame, *keys: str) -> DataFrame:
    """One row per key with its amounts in day order; a key has as many values as the window has days."""
    ordered = F.array_sort(F.collect_list(F.struct("day", "cents")))
    return days.groupBy(*keys).agg(F.transform(ordered, lambda x: x.cents.cast("double")).alias("xs"))


def ols_at(xs: Column, at: Column) -> Column:
    """Least squares over (0..n-1, xs), at ``at``; one value has slope 0, none gives 0."""
    n = F.size(xs).cast("double")
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    sy = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    sxy = F.aggregate(F.transform(xs, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    slope = F.when(n < 2, 0.0).otherwise((n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0)))
    return F.when(n == 0, 0.0).otherwise((sy - slope * sx) / F.nullif(n, F.lit(0.0)) + slope * at)


def ewma(xs: Column, alpha: float = ALPHA) -> Column:
    """Seeded with the first value; 0 without values. Alpha is held within 0.01 and 1."""
    alpha = min(1.0, max(0.01, alpha))
    tail = F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))
    return F.coalesce(F.aggregate(tail, F.get(xs, F.lit(0)), lambda a, x: alpha * x + (1 - alpha) * a), F.lit(0.0))


def run_rate(xs: Column, weight: float = WEIGHT, alpha: float = ALPHA) -> Column:
    return weight * F.greatest(F.lit(0.0), ols_at(xs, F.size(xs).cast("double"))) + (1 - weight) * F.greatest(F.lit(0.0), ewma(xs, alpha))


def backtest(xs: Column, weight: float = WEIGHT, alpha: float = ALPHA) -> Column:
    """Mean absolute percentage error of the next day, from each prefix of max(7, n/2) days on; null below 10 days.

    Days of 0 are left out, and a series of only such days gives 0.
    """
    first = F.greatest(F.lit(7), F.floor(F.size(xs) / 2).cast("int"))
    errors = F.transform(
        F.filter(F.sequence(first, F.size(xs) - 1), lambda i: F.get(xs, i) != 0),
        lambda i: F.abs((F.get(xs, i) - run_rate(F.slice(xs, F.lit(1), i), weight, alpha)) / F.get(xs, i)),
    )
    mean = F.aggregate(errors, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(errors), F.lit(1))
    return F.when(F.size(xs) >= 10, mean)


def alert_outcome(budget: Column, threshold: Column, spend: Column, minutes_since: Column, cooldown: Column, enabled: Column) -> Column:
    """``fired`` or why not, in the order the checks are made."""
    return (
        F.when(~enabled, "disabled")
        .when(budget.isNull() | (budget <= 0), "no-budget")
        .when(spend * 100.0 / budget < threshold, "below-threshold")
        .when(minutes_since < cooldown, "cooldown")
        .otherwise("fired")
    )


def budget_outcome(daily_spend: Column, daily_limit: Column, monthly_spend: Column, monthly_limit: Column) -> Column:
    """The limit used up most decides: 1 or more denies, 0.8 or more warns."""
    used = F.greatest(F.coalesce(daily_spend / daily_limit, F.lit(0.0)), F.coalesce(monthly_spend / monthly_limit, F.lit(0.0)))
    return F.when(used >= 1, "deny").when(used >= 0.8, "soft").otherwise("allow")
