"""Usage-ledger queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L
from ledgerloom.plans.registry import query, table

U = """u AS (SELECT event_id, ts, user_id, event_type, props, user_id % 10 AS workspace, ts::DATE AS day, round(value * 100)::BIGINT AS cents,
  CASE WHEN event_type <> 'error' THEN round(value * 100)::BIGINT END AS priced_cents FROM events)"""
START, END, MONTH_START, NOW = "2024-01-01", "2024-01-25", "2024-01-01", "2024-01-25"
SERIES = f"""{U}, d AS (SELECT workspace, day, sum(cents)::BIGINT AS cents FROM u WHERE day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ALL),
 k AS (SELECT DISTINCT workspace FROM d), c AS (SELECT workspace, unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::DATE AS day FROM k),
 f AS (SELECT workspace, day, coalesce(d.cents, 0) AS cents FROM c LEFT JOIN d USING (workspace, day)),
 s AS (SELECT workspace, list(cents::DOUBLE ORDER BY day) AS xs FROM f GROUP BY 1)"""
OLS = "regr_intercept(x, i) + regr_slope(x, i) * count(*)"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.usage(table(spark, sf_dir, "events"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = L.daily(_usage(spark, sf_dir).where(F.col("day").between(START, END)), "workspace")
    return L.fill_days(days, START, END, "workspace")


@query(f"WITH {U} SELECT sum(cents)::BIGINT AS cents, sum(priced_cents)::BIGINT AS priced, count(*) AS n FROM u")
def ledger_totals(spark, sf_dir):
    return _usage(spark, sf_dir).agg(F.sum("cents").alias("cents"), F.sum("priced_cents").alias("priced"), F.count("*").alias("n"))


@query(f"WITH {U} SELECT event_type, sum(cents)::BIGINT AS cents, count(*) AS n FROM u GROUP BY 1 ORDER BY 2 DESC")
def ledger_by_type(spark, sf_dir):
    return _usage(spark, sf_dir).groupBy("event_type").agg(F.sum("cents").alias("cents"), F.count("*").alias("n")).orderBy(F.desc("cents"))


@query(f"WITH {U} SELECT workspace, (sum(coalesce(priced_cents, 0)) + sum(CASE WHEN priced_cents IS NULL THEN cents ELSE 0 END))::BIGINT AS cents, sum(CASE WHEN priced_cents IS NULL THEN cents ELSE 0 END)::BIGINT AS legacy_cents FROM u GROUP BY 1")
def ledger_conditional_cost(spark, sf_dir):
    legacy = F.sum(F.when(F.col("priced_cents").isNull(), F.col("cents")).otherwise(0))
    return _usage(spark, sf_dir).groupBy("workspace").agg((F.sum(F.coalesce("priced_cents", F.lit(0))) + legacy).alias("cents"), legacy.alias("legacy_cents"))


@query(f"WITH {U} SELECT event_type, CASE WHEN count(*) = 0 THEN 0 WHEN count(priced_cents) = 0 THEN NULL ELSE sum(priced_cents) END::BIGINT AS cost FROM u GROUP BY 1")
def ledger_null_aware_cost(spark, sf_dir):
    return _usage(spark, sf_dir).groupBy("event_type").agg(L.null_aware_sum(F.col("priced_cents")).alias("cost"))


@query(f"WITH {U} SELECT event_id, round(coalesce(priced_cents / 100.0, cents / 100.0), 6)::DOUBLE AS cost_usd FROM u")
def ledger_row_cost(spark, sf_dir):
    return _usage(spark, sf_dir).select("event_id", F.round(F.coalesce(F.col("priced_cents") / 100, F.col("cents") / 100), 6).alias("cost_usd"))


@query(f"WITH {U} SELECT user_id AS session, sum(cents)::BIGINT AS with_cache, sum(CASE WHEN event_type <> 'view' THEN cents ELSE 0 END)::BIGINT AS without_cache, count(priced_cents) AS priced_rows, sum((props->>'$.k')::BIGINT)::BIGINT AS requests FROM u GROUP BY 1")
def ledger_session_summary(spark, sf_dir):
    asked = F.from_json("props", "k long").k
    return _usage(spark, sf_dir).groupBy(F.col("user_id").alias("session")).agg(
        F.sum("cents").alias("with_cache"), F.sum(F.when(F.col("event_type") != "view", F.col("cents")).otherwise(0)).alias("without_cache"), F.count("priced_cents").alias("priced_rows"), F.sum(asked).alias("requests")
    )


@query(f"WITH {U} SELECT workspace, day, sum(cents)::BIGINT AS cents FROM u GROUP BY ALL")
def ledger_daily(spark, sf_dir):
    return L.daily(_usage(spark, sf_dir), "workspace")


@query(f"WITH {SERIES} SELECT * FROM f")
def ledger_gap_filled(spark, sf_dir):
    return _dense(spark, sf_dir)


@query(f"WITH {U} SELECT workspace, sum(CASE WHEN day BETWEEN date_trunc('month', DATE '{NOW}') AND DATE '{NOW}' THEN cents ELSE 0 END)::BIGINT AS mtd FROM u GROUP BY 1")
def ledger_month_to_date(spark, sf_dir):
    inside = F.col("day").between(F.trunc(F.lit(NOW).cast("date"), "month"), F.lit(NOW).cast("date"))
    return _usage(spark, sf_dir).groupBy("workspace").agg(F.sum(F.when(inside, F.col("cents")).otherwise(0)).alias("mtd"))


@query(f"WITH {SERIES}, p AS (SELECT workspace, cents::DOUBLE AS x, row_number() OVER (PARTITION BY workspace ORDER BY day) - 1 AS i FROM f) SELECT workspace, round(regr_slope(x, i), 4) AS slope, round(regr_intercept(x, i), 4) AS intercept, round({OLS}, 4) AS next_day FROM p GROUP BY 1")
def ledger_trend(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("workspace").orderBy("day")) - 1
    p = _dense(spark, sf_dir).select("workspace", F.col("cents").cast("double").alias("x"), at.alias("i"))
    fit = p.groupBy("workspace").agg(F.regr_slope("x", "i").alias("s"), F.regr_intercept("x", "i").alias("c"), F.count("*").alias("n"))
    return fit.select("workspace", F.round("s", 4).alias("slope"), F.round("c", 4).alias("intercept"), F.round(F.col("c") + F.col("s") * F.col("n"), 4).alias("next_day"))


EWMA = "list_reduce(xs, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a)"


@query(f"WITH {SERIES} SELECT workspace, round({EWMA}, 4) AS level FROM s")
def ledger_ewma(spark, sf_dir):
    return L.series(_dense(spark, sf_dir), "workspace").select("workspace", F.round(L.ewma(F.col("xs")), 4).alias("level"))


FORECAST = f"""{SERIES}, p AS (SELECT workspace, cents::DOUBLE AS x, row_number() OVER (PARTITION BY workspace ORDER BY day) - 1 AS i FROM f),
 o AS (SELECT workspace, {OLS} AS ols FROM p GROUP BY 1), m AS (SELECT workspace, sum(cents) AS mtd FROM f GROUP BY 1),
 r AS (SELECT workspace, mtd, 0.5 * greatest(0, ols) + 0.5 * greatest(0, {EWMA}) AS rate FROM s JOIN o USING (workspace) JOIN m USING (workspace)),
 pr AS (SELECT workspace, mtd::BIGINT AS mtd, round(rate, 4) AS rate, ceil(round(mtd + rate * 6, 4))::BIGINT AS projected FROM r)"""


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month to date, blended daily rate and month-end projection per workspace; six days of the month remain."""
    days = _dense(spark, sf_dir)
    rated = L.series(days, "workspace").select("workspace", L.run_rate(F.col("xs")).alias("rate"), F.aggregate("xs", F.lit(0.0), lambda a, x: a + x).cast("long").alias("mtd"))
    left = F.dayofmonth(F.last_day(F.lit(NOW).cast("date"))) - F.dayofmonth(F.lit(NOW).cast("date"))
    return rated.select("workspace", "mtd", F.round("rate", 4).alias("rate"), F.ceil(F.round(F.col("mtd") + F.col("rate") * left, 4)).alias("projected"))


@query(f"WITH {FORECAST} SELECT * FROM pr")
def ledger_projection(spark, sf_dir):
    return _forecast(spark, sf_dir)


@query(f"""WITH {SERIES}, p AS (SELECT workspace, cents::DOUBLE AS x, row_number() OVER (PARTITION BY workspace ORDER BY day) - 1 AS i FROM f),
 t AS (SELECT a.workspace, a.i, a.x AS actual, regr_intercept(b.x, b.i) + regr_slope(b.x, b.i) * a.i AS ols, list_reduce(list(b.x ORDER BY b.i), lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a) AS ew
   FROM p a JOIN p b ON a.workspace = b.workspace AND b.i < a.i WHERE a.i >= 12 GROUP BY 1, 2, 3)
 SELECT workspace, round(coalesce(avg(abs((actual - (0.5 * greatest(0, ols) + 0.5 * greatest(0, ew))) / actual)) FILTER (WHERE actual <> 0), 0), 6) AS mape FROM t GROUP BY 1""")
def ledger_backtest(spark, sf_dir):
    return L.series(_dense(spark, sf_dir), "workspace").select("workspace", F.round(L.backtest(F.col("xs")), 6).alias("mape"))


RULES = "(VALUES (1, 50.0, 'mtd', 60, true, NULL), (2, 90.0, 'projected', 60, true, 30), (3, 80.0, 'projected', 60, true, 90), (4, 10.0, 'mtd', 0, false, NULL)) AS rule(rule_id, threshold, basis, cooldown, enabled, minutes_since)"


@query(f"""WITH {FORECAST} SELECT workspace, rule_id, CASE WHEN NOT enabled THEN 'disabled' WHEN (workspace % 4) * 400000 <= 0 THEN 'no-budget'
 WHEN (CASE basis WHEN 'mtd' THEN mtd ELSE projected END) * 100.0 / ((workspace % 4) * 400000) < threshold THEN 'below-threshold' WHEN minutes_since < cooldown THEN 'cooldown' ELSE 'fired' END AS outcome FROM pr, {RULES}""")
def trace_usage_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums, filled gaps, trend and level, projection, then every rule on every workspace."""
    rules = spark.sql(f"SELECT * FROM {RULES}")
    both = _forecast(spark, sf_dir).join(F.broadcast(rules))  # a fixed list of four rules
    spend = F.when(F.col("basis") == "mtd", F.col("mtd")).otherwise(F.col("projected"))
    return both.select("workspace", "rule_id", L.alert_outcome((F.col("workspace") % 4) * 400000, F.col("threshold"), spend, F.col("minutes_since"), F.col("cooldown"), F.col("enabled")).alias("outcome"))


@query(f"""WITH {U}, a AS (SELECT workspace, sum(CASE WHEN day = DATE '{NOW}' THEN cents ELSE 0 END) AS d, sum(CASE WHEN day BETWEEN DATE '{MONTH_START}' AND DATE '{NOW}' THEN cents ELSE 0 END) AS m FROM u GROUP BY 1)
 SELECT workspace, CASE WHEN greatest(d / 20000.0, m / 700000.0) >= 1 THEN 'deny' WHEN greatest(d / 20000.0, m / 700000.0) >= 0.8 THEN 'soft' ELSE 'allow' END AS outcome FROM a""")
def ledger_budget_check(spark, sf_dir):
    on = lambda cond: F.sum(F.when(cond, F.col("cents")).otherwise(0))
    a = _usage(spark, sf_dir).groupBy("workspace").agg(on(F.col("day") == NOW).alias("d"), on(F.col("day").between(MONTH_START, NOW)).alias("m"))
    return a.select("workspace", L.budget_outcome(F.col("d"), F.lit(20000.0), F.col("m"), F.lit(700000.0)).alias("outcome"))


@query(f"WITH {U} SELECT workspace, day, sum(cents)::BIGINT AS cents, count(*) AS n, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM u WHERE day >= DATE '{NOW}' - 2 GROUP BY ALL")
def ledger_late_recompute(spark, sf_dir):
    """The trailing days that each run rolls up again, as an upsert's rows keyed by workspace and day."""
    rows = _usage(spark, sf_dir).where(F.col("day") >= F.date_sub(F.lit(NOW).cast("date"), 2))
    return rows.groupBy("workspace", "day").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), "|").alias("types"))


@query(f"""WITH {U} SELECT event_type, workspace, sum(cents)::BIGINT AS cents, round(count(*) FILTER (WHERE event_type = 'view') / count(*)::DOUBLE, 6) AS hit_ratio, count(*) AS n
 FROM u GROUP BY GROUPING SETS ((event_type, workspace), ())""")
def cache_telemetry_totals(spark, sf_dir):
    """Sums by pair and over everything, in one pass of grouping sets."""
    rows = _usage(spark, sf_dir)
    return rows.groupingSets([["event_type", "workspace"], []], "event_type", "workspace").agg(F.sum("cents").alias("cents"), F.round(F.count_if(F.col("event_type") == "view") / F.count("*"), 6).alias("hit_ratio"), F.count("*").alias("n"))


@query(f"WITH {U} SELECT workspace, event_type AS pass, sum(cents)::BIGINT AS cents, CASE WHEN bool_and(priced_cents IS NOT NULL) THEN sum(priced_cents)::BIGINT END AS cost, round(sum(CASE WHEN cents > 5000 THEN cents ELSE 0 END)::DOUBLE / nullif(sum(cents), 0), 6) AS read_share FROM u GROUP BY ALL")
def prompt_cache_summary(spark, sf_dir):
    large = F.sum(F.when(F.col("cents") > 5000, F.col("cents")).otherwise(0))
    return _usage(spark, sf_dir).groupBy("workspace", F.col("event_type").alias("pass")).agg(
        F.sum("cents").alias("cents"), F.when(F.bool_and(F.col("priced_cents").isNotNull()), F.sum("priced_cents")).alias("cost"), F.round(large / F.nullif(F.sum("cents"), F.lit(0)), 6).alias("read_share")
    )


@query(f"""WITH {U}, c AS (SELECT user_id, event_type, props, workspace, row_number() OVER (PARTITION BY workspace, event_type, props ORDER BY ts, event_id) = 1 AS first FROM u)
 SELECT workspace, count(*) AS calls, count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type = 'error') AS bypasses, count(*) FILTER (WHERE NOT first) AS repeats FROM c GROUP BY 1""")
def tool_cache_summary(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("workspace", "event_type", "props").orderBy("ts", "event_id")) == 1
    c = _usage(spark, sf_dir).withColumn("first", first)
    return c.groupBy("workspace").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "error").alias("bypasses"), F.count_if(~F.col("first")).alias("repeats"))


@query("""SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE value > 90) AS errors, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE k <= 3) AS samples
 FROM (SELECT *, row_number() OVER (PARTITION BY event_type, value > 90 ORDER BY event_id) + CASE WHEN value > 90 THEN 0 ELSE 10 END AS k FROM events) GROUP BY 1""")
def tool_call_telemetry(spark, sf_dir):
    """Calls and errors of each tool with three samples of errors. Samples are picked in 64 parts of a tool, then among these."""
    bad = F.col("value") > 90
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(bad).alias("errors"))
    few = events.where(bad).select("event_type", "event_id", F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("part"))
    for keys in (["event_type", "part"], ["event_type"]):
        few = few.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("event_id"))).where("k <= 3")
    samples = few.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list("event_id")).cast("array<string>"), ",").alias("samples"))
    return counts.join(samples, "event_type", "left").select(F.col("event_type").alias("tool"), "calls", "errors", "samples")


@query("SELECT strftime(ts, '%Y-%m') AS month, date_trunc('month', ts)::DATE AS start, day(last_day(ts::DATE))::INTEGER AS days, count(*) AS n FROM events GROUP BY ALL")
def ledger_month_bucket(spark, sf_dir):
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.trunc(day, "month").alias("start"), F.dayofmonth(F.last_day(day)).alias("days")).agg(F.count("*").alias("n"))


@query(r"""WITH r AS (SELECT event_type, CASE WHEN workspace IN (1, 3) THEN '=' || event_type ELSE event_type || ',"x"' END AS label, cents FROM (SELECT event_type, user_id % 10 AS workspace, round(value * 100)::BIGINT AS cents FROM events WHERE ts >= TIMESTAMP '2024-01-18' AND ts < TIMESTAMP '2024-01-25')),
 q AS (SELECT CASE WHEN regexp_matches(label, '^[=+\-@\t\r]') THEN '''' || label ELSE label END AS label, cents FROM r)
 SELECT CASE WHEN regexp_matches(label, '[",\r\n]') THEN '"' || replace(label, '"', '""') || '"' ELSE label END || ',' || sum(cents)::BIGINT::VARCHAR || chr(13) || chr(10) AS line FROM q GROUP BY label""")
def usage_csv_export(spark, sf_dir):
    """Lines of a seven-day export, with formula characters neutralised and RFC-4180 quoting."""
    from ledgerloom.functions.text import csv_cell

    rows = _usage(spark, sf_dir).where("ts >= '2024-01-18' AND ts < '2024-01-25'")
    label = F.when(F.col("workspace").isin(1, 3), F.concat(F.lit("="), "event_type")).otherwise(F.concat("event_type", F.lit(',"x"')))
    return rows.groupBy(label.alias("label")).agg(F.sum("cents").alias("cents")).select(F.concat(csv_cell(F.col("label")), F.lit(","), F.col("cents").cast("string"), F.lit("\r\n")).alias("line"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS ours FROM orders GROUP BY 1), e AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, round(sum(l_extendedprice), 2) AS theirs FROM lineitem GROUP BY 1)
 SELECT period, round(ours, 1) AS ours, round(theirs, 1) AS theirs, abs(coalesce(ours, 0) - coalesce(theirs, 0)) / greatest(coalesce(ours, 0), coalesce(theirs, 0), 1) > 0.1 AS warning FROM o FULL JOIN e USING (period)""")
def external_ledger_reconciliation(spark, sf_dir):
    ours = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("ours"))
    theirs = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("period")).agg(F.round(F.sum("l_extendedprice"), 2).alias("theirs"))
    a, b = F.coalesce("ours", F.lit(0.0)), F.coalesce("theirs", F.lit(0.0))
    return ours.join(theirs, "period", "full").select("period", F.round("ours", 1).alias("ours"), F.round("theirs", 1).alias("theirs"), (F.abs(a - b) / F.greatest(a, b, F.lit(1.0)) > 0.1).alias("warning"))
