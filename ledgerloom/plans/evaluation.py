"""Evaluation queries: labels against rules over documents, verdict roll-ups, runs and arms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import metrics as M
from ledgerloom.plans.registry import query, table

SCORED = "s AS (SELECT doc_id, source, lang, quality = 1 AS actual, n_chars > 400 AS predicted, least(1.0, n_chars / 20000.0)::DOUBLE AS confidence, n_chars FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select("doc_id", "source", "lang", (F.col("quality") == 1).alias("actual"), (F.col("n_chars") > 400).alias("predicted"), F.least(F.lit(1.0), F.col("n_chars") / 20000).alias("confidence"), "n_chars")


PRF = "SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS r FROM c"
COUNTS = "count(*) FILTER (WHERE actual AND predicted) AS tp, count(*) FILTER (WHERE NOT actual AND predicted) AS fp, count(*) FILTER (WHERE actual AND NOT predicted) AS fn, count(*) FILTER (WHERE NOT actual AND NOT predicted) AS tn"


@query(f"WITH {SCORED}, c AS (SELECT source, {COUNTS} FROM s GROUP BY 1), x AS ({PRF}) SELECT source, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM x")
def precision_recall(spark, sf_dir):
    c = M.confusion(_scored(spark, sf_dir), F.col("actual"), F.col("predicted"), "source")
    p, r, f1 = M.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("source", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query(f"WITH {SCORED}, c AS (SELECT {COUNTS} FROM s) SELECT tp, fp, fn, tn, round(CASE WHEN fp + tn = 0 THEN 1 ELSE fp / (fp + tn)::DOUBLE END, 6) AS over_flag FROM c")
def confusion_overall(spark, sf_dir):
    return M.confusion(_scored(spark, sf_dir), F.col("actual"), F.col("predicted"))


@query(f"WITH {SCORED}, c AS (SELECT lang, {COUNTS} FROM s GROUP BY GROUPING SETS ((lang), ())) SELECT lang, tp, fp, fn, tn FROM c")
def confusion_sliced(spark, sf_dir):
    a, p = F.col("actual"), F.col("predicted")
    counts = [F.count_if(c).alias(n) for n, c in (("tp", a & p), ("fp", ~a & p), ("fn", a & ~p), ("tn", ~a & ~p))]
    return _scored(spark, sf_dir).groupingSets([["lang"], []], "lang").agg(*counts)


@query(f"WITH {SCORED}, c AS (SELECT source, {COUNTS} FROM s GROUP BY 1), x AS ({PRF}) SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(sum(tp) / sum(tp + fp)::DOUBLE, 6) AS micro_precision, round(avg(CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_rate FROM x")
def macro_micro(spark, sf_dir):
    c = M.confusion(_scored(spark, sf_dir), F.col("actual"), F.col("predicted"), "source")
    p, r, _ = M.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.agg(F.round(F.avg(p), 6).alias("macro_precision"), F.round(F.avg(r), 6).alias("macro_recall"), F.round(F.sum("tp") / F.sum(F.col("tp") + F.col("fp")), 6).alias("micro_precision"), F.round(F.avg((F.col("tp") > 0).cast("double")), 6).alias("hit_rate"))


SETS = "a AS (SELECT o_custkey AS k, list(DISTINCT o_orderstatus) AS e FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT o_orderstatus) AS f FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1), h AS (SELECT k, len(list_intersect(e, f)) AS hit, len(f) - len(list_intersect(e, f)) AS wrong, len(e) - len(list_intersect(e, f)) AS miss FROM a JOIN b USING (k))"


def _sets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    half = lambda k, n: orders.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderstatus").alias(n))
    hit, wrong, miss = M.set_score(F.col("e"), F.col("f"))
    return half(0, "e").join(half(1, "f"), "k").select("k", hit.alias("hit"), wrong.alias("wrong"), miss.alias("miss"), "e", "f")


@query(f"WITH {SETS} SELECT k, hit::INTEGER AS hit, wrong::INTEGER AS wrong, miss::INTEGER AS miss, round(CASE WHEN hit + wrong = 0 THEN 1 ELSE hit / (hit + wrong)::DOUBLE END, 6) AS precision FROM h")
def set_scores(spark, sf_dir):
    return _sets(spark, sf_dir).select("k", "hit", "wrong", "miss", F.round(M.ratio(F.col("hit"), F.col("hit") + F.col("wrong"), 1.0), 6).alias("precision"))


@query(f"WITH {SETS} SELECT round(avg(hit / (hit + wrong + miss)::DOUBLE), 6) AS mean_jaccard, count(*) FILTER (WHERE wrong + miss = 0) AS same, count(*) AS pairs FROM h")
def fresh_agreement(spark, sf_dir):
    return _sets(spark, sf_dir).agg(F.round(F.avg(F.col("hit") / (F.col("hit") + F.col("wrong") + F.col("miss"))), 6).alias("mean_jaccard"), F.count_if(F.col("wrong") + F.col("miss") == 0).alias("same"), F.count("*").alias("pairs"))


@query(f"WITH {SCORED}, b AS (SELECT least(floor(confidence * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(CASE WHEN actual THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM s GROUP BY 1) SELECT i::INTEGER AS bin, coalesce(n, 0) AS n, confidence, accuracy FROM range(10) t(i) LEFT JOIN b ON b.bin = i")
def calibration_bins(spark, sf_dir):
    return M.calibration(_scored(spark, sf_dir), "confidence", F.col("actual"))


@query(f"WITH {SCORED} SELECT lang, round(avg(x), 6) AS mean, count(x) AS scored, count(*) - count(x) AS unverifiable FROM (SELECT lang, CASE WHEN n_chars > 500 THEN confidence END AS x FROM s) GROUP BY 1")
def mean_with_coverage(spark, sf_dir):
    x = F.when(F.col("n_chars") > 500, F.col("confidence"))
    return _scored(spark, sf_dir).groupBy("lang").agg(F.round(F.avg(x), 6).alias("mean"), F.count(x).alias("scored"), F.count_if(x.isNull()).alias("unverifiable"))


@query(f"WITH {SCORED}, m AS (SELECT lang, doc_id % 2 AS run, avg(CASE WHEN n_chars > 300 THEN confidence END) AS m FROM s GROUP BY 1, 2) SELECT c.lang, round(c.m - b.m, 6) AS delta, c.m - b.m < -0.05 AS regressed FROM m c JOIN m b ON c.lang = b.lang AND c.run = 1 AND b.run = 0")
def regression_deltas(spark, sf_dir):
    m = _scored(spark, sf_dir).groupBy("lang", (F.col("doc_id") % 2).alias("run")).agg(F.avg(F.when(F.col("n_chars") > 300, F.col("confidence"))).alias("m"))
    pivoted = m.groupBy("lang").pivot("run", [0, 1]).agg(F.first("m"))
    delta = F.col("1") - F.col("0")
    return pivoted.where(F.col("1").isNotNull() | F.col("0").isNotNull()).select("lang", F.round(delta, 6).alias("delta"), (delta < -0.05).alias("regressed"))


@query(f"WITH {SCORED}, c AS (SELECT lang, least(n_chars // 2000, 3) AS tier, count(*) AS n, count(*) FILTER (WHERE actual) AS hits FROM s GROUP BY ALL), d AS (SELECT * FROM (SELECT DISTINCT lang FROM s) CROSS JOIN (SELECT i AS tier FROM range(4) t(i))) SELECT lang, tier, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, round(hits / n::DOUBLE, 6) AS precision FROM d LEFT JOIN c USING (lang, tier)")
def tier_matrix(spark, sf_dir):
    """Language by length tier, with empty cells: every key gets the four fixed tiers, the last of which is open."""
    s = _scored(spark, sf_dir)
    tier = F.least(F.floor(F.col("n_chars") / 2000), F.lit(3))
    c = s.groupBy("lang", tier.alias("tier")).agg(F.count("*").alias("n"), F.count_if("actual").alias("hits"))
    dense = s.select("lang").distinct().withColumn("tier", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return dense.join(c, ["lang", "tier"], "left").select("lang", "tier", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.col("hits") / F.col("n"), 6).alias("precision"))


@query(f"WITH {SCORED} SELECT doc_id % 2 AS arm, lang, count(*) AS n, round(avg(confidence), 6) AS mean, round(avg(CASE WHEN predicted THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS escalation, sum(n_chars)::BIGINT AS tokens FROM s GROUP BY GROUPING SETS ((doc_id % 2), (doc_id % 2, lang))")
def ab_arms(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("arm", F.col("doc_id") % 2)
    return s.groupingSets([["arm"], ["arm", "lang"]], "arm", "lang").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.avg(F.col("predicted").cast("double")), 6).alias("escalation"), F.sum("n_chars").alias("tokens"))


@query(f"WITH {SCORED}, a AS (SELECT doc_id % 2 AS arm, avg(confidence) AS m, sum(n_chars)::DOUBLE AS t FROM s GROUP BY 1) SELECT round(b.m - a.m, 6) AS delta, b.m - a.m >= -0.02 AS quality_ok, round(1 - b.t / a.t, 6) AS saved, CASE WHEN b.m - a.m >= -0.02 AND 1 - b.t / a.t >= 0.1 THEN 'GO' WHEN b.m - a.m < -0.02 THEN 'NO-GO' ELSE 'INVALID' END AS verdict FROM a JOIN a b ON a.arm = 0 AND b.arm = 1")
def ab_gate(spark, sf_dir):
    arm = lambda k, c: F.when(F.col("doc_id") % 2 == k, F.col(c))
    one = _scored(spark, sf_dir).agg((F.avg(arm(1, "confidence")) - F.avg(arm(0, "confidence"))).alias("d"), (1 - F.sum(arm(1, "n_chars")).cast("double") / F.sum(arm(0, "n_chars"))).alias("s"))
    ok = F.col("d") >= -0.02
    return one.select(F.round("d", 6).alias("delta"), ok.alias("quality_ok"), F.round("s", 6).alias("saved"), F.when(ok & (F.col("s") >= 0.1), "GO").when(~ok, "NO-GO").otherwise("INVALID").alias("verdict"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE user_id % 3 = 0) AS resolved, floor(count(*) FILTER (WHERE user_id % 3 = 0) * 1000.0 / count(*) + 0.5) / 10 AS percent FROM events GROUP BY 1")
def lineage_coverage(spark, sf_dir):
    hit = F.count_if(F.col("user_id") % 3 == 0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"), hit.alias("resolved"), (F.floor(hit * 1000.0 / F.count("*") + 0.5) / 10).alias("percent"))


VERDICTS = "p AS (SELECT c_nationkey AS product, c_custkey % 6 AS criterion, bool_or(c_acctbal > 8000) AS covered, bool_or(c_acctbal > 0) AS checked FROM customer GROUP BY 1, 2), v AS (SELECT product, CASE WHEN bool_and(NOT checked) THEN 'not-checked' WHEN bool_and(covered) THEN 'covers' WHEN bool_or(covered) THEN 'partial' ELSE 'not-covered' END AS verdict FROM p GROUP BY 1)"


def _verdicts(spark, sf_dir):
    """A criterion is covered if any repository covers it; a product by all, some or none of its criteria."""
    c = table(spark, sf_dir, "customer")
    p = c.groupBy(F.col("c_nationkey").alias("product"), (F.col("c_custkey") % 6).alias("criterion")).agg(F.bool_or(F.col("c_acctbal") > 8000).alias("covered"), F.bool_or(F.col("c_acctbal") > 0).alias("checked"))
    verdict = F.when(F.bool_and(~F.col("checked")), "not-checked").when(F.bool_and("covered"), "covers").when(F.bool_or("covered"), "partial").otherwise("not-covered")
    return p.groupBy("product").agg(verdict.alias("verdict"))


@query(f"WITH {VERDICTS} SELECT * FROM v")
def product_coverage(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(f"WITH {VERDICTS} SELECT n_regionkey AS portfolio, CASE WHEN bool_or(verdict = 'covers') THEN 'covers' WHEN bool_or(verdict = 'partial') THEN 'partial' WHEN bool_and(verdict = 'not-covered') THEN 'not-covered' ELSE 'unknown' END AS verdict FROM v JOIN nation ON product = n_nationkey GROUP BY 1")
def portfolio_verdict(spark, sf_dir):
    v = _verdicts(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("product") == F.col("n_nationkey"))
    is_ = lambda x: F.col("verdict") == x
    return v.groupBy(F.col("n_regionkey").alias("portfolio")).agg(F.when(F.bool_or(is_("covers")), "covers").when(F.bool_or(is_("partial")), "partial").when(F.bool_and(is_("not-covered")), "not-covered").otherwise("unknown").alias("verdict"))


@query("SELECT l_partkey AS target, CASE max(CASE WHEN l_returnflag = 'N' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) WHEN 2 THEN 'used' WHEN 1 THEN 'uncertain' ELSE 'unreferenced' END AS class FROM lineitem GROUP BY 1")
def usage_class(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(F.element_at(F.array(F.lit("unreferenced"), F.lit("uncertain"), F.lit("used")), F.max(rank) + 1).alias("class"))


@query("SELECT l_orderkey AS path, ['low', 'medium', 'high', 'critical'][greatest(0, least(3, min(least(3, greatest(0, l_linenumber % 4 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END - CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END)))))::INTEGER + 1] AS severity FROM lineitem GROUP BY 1")
def weakest_link(spark, sf_dir):
    """Severity of each hop (base, +1 if breaking, -1 if unsure, held to the scale), then the least along the path."""
    hop = F.col("l_linenumber") % 4 + F.when(F.col("l_returnflag") == "R", 1).otherwise(0) - F.when(F.col("l_discount") < 0.05, 1).otherwise(0)
    least = F.min(F.least(F.lit(3), F.greatest(F.lit(0), hop)))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), least.cast("int") + 1).alias("severity"))


@query("WITH w AS (SELECT user_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 20)::BIGINT AS win, value FROM events), m AS (SELECT user_id, win, avg(value) AS mean FROM w GROUP BY 1, 2) SELECT user_id, win, round(mean, 6) AS mean, coalesce(mean - lag(mean) OVER (PARTITION BY user_id ORDER BY win) < -5, false) AS alert FROM m")
def count_window_drift(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    m = table(spark, sf_dir, "events").select("user_id", F.floor((n - 1) / 20).alias("win"), "value").groupBy("user_id", "win").agg(F.avg("value").alias("mean"))
    before = F.lag("mean").over(Window.partitionBy("user_id").orderBy("win"))
    return m.select("user_id", "win", F.round("mean", 6).alias("mean"), F.coalesce(F.col("mean") - before < -5, F.lit(False)).alias("alert"))


@query()
def bootstrap_interval(spark, sf_dir):
    return M.bootstrap(_scored(spark, sf_dir).select("doc_id", "confidence"), "confidence")


@query("SELECT o_orderkey, round(0.5::DOUBLE * (CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 0.5::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, o_totalprice / 200000)), 4) AS score FROM orders")
def scenario_score(spark, sf_dir):
    tool, state = (F.col("o_orderstatus") == "F").cast("double"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("o_totalprice") / 200000))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(0.5 * tool + 0.5 * state, 4).alias("score"))
