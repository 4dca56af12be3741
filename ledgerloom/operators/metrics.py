"""Evaluation metrics as aggregate expressions, each with its own rule for zero over zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None) -> Column:
    """a / b, and ``empty`` where b is 0 (callers differ: 0, 1 or null)."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / F.nullif(b, F.lit(0)))


def precision_recall_f1(tp: Column, fp: Column, fn: Column, empty: float = 0.0) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty)
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def set_score(expected: Column, found: Column) -> tuple[Column, Column, Column]:
    """Hits, wrong and missed of two sets as arrays."""
    return F.size(F.array_intersect(expected, found)), F.size(F.array_except(found, expected)), F.size(F.array_except(expected, found))


def confusion(df: DataFrame, actual: Column, predicted: Column, *keys: str) -> DataFrame:
    """Counts with the over-flag rate fp / (fp + tn), per key or over everything."""
    tp, fp, fn, tn = (F.count_if(c) for c in (actual & predicted, ~actual & predicted, actual & ~predicted, ~actual & ~predicted))
    counts = df.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return counts.withColumn("over_flag", F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn"), 1.0), 6))


def calibration(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Equal bins, the last one closed on the right; empty bins come with nulls."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    filled = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("confidence"), F.round(F.avg(correct.cast("double")), 6).alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "confidence", "accuracy")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """nDCG@k, recall@k and reciprocal rank per query of ``ranked(query, item, rank)`` and ``relevant(query, item)``.

    Gains are binary and the ideal is cut at k. Queries without relevant items are left out.
    """
    total = relevant.groupBy("query").agg(F.count("*").alias("total"))
    return _ranked(total, ranked.join(relevant, ["query", "item"]), k)


def label_metrics(ranked: DataFrame, queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """:func:`ranking_metrics` where a query's relevant items are the others of its label, without a row for each of them.

    ``queries(query, label)`` are among the items of ``labels(item, label)``, whose ids are distinct. What is relevant is counted by label, and only
    ranked items are looked up. A null label is relevant to nothing; queries alone in their label are left out.
    """
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("total")).where("total > 0")
    hits = ranked.join(queries, "query").join(labels, ["item", "label"]).where("query <> item")
    return _ranked(queries.join(sizes, "label").select("query", "total"), hits, k)


def _ranked(total: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Metrics from ``total(query, total)`` and the relevant ones of what was ranked, ``hits(query, rank)``."""
    hits = hits.groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = total.join(hits, "query", "left")
    return out.select("query", F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"), F.round(F.coalesce("found", F.lit(0)) / F.col("total"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def bootstrap(values: DataFrame, value: str, rounds: int = 200, seed: int = 11) -> DataFrame:
    """Percentile interval of the mean: each row weighs in each round by a Poisson count drawn from a hash.

    The Poisson form needs no row to know how many there are, so rounds are sums of one grouped pass.
    """
    r = F.explode(F.sequence(F.lit(1), F.lit(rounds)))
    drawn = values.select(F.col(value).alias("v"), F.xxhash64(*values.columns).alias("h")).select("v", "h", r.alias("round"))
    u = F.pmod(F.xxhash64("h", "round", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    cuts = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)  # fixed values: Poisson(1) up to 5
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    means = drawn.groupBy("round").agg((F.sum(weight * F.col("v")) / F.nullif(F.sum(weight), F.lit(0))).alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"), F.count("*").alias("rounds"))
