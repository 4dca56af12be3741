"""Quality rules whose cutoffs are set by labelled holdouts, so that few good documents are rejected."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WHITESPACE

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(positions: Column) -> Column:
    """Words covered by the windows that start at these sorted positions."""
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("end"))
    step = lambda a, i: F.struct((a.covered + F.least(F.lit(WINDOW).cast("long"), i + WINDOW - a.end)).alias("covered"), (i + WINDOW).cast("long").alias("end"))
    return F.aggregate(positions, start, step, lambda a: a.covered)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) of the whole text.

    Null texts count as empty: all zero. Repeated rows and null ids stay, an empty table gives an empty one. Input columns
    of the five names are replaced; others may have any name, as they travel in a struct. All five measures come
    from built-in functions over the row; nothing is shuffled. Windows are told apart by 64-bit hashes.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    out = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumn("words", F.array_remove(F.split("text", WHITESPACE), ""))
    out = out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "lines": lines,
        "windows": F.when(F.size("hashes") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.slice(F.transform("hashes", lambda h, i: F.xxhash64(h, *[F.get("hashes", i + k) for k in range(1, WINDOW)])), F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0)))
        ),
    })
    # Only texts with a repeated window are sorted by hash; equal neighbours are the repeats.
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs).otherwise(none))
    near = lambda x, k: F.coalesce(F.get("sorted", k).h == x.h, F.lit(False))
    out = out.withColumn("again", F.sort_array(F.transform(F.filter("sorted", lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x.i)))
    out = out.withColumns({"n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "n_repeat_words": _covered(F.col("again"))})
    return out.select("row.*", *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject where ``measure`` is above the cutoff; ``cutoffs`` go from strict (rejects most) to lenient."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


@dataclass(frozen=True)
class RiskControl:
    """With probability ``1 - delta`` all rules together falsely reject at most ``risk`` of every stratum's good documents.

    The risk is shared among the rules (a union bound), delta among rules and strata (Bonferroni). The cutoffs of a
    rule are tested in a fixed sequence, from the most lenient on and until the first one fails, so each is tested
    at the rule's whole share of delta. Without a false rejection 210 good labels of a stratum certify a cutoff. Strata
    are the listed languages and ``other``; their number is fixed, so the cutoff table is small.
    """

    risk: float = 0.1
    delta: float = 0.1
    strata: tuple[str, ...] = ("en", "de", "fr", "es")
    rules: tuple[Rule, ...] = field(
        default_factory=lambda: (
            Rule("symbols", "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0D END", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
            Rule("dup_lines", "CASE WHEN n_words > 0 THEN n_dup_lines / n_words ELSE 0D END", (0.002, 0.005, 0.01, 0.02, 0.05, 0.1)),
            Rule("repeats", "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0D END", (0.02, 0.05, 0.1, 0.15, 0.2)),
            Rule("long_words", "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0D END", (8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
        )
    )

    @property
    def rule_risk(self) -> float:
        return self.risk / len(self.rules)

    @property
    def test_delta(self) -> float:
        return self.delta / ((len(self.strata) + 1) * len(self.rules))


def stratum(lang: Column, control: RiskControl) -> Column:
    return F.when(lang.isin(*control.strata), lang).otherwise(F.lit("other"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial with success rate ``p``, exactly, summed in logarithms from the first term."""
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a.term + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        high, low = F.greatest(a.total, term), F.least(a.total, term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, add, lambda a: a.total))


def calibrate(measured: DataFrame, labels: DataFrame, control: RiskControl = RiskControl()) -> DataFrame:
    """``(stratum, rule, cutoff, n_good, n_rejected, n_bad, n_caught, tail)``: one certified cutoff of each rule that has any.

    ``measured`` has features, ``doc_id`` and ``lang``; the holdout is its labelled rows, good ones (quality 1) and bad
    ones. A cutoff passes if the exact binomial bound on its false rejection rate is within the rule's risk: a rate
    of that size or more would show so few rejections with probability ``test_delta`` at most. It is certified if it
    and all more lenient ones of its rule pass. Of these the one with the largest share of bad documents caught,
    less the share of good ones rejected, is taken, and the strictest on ties; if bad labels exist and none is caught
    at a gain, the rule is not used. Strata without a certified cutoff (too few labels) have no row, and the rule rejects
    none there. An id counts once, with the largest measures of its rows, so that repeated rows certify nothing; near copies
    under other ids are taken for independent. Null ids and qualities do not count, and conflicting labels
    of an id count as bad. Empty tables give no cutoff.
    """
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("good"))
    seen = measured.select(F.col("doc_id").alias("id"), stratum(F.col("lang"), control).alias("stratum"), *[F.expr(r.measure).alias(f"m{k}") for k, r in enumerate(control.rules)])
    measures = [F.max(f"m{k}").alias(f"m{k}") for k in range(len(control.rules))]
    held = seen.join(own, "id").groupBy("id").agg(F.min("stratum").alias("stratum"), F.min("good").alias("good"), *measures)
    good = F.col("good") == 1
    over = [(f"{k}_{j}", F.col(f"m{k}") > c) for k, r in enumerate(control.rules) for j, c in enumerate(r.cutoffs)]
    counts = held.groupBy("stratum").agg(F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_bad"), *[F.count_if(good & x).alias(f"r{k}") for k, x in over], *[F.count_if(~good & x).alias(f"b{k}") for k, x in over])
    tests = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"r{k}_{j}").alias("n_rejected"), F.col(f"b{k}_{j}").alias("n_caught")) for k, r in enumerate(control.rules) for j, c in enumerate(r.cutoffs)])
    rows = counts.select("stratum", "n_good", "n_bad", F.explode(tests).alias("t")).select("stratum", "n_good", "n_bad", "t.*")
    # Above the expected count the tail is over a half or so, so it need not be summed.
    near = F.col("n_rejected") <= control.rule_risk * F.col("n_good")
    rows = rows.withColumn("tail", F.when(near, binomial_cdf(F.col("n_rejected"), F.col("n_good"), control.rule_risk)).otherwise(F.lit(1.0)))
    failed = F.max(F.when(F.col("tail") > control.test_delta, F.col("cutoff"))).over(Window.partitionBy("stratum", "rule"))
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))
    rows = rows.withColumn("failed", failed).withColumn("gain", share("n_caught", "n_bad") - share("n_rejected", "n_good"))
    rows = rows.where((F.col("failed").isNull() | (F.col("cutoff") > F.col("failed"))) & ((F.col("n_bad") == 0) | (F.col("gain") > 0)))
    best = F.max_by(F.struct("cutoff", "n_good", "n_rejected", "n_bad", "n_caught", "tail"), F.struct("gain", -F.col("cutoff")))
    return rows.groupBy("stratum", "rule").agg(best.alias("best")).select("stratum", "rule", "best.*")


def judge(measured: DataFrame, cutoffs: DataFrame, control: RiskControl = RiskControl()) -> DataFrame:
    """``measured`` with ``base_failed``, ``method_failed`` and ``kept``.

    The cutoff table, of one row per stratum, is broadcast: at most ``len(strata) + 1`` rows. A stratum without cutoffs,
    and so an empty cutoff table, leaves only the base rule. Null languages are of the stratum ``other``. Every row
    of ``measured`` stays, with all its columns but those of the three names, which are replaced.
    """
    added = ("base_failed", "method_failed", "kept")
    wide = cutoffs.groupBy(F.col("stratum").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    rest = F.struct(*[F.col(f"`{c}`") for c in measured.columns if c not in added])
    failed = [F.expr(r.measure).alias(f"m{k}") for k, r in enumerate(control.rules)]
    rows = measured.select(rest.alias("row"), stratum(F.col("lang"), control).alias("key"), base_failed().alias("base_failed"), *failed)
    out = rows.join(F.broadcast(wide), "key", "left")
    method = F.lit(False)
    for k, r in enumerate(control.rules):
        method = method | F.coalesce(F.col(f"m{k}") > F.element_at("cut", F.lit(r.name)), F.lit(False))
    out = out.withColumn("method_failed", method)
    return out.select("row.*", "base_failed", "method_failed", (~F.col("base_failed") & ~F.col("method_failed")).alias("kept"))
