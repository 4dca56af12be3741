"""Threshold joins, assignments and budgets over parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import matching as M
from ledgerloom.operators.graph import written
from ledgerloom.plans.registry import query, table

#: Parts of odd keys are expected, those of even keys predicted, within a brand.
PARTS = "t AS (SELECT p_brand, p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w, p_size FROM part)"
PAIRS = f"{PARTS}, p AS (SELECT a.p_brand AS brand, a.p_partkey AS l, b.p_partkey AS r, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE AS score FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 1 AND b.p_partkey % 2 = 0)"


def _sides(spark, sf_dir, *block):
    parts = table(spark, sf_dir, "part").select(*block, "p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("tokens"))
    side = lambda odd, name: parts.where(F.col("p_partkey") % 2 == odd).withColumnRenamed("p_partkey", name)
    return side(1, "left"), side(0, "right")


@query(f"WITH {PAIRS} SELECT brand, l AS expected, r AS predicted, round(score, 6) AS score FROM p WHERE score >= 0.4")
def threshold_join(spark, sf_dir):
    """Pairs of a brand whose words agree enough."""
    pairs = M.threshold_pairs(*_sides(spark, sf_dir, "p_brand"), ["p_brand"], 0.4, 6)
    return pairs.select(F.col("p_brand").alias("brand"), F.col("left").alias("expected"), F.col("right").alias("predicted"), "score")


@query(f"""WITH RECURSIVE {PAIRS}, q AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, l, r) AS k FROM p WHERE score >= 0.4),
 g AS (SELECT DISTINCT brand, 0::BIGINT AS k, []::BIGINT[] AS ls, []::BIGINT[] AS rs FROM q UNION ALL
 SELECT g.brand, g.k + 1, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END FROM g JOIN q ON q.brand = g.brand AND q.k = g.k + 1),
 last AS (SELECT brand, arg_max(ls, k) AS ls, arg_max(rs, k) AS rs FROM g GROUP BY 1) SELECT brand, unnest(ls) AS expected, unnest(rs) AS predicted FROM last""")
def greedy_matching(spark, sf_dir):
    """One-to-one, best score first."""
    left, right = (written(M.token_classes(df, ["p_brand"], key)) for df, key in zip(_sides(spark, sf_dir, "p_brand"), ("left", "right")))
    pairs = M.class_pairs(M.classes(left, ["p_brand"], "left"), M.classes(right, ["p_brand"], "right"), ["p_brand"], 0.4)
    return M.greedy_classes(pairs, left, right, ["p_brand"]).select(F.col("p_brand").alias("brand"), F.col("left").alias("expected"), F.col("right").alias("predicted"))


@query(f"""WITH RECURSIVE {PARTS}, p AS (SELECT a.p_brand AS brand, a.p_partkey AS l, b.p_partkey AS r, CASE WHEN a.p_size = b.p_size AND list_sort(a.w) = list_sort(b.w) THEN 1000000 ELSE CASE WHEN a.p_size = b.p_size THEN 1000 ELSE 0 END + len(list_intersect(a.w, b.w)) END AS score FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 1 AND b.p_partkey % 2 = 0),
 q AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, l, r) AS k FROM p WHERE score > 0),
 g AS (SELECT DISTINCT brand, 0::BIGINT AS k, []::BIGINT[] AS ls, []::BIGINT[] AS rs FROM q UNION ALL
 SELECT g.brand, g.k + 1, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END FROM g JOIN q ON q.brand = g.brand AND q.k = g.k + 1),
 last AS (SELECT brand, arg_max(ls, k) AS ls, arg_max(rs, k) AS rs FROM g GROUP BY 1) SELECT brand, unnest(ls) AS question, unnest(rs) AS ambiguity FROM last""")
def tiered_matching(spark, sf_dir):
    """Questions to open points of a brand: the exact key first, then the same field (size), then shared words; none without any."""
    sides = _sides(spark, sf_dir, "p_brand", "p_size")
    fields = [written(M.token_classes(df, ["p_brand", "p_size"], key)) for df, key in zip(sides, ("left", "right"))]
    x, y = (M.classes(df, ["p_brand", "p_size"], key) for df, key in zip(fields, ("left", "right")))
    # Within a field all pairs count, the exact key most; behind that one side of each field is used up, so only words are left to score.
    met = x.withColumnRenamed("tokens", "x").join(y.withColumnRenamed("tokens", "y"), ["p_brand", "p_size"])
    score = F.when(F.col("x") == F.col("y"), 1000000).otherwise(F.size(F.array_intersect("x", "y")))
    first = written(M.greedy_classes(met.select("p_brand", "p_size", "left", "right", score.alias("score")), *fields, ["p_brand", "p_size"]))
    rest = [written(M.token_classes(df.join(first, key, "left_anti"), ["p_brand"], key)) for df, key in zip(sides, ("left", "right"))]
    a, b = (M.classes(df, ["p_brand"], key).select("p_brand", key, F.explode("tokens").alias("t")) for df, key in zip(rest, ("left", "right")))
    shared = a.join(b, ["p_brand", "t"]).groupBy("p_brand", "left", "right").agg(F.count("*").alias("score"))
    taken = first.select("p_brand", "left", "right").unionByName(M.greedy_classes(shared, *rest, ["p_brand"]))
    return taken.select(F.col("p_brand").alias("brand"), F.col("left").alias("question"), F.col("right").alias("ambiguity"))


@query(f"WITH {PARTS}, a AS (SELECT * FROM t WHERE p_partkey % 2 = 1), b AS (SELECT * FROM t WHERE p_partkey % 2 = 0) SELECT p_partkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.p_brand = a.p_brand AND b.p_size = a.p_size AND len(list_intersect(a.w, b.w)) >= 0.5 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))")
def fuzzy_anti_join(spark, sf_dir):
    """Candidates that no existing row of the same brand and size resembles."""
    return M.fuzzy_anti_join(*_sides(spark, sf_dir, "p_brand", "p_size"), ["p_brand", "p_size"], 0.5).select(F.col("left").alias("p_partkey"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations),
 g AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS taken FROM s UNION ALL SELECT g.conv_id, g.k + 1, CASE WHEN used + n <= 600 THEN used + n ELSE used END, CASE WHEN used + n <= 600 THEN list_append(taken, turn) ELSE taken END FROM g JOIN s ON s.conv_id = g.conv_id AND s.k = g.k + 1)
 SELECT conv_id, max(used) AS used, array_to_string(list_sort(arg_max(taken, k)), ',') AS turns FROM g GROUP BY 1""")
def budget_skip_fit(spark, sf_dir):
    """The longest turns first; those that do not fit what is left of 600 characters are skipped."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("text")).alias("less"), "turn"))).alias("s"))
    taken = M.fitting(F.col("s"), lambda x: -x.less, 600)
    done = rows.select("conv_id", taken.alias("taken"))
    used = F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a - x.less)
    return done.select("conv_id", used.alias("used"), F.array_join(F.array_sort(F.transform("taken", lambda x: x.turn)).cast("array<string>"), ",").alias("turns"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 64) / 192.0)::INTEGER - 1) + 1))::INTEGER AS i FROM documents), x AS (SELECT doc_id, i, substr(text, i * 192 + 1, 256) AS t FROM c),
 o AS (SELECT doc_id, i, t, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM x), k AS (SELECT doc_id, i, t, before, list_filter(range(least(length(t), length(before)), 15, -1), lambda k: substr(t, 1, 16) = substr(before, length(before) - k + 1, 16) AND left(t, k) = right(before, k))[1] AS k FROM o)
 SELECT doc_id, md5(string_agg(CASE WHEN before IS NULL THEN t WHEN k IS NULL THEN chr(10) || t ELSE substr(t, k + 1) END, '' ORDER BY i)) AS digest FROM k GROUP BY 1""")
def chunk_overlap_join(spark, sf_dir):
    """Chunks joined back into their text; each is compared with the one before it, so no text is folded whole, and none leaves its row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.transform(X.chunks(F.col("text"), 256, 64), lambda c: c.text).alias("chunks"))
    parts = F.transform("chunks", lambda t, i: F.when(i == 0, t).otherwise(M.added(F.get("chunks", i - 1), t)))
    return docs.select("doc_id", F.when(F.col("text").isNotNull(), F.md5(F.array_join(parts, ""))).alias("digest"))


SUMMARY = r"""s AS (SELECT conv_id * 1000 + turn AS k, conv_id, turn, unnest(l) AS s, unnest(range(len(l))) AS i, len(l) AS n FROM (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM conversations WHERE length(text) > 400)),
 p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN i = 0 THEN 10 ELSE 0 END + CASE WHEN i = n - 1 THEN 8 ELSE 0 END + CASE WHEN regexp_matches(s, '[A-Z][A-Za-z]+[^.!?]* [A-Z][a-z]+|\d') THEN 3 ELSE 0 END + CASE WHEN length(s) < 100 AND regexp_matches(s, '\d') THEN 2 ELSE 0 END DESC, i) AS r FROM s WHERE n > 2),
 g AS (SELECT DISTINCT k, 0::BIGINT AS r, 0::BIGINT AS used, []::STRUCT(i BIGINT, s VARCHAR)[] AS taken FROM p UNION ALL SELECT g.k, g.r + 1, CASE WHEN used + length(s) > 400 THEN used ELSE used + length(s) + 1 END, CASE WHEN used + length(s) > 400 THEN taken ELSE list_append(taken, {'i': i, 's': s}) END FROM g JOIN p ON p.k = g.k AND p.r = g.r + 1),
 done AS (SELECT k, array_to_string(list_transform(list_sort(arg_max(taken, r)), lambda x: x.s), ' ') AS t FROM g GROUP BY 1)"""


@query(f"WITH RECURSIVE {SUMMARY} SELECT conv_id, turn, md5(CASE WHEN length(text) <= 400 THEN text WHEN t IS NULL THEN left(text, 400) ELSE t END) AS digest FROM conversations LEFT JOIN done ON k = conv_id * 1000 + turn")
def extractive_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.extractive_summary(F.col("text"), 400)).alias("digest"))


@query(f"""WITH RECURSIVE {SUMMARY}, short AS (SELECT conv_id, turn, CASE WHEN length(text) <= 400 THEN text WHEN t IS NULL THEN left(text, 400) ELSE t END AS t FROM conversations LEFT JOIN done ON k = conv_id * 1000 + turn),
 level AS (SELECT conv_id, turn // 4 AS part, string_agg(t, chr(10) ORDER BY turn) AS t FROM short GROUP BY 1, 2) SELECT conv_id, count(*) AS parts, sum(length(t))::BIGINT AS chars, md5(string_agg(t, chr(10) || chr(10) ORDER BY part)) AS digest FROM level GROUP BY 1""")
def hierarchical_summary(spark, sf_dir):
    """Map each turn to its summary, then reduce four turns to a part and parts to the conversation, one grouping a level."""
    short = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.extractive_summary(F.col("text"), 400).alias("t"))
    joined = lambda by, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "t"))), lambda x: x.t), sep)
    level = short.groupBy("conv_id", F.floor(F.col("turn") / 4).alias("part")).agg(joined("turn", "\n").alias("t"))
    return level.groupBy("conv_id").agg(F.count("*").alias("parts"), F.sum(F.length("t")).alias("chars"), F.md5(joined("part", "\n\n")).alias("digest"))
