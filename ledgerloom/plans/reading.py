"""Queries for readings of documents and summaries of many chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import reading as R
from ledgerloom.operators import summaries as M
from ledgerloom.operators.spans import LEAST_WORDS, SPACES
from ledgerloom.plans.registry import query, table

LINES = "x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"


@query(rf"""WITH {LINES}, lab AS (SELECT doc_id, 'R' || i AS label, 'S' || (i // 4) AS section, i AS place FROM x WHERE i % 2 = 0),
 fnd AS (SELECT doc_id, i, CASE WHEN i % 11 = 0 THEN NULL WHEN i % 7 = 0 THEN 'X' || i ELSE 'R' || (i - i % 6) END AS label, CASE WHEN i % 5 = 0 THEN upper(s) WHEN i % 2 = 0 THEN replace(s, ' ', '  ') ELSE s END AS quote FROM x WHERE i % 3 <> 1),
 amb AS (SELECT doc_id, 'A' || i AS ambiguity, i AS place FROM x WHERE i % 3 = 0), qst AS (SELECT doc_id, CASE WHEN i % 8 < 6 THEN 'A' || (i - i % 6) END AS ambiguity, length(s) % 2 = 0 AS worth FROM x WHERE i % 4 = 3),
 st AS (SELECT doc_id, label, count(*) AS hits FROM fnd WHERE label IS NOT NULL GROUP BY 1, 2), lm AS (SELECT lab.*, coalesce(hits, 0) AS hits FROM lab LEFT JOIN st USING (doc_id, label)),
 sec AS (SELECT doc_id, section, min(place) AS place, max(hits) > 0 AS covered FROM lm GROUP BY 1, 2),
 a1 AS (SELECT doc_id, count(*) AS labelled, count(*) FILTER (WHERE hits > 0) AS matched, sum(CASE WHEN hits > 0 THEN hits - 1 ELSE 0 END) AS repeats, string_agg(label, ',' ORDER BY place) FILTER (WHERE hits = 0) AS ml FROM lm GROUP BY 1),
 a2 AS (SELECT doc_id, count(*) AS ls, count(*) FILTER (WHERE covered) AS cs, string_agg(section, ',' ORDER BY place) FILTER (WHERE NOT covered) AS ms FROM sec GROUP BY 1),
 a3 AS (SELECT st.doc_id, sum(hits) AS invalid FROM st LEFT JOIN lab USING (doc_id, label) WHERE section IS NULL GROUP BY 1),
 a4 AS (SELECT doc_id, count(*) AS questions, count(*) FILTER (WHERE worth) AS worth FROM qst GROUP BY 1),
 a5 AS (SELECT amb.doc_id, count(*) AS ambiguities, count(q.ambiguity) AS raised, string_agg(amb.ambiguity, ',' ORDER BY place) FILTER (WHERE q.ambiguity IS NULL) AS ma FROM amb LEFT JOIN (SELECT DISTINCT * EXCLUDE (worth) FROM qst) q ON q.doc_id = amb.doc_id AND q.ambiguity = amb.ambiguity GROUP BY 1),
 qt AS (SELECT fnd.doc_id, regexp_replace(regexp_replace(quote, '[{SPACES}]+', ' ', 'g'), '^ +| +$', '', 'g') AS q, regexp_replace(text, '[{SPACES}]+', ' ', 'g') AS t FROM fnd JOIN documents USING (doc_id)),
 a6 AS (SELECT doc_id, count(*) AS extracted, count(*) FILTER (WHERE q <> '') AS quoted, count(*) FILTER (WHERE q <> '' AND len(string_split(q, ' ')) >= {LEAST_WORDS} AND contains(t, q)) AS verified FROM qt GROUP BY 1)
 SELECT doc_id, coalesce(labelled, 0) AS labelled, coalesce(extracted, 0) AS extracted, coalesce(matched, 0) AS matched, coalesce(repeats, 0)::BIGINT AS repeats, coalesce(invalid, 0)::BIGINT AS invalid, coalesce(ls, 0) AS labelled_sections, coalesce(cs, 0) AS covered_sections, coalesce(questions, 0) AS questions, coalesce(worth, 0) AS worth_asking,
  coalesce(ambiguities, 0) AS ambiguities, coalesce(raised, 0) AS ambiguities_raised, coalesce(quoted, 0) AS quoted, coalesce(verified, 0) AS quotes_verified, coalesce(ms, '') AS missed_sections, md5(coalesce(ml, '')) AS missed_labels, md5(coalesce(ma, '')) AS missed_ambiguities,
  round(matched / nullif(labelled, 0)::DOUBLE, 6) AS recall, round(matched / nullif(extracted, 0)::DOUBLE, 6) AS "precision", round(cs / nullif(ls, 0)::DOUBLE, 6) AS section_coverage, round(worth / nullif(questions, 0)::DOUBLE, 6) AS question_precision, round(raised / nullif(ambiguities, 0)::DOUBLE, 6) AS ambiguity_recall, round(verified / nullif(quoted, 0)::DOUBLE, 6) AS quote_accuracy
 FROM documents LEFT JOIN a1 USING (doc_id) LEFT JOIN a2 USING (doc_id) LEFT JOIN a3 USING (doc_id) LEFT JOIN a4 USING (doc_id) LEFT JOIN a5 USING (doc_id) LEFT JOIN a6 USING (doc_id)""")
def document_scores(spark, sf_dir):
    """Readings of all documents, whose even lines are labelled: some labels are claimed again or unknown, some quotes are altered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    i, named = F.col("i"), lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    labels = lines.where(i % 2 == 0).select("doc_id", named("R", i).alias("label"), named("S", F.floor(i / 4)).alias("section"), i.alias("place"))
    quote = F.when(i % 5 == 0, F.upper("s")).when(i % 2 == 0, F.replace("s", F.lit(" "), F.lit("  "))).otherwise(F.col("s"))
    found = lines.where(i % 3 != 1).select("doc_id", F.when(i % 11 == 0, None).when(i % 7 == 0, named("X", i)).otherwise(named("R", i - i % 6)).alias("label"), quote.alias("quote"))
    ambiguities = lines.where(i % 3 == 0).select("doc_id", named("A", i).alias("ambiguity"), i.alias("place"))
    questions = lines.where(i % 4 == 3).select("doc_id", F.when(i % 8 < 6, named("A", i - i % 6)).alias("ambiguity"), (F.length("s") % 2 == 0).alias("worth_asking"))
    scores = R.reading_scores(docs, labels, found, ambiguities, questions)
    ratios = ("recall", "precision", "section_coverage", "question_precision", "ambiguity_recall", "quote_accuracy")
    scores = scores.withColumns({c: F.round(c, 6) for c in ratios} | {c: F.md5(F.array_join(c, ",")) for c in ("missed_labels", "missed_ambiguities")})
    return scores.withColumn("missed_sections", F.array_join("missed_sections", ","))


BUDGET, DEPTH = 60, 3
#: What is planted in turns, by remainder of the turn: facts that a summary keeps.
FACTS = (' On 2024-03-05 the build took 15ms. It is "nearly done" now.', " See /srv/app/log.txt and https://example.org/x for 20% more. Ask a.b@c.example again!", "")
FACT_SQL = "CASE turn % 3 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(FACTS)) + " END"


def _summary_sql(source: str, out: str) -> str:
    """CTEs from ``source(k, t, most)`` to ``out(k, t)``, where only what doesn't fit is summarised."""
    found = " || ".join(f"regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}')" for p in M.ENTITIES)
    return rf"""{out}_l AS (SELECT k, most, {found} AS ents, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM {source} WHERE length(t) > most),
 {out}_s AS (SELECT k, most, ents, unnest(l) AS s, unnest(range(len(l))) AS i, len(l) AS n FROM {out}_l),
 {out}_p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN i = 0 THEN 10 ELSE 0 END + CASE WHEN i = n - 1 THEN 8 ELSE 0 END + CASE WHEN len(list_filter(ents, lambda e: contains(s, e))) > 0 THEN 3 ELSE 0 END + CASE WHEN length(s) < 100 AND regexp_matches(s, '[0-9]') THEN 2 ELSE 0 END DESC, i) AS r FROM {out}_s WHERE n > 2),
 {out}_g AS (SELECT DISTINCT k, 0::BIGINT AS r, 0::BIGINT AS used, []::STRUCT(i BIGINT, s VARCHAR)[] AS taken FROM {out}_p UNION ALL SELECT g.k, g.r + 1, CASE WHEN used + length(s) > most THEN used ELSE used + length(s) + 1 END, CASE WHEN used + length(s) > most THEN taken ELSE list_append(taken, {{'i': i, 's': s}}) END FROM {out}_g g JOIN {out}_p p ON p.k = g.k AND p.r = g.r + 1),
 {out}_d AS (SELECT k, array_to_string(list_transform(list_sort(arg_max(taken, r)), lambda x: x.s), ' ') AS t FROM {out}_g GROUP BY 1),
 {out} AS (SELECT s.k, CASE WHEN length(s.t) <= most THEN s.t WHEN d.k IS NULL THEN left(s.t, most::BIGINT) ELSE coalesce(d.t, '') END AS t FROM {source} s LEFT JOIN {out}_d d USING (k))"""


def _levels_sql() -> str:
    join, size = "string_agg(t, chr(10) || chr(10) ORDER BY k)", "count(*) AS n, ceil((sum(length(t)) + 2 * (count(*) - 1)) / 4.0)::BIGINT AS tok"
    sql = rf"""WITH RECURSIVE c AS (SELECT conv_id * 1000 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, text || {FACT_SQL} AS t FROM conversations), z0 AS (SELECT k // 1000 AS d, {size} FROM c GROUP BY 1),
 e0 AS (SELECT k // 1000 AS d, 0 AS depth, {join} AS content FROM c JOIN z0 ON d = k // 1000 WHERE tok <= {2 * BUDGET} GROUP BY 1),
 i1 AS (SELECT k, t, 4 * greatest({M.LEAST_TOKENS}, ceil(ceil(length(t) / 4.0) * 0.25)) AS most FROM c JOIN z0 ON d = k // 1000 WHERE tok > {2 * BUDGET}), {_summary_sql('i1', 'l1')}"""
    for depth in range(1, DEPTH + 1):
        sql += f""", z{depth} AS (SELECT k // 1000 AS d, {size} FROM l{depth} GROUP BY 1), e{depth} AS (SELECT k // 1000 AS d, {depth} AS depth, {join} AS content FROM l{depth} JOIN z{depth} ON d = k // 1000 WHERE tok <= {BUDGET} GROUP BY 1),
 r{depth} AS (SELECT k, t, greatest(2, ceil(n / 4.0))::BIGINT AS per, n FROM l{depth} JOIN z{depth} ON d = k // 1000 WHERE tok > {BUDGET}), """
        if depth < DEPTH:
            sql += f"i{depth + 1} AS (SELECT k // 1000 * 1000 + k % 1000 // per AS k, {join} AS t, 4 * ceil({BUDGET} / ceil(any_value(n) / any_value(per)::DOUBLE)) AS most FROM r{depth} GROUP BY k // 1000 * 1000 + k % 1000 // per), {_summary_sql(f'i{depth + 1}', f'l{depth + 1}')}"
        else:
            sql += f"i9 AS (SELECT k // 1000 AS k, {join} AS t, {4 * BUDGET} AS most FROM r{depth} GROUP BY k // 1000), {_summary_sql('i9', 'l9')}, e9 AS (SELECT k AS d, {DEPTH} AS depth, t AS content FROM l9)"
    ended = " UNION ALL ".join(f"SELECT * FROM e{n}" for n in [*range(DEPTH + 1), 9])
    return f"{sql} SELECT d AS conv_id, n AS chunks, tok AS input_tokens, depth, ceil(length(content) / 4.0)::BIGINT AS output_tokens, md5(content) AS digest FROM ({ended}) JOIN z0 USING (d)"


@query(_levels_sql())
def summary_levels(spark, sf_dir):
    """Conversations to a budget of tokens; how many levels each needs is in the output."""
    fact = F.element_at(F.array(*map(F.lit, FACTS)), (F.col("turn") % len(FACTS) + 1).cast("int"))
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("i"), F.concat("text", fact).alias("text"))
    rows = M.hierarchical_summaries(chunks, BUDGET, DEPTH)
    return rows.select(F.col("doc_id").alias("conv_id"), "chunks", "input_tokens", "depth", "output_tokens", F.md5("content").alias("digest"))
