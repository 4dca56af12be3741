"""Requirement, name and state records: diffs by field, escapes, names, versions, balances and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.graph import scratch
from ledgerloom.plans.registry import query, table


@query("""WITH a AS (SELECT p_partkey AS id, p_name AS title, p_type AS type, p_size AS points, p_brand AS parent FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) || ' ' ELSE p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN 'task' ELSE p_type END AS type, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS points, p_brand AS parent FROM part WHERE p_partkey % 13 <> 0),
 j AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NULL AS added, b.id IS NULL AS removed, lower(trim(a.title)) IS DISTINCT FROM lower(trim(b.title)) AS t, a.type IS DISTINCT FROM b.type AS k, a.points IS DISTINCT FROM b.points AS p FROM a FULL JOIN b ON a.id = b.id)
 SELECT id, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN t OR k OR p THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN added OR removed THEN '' ELSE array_to_string(list_filter([CASE WHEN t THEN 'title' END, CASE WHEN k THEN 'type' END, CASE WHEN p THEN 'points' END], lambda x: x IS NOT NULL), ',') END AS fields FROM j""")
def requirement_diff(spark, sf_dir):
    """Two snapshots by id with the fields that changed; titles compare without case and outer space, nulls as equal."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.col("p_size").alias("points"))
    before = part.where("id % 11 <> 0")
    after = part.where("id % 13 <> 0").select(
        "id", F.when(F.col("id") % 4 == 0, F.concat(F.upper("title"), F.lit(" "))).otherwise(F.col("title")).alias("title"), F.when(F.col("id") % 5 == 0, "task").otherwise(F.col("type")).alias("type"), F.when(F.col("id") % 6 != 0, F.col("points")).alias("points")
    )
    both = before.select("id", F.struct("title", "type", "points").alias("a")).join(after.select("id", F.struct("title", "type", "points").alias("b")), "id", "full")
    flat = lambda c: F.lower(F.trim(c))
    unlike = {"title": ~flat(F.col("a.title")).eqNullSafe(flat(F.col("b.title"))), "type": ~F.col("a.type").eqNullSafe(F.col("b.type")), "points": ~F.col("a.points").eqNullSafe(F.col("b.points"))}
    fields = F.concat_ws(",", *[F.when(test, name) for name, test in unlike.items()])
    alone = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
    return both.select("id", F.coalesce(alone, F.when(fields != "", "changed").otherwise("unchanged")).alias("status"), F.when(alone.isNotNull(), "").otherwise(fields).alias("fields"))


@query(r"SELECT substr(sha256(trim(regexp_replace(lower(p_name || '!  ' || p_type), '[^a-z0-9]+', ' ', 'g'))), 1, 16) AS title_hash, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def title_hash(spark, sf_dir):
    """Titles that differ in case, punctuation and space share a hash."""
    flat = F.trim(F.regexp_replace(F.lower(F.concat("p_name", F.lit("!  "), "p_type")), "[^a-z0-9]+", " "))
    return table(spark, sf_dir, "part").groupBy(F.substring(F.sha2(flat, 256), 1, 16).alias("title_hash")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'db' END AS schema_name, CASE WHEN p_partkey % 3 >= 1 THEN 'T' || p_size ELSE NULL END AS table_name, replace(p_name, ' ', '_') AS column_name FROM part")
def qualified_names(spark, sf_dir):
    """Names of one to three parts, built and split again; missing leading parts are null."""
    column = F.replace("p_name", F.lit(" "), F.lit("_"))
    built = F.concat_ws(".", F.when(F.col("p_partkey") % 3 == 2, F.lit("db")), F.when(F.col("p_partkey") % 3 >= 1, F.concat(F.lit("T"), F.col("p_size").cast("string"))), column)
    parts = F.reverse(F.split(built, r"\."))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.get(parts, F.lit(k)).alias(n) for k, n in ((2, "schema_name"), (1, "table_name"), (0, "column_name"))])


@query(r"""SELECT doc_id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0))) AS fence, md5(regexp_replace(t, '([\\`*_{}\[\]()#+!|<>-])', '\\\1', 'g')) AS escaped FROM (SELECT doc_id, text || ' ' || repeat('`', (doc_id % 6)::INTEGER) || ' a|b' AS t FROM documents)""")
def markdown_escapes(spark, sf_dir):
    """A code fence longer than any run of marks inside, and text with Markdown's marks escaped."""
    t = F.concat("text", F.lit(" "), F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit(" a|b"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", X.code_fence(F.col("t")).alias("fence"), F.md5(X.escape_markdown(F.col("t"))).alias("escaped"))


@query("SELECT '| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' | ' || CASE WHEN n_regionkey = 2 THEN '' ELSE n_regionkey::VARCHAR END || ' |' AS line, n_nationkey + 2 AS place FROM nation UNION ALL SELECT '| key | name | region |', 0 UNION ALL SELECT '| --- | --- | --- |', 1")
def markdown_table(spark, sf_dir):
    """A DataFrame as lines of a Markdown table; nulls are empty cells."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("region"))
    head = spark.createDataFrame([(f"| {' | '.join(rows.columns)} |", 0), ("|" + " --- |" * len(rows.columns), 1)], "line string, place int")
    return rows.select(X.markdown_row(*[F.col(c) for c in rows.columns]).alias("line"), (F.col("key") + 2).alias("place")).unionByName(head)


@query("""WITH l AS (SELECT o_custkey AS k, o_orderstatus = 'F' AS old, '+' || l_partkey % 40 AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT o_custkey, o_orderstatus = 'F', ' ctx' FROM orders), s AS (SELECT k, list(DISTINCT line) FILTER (WHERE old AND line LIKE '+%') AS a, list(DISTINCT line) FILTER (WHERE NOT old AND line LIKE '+%') AS b FROM l GROUP BY 1)
 SELECT k AS patch, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 6)::DOUBLE AS similarity FROM s""")
def patch_similarity(spark, sf_dir):
    """Jaccard of the changed lines of two patches; context lines do not count, an empty patch resembles none."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    patch = lambda old: F.concat(F.lit(" ctx\n"), F.coalesce(F.array_join(F.collect_list(F.when((F.col("o_orderstatus") == "F") == F.lit(old), F.concat(F.lit("+"), (F.col("l_partkey") % 40).cast("string")))), "\n"), F.lit("")))
    both = lines.groupBy(F.col("o_custkey").alias("patch")).agg(patch(True).alias("a"), patch(False).alias("b"))
    return both.select("patch", F.round(X.jaccard(X.patch_lines(F.col("a")), X.patch_lines(F.col("b")), 0.0), 6).alias("similarity"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT = 7 AS equal, (props->>'$.k')::BIGINT >= 50 AS subset FROM events""")
def json_subset(spark, sf_dir):
    """Whether a JSON object equals, and whether it is part of, another; the order of keys does not count."""
    k = F.get_json_object("props", "$.k").cast("long")
    larger = F.concat(F.lit('{"b": "x", "k": "'), F.greatest(k, F.lit(50)).cast("string"), F.lit('"}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"k": "'), k.cast("string"), F.lit('", "b": "x"}')).alias("own"), larger.alias("other"))
    return rows.select("event_id", X.json_contains(F.lit('{"b":"x","k":"7"}'), F.col("own")).alias("equal"), X.json_contains(F.col("other"), F.col("own")).alias("subset"))


@query("SELECT event_id, sum(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN c ELSE c - c // 2 END) OVER w::BIGINT AS held, 500000 - sum(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN c ELSE c - c // 2 END) OVER w >= 0 AS within FROM (SELECT *, round(value * 100)::BIGINT AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)".replace("OVER w::BIGINT", "OVER w"))
def budget_state(spark, sf_dir):
    """What a user's budget holds after every call: reserved in full, half given back when settled, all when it failed."""
    cents = F.round(F.col("value") * 100).cast("long")
    held = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", cents).otherwise(cents - F.floor(cents / 2))
    running = F.sum(held).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("event_id", running.alias("held"), (500000 - running >= 0).alias("within"))


@query("SELECT doc_id, round(avg(score), 6) AS faithfulness, count(score) AS judged FROM (SELECT conv_id AS doc_id, CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN least(1.0, length(text) / 800.0) END AS score FROM conversations) GROUP BY 1")
def mean_faithfulness(spark, sf_dir):
    """Mean over the answers that were judged, null where none was."""
    score = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 != 0), F.least(F.lit(1.0), F.length("text") / 800))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.round(F.avg(score), 6).alias("faithfulness"), F.count(score).alias("judged"))


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AND o_orderpriority NOT LIKE '5%' AS flagged FROM orders")
def flagged_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").startswith("5")).alias("flagged"))


@query("SELECT (user_id % 4)::INTEGER AS workspace, ts::DATE AS day, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def daily_upsert(spark, sf_dir):
    """Days are written, some again with all their rows: a repeated day replaces itself and leaves the others alone."""
    from ledgerloom.streaming.jobs import upsert_days

    cents = F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    days = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).cast("int").alias("workspace"), F.to_date("ts").alias("day")).agg(cents)
    path = scratch(spark)
    write = upsert_days(path)
    write(days.withColumn("cents", F.when(F.dayofmonth("day") < 9, F.lit(-1)).otherwise(F.col("cents"))), 0)
    write(days.where(F.dayofmonth("day") < 9), 1)
    return spark.read.parquet(path).select(F.col("workspace").cast("int"), F.col("day").cast("date"), "cents")
