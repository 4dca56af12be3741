"""Queries over nested JSON: what changed between two snapshots, path by path, and whether one is part of the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import guards
from ledgerloom.operators import nested as N
from ledgerloom.plans.registry import query, table

#: Two snapshots of each event's call, five levels deep: equal but for the order of keys, a changed leaf, a longer array, a removed and an added key, a malformed one.
BEFORE = '{"tool":{"name":"@type","args":{"k":@k,"deep":{"list":[1,{"z":@cents,"y":null},[]],"e":{}}}},"a.c":true}'
AFTER = (
    '{"a.c": true, "tool": {"args": {"deep": {"e": {}, "list": [1, {"y": null, "z": @cents}, []]}, "k": @k}, "name": "@type"}}', '{"a.c":true,"tool":{"name":"@type","args":{"k":@k,"deep":{"list":[1,{"z":-@cents,"y":null},[]],"e":{}}}}}',
    '{"a.c":true,"tool":{"name":"@type","args":{"k":@k,"deep":{"list":[1,{"z":@cents,"y":null},[],"@type"],"e":{}}}}}', '{"tool":{"name":"@type","args":{"k":@k,"deep":{"list":[1,{"z":@cents},[]],"e":{}}}},"a.c":true}',
    '{"tool":{"name":"@type","args":{"k":@k,"deep":{"list":[1,{"z":@cents,"y":null},[]],"e":{"new":[]}}}},"a.c":true,"b":@k}', '{"tool":{"name":',
)


def _filled(template: str) -> str:
    """SQL of the template with an event's type, number and cents in it; both engines read it."""
    return f"replace(replace(replace('{template}', '@type', event_type), '@k', CAST(get_k AS STRING)), '@cents', CAST(cents AS STRING))"


AFTER_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {_filled(t)}" for i, t in enumerate(AFTER)) + " END"
TREES = f"""src AS (SELECT event_id, event_type, (props->>'$.k')::BIGINT AS get_k, round(value * 100)::BIGINT AS cents FROM events), j AS (SELECT event_id, {_filled(BEFORE)} AS a, {AFTER_SQL} AS b FROM src),
 v AS (SELECT event_id, CASE WHEN json_valid(a) THEN a END AS a, CASE WHEN json_valid(b) THEN b END AS b FROM j),
 t AS (SELECT event_id, 'a' AS side, x.type AS type, x.fullkey AS p, x.atom AS atom, a AS doc FROM v, json_tree(a) x UNION ALL SELECT event_id, 'b', x.type, x.fullkey, x.atom, b FROM v, json_tree(b) x),
 l AS (SELECT event_id, side, CASE WHEN type = 'ARRAY' THEN p || '[#]' ELSE p END AS path, CASE type WHEN 'ARRAY' THEN json_array_length(doc, p)::VARCHAR WHEN 'OBJECT' THEN '{{}}' ELSE coalesce(atom::VARCHAR, 'null') END AS leaf FROM t WHERE type <> 'OBJECT' OR json_extract(doc, p)::VARCHAR = '{{}}'),
 d AS (SELECT event_id, path, max(leaf) FILTER (WHERE side = 'a') AS before, max(leaf) FILTER (WHERE side = 'b') AS after FROM l GROUP BY 1, 2)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("get_k"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rows.select("event_id", F.expr(_filled(BEFORE)).alias("a"), F.expr(AFTER_SQL).alias("b"))


@query(f"WITH {TREES} SELECT event_id, path, before, after FROM d WHERE before IS DISTINCT FROM after")
def json_path_diff(spark, sf_dir):
    """Leaves that differ; the order of keys makes no difference at any depth, that of array items does."""
    return N.document_diff(_snapshots(spark, sf_dir), "event_id", "a", "b")


@query(f"WITH {TREES}, s AS (SELECT event_id, count(*) FILTER (WHERE before IS DISTINCT FROM after) AS n, count(*) FILTER (WHERE before IS NOT NULL AND before IS DISTINCT FROM after) AS lost FROM d GROUP BY 1) SELECT event_id, b IS NULL AS malformed, b IS NOT NULL AND n = 0 AS equal, b IS NOT NULL AND lost = 0 AS part FROM v JOIN s USING (event_id)")
def json_deep_subset(spark, sf_dir):
    """Whether the first snapshot equals the second, and whether it is part of it: objects may have more keys there, arrays must agree."""
    docs = _snapshots(spark, sf_dir)
    lost = N.document_diff(docs, "event_id", "a", "b").groupBy("event_id").agg(F.count("*").alias("n"), F.count("before").alias("lost"))
    rows = docs.select("event_id", F.try_parse_json("b").isNull().alias("malformed")).join(lost, "event_id", "left")
    none = lambda c: ~F.col("malformed") & (F.coalesce(c, F.lit(0)) == 0)
    return rows.select("event_id", "malformed", none(F.col("n")).alias("equal"), none(F.col("lost")).alias("part"))


@query("""
    WITH v AS (SELECT role, text FROM conversations WHERE role IS NOT NULL)
    SELECT 'verdict.reason' AS path, count(text) AS n_rows, count(*) FILTER (length(text) > 2000) AS n_over FROM v
    UNION ALL SELECT 'verdict.role', count(role), count(*) FILTER (length(role) > 128) FROM v
    UNION ALL SELECT 'turns[].said', count(text), count(*) FILTER (length(text) > 128) FROM v
    UNION ALL SELECT 'notes.*', count(text), count(*) FILTER (CASE role WHEN 'judge' THEN length(text) > 128 WHEN 'reason' THEN length(text) > 2000 ELSE length(text) > 128 END) FROM v
""")
def leaf_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings at every leaf of nested turns, and those beyond what their name allows."""
    turns = table(spark, sf_dir, "conversations").where("role IS NOT NULL")
    said = F.struct(F.col("text").alias("said"))
    rows = turns.select(F.struct(F.col("text").alias("reason"), "role").alias("verdict"), F.array(said).alias("turns"), F.create_map("role", "text").alias("notes"))
    return guards.leaf_report(rows)
