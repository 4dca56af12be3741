"""Graph queries over parts, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.operators.relational import first_by
from ledgerloom.plans.registry import query, table

#: Nodes are suppliers (1000000 + key) and parts; an edge of weight 0.5 to 1 in each direction.
EDGES = "e AS (SELECT p AS src, 1000000 + s AS dst, 0.5 + (p % 6) / 10.0::DOUBLE AS weight, CASE WHEN p % 2 = 0 THEN 'imports' ELSE 'caller' END AS relation FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) UNION ALL SELECT 1000000 + s, p, 0.5 + (p % 6) / 10.0::DOUBLE, 'caller' FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem))"


def _edges(spark, sf_dir, repeated=False):
    """The edges, each once, or as often as the table has them."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    pairs = rows if repeated else rows.distinct()
    part, supplier, weight = F.col("l_partkey"), F.col("l_suppkey") + 1000000, 0.5 + (F.col("l_partkey") % 6) / 10
    out = pairs.select(part.alias("src"), supplier.alias("dst"), weight.alias("weight"), F.when(part % 2 == 0, "imports").otherwise("caller").alias("relation"))
    return out.unionByName(pairs.select(supplier.alias("src"), part.alias("dst"), weight.alias("weight"), F.lit("caller").alias("relation")))


@query(f"""WITH {EDGES}, l0 AS (SELECT * FROM (VALUES (5, 1.0::DOUBLE), (20, 0.9::DOUBLE)) t(node, seed)),
 x1 AS (SELECT dst AS node, weight AS raw, seed, relation, src AS parent FROM l0 JOIN e ON node = src), l1 AS (SELECT node, arg_max((raw, seed, relation), (raw, seed, -parent)) AS b FROM x1 WHERE node NOT IN (SELECT node FROM l0) GROUP BY 1),
 y1 AS (SELECT node, b[1] AS raw, b[2] AS seed, b[3] AS relation FROM l1), x2 AS (SELECT dst AS node, weight * 0.7::DOUBLE AS raw, seed, y1.relation, src AS parent FROM y1 JOIN e ON node = src),
 l2 AS (SELECT node, arg_max((raw, seed, relation), (raw, seed, -parent)) AS b FROM x2 WHERE node NOT IN (SELECT node FROM l0 UNION SELECT node FROM l1) GROUP BY 1)
 SELECT node::BIGINT AS node, 0 AS depth, seed AS confidence, NULL::VARCHAR AS relation FROM l0 UNION ALL SELECT node, 1, round(raw * seed, 6), relation FROM y1 WHERE raw >= 0.4 UNION ALL SELECT node, 2, round(b[1] * b[2], 6), b[3] FROM l2 WHERE b[1] >= 0.4""")
def blast_radius(spark, sf_dir):
    seeds = spark.createDataFrame([(5, 1.0), (20, 0.9)], "node long, weight double")
    return G.reach(_edges(spark, sf_dir), seeds, 2)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS key, l_partkey AS item FROM lineitem), s AS (SELECT key, count(*) AS size, list_sort(list(item)) AS items FROM m GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT key, size, min(key) OVER (PARTITION BY items) AS rep FROM s),
 reps AS (SELECT key, size FROM r WHERE key = rep), o AS (SELECT m.* FROM m JOIN reps USING (key)), i AS (SELECT a.key AS a, b.key AS b, count(*) AS hit FROM o a JOIN o b ON a.item = b.item AND a.key < b.key GROUP BY 1, 2)
 SELECT 'member' AS kind, key AS a, rep AS b, 1.0::DOUBLE AS similarity FROM r UNION ALL SELECT 'pair', a, b, round(hit / (x.size + y.size - hit)::DOUBLE, 6) FROM i JOIN reps x ON a = x.key JOIN reps y ON b = y.key WHERE hit / (x.size + y.size - hit)::DOUBLE >= 0.6""")
def structural_twins(spark, sf_dir):
    """Orders by the parts they hold."""
    return G.twins(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("item")), 0.6, 2)


@query(f"WITH {EDGES} SELECT dst AS node, count(*) AS callers, min(src) AS first FROM e GROUP BY 1")
def callers(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers"), F.min("src").alias("first"))


@query(f"WITH {EDGES} SELECT 'in' AS side, src AS other, weight FROM e WHERE dst = 1000007 UNION ALL SELECT 'out', dst, weight FROM e WHERE src = 1000007")
def imports_both_ways(spark, sf_dir):
    e = _edges(spark, sf_dir)
    into = e.where("dst = 1000007").select(F.lit("in").alias("side"), F.col("src").alias("other"), "weight")
    return into.unionByName(e.where("src = 1000007").select(F.lit("out").alias("side"), F.col("dst").alias("other"), "weight"))


@query("SELECT p_brand AS name, min(p_partkey) AS definition, arg_min(p_name, p_partkey) AS text FROM part GROUP BY 1")
def definition_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("definition"), F.min_by("p_name", "p_partkey").alias("text"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey) AS outline FROM lineitem GROUP BY 1")
def file_outline(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    text = F.array_join(F.transform(lines, lambda x: F.concat_ws(":", x.l_linenumber.cast("string"), x.l_partkey.cast("string"))), " ")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(text.alias("outline"))


@query("WITH s AS (SELECT l_orderkey AS file, l_linenumber AS lo, l_linenumber + l_partkey % 4 AS hi, l_partkey AS symbol FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS line FROM lineitem) SELECT file, line, symbol FROM (SELECT c.file, line, symbol, row_number() OVER (PARTITION BY c.file, line ORDER BY hi - lo, symbol) AS k FROM c JOIN s ON c.file = s.file AND line BETWEEN lo AND hi) WHERE k = 1")
def symbol_containment(spark, sf_dir):
    """The smallest range of the same file that holds each call site; ranges join by file, so they stay local to it."""
    lines = table(spark, sf_dir, "lineitem")
    s = lines.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.col("l_partkey") % 4).alias("hi"), F.col("l_partkey").alias("symbol"))
    sites = lines.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    inside = sites.join(s, "file").where(F.col("line").between(F.col("lo"), F.col("hi")))
    return first_by(inside, ["file", "line"], F.col("hi") - F.col("lo"), F.col("symbol")).select("file", "line", "symbol")


@query("SELECT event_id, CASE WHEN (props->>'$.k')::BIGINT > 90 THEN 'dynamic' WHEN event_type = 'view' THEN 'coarse' ELSE 'exact' END AS resolution FROM events")
def edge_resolution(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.when(k > 90, "dynamic").when(F.col("event_type") == "view", "coarse").otherwise("exact").alias("resolution"))


def _levels(depth: int, most: int) -> str:
    """CTEs l0 to l``depth`` of (root, node, depth): each level's new nodes by key, as many as the root has left."""
    out = ["l0 AS (SELECT p_partkey::BIGINT AS root, p_partkey::BIGINT AS node, 0 AS depth FROM part WHERE p_partkey % 20 = 0)"]
    for k in range(1, depth + 1):
        out.append(f"""n{k} AS (SELECT DISTINCT l.root, e.dst AS node FROM l{k - 1} l JOIN e ON e.src = l.node WHERE l.depth = {k - 1}),
 u{k} AS (SELECT root, count(*) AS used FROM l{k - 1} GROUP BY 1),
 l{k} AS (SELECT * FROM l{k - 1} UNION ALL SELECT root, node, {k} FROM (SELECT n.root, n.node, used, row_number() OVER (PARTITION BY n.root ORDER BY n.node) AS r FROM n{k} n JOIN u{k} USING (root) ANTI JOIN l{k - 1} s ON s.root = n.root AND s.node = n.node) WHERE r <= {most} - used)""")
    return ", ".join(out)


@query(f"WITH {EDGES}, {_levels(3, 60)} SELECT root, node, depth, count(*) OVER (PARTITION BY root) >= 60 AS truncated FROM l3")
def call_graph_budget(spark, sf_dir):
    """Every twentieth part (the stated set of roots) with what it reaches in three steps, 60 nodes at most."""
    roots = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").cast("long").alias("root"))
    return G.call_graph(_edges(spark, sf_dir, repeated=True), roots, 3, 60)
