"""Joins, set operations, ranking, paging and predicates over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import relational as R
from ledgerloom.plans.registry import query, table


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def scan_filter_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"))


@query("SELECT * FROM (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name LIMIT 11)")
def capped_select(spark, sf_dir):
    """A read-only select with a row cap; one row more than the cap tells that it was cut."""
    from ledgerloom.sources.sql import read_only

    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"capped_{name}")
    return read_only(spark, "SELECT n_name, r_name FROM capped_nation JOIN capped_region ON n_regionkey = r_regionkey ORDER BY n_name", 10)


@query("SELECT o.o_orderkey, o.o_totalprice FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE o.o_orderstatus IS NOT NULL AND o_totalprice > 100000 AND c.c_mktsegment = 'BUILDING'")
def soft_delete_filter(spark, sf_dir):
    """Rows alive themselves and through the parent they belong to."""
    live = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus IS NOT NULL AND o_totalprice > 100000")
    return rows.join(live, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE lower('%1!_%') ESCAPE '!' OR lower(p_name) LIKE '%a%'")
def escaped_contains(spark, sf_dir):
    name = F.lower("p_name")
    return table(spark, sf_dir, "part").where(F.expr(f"lower(p_name) LIKE '%{X.like_escape('1_')}%' ESCAPE '!'") | F.contains(name, F.lit("a"))).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type), '^[^/]*br.ss[^/]*$') OR regexp_matches(lower(p_brand), '^brand#1.$')")
def case_fold_glob(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_type").rlike("(?iu)" + X.glob_regex("*br?ss*")) | F.col("p_brand").rlike("(?iu)" + X.glob_regex("brand#1?"))).select("p_partkey")


@query("SELECT page_id, regexp_matches(url, '^(?:.*/)?en/[^/]*$') AS english, regexp_matches(url, '^https?:/.*page=.$') AS paged FROM pages")
def repo_glob(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url.rlike(X.glob_regex("**/en/*")).alias("english"), url.rlike("^https?:/.*page=.$").alias("paged"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_totalprice > 200000 THEN 'verified' WHEN o_totalprice > 150000 THEN 'likely' WHEN o_totalprice > 50000 THEN 'possible' ELSE 'needs-review' END AS tier FROM orders")
def impact_tier(spark, sf_dir):
    price = F.col("o_totalprice")
    tier = F.when(F.col("o_orderpriority").startswith("1") & (price > 200000), "verified").when(price > 150000, "likely").when(price > 50000, "possible").otherwise("needs-review")
    return table(spark, sf_dir, "orders").select("o_orderkey", tier.alias("tier"))


@query("SELECT event_id FROM events WHERE event_type <> 'error' OR props->>'$.k' IS NOT NULL")
def lineage_edge_predicate(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("event_type") != "error") | F.get_json_object("props", "$.k").isNotNull()).select("event_id")


@query("SELECT doc_id, len(list_filter(acl, lambda s: s IN ('src1', 'en'))) > 0 OR len(acl) = 0 AS visible FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN []::VARCHAR[] ELSE [source, lang] END AS acl FROM documents)")
def access_filter(spark, sf_dir):
    acl = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", ((F.size(acl) == 0) | F.arrays_overlap(acl, F.array(F.lit("src1"), F.lit("en")))).alias("visible"))


@query("SELECT conv_id, turn, length(text) > 2000 AS too_long FROM conversations WHERE role IN ('assistant', 'system')")
def content_length_guard(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("assistant", "system")).select("conv_id", "turn", (F.length("text") > 2000).alias("too_long"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def equi_join(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


@query("SELECT r_name, count(n_nationkey) AS n, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def relation_traversal(spark, sf_dir):
    joined = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.groupBy("r_name").agg(F.count("n_nationkey").alias("n"), F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("nations"))


@query("SELECT o_orderkey, coalesce(c.c_name, o.o_orderstatus, '<unresolved>') AS target FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey AND c_acctbal > 0")
def left_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    joined = table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.coalesce("c_name", "o_orderstatus", F.lit("<unresolved>")).alias("target"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(hits, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, sf_dir):
    hidden = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(hidden, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_name, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY 1")
def disjunct_join(spark, sf_dir):
    """Either key may match: two equi-joins united instead of one join on an OR."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sides = [table(spark, sf_dir, t).join(nation, F.col(k) == F.col("n_nationkey")).select("n_name") for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return sides[0].unionByName(sides[1]).groupBy("n_name").agg(F.count("*").alias("n"))


RUNS = """a AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS status FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS status FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"""


@query(f"WITH {RUNS} SELECT o_custkey, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n IS NOT DISTINCT FROM b.n AND a.status IS NOT DISTINCT FROM b.status THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (o_custkey)")
def snapshot_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    run = lambda k: orders.where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("status"))
    return R.snapshot_diff(run(0), run(1), "o_custkey", ["n", "status"])


@query("""WITH u AS (SELECT DISTINCT lower(CASE WHEN p_partkey % 3 = 0 THEN 'db.' || p_brand WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'x.' || p_type END) AS name FROM part), c AS (SELECT DISTINCT lower('db.' || p_brand) AS qualified FROM part WHERE p_size > 2 UNION SELECT lower('app.' || p_brand) FROM part WHERE p_size > 48),
 bare AS (SELECT split_part(qualified, '.', -1) AS bare, min(qualified) AS q FROM c GROUP BY 1), f AS (SELECT u.name, coalesce(c.qualified, bare.q) AS qualified, CASE WHEN c.qualified IS NOT NULL THEN 'qualified' WHEN bare.q IS NOT NULL THEN 'bare' ELSE 'phantom' END AS status FROM u LEFT JOIN c ON u.name = c.qualified LEFT JOIN bare ON split_part(u.name, '.', -1) = bare.bare)
 SELECT * FROM f UNION ALL SELECT NULL, qualified, 'unused' FROM c WHERE qualified NOT IN (SELECT qualified FROM f WHERE qualified IS NOT NULL)""")
def schema_reconciliation(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("db."), "p_brand")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.concat(F.lit("x."), "p_type"))
    catalog = part.where("p_size > 2").select(F.concat(F.lit("db."), "p_brand").alias("qualified")).unionByName(part.where("p_size > 48").select(F.concat(F.lit("app."), "p_brand").alias("qualified")))
    return R.two_key_reconcile(part.select(name.alias("name")), catalog)


@query("""WITH r AS (SELECT p_brand AS target, CASE WHEN max(p_size) > 49 THEN 'used' ELSE 'uncertain' END AS class FROM part GROUP BY 1), o AS (SELECT target, arg_min(class, pk) AS class FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'New#' || (p_partkey % 5) END AS target, CASE WHEN p_size > 25 THEN 'used' ELSE 'unreferenced' END AS class, p_partkey AS pk FROM part) GROUP BY 1)
 SELECT target, coalesce(o.class, r.class) AS class, CASE WHEN o.class IS NOT NULL THEN r.class END AS prior_class FROM r FULL JOIN o USING (target)""")
def override_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.groupBy(F.col("p_brand").alias("target")).agg(F.when(F.max("p_size") > 49, "used").otherwise("uncertain").alias("class"))
    target = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("New#"), (F.col("p_partkey") % 5).cast("string")))
    return R.override_merge(rows, part.select(target.alias("target"), F.when(F.col("p_size") > 25, "used").otherwise("unreferenced").alias("class"), F.col("p_partkey").alias("at")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    return R.top_overall(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 4) SELECT * FROM t ORDER BY o_totalprice DESC, o_orderkey LIMIT 24""")
def top_per_group_then_overall(spark, sf_dir):
    four = R.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], 4, F.desc("o_totalprice"), F.col("o_orderkey"))
    return R.top_overall(four.select("o_custkey", "o_orderkey", "o_totalprice"), 24, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def priority_dedup(spark, sf_dir):
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return R.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], tier, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, max(o_orderdate) AS last, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_per_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def offset_page(spark, sf_dir):
    return R.page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 3, 20, F.col("p_name"), F.col("p_partkey"))


@query("SELECT p_partkey, 70::BIGINT AS next_cursor FROM part WHERE p_partkey > 50 ORDER BY p_partkey LIMIT 20")
def keyset_page(spark, sf_dir):
    return R.keyset_page(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 50, 20)


@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 20000")
def budget_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").cast("long").alias("size"))
    return R.budget_prefix(rows, "size", 20000, ["source"], F.col("doc_id")).select("source", "doc_id", "running")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, CASE WHEN o_orderpriority < '3' THEN -o_totalprice ELSE 0 END, o_orderkey) AS place FROM orders")
def enum_sort(spark, sf_dir):
    """Three statuses hold all rows, so places are counted by ranges, not by one task a status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderpriority") < "3", -F.col("o_totalprice")).otherwise(0.0).alias("less"))
    return R.numbered(orders, "o_orderstatus", "place", F.col("o_orderpriority"), F.col("less"), F.col("o_orderkey")).select("o_orderkey", "place")


@query("(SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 1)")
def set_difference(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    half = lambda k: part.where(F.col("p_partkey") % 2 == k).select("p_brand", "p_size")
    return half(0).exceptAll(half(1))


@query("SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 1")
def set_intersection(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    half = lambda k: part.where(F.col("p_partkey") % 2 == k).select("p_brand", "p_size")
    return half(0).intersect(half(1))


@query("SELECT k, max(bal) AS best, arg_max(side, (bal, side)) AS side FROM (SELECT c_nationkey AS k, c_acctbal AS bal, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 's' FROM supplier) GROUP BY 1")
def union_best_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"), F.lit("c").alias("side"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal"), F.lit("s").alias("side"))
    return c.unionByName(s).groupBy("k").agg(F.max("bal").alias("best"), F.max_by("side", F.struct("bal", "side")).alias("side"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(r"SELECT min(doc_id) AS doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents GROUP BY 2")
def content_hash_dedup(spark, sf_dir):
    """First id of each normalised text; only the digest is shuffled."""
    digest = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    return table(spark, sf_dir, "documents").groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT (l_returnflag = 'N' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R'))")
def superseded_hiding(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    grounded = rows.where("l_returnflag = 'R'").select("l_orderkey").distinct()
    kept = rows.where("l_returnflag <> 'N'").unionByName(rows.where("l_returnflag = 'N'").join(grounded, "l_orderkey", "left_anti"))
    return kept.select("l_orderkey", "l_linenumber")


@query("SELECT a.p_partkey, list_sort(list_distinct(string_split(lower(a.p_type), ' '))) = list_sort(list_distinct(string_split(lower(b.p_type), ' '))) AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def set_equality(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.sort_array(F.array_distinct(F.split(F.lower("p_type"), " "))).alias("words"))
    return part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("words").alias("next")), "p_partkey").select("p_partkey", (F.col("words") == F.col("next")).alias("same"))


@query("SELECT field, CASE WHEN k = 1 THEN field ELSE field || '#' || k END AS key, p_partkey FROM (SELECT p_brand AS field, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)")
def key_suffixing(spark, sf_dir):
    rows = R.numbered(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "k", F.col("p_partkey"))
    key = F.when(F.col("k") == 1, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("#"), F.col("k").cast("string")))
    return rows.select(F.col("p_brand").alias("field"), key.alias("key"), "p_partkey")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce((props->>'$.k') = '7', false) AS flag, try_cast(props->>'$.k' AS BIGINT) > 50 AS large FROM events")
def json_columns(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), F.coalesce(k == "7", F.lit(False)).alias("flag"), (k.try_cast("long") > 50).alias("large"))


@query("WITH a AS (SELECT event_id, props FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id - 1 AS event_id, props FROM events WHERE event_id % 2 = 1) SELECT event_id, CASE WHEN a.props IS NULL THEN 'added' WHEN b.props IS NULL THEN 'removed' WHEN a.props = b.props THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (event_id)")
def schema_snapshot_diff(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", R.canonical_json(F.col("props")).alias("props"))
    before, after = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1").withColumn("event_id", F.col("event_id") - 1)
    return R.snapshot_diff(before, after, "event_id", ["props"])


@query("WITH f AS (SELECT l_orderkey AS k, count(*) AS n, round(sum(l_extendedprice), 2) AS total, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1) SELECT count(*) AS headline, sum(n)::BIGINT AS edits, max(suppliers) AS most FROM f")
def headline_counts(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))
    return f.agg(F.count("*").alias("headline"), F.sum("n").alias("edits"), F.max("suppliers").alias("most"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def project_health(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest")
    )


@query("SELECT a.l_orderkey, greatest(0, least(b.hi, a.hi) - greatest(a.lo, b.lo))::BIGINT AS overlap FROM (SELECT l_orderkey, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey - 1 AS l_orderkey, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1) b USING (l_orderkey)")
def range_overlap(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"))
    b = a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return a.join(b, "l_orderkey").select("l_orderkey", F.greatest(F.lit(0).cast("long"), F.least("hi", "hi2") - F.greatest("lo", "lo2")).alias("overlap"))
