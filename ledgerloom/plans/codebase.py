"""Queries over text sources, paths and symbols. Their texts are built from the tables, so SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.graph import scratch
from ledgerloom.operators.relational import first_by
from ledgerloom.plans.registry import query, table
from ledgerloom.sources import orm as O
from ledgerloom.sources import text as S
from ledgerloom.sources import vectors as V


def _lines_of(spark, sf_dir, line):
    """One text for each order: its lines by number."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t")))).alias("s"))
    return rows.select("l_orderkey", F.transform("s", lambda x: x.t).alias("lines"))


@query("SELECT l_orderkey, 'src/p' || l_partkey || '.ts' AS file, l_suppkey AS start_line, l_suppkey + greatest(0, CASE WHEN l_linenumber = 3 THEN 1 ELSE l_quantity::BIGINT % 7 END - 1) AS end_line FROM lineitem")
def unified_diff(spark, sf_dir):
    key, start, span = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), (F.col("l_quantity").cast("long") % 7).cast("string")
    into = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("+"), start)).otherwise(F.concat(F.lit("+"), start, F.lit(","), span))
    diff = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/src/p"), key, F.lit(".ts\n@@ -1,2 "), into, F.lit(" @@ fn\n+++ c\n- @@ -1 +2 @@\n"))
    texts = _lines_of(spark, sf_dir, diff).select("l_orderkey", F.concat(F.lit("@@ -1 +1 @@\n"), F.array_join("lines", "")).alias("diff"))
    return texts.select("l_orderkey", F.explode(S.diff_hunks(F.col("diff"))).alias("h")).select("l_orderkey", "h.*")


@query("SELECT o_custkey, sha1('c' || o_orderkey) AS sha, (o_orderkey % 3)::INTEGER AS n_parents, o_orderkey * 10 AS seconds, o_orderpriority AS author, 'fix ' || o_orderkey AS subject, 'closes #' || o_custkey AS body FROM orders WHERE o_orderkey % 5 <> 0")
def history_log(spark, sf_dir):
    """Commits of a delimited log; records of malformed time are left out."""
    key = F.col("o_orderkey").cast("string")
    parents = F.array_join(F.slice(F.array(F.sha1(F.lit("a")), F.sha1(F.lit("b"))), F.lit(1), (F.col("o_orderkey") % 3).cast("int")), " ")
    seconds = F.when(F.col("o_orderkey") % 5 == 0, F.lit("soon")).otherwise((F.col("o_orderkey") * 10).cast("string"))
    record = F.concat(F.lit("\n"), F.concat_ws("\u001f", F.sha1(F.concat(F.lit("c"), key)), parents, seconds, "o_orderpriority", F.concat(F.lit("fix "), key), F.concat(F.lit("\ncloses #"), F.col("o_custkey").cast("string"), F.lit("\n"))))
    logs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(record), "\0").alias("log"))
    return logs.select("o_custkey", F.explode(S.history_records(F.col("log"))).alias("c")).select("o_custkey", "c.*")


@query("""SELECT n_regionkey AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'geo' ELSE 'public' END AS "schema", 't' || n_nationkey AS "table", c AS "column", CASE c WHEN 'id' THEN 'bigint' WHEN 'price' THEN 'decimal(10,2)' ELSE 'text' END AS type, c <> 'id' AS nullable, c = 'id' OR (c = 'name' AND n_nationkey % 3 = 0) AS primary_key FROM nation, (VALUES ('id'), ('price'), ('name')) v(c)""")
def ddl_source(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    ddl = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS "), F.when(F.col("n_nationkey") % 2 == 0, F.lit('"geo".')).otherwise(F.lit("")), F.lit("[T"), key, F.lit("] (\n  `id` BIGINT NOT NULL PRIMARY KEY,\n  price Decimal(10, 2),\n  name text"),
        F.when(F.col("n_nationkey") % 3 == 0, F.lit(",\n  PRIMARY KEY (id, name)")).otherwise(F.lit(",\n  CONSTRAINT c CHECK (price > 0)")), F.lit("\n);\n-- next\n"),
    )
    files = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.collect_list(ddl), "").alias("ddl"))
    return files.select("region", F.explode(S.ddl_columns(F.col("ddl"))).alias("c")).select("region", "c.*")


RULES = ("# generated", "*.log", "build/", "/src1/", "!src1/en/keep*", "docs/**/*.md", "src2/fr")


@query("""WITH p AS (SELECT doc_id, source || '/' || lang || '/' || CASE doc_id % 5 WHEN 0 THEN 'a.log' WHEN 1 THEN 'build/x.ts' WHEN 2 THEN 'keep.ts' WHEN 3 THEN 'docs/a/b/r.md' ELSE 'm.ts' END AS path, source, lang, doc_id % 5 AS k FROM documents)
 SELECT doc_id, CASE WHEN source = 'src2' AND lang = 'fr' THEN true WHEN k = 3 THEN true WHEN source = 'src1' AND lang = 'en' AND k = 2 THEN false WHEN source = 'src1' THEN true WHEN k IN (0, 1) THEN true ELSE false END AS ignored FROM p""")
def ignore_rules(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.log", "build/x.ts", "keep.ts", "docs/a/b/r.md", "m.ts")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", S.ignored(F.concat_ws("/", "source", "lang", name), RULES).alias("ignored"))


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true ELSE false END AS is_dev FROM part")
def dev_file_class(spark, sf_dir):
    paths = ("dev/.env.PROD", "prod/docker-compose.yml", "prod/test/a.yml", "src\\test\\a.properties", "staging/app.yml", "x/local/.env", "tested/development2.yml")
    path = F.element_at(F.array(*[F.lit(p) for p in paths]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.dev_file(path).alias("is_dev"))


@query(r"""WITH i AS (SELECT p_partkey, 'HTTPServer' || upper(p_name[1]) || replace(p_name[2:], ' ', '_') || 's and the ' || p_type || 'Policies' AS t FROM part), w AS (SELECT p_partkey, unnest(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_]*')) AS w FROM i),
 c AS (SELECT p_partkey, lower(w) AS x FROM w UNION ALL SELECT p_partkey, lower(unnest(string_split(regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_'))) FROM w)
 SELECT DISTINCT p_partkey, CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) > 5 AND x LIKE '%ing' THEN x[:-4] WHEN length(x) > 4 AND x LIKE '%ed' THEN x[:-3] WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END AS term FROM c WHERE length(x) >= 2 AND x NOT IN ('and','are','for','from','has','that','the','this','was','with')""")
def code_terms(spark, sf_dir):
    t = F.concat(F.lit("HTTPServer"), F.upper(F.substring("p_name", 1, 1)), F.replace(F.expr("substring(p_name, 2)"), F.lit(" "), F.lit("_")), F.lit("s and the "), "p_type", F.lit("Policies"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(X.code_terms(t)).alias("term"))


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([o_custkey, o_orderkey % 50, 0], lambda x: x > 0))), ',') AS issues FROM orders")
def branch_issues(spark, sf_dir):
    """Issue numbers of a branch name, each once, in order; zero is none."""
    branch = F.concat(F.lit("feature/issue-"), F.col("o_custkey").cast("string"), F.lit("-gh-"), (F.col("o_orderkey") % 50).cast("string"), F.lit("_x/0-v"), F.lit("1a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.branch_issues(branch).cast("array<string>"), ",").alias("issues"))


@query("SELECT l_orderkey, l_linenumber, 'rejects part ' || l_partkey || ' twice' AS criterion FROM lineitem")
def criterion_normalise(spark, sf_dir):
    """Criteria that differ in citations, case and punctuation compare equal."""
    key = F.col("l_partkey").cast("string")
    t = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Rejects part  "), key, F.lit(", TWICE! (api/a.go:"), key, F.lit(" and b.go:7)"))).otherwise(F.concat(F.lit("rejects (part) "), key, F.lit(" twice internal/cli.go:12-17, ")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.normalise_criterion(t).alias("criterion"))


SYMBOLS = "s AS (SELECT l_orderkey AS file, l_partkey AS symbol, l_linenumber * 10 AS lo, l_linenumber * 10 + 5 + l_partkey % 20 AS hi FROM lineitem), h AS (SELECT DISTINCT l_orderkey AS file, l_linenumber * 10 - 4 + l_suppkey % 9 AS line FROM lineitem)"


@query(f"""WITH {SYMBOLS}, below AS (SELECT h.file, line, symbol, row_number() OVER (PARTITION BY h.file, line ORDER BY lo, symbol) AS k FROM h JOIN s ON h.file = s.file AND lo BETWEEN line AND line + 3), around AS (SELECT h.file, line, symbol, row_number() OVER (PARTITION BY h.file, line ORDER BY hi - lo, lo, symbol) AS k FROM h JOIN s ON h.file = s.file AND line BETWEEN lo AND hi)
 SELECT h.file, h.line, coalesce(b.symbol, a.symbol) AS symbol FROM h LEFT JOIN below b ON h.file = b.file AND h.line = b.line AND b.k = 1 LEFT JOIN around a ON h.file = a.file AND h.line = a.line AND a.k = 1""")
def rationale_link(spark, sf_dir):
    """A note belongs to the symbol that starts at most three lines below it, else to the smallest one around it."""
    lines = table(spark, sf_dir, "lineitem")
    s = lines.select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("symbol"), (F.col("l_linenumber") * 10).alias("lo"), (F.col("l_linenumber") * 10 + 5 + F.col("l_partkey") % 20).alias("hi"))
    h = lines.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 10 - 4 + F.col("l_suppkey") % 9).alias("line")).distinct()
    below, around = F.col("lo").between(F.col("line"), F.col("line") + 3), F.col("line").between(F.col("lo"), F.col("hi"))
    met = h.join(s, "file").where(below | around).withColumn("far", (~below).cast("int"))
    found = first_by(met, ["file", "line"], "far", F.when(F.col("far") == 0, F.col("lo")).otherwise(F.col("hi") - F.col("lo")), "lo", "symbol")
    return h.join(found.select("file", "line", "symbol"), ["file", "line"], "left")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS file FROM orders WHERE o_totalprice > 400000), e AS (SELECT o_custkey AS a, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey), r AS (SELECT y.a AS file, max(1.0 - (y.p % 10) / 10.0)::DOUBLE AS score FROM f JOIN e x ON x.a = f.file JOIN e y ON x.p = y.p AND y.a <> x.a GROUP BY 1),
 u AS (SELECT file, max(score) AS score FROM (SELECT file, 10.0::DOUBLE AS score FROM f UNION ALL SELECT * FROM r) GROUP BY 1), b AS (SELECT *, sum(5 + file % 10) OVER (ORDER BY score DESC, file) AS used FROM u) SELECT file, round(score, 6) AS score, used::BIGINT AS used FROM b WHERE used <= 2000""")
def repo_map(spark, sf_dir):
    """Focus files score 10, files that share a part with one the best of their links; the map ends where the budget does.

    Every file costs at least 5, so the budget bounds the rows that are ordered together.
    """
    e = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("file"), F.col("l_partkey").alias("part")).distinct()
    focus = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("file")).distinct()
    own = e.join(focus, "file").select("part", F.col("file").alias("of")).distinct()
    # Of a part's focus files two are enough to know whether another one than the file itself has it.
    few = own.groupBy("part").agg(F.min("of").alias("low"), F.max("of").alias("high"))
    related = e.join(few, "part").where("low <> file OR high <> file").groupBy("file").agg(F.max(1 - (F.col("part") % 10) / 10).alias("score"))
    every = focus.withColumn("score", F.lit(10.0)).unionByName(related).groupBy("file").agg(F.max("score").alias("score"))
    best = every.orderBy(F.desc("score"), "file").limit(2000 // 5)
    used = F.sum(5 + F.col("file") % 10).over(Window.orderBy(F.desc("score"), "file"))
    return best.withColumn("used", used).where("used <= 2000").select("file", F.round("score", 6).alias("score"), "used")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS product, CASE WHEN o_orderpriority LIKE '1%' THEN 'direct' ELSE 'none' END AS kind FROM orders), p AS (SELECT c_custkey AS product, c_nationkey AS portfolio, CASE WHEN o.product IS NULL THEN NULL ELSE o.direct END AS direct, c_acctbal > 0 AS connected FROM customer LEFT JOIN (SELECT product, bool_or(kind = 'direct') AS direct FROM e GROUP BY 1) o ON product = c_custkey), a AS (SELECT portfolio, bool_or(coalesce(direct, false)) AS changes FROM p GROUP BY 1)
 SELECT product, CASE WHEN NOT changes THEN 'unknown' WHEN direct IS NULL THEN 'never-analysed' WHEN direct THEN 'direct-change' WHEN connected THEN 'reached' ELSE 'not-in-scope' END AS scope FROM p JOIN a USING (portfolio)""")
def scope_of_change(spark, sf_dir):
    """Products of a portfolio: changed, reached, unreached or never analysed; nothing is said of a portfolio without a change."""
    direct = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("product")).agg(F.bool_or(F.col("o_orderpriority").startswith("1")).alias("direct"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("product"), F.col("c_nationkey").alias("portfolio"), (F.col("c_acctbal") > 0).alias("connected")).join(direct, "product", "left")
    changes = p.groupBy("portfolio").agg(F.bool_or(F.coalesce("direct", F.lit(False))).alias("changes"))
    scope = F.when(~F.col("changes"), "unknown").when(F.col("direct").isNull(), "never-analysed").when(F.col("direct"), "direct-change").when(F.col("connected"), "reached").otherwise("not-in-scope")
    return p.join(changes, "portfolio").select("product", scope.alias("scope"))


@query("""WITH r AS (SELECT l_partkey AS symbol, l_suppkey AS via, 1 + l_linenumber % 3 AS depth, l_discount AS confidence, CASE WHEN l_returnflag = 'A' THEN 'writer' WHEN l_returnflag = 'R' THEN 'model' ELSE 'related' END AS role FROM lineitem), x AS (SELECT symbol, CASE WHEN role = 'writer' THEN 0 ELSE depth END AS depth, confidence, CASE role WHEN 'writer' THEN 0 WHEN 'model' THEN 1 ELSE 2 END AS rank, via FROM r)
 SELECT symbol, arg_min(depth, (rank, depth, -confidence, via)) AS depth, arg_min(confidence, (rank, depth, -confidence, via)) AS confidence, CASE min(rank) WHEN 0 THEN 'data-writer' WHEN 1 THEN 'data-model' ELSE 'related' END AS role FROM x GROUP BY 1""")
def impact_roles(spark, sf_dir):
    """Writers of the data come first, at depth 0; rows of the data model replace weaker ones; related rows fill in."""
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    depth = F.when(rank == 0, 0).otherwise(1 + F.col("l_linenumber") % 3)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), rank.alias("rank"), depth.alias("depth"), F.col("l_discount").alias("confidence"), F.col("l_suppkey").alias("via"))
    best = rows.groupBy("symbol").agg(F.min(F.struct("rank", "depth", (-F.col("confidence")).alias("less"), "via")).alias("b"))
    role = F.when(F.col("b.rank") == 0, "data-writer").when(F.col("b.rank") == 1, "data-model").otherwise("related")
    return best.select("symbol", "b.depth", (-F.col("b.less")).alias("confidence"), role.alias("role"))


@query("SELECT event_id, i::INTEGER AS request, CASE WHEN event_id % 3 = 0 THEN 2 * k ELSE CASE i WHEN 0 THEN k ELSE event_id END END AS input_tokens FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k, unnest(range(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END)) AS i FROM events)")
def summed_rows(spark, sf_dir):
    """The requests of a summed row if their sums are its own; else the row as one request."""
    k = F.get_json_object("props", "$.k").cast("long")
    total = F.when(F.col("event_id") % 3 == 0, 2 * k).otherwise(k + F.col("event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", total.alias("total"), F.format_string("[[%d,1,0,0],[%d,1,0,0]]", k, F.col("event_id") + F.when(F.col("event_id") % 3 == 0, k + 1).otherwise(0)).alias("requests"))
    each = F.from_json("requests", "array<array<bigint>>")
    adds_up = (F.size(each) >= 2) & (F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x[0]) == F.col("total"))
    parts = F.when(adds_up, F.transform(each, lambda x: x[0])).otherwise(F.array("total"))
    return rows.select("event_id", F.posexplode(parts).alias("request", "input_tokens"))


@query("""WITH b AS (SELECT item_id, unnest(range(16)) AS i, sha256('offline|0|' || text) AS h FROM benchmark), v AS (SELECT item_id, i, ((instr('0123456789abcdef', h[2 * i + 1]) - 1) * 16 + instr('0123456789abcdef', h[2 * i + 2]) - 1 - 128) / 128.0::DOUBLE AS v FROM b)
 SELECT item_id, i::INTEGER AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM v""")
def hash_embedding(spark, sf_dir):
    """Vectors of 16 numbers from the bytes of a hash, of length 1."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.hash_embedding(F.col("text"), 16, "offline")).alias("i", "v")).select("item_id", "i", F.round("v", 6).alias("value"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k, l_partkey AS x, l_partkey % 3 AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k, l_partkey AS x, l_partkey % 3 AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'),
 d AS (SELECT k, 'added' AS change, x, r FROM b ANTI JOIN a USING (k, x) UNION ALL SELECT k, 'removed', x, r FROM a ANTI JOIN b USING (k, x)) SELECT k AS plan, change, string_agg(x, ',' ORDER BY r, x) AS items FROM d GROUP BY 1, 2""")
def design_set_change(spark, sf_dir):
    """What a plan gained and lost, by rank, then in order."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    side = lines.groupBy("o_custkey", "l_partkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("old"), F.bool_or(F.col("o_orderstatus") != "F").alias("new")).where("old <> new")
    change = F.when(F.col("new"), "added").otherwise("removed")
    rows = side.groupBy(F.col("o_custkey").alias("plan"), change.alias("change")).agg(F.array_sort(F.collect_list(F.struct((F.col("l_partkey") % 3).alias("r"), "l_partkey"))).alias("s"))
    return rows.select("plan", "change", F.array_join(F.transform("s", lambda x: x.l_partkey.cast("string")), ",").alias("items"))


@query("SELECT doc_id, round((coalesce(least(1.0, n_chars / 1000.0), 0) + CASE WHEN lang = 'en' THEN 1 ELSE 0 END) / 2, 6)::DOUBLE AS score, 'stub' AS judge FROM documents")
def judge_scores(spark, sf_dir):
    """Any judge is a function from a row's columns to a score; this one stands in for a model."""
    stub = lambda chars, lang: (F.least(F.lit(1.0), chars / 1000) + (lang == "en").cast("double")) / 2
    return table(spark, sf_dir, "documents").select("doc_id", F.round(stub(F.col("n_chars"), F.col("lang")), 6).alias("score"), F.lit("stub").alias("judge"))


@query("""WITH c AS (SELECT n_regionkey AS sheet, n_nationkey % 5 AS r0, n_nationkey % 3 AS c0, n_name AS value, n_nationkey AS k FROM nation), x AS (SELECT sheet, r, c, value, k FROM c, (SELECT unnest(range(20)) AS r), (SELECT unnest(range(20)) AS c) WHERE r BETWEEN r0 AND r0 + k % 3 AND c BETWEEN c0 AND c0 + 1)
 SELECT sheet, r::INTEGER AS row, c::INTEGER AS col, arg_min(value, k) AS value FROM x GROUP BY 1, 2, 3""")
def merged_cells(spark, sf_dir):
    """Every cell of a merged range has the value of its first cell; where ranges overlap the first range wins."""
    n = table(spark, sf_dir, "nation")
    r0, c0 = (F.col("n_nationkey") % 5).cast("int"), (F.col("n_nationkey") % 3).cast("int")
    rows = n.select(F.col("n_regionkey").alias("sheet"), F.col("n_name").alias("value"), "n_nationkey", F.explode(F.sequence(r0, r0 + (F.col("n_nationkey") % 3).cast("int"))).alias("row"), c0.alias("c0"))
    cells = rows.select("sheet", "row", F.explode(F.sequence(F.col("c0"), F.col("c0") + 1)).alias("col"), "value", "n_nationkey")
    return cells.groupBy("sheet", "row", "col").agg(F.min_by("value", "n_nationkey").alias("value"))


@query("SELECT doc_id, round(hit / greatest(wanted, 1)::DOUBLE, 6) AS recall, round(hit / greatest(asked, 1)::DOUBLE, 6) AS question_precision, covered AS sections FROM (SELECT conv_id AS doc_id, count(*) FILTER (WHERE role = 'user') AS wanted, count(*) FILTER (WHERE role = 'assistant') AS asked, count(DISTINCT CASE WHEN role = 'user' AND length(text) < 500 THEN turn END) AS hit, count(DISTINCT turn // 2) FILTER (WHERE role = 'assistant') AS covered FROM conversations GROUP BY 1)")
def document_reading(spark, sf_dir):
    """Requirement recall, question precision and section coverage of each document read."""
    user, own = F.col("role") == "user", F.col("role") == "assistant"
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count_if(user).alias("wanted"), F.count_if(own).alias("asked"), F.count_distinct(F.when(user & (F.length("text") < 500), F.col("turn"))).alias("hit"), F.count_distinct(F.when(own, F.floor(F.col("turn") / 2))).alias("sections"))
    return rows.select("doc_id", F.round(F.col("hit") / F.greatest("wanted", F.lit(1)), 6).alias("recall"), F.round(F.col("hit") / F.greatest("asked", F.lit(1)), 6).alias("question_precision"), "sections")


@query("""SELECT n_regionkey AS region, 'nat_' || n_nationkey AS "table", c AS "column", CASE c WHEN 'id' THEN 'Int' WHEN 'full_name' THEN 'String' ELSE 'DateTime' END AS type, c = 'at' AS nullable, c = 'id' AS primary_key FROM nation, (VALUES ('id'), ('full_name'), ('at')) v(c)
 UNION ALL SELECT n_regionkey, 'Side' || n_nationkey, 'key', 'BigInt', false, true FROM nation""")
def prisma_models(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    model = F.concat(
        F.lit("model Nation"), key, F.lit(' {\n  id Int @id @default(autoincrement())\n  name String @map("full_name")\n  at DateTime?\n  sides Side[]\n  region Region @relation(fields: [id])\n  // note\n  @@map("nat_'), key,
        F.lit('")\n}\n\nmodel Side'), key, F.lit(" {\n  key BigInt @id\n}\n"),
    )
    files = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.collect_list(model), "\n").alias("t"))
    return files.select("region", F.explode(O.prisma_columns(F.col("t"))).alias("c")).select("region", "c.*")


@query("""SELECT n_nationkey AS file, CASE WHEN n_nationkey % 2 = 0 THEN 't' || n_nationkey ELSE 'Nation' || n_nationkey END AS "table", c AS "column", CASE c WHEN 'id' THEN 'Long' WHEN 'full_name' THEN 'String' ELSE 'Region' END AS type, c = 'region_id' AS nullable, c = 'id' AS primary_key FROM nation, (VALUES ('id'), ('full_name'), ('region_id')) v(c) WHERE n_nationkey % 3 <> 0""")
def jpa_entities(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    source = F.concat(
        F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).otherwise(F.lit("@Entity\n")), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('@Table(schema = "s", name = "t'), key, F.lit('")\n'))).otherwise(F.lit("")), F.lit("public class Nation"), key,
        F.lit(' {\n  @Id\n  @GeneratedValue(strategy = X)\n  private Long id;\n  @Column(name = "full_name", nullable = false)\n  private String name = "";\n  @ManyToOne\n  @JoinColumn(name = "region_id")\n  protected Region region;\n  @OneToMany(mappedBy = "n")\n  private List<City> cities;\n  @Transient\n  private int seen;\n}\n'),
    )
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), source.alias("t"))
    return files.select("file", F.explode(O.jpa_columns(F.col("t"))).alias("c")).select("file", "c.*")


@query("""SELECT n_regionkey AS region, 'E' || n_nationkey AS entity, CASE WHEN n_nationkey % 2 = 0 THEN 'tbl_' || n_nationkey ELSE 'Es' || n_nationkey END AS "table" FROM nation""")
def ef_sets(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(
        F.array_join(F.collect_list(F.concat(F.lit("public DbSet<E"), key, F.lit("> Es"), key, F.lit(" { get; set; }"))), "\n").alias("sets"),
        F.array_join(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("b.Entity<E"), key, F.lit('>()\n  .HasKey(x => x.Id)\n  .ToTable("tbl_'), key, F.lit('");')))), "\n").alias("fluent"),
    )
    return rows.select("region", F.explode(O.ef_tables(F.concat_ws("\n", "sets", "fluent"))).alias("c")).select("region", "c.*")


@query("SELECT DISTINCT table_name AS \"table\", column_name AS \"column\", ordinal_position::INTEGER AS place FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')")
def catalog_columns(spark, sf_dir):
    """What a catalog lists of its tables: columns in order, read from the schemas alone."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    listed = [(n, c, k) for n in names for k, c in enumerate(table(spark, sf_dir, n).columns, 1)]
    return spark.createDataFrame(listed, "table string, column string, place int")


@query("SELECT vec_id AS id, len(embedding)::INTEGER AS size, label = 3 AS renewed FROM embeddings")
def vector_swap(spark, sf_dir):
    """A second generation takes the first one's place at once; a third that is not valid changes nothing."""
    store = V.VectorTable(spark, scratch(spark))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    store.write(rows.limit(3), 1, "old", 64)
    old = rows.withColumn("at", F.lit(0)).drop("label")
    new = rows.where("label = 3").select("id", F.transform("vector", lambda x: (x * 0).cast("float")).alias("vector"), F.lit(1).alias("at"))
    store.write(old.unionByName(new), 2, "new", 64)
    try:
        store.write(rows.select("id", F.slice("vector", 1, 8).alias("vector")), 3, "short", 64)
    except ValueError:
        pass
    return store.read().select("id", F.size("vector").alias("size"), F.forall("vector", lambda x: x == 0).alias("renewed"))
