"""Threshold joins, greedy matching, numbering, replays and text sources on small literals and against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import graph, matching, relational, retrieval
from ledgerloom.plans import registry
from ledgerloom.sources import text as S
from ledgerloom.sources.sql import read_only

from .oracle import rows as canonical

registry.load_all()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_threshold_pairs_against_all_pairs(spark):
    r = random.Random(1)
    draw = lambda n: [(r.choice("pq"), i, [r.choice("abcdefgh") for _ in range(r.randint(0, 6))]) for i in range(n)]
    left, right = draw(60), draw(60)
    for least in (0.4, 0.75, 1.0):
        want = {(b, i, j) for b, i, x in left for c, j, y in right if b == c and set(x) & set(y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
        a, b = (spark.createDataFrame(rows, f"b string, {key} long, tokens array<string>") for rows, key in ((left, "left"), (right, "right")))
        got = {(x.b, x["left"], x["right"]) for x in matching.threshold_pairs(a, b, ["b"], least).collect()}
        assert got == want
    kept = matching.fuzzy_anti_join(a, b, ["b"], 0.75)
    assert kept.count() == 60 - len({(x, i) for x, i, _ in {(b, i, j) for b, i, x in left for c, j, y in right if b == c and set(x) & set(y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.75}})
    assert matching.threshold_pairs(a.limit(0), b, ["b"], 0.5).count() == 0


def test_pairs_of_copies_are_made_by_many_tasks(spark, monkeypatch):
    """Many copies of few sets, one key many times, with small lists: each pair of copies as often as it occurs, rounded as its sets, by tasks that go by the rows."""
    for name, size in (("CHUNK", 5), ("TASK_ROWS", 500)):
        monkeypatch.setattr(matching, name, size, raising=False)
    r = random.Random(6)
    sets = [["a", "b", "c"], ["a", "b", "d"], ["b", "c", "a", "a"], ["x", "y"], ["a", "b", "c", "d", "e", "f", "g"]]
    draw = lambda odd: [(r.choice("pq"), 2 * i + odd, r.choice(sets)) for i in range(90)] + [("p", 500 + odd, sets[0])] * 12 + [(None, 600 + odd, sets[0]), ("p", 700 + odd, []), ("q", 800 + odd, None)]
    left, right = draw(1), draw(0)
    want = [(b, i, j, len(set(s) & set(t)) / len(set(s) | set(t))) for b, i, s in left for c, j, t in right if b and b == c and s and t]
    want = sorted(p for p in want if p[3] >= 0.4)
    a, b = (spark.createDataFrame(rows, f"b string, {key} long, tokens array<string>") for rows, key in ((left, "left"), (right, "right")))
    got = matching.threshold_pairs(a, b, ["b"], 0.4)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 2000
    assert got.rdd.getNumPartitions() == -(-len(want) // 500)
    assert sorted(map(tuple, matching.threshold_pairs(a, b, ["b"], 0.4, 2).collect())) == sorted((*p[:3], round(p[3], 2)) for p in want)


def test_greedy_assignment(spark):
    r = random.Random(2)
    pairs = [(g, a, b, r.choice([0.5, 0.75, 1.0])) for g in ("x", "y", None) for a in range(12) for b in range(12) if r.random() < 0.7]
    want = set()
    for g in ("x", "y", None):
        left, right = set(), set()
        for p in sorted((p for p in pairs if p[0] == g), key=lambda p: (-p[3], p[1], p[2])):
            if p[1] not in left and p[2] not in right:
                left.add(p[1])
                right.add(p[2])
                want.add(p)
    df = spark.createDataFrame(pairs, "g string, left long, right long, score double")
    got = [tuple(x) for x in matching.greedy_assignment(df, "g").collect()]
    assert set(got) == want and len(got) == len(want)
    assert matching.greedy_assignment(df.limit(0), "g").count() == 0


def test_numbered_equals_a_window(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id").unionByName(spark.createDataFrame([(None, 1, -1)], "g boolean, v long, id long"))
    got = {r.id: r.k for r in relational.numbered(df, "g", "k", F.col("v"), F.col("id")).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.v, r.id))
    counts, want = {}, {}
    for r in rows:
        counts[r.g] = counts.get(r.g, 0) + 1
        want[r.id] = counts[r.g]
    assert got == want


@pytest.mark.parametrize("cell", [7, 1024])
def test_cache_replay_against_a_plain_replay(spark, cell):
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8))
    rows = [(i % 2, i, [float(x) for x in (base[r.integers(12)] + r.choice([0, 0.15, 0.4]) * r.normal(size=8))]) for i in range(150)]
    rows += [(0, 200 + i, rows[4][2]) for i in range(5)] + [(1, 300, [0.0] * 8)]
    want, stored = {}, {0: [], 1: []}
    for s, i, v in sorted(rows, key=lambda x: x[1]):
        v = np.array(v) / (np.linalg.norm(v) or 1)
        want[i] = any(float(u @ v) >= 0.92 for u in stored[s])
        if not want[i]:
            stored[s].append(v)
    df = spark.createDataFrame(rows, "scope int, vec_id long, embedding array<double>")
    assert {x.vec_id: x.hit for x in retrieval.cache_replay(df, 0.92, cell).collect()} == want


def test_twins_of_equal_and_near_sets(spark):
    sets = {1: "abcdef", 2: "abcdef", 3: "abcdeg", 4: "xyz", 5: "ab", 9: "abcdef"}
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s + s[0]], "key long, item string")
    got = {(r.kind, r.a, r.b, r.similarity) for r in graph.twins(df, 0.7, 3).collect()}
    assert got == {("member", 1, 1, 1.0), ("member", 2, 1, 1.0), ("member", 9, 1, 1.0), ("member", 3, 3, 1.0), ("member", 4, 4, 1.0), ("pair", 1, 3, 0.714286)}


def test_twins_against_all_pairs(spark, monkeypatch):
    """Random sets, larger ones than there are bits too; of 200 sets that share one rare item alone no pair is verified."""
    r = random.Random(14)
    sets = {k: {r.randrange(12) for _ in range(r.randrange(1, 9))} for k in range(80)} | {k: {*range(1000, 1100)} - {r.randrange(1000, 1100) for _ in range(30)} for k in range(100, 110)}
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in [*s, min(s)]], "key long, item long")
    got = {(x.kind, x.a, x.b, x.similarity) for x in graph.twins(df, 0.6, 2).collect()}
    sets = {k: s for k, s in sets.items() if len(s) > 1}
    rep = {k: min(j for j in sets if sets[j] == s) for k, s in sets.items()}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {("member", k, j, 1.0) for k, j in rep.items()} | {("pair", a, b, round(share(a, b), 6)) for a in set(rep.values()) for b in set(rep.values()) if a < b and share(a, b) >= 0.6}
    assert got - want == set() and want - got == set()
    assert len(got) > len(sets)
    apart = spark.createDataFrame([(k, x) for k in range(200) for x in (-1, *range(10 * k, 10 * k + 4))], "key long, item long")
    met = []
    monkeypatch.setattr(type(apart), "distinct", lambda self, plain=type(apart).distinct: met.append(self) or plain(self))
    assert graph.twins(apart, 0.2, 2).where("kind = 'pair'").count() == 0 and met[-1].count() < 12000  # of 19,900


def test_fitting_and_chunks(spark):
    items = F.array(*[F.lit(x) for x in ("aaaa", "bbbbbb", "cc", "d")])
    assert one(spark, matching.fitting(items, lambda x: F.length(x), 7)) == ["aaaa", "cc", "d"]
    assert one(spark, matching.fitting(items, lambda x: F.length(x), 7, 1)) == ["aaaa", "cc"]
    text = "".join(f"word{i} " for i in range(60))
    parts = F.array(*[F.lit(text[i : i + 80]) for i in range(0, len(text), 60)])
    assert one(spark, matching.join_chunks(parts)) == text
    assert one(spark, matching.join_chunks(F.array(F.lit("one"), F.lit("two")))) == "one\ntwo"
    assert one(spark, matching.join_chunks(F.array().cast("array<string>"))) == ""


def test_overlap_against_plain_search(spark):
    """Repeating texts, places that only seem to begin the overlap, characters beyond the basic plane."""
    r = random.Random(10)
    pairs = [("", ""), ("a" * 40, "a" * 30), ("abcabcab" * 9, "abcabcabX" * 9), ("abcdabcX" + "abcd" * 2, "abcd" * 2 + "z"), ("😀ab" * 9, "😀ab" * 5), ("xyz", "xyzxyz")]
    for _ in range(300):
        a, b = ("".join(r.choice(["ab", "a", "😀"]) for _ in range(r.randrange(30))) for _ in range(2))
        pairs.append((a + b[: r.randrange(20)] * r.randrange(1, 3), b))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, a string, b string")
    got = {x.k: x.n for x in df.select("k", matching.overlap(F.col("a"), F.col("b"), 4).alias("n")).collect()}
    want = {k: next((n for n in range(min(len(a), len(b)), 3, -1) if a.endswith(b[:n])), 0) for k, (a, b) in enumerate(pairs)}
    assert got == want and len(set(want.values())) > 10


def test_chunks_are_cut_once_and_joined_in_their_row(spark, tmp_path):
    texts = ["", "x", "😀y" * 50, "abcdefgh\n" * 40, None, "z" * 256, "z" * 257]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for size, shared in ((256, 64), (7, 3), (10, 0), (4, 2)):
        got = {x.k: x.c and [(c.position, c.text) for c in x.c] for x in df.select("k", X.chunks(F.col("t"), size, shared).alias("c")).collect()}
        last = lambda t: max(0, -((shared - len(t)) // (size - shared)) - 1)
        assert got == {k: [(0, None)] if t is None else [(i, t[i * (size - shared) :][:size]) for i in range(last(t) + 1)] for k, t in enumerate(texts)}
    df.withColumnsRenamed({"k": "doc_id", "t": "text"}).write.parquet(str(tmp_path / "documents.parquet"))
    query = registry.QUERIES["chunk_overlap_join"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert canonical(query.toPandas()) == canonical(con.execute(registry.ORACLE_SQL["chunk_overlap_join"]).df())
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_diffs_logs_and_ddl(spark):
    diff = "--- a/x\r\n+++ b/y.ts\r\n@@ -1 +3,0 @@\r\n+++ b\r\n@@ -1,2 +9 @@ f\r\n"
    assert [tuple(h) for h in one(spark, S.diff_hunks(F.lit(diff)))] == [("y.ts", 3, 3), ("y.ts", 9, 9)]
    assert one(spark, S.diff_hunks(F.lit("@@ -1 +3 @@"))) == [] == one(spark, S.diff_hunks(F.lit("")))
    sha = "a" * 40
    log = f"{sha}\x1f\x1f12\x1fann\x1fs\x1fbody\x1fmore\n\0\n{sha}\x1f{sha}\x1fx\x1fann\x1fs\x1f\0short\0"
    assert [tuple(c) for c in one(spark, S.history_records(F.lit(log)))] == [(sha, 0, 12, "ann", "s", "body\x1fmore")]
    ddl = 'create table a."B" (x INT, y numeric(3, 1) not null, primary key (x, "y"), index i (x)); CREATE TABLE c (z text'
    assert [tuple(c) for c in one(spark, S.ddl_columns(F.lit(ddl)))] == [("a", "b", "x", "int", True, True), ("a", "b", "y", "numeric(3,1)", False, True)]


@pytest.mark.parametrize("path,rules,want", [
    ("a/b/c.log", ["*.log"], True), ("a/b/c.log", ["*.log", "!a/b/*.log"], False), ("build", ["build/"], False), ("x/build/y", ["build/"], True), ("x/src/y", ["/src"], False), ("src/y", ["/src"], True),
    ("docs/a.md", ["docs/**/*.md"], True), ("docs/x/y/a.md", ["docs/**/*.md"], True), ("a.b", ["a?b", "# a.b", ""], True), ("node_modules/x", ["node_modules/**"], True),
])
def test_ignore_rules(spark, path, rules, want):
    assert one(spark, S.ignored(F.lit(path), rules)) is want


def test_text_helpers(spark):
    assert set(one(spark, X.code_terms(F.lit("ScheduleNextCheck HTTPServerError policies class bus the")))) == {"schedulenextcheck", "schedule", "next", "check", "httpservererror", "http", "server", "error", "policy", "class", "bus"}
    assert one(spark, X.normalise_criterion(F.lit("Shows A, b! (api.go:43 and 37) in cli/x.go:12-17."))) == "shows a b in"
    assert one(spark, X.branch_issues(F.lit("fix/issue-12-gh-7_v2/12"))) == [7, 12]
    assert one(spark, X.redact(F.lit("a@b.co x.y@z.org 4111 1111 1111 1111 1234567890123 123-45-6789"))) == "[EMAIL] [EMAIL] [CARD] 1234567890123 [SSN]"
    rows = spark.createDataFrame([({"k": ["a@b.co", None]}, None)], "m map<string,array<string>>, s struct<x:string>")
    kept = rows.select(*[X.redact_value(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields]).first()
    assert kept.m == {"k": ["[EMAIL]", None]} and kept.s is None


@pytest.mark.parametrize("sql", ["SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/etc`", "SELECT 1; DROP TABLE x", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SET a=b", "FROM x INSERT OVERWRITE y SELECT 1"])
def test_ad_hoc_sql_refuses(spark, sql):
    with pytest.raises(ValueError):
        read_only(spark, sql, 3)


def test_ad_hoc_sql_redacts(spark):
    assert read_only(spark, "SELECT 'x; a@b.co' AS t -- note", 3).first().t == "x; [EMAIL]"


def test_vector_top_k_against_all_pairs(spark, monkeypatch):
    """Copies, near ties, no length, NaN, nulls and other sizes, with several blocks of queries and parts; pairs are never rows."""
    monkeypatch.setattr(retrieval, "QUERY_CELL", 40)
    monkeypatch.setattr(retrieval, "ITEM_CELL", 150)
    r = np.random.default_rng(5)
    base = r.normal(size=(30, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[r.integers(30)] + (r.normal(size=8) * r.choice([0, 1e-7, 1e-3, 1])).astype(np.float32)]) for i in range(900)]
    rows += [(900, [0.0] * 8), (901, None), (902, [1.0, None] + [0.5] * 6), (903, [float("nan")] + [1.0] * 7), (904, [1.0] * 5), (905, [1e-30] * 8), (906, [1e30] * 8)]
    df = spark.createDataFrame(rows, "item long, vector array<float>")
    queries = df.where("item % 9 = 0 OR item >= 900").withColumnRenamed("item", "query")
    score = F.round(F.when(F.col("n") == 0, 0.0).otherwise(retrieval.dot(F.col("v"), F.col("vector")) / F.nullif(F.col("n"), F.lit(0.0))), 6)
    length = lambda c: F.sqrt(retrieval.dot(F.col(c), F.col(c)))
    pairs = queries.withColumnRenamed("vector", "v").join(df, F.col("query") != F.col("item")).withColumn("n", length("v") * length("vector"))
    for k in (3, 12):
        want = relational.top_per_group(pairs.select("query", "item", F.when(F.size("v") == F.size("vector"), score).alias("score")), ["query"], k, F.desc("score"), F.col("item"))
        found = retrieval.vector_top_k(queries, df, k)
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
        assert sorted(map(repr, found.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_similarity_labels_takes_every_vector_as_a_query(spark, tmp_path, monkeypatch):
    """Ids of which few can be divided by 20, copies, ties, no length and a null; several blocks, parts and slices."""
    for name, size in (("QUERY_CELL", 40), ("ITEM_CELL", 60), ("SLICE", 16)):
        monkeypatch.setattr(retrieval, name, size, raising=False)
    r = np.random.default_rng(8)
    base = r.normal(size=(12, 8))
    rows = [(3 * i + 1, [float(x) for x in base[r.integers(12)] + r.normal(size=8) * r.choice([0, 0.2, 0.4, 3])], 1) for i in range(120)]
    rows += [(1000, [0.0] * 8, 1), (1001, None, 2), (-7, rows[0][1], 3)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path)
    got = registry.QUERIES["similarity_labels"](spark, str(tmp_path)).toPandas()
    assert set(got["query"]) == {i for i, _, _ in rows} and (got.groupby("query").size() == 5).all()
    assert {"duplicate", "overlap", "related"} <= set(got["label"].dropna()) and got["label"].isna().any()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert canonical(got) == canonical(con.execute(registry.ORACLE_SQL["similarity_labels"]).df())
    assert "% 20" not in registry.ORACLE_SQL["similarity_labels"] and "vec_id % 20 = 0" in registry.ORACLE_SQL["vector_top_k"]


def test_weighted_hybrid_rounds_halves_as_its_sql(spark, tmp_path):
    x = spark.createDataFrame([(20, [1.0, 0.0], 1), (21, [0.40743, (1 - 0.40743**2) ** 0.5], 2), (22, [0.1, 0.2], 1)], "vec_id long, embedding array<double>, label int")
    x.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    got = registry.QUERIES["weighted_hybrid"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert canonical(got) == canonical(con.execute(registry.ORACLE_SQL["weighted_hybrid"]).df())
    assert 0.387059 in set(got["score"])


def test_classes_take_what_members_take(spark):
    """Copies of a few sets: pairs of classes alone are formed, and the greedy choice is the one among all pairs of members."""
    r = random.Random(4)
    sets = [[r.choice("abcdef") for _ in range(3)] for _ in range(9)]
    draw = lambda odd: [(r.choice("pq"), 2 * i + odd, r.choice(sets)) for i in range(80)]
    left, right = draw(1), draw(0)
    a, b = (spark.createDataFrame(rows, f"b string, {key} long, tokens array<string>") for rows, key in ((left, "left"), (right, "right")))
    x, y = (matching.token_classes(df, ["b"], key) for df, key in ((a, "left"), (b, "right")))
    pairs = graph.written(matching.class_pairs(matching.classes(x, ["b"], "left"), matching.classes(y, ["b"], "right"), ["b"], 0.4))
    every = [(k, i, j, len(set(s) & set(t)) / len(set(s) | set(t))) for k, i, s in left for l, j, t in right if k == l]
    every = sorted((p for p in every if p[3] >= 0.4), key=lambda p: (-p[3], p[1], p[2]))
    assert pairs.count() <= 2 * 81 < len(every)
    used, want = set(), set()
    for k, i, j, _ in every:
        if i not in used and j not in used:
            used |= {i, j}
            want.add((k, i, j))
    got = [tuple(p) for p in matching.greedy_classes(pairs, x, y, ["b"]).collect()]
    assert set(got) == want and len(got) == len(want)
    assert matching.greedy_classes(pairs.limit(0), x, y, ["b"]).count() == 0


@pytest.mark.parametrize("name", ["byte_budget_split", "nfkc_keys"])
def test_whole_texts_go_to_python_in_small_batches(spark, name):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(rows, "10000")
    spark.conf.unset(size)
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(rows)) == 2000 and int(spark.conf.get(size)) == 4 << 20
