"""Edge cases on small literals: nulls, ties, empty input, zero denominators, escapes."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import udfs
from ledgerloom.operators import graph, ledger, metrics, relational, retrieval
from ledgerloom.sources.sql import read_only
from ledgerloom.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def doubles(*xs):
    return F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")


def test_forecast_of_short_series(spark):
    assert one(spark, ledger.ols_at(doubles(), F.lit(0.0))) == 0
    assert one(spark, ledger.ols_at(doubles(5), F.lit(1.0))) == 5
    assert one(spark, ledger.ols_at(doubles(1, 2, 3), F.lit(3.0))) == pytest.approx(4)
    assert one(spark, ledger.ewma(doubles())) == 0
    assert one(spark, ledger.ewma(doubles(10, 20), 0.5)) == 15
    assert one(spark, ledger.backtest(doubles(*[1] * 9))) is None
    assert one(spark, ledger.backtest(doubles(*[0] * 12))) == 0
    assert one(spark, ledger.backtest(doubles(*[3] * 12))) == pytest.approx(0)


def test_fill_days_keeps_order_and_zero(spark):
    days = spark.createDataFrame([("a", datetime.date(2024, 1, 2), 7)], "k string, day date, cents long")
    got = [(str(r.day), r.cents) for r in ledger.fill_days(days, "2024-01-01", "2024-01-03", "k").orderBy("day").collect()]
    assert got == [("2024-01-01", 0), ("2024-01-02", 7), ("2024-01-03", 0)]
    assert ledger.fill_days(days.limit(0), "2024-01-01", "2024-01-03", "k").count() == 0


def test_null_aware_sum(spark):
    rows = spark.createDataFrame([("a", None), ("b", 1), ("b", None)], "k string, v long")
    assert {r.k: r.s for r in rows.groupBy("k").agg(ledger.null_aware_sum(F.col("v")).alias("s")).collect()} == {"a": None, "b": 1}
    assert rows.limit(0).agg(ledger.null_aware_sum(F.col("v")).alias("s")).first().s == 0


def test_zero_over_zero_rules(spark):
    for empty in (0.0, 1.0, None):
        assert one(spark, metrics.ratio(F.lit(0), F.lit(0), empty)) == empty


def test_snapshot_diff_with_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "z")], "k long, v string")
    got = {r.k: r.status for r in relational.snapshot_diff(a, b, "k", ["v"]).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "removed", 4: "added"}


def test_paging(spark):
    df = spark.range(5)
    assert [r.id for r in relational.page(df, 0, 2, F.col("id")).collect()] == [0, 1]
    assert [(r.id, r.total) for r in relational.page(df, 3, 2, F.col("id")).collect()] == [(4, 5)]
    assert [(r.id, r.next_cursor) for r in relational.keyset_page(df, "id", 2, 2).collect()] == [(3, None), (4, None)]
    assert [(r.id, r.next_cursor) for r in relational.keyset_page(df, "id", 0, 2).collect()] == [(1, 2), (2, 2)]


def test_budget_prefix_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 1)], "k string, at int, cost int")
    assert [r["at"] for r in relational.budget_prefix(df, "cost", 10, ["k"], F.col("at")).collect()] == [1]


@pytest.mark.parametrize(("glob", "path", "ok"), [("**/en/*", "a/b/en/x", True), ("**/en/*", "en/x", True), ("**/en/*", "en/x/y", False), ("a?c*", "abcd", True), ("a?c*", "abc/d", False), ("x+y", "x+y", True)])
def test_glob(glob, path, ok):
    assert bool(re.match(X.glob_regex(glob), path)) == ok


def test_text_functions(spark):
    assert one(spark, X.csv_cell(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, X.csv_cell(F.lit('a"b,c'))) == '"a""b,c"'
    assert one(spark, X.luhn_ok(F.lit("4111111111111111"))) is True
    assert one(spark, X.luhn_ok(F.lit("4111111111111112"))) is False
    assert one(spark, X.redact(F.lit("a@b.com and +1 (743) 555-3824 and 123-45-6789"))) == "[EMAIL] and [PHONE] and [SSN]"
    assert one(spark, X.annotate_hidden(F.lit("a​b‮c"))) == "a[ZERO-WIDTH]b[BIDI]c"
    assert one(spark, X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), 1.0)) == 1
    assert one(spark, X.html_to_markdown(F.lit('<h1>T</h1><p>a <b>b</b> <a href="u">l</a> &amp;lt;</p>'))) == "# T\na **b** [l](u) &lt;"
    assert [r.position for r in one(spark, X.chunks(F.lit("x" * 10), 4, 1))] == [0, 1, 2]


def test_udfs(spark):
    parts = one(spark, udfs.split_bytes(5)(F.lit("ab\ncdefghé\n")))
    assert "".join(parts) == "ab\ncdefghé\n" and all(len(p.encode()) <= 5 for p in parts)
    assert one(spark, udfs.fnv1a(F.lit("a"))) == "e40c292c"
    assert one(spark, udfs.rouge_l(F.lit("a b c"), F.lit("a c"))) == pytest.approx(0.8)
    assert udfs.lcs_length("abcbdab", "bdcaba") == 4
    assert one(spark, udfs.nfkc_key(F.lit("Ｆｕｌｌ-Width_x"))) == "full width x"


def test_cosine(spark):
    assert one(spark, retrieval.cosine(doubles(0, 0), doubles(1, 0))) == 0
    assert one(spark, retrieval.cosine(doubles(2, 0), doubles(1, 0))) == 1
    with pytest.raises(Exception, match="differ in size"):
        one(spark, retrieval.cosine(doubles(1), doubles(1, 0)))


def test_reach_in_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2, 1.0, "x"), (2, 1, 1.0, "x"), (2, 3, 0.5, "y"), (3, 4, 1.0, "z")], "src long, dst long, weight double, relation string")
    seeds = spark.createDataFrame([(1, 0.5)], "node long, weight double")
    got = {r.node: (r.depth, r.confidence, r.relation) for r in graph.reach(edges, seeds, 3).collect()}
    assert got == {1: (0, 0.5, None), 2: (1, 0.5, "x"), 4: (3, 0.245, "x")}


def test_read_only(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert read_only(spark, "SELECT * FROM five", 3).count() == 4
    for sql in ("DROP TABLE five", "CREATE TABLE x AS SELECT 1", "INSERT INTO five VALUES (1)"):
        with pytest.raises(ValueError):
            read_only(spark, sql, 3)


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    path = str(tmp_path / "events")
    batch.unionByName(batch.limit(20)).orderBy("ts").coalesce(1).write.parquet(path)
    clean = str(tmp_path / "clean")
    batch.orderBy("ts").coalesce(1).write.parquet(clean)
    stream = jobs.read_events(spark, path)
    assert _run(jobs.deliveries(stream), "t_deliveries").count() == batch.select("event_id").distinct().count()
    counted = _run(jobs.hourly_counters(jobs.read_events(spark, clean)), "t_hours", "complete")
    assert counted.agg(F.sum("hits")).first()[0] == batch.count()
    fired = {r.event_id for r in _run(jobs.cooldown_alerts(jobs.read_events(spark, clean)), "t_alerts").collect()}
    from ledgerloom.plans.stateful import cooldown_alerts

    assert fired == {r.event_id for r in cooldown_alerts(spark, "/root/testdata/sf0.001").collect()}
    out = str(tmp_path / "days")
    q = jobs.daily_rollup(jobs.read_events(spark, clean)).writeStream.foreachBatch(jobs.upsert_days(out)).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.read.parquet(out).agg(F.sum("cents")).first()[0] == batch.agg(F.sum(F.round(F.col("value") * 100).cast("long"))).first()[0]


def test_call_graph_against_a_walk(spark):
    """Budgets, depths, a start with very many edges, cycles, null keys and repeated edges."""
    import random

    from ledgerloom.operators import graph as G

    r = random.Random(6)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(120)] + [(1, k) for k in range(100, 300)] + [(None, 1), (2, None), (3, 3)]
    pairs += pairs[:20]
    out = {}
    for a, b in pairs:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    roots = spark.createDataFrame([(k,) for k in [*range(40), 5, 999, None]], "root long")
    for depth, most in ((1, 5), (3, 12), (5, 1000), (2, 1), (0, 3)):
        want = set()
        for root in [*range(40), 999]:
            seen = {root: 0}
            for level in range(1, depth + 1):
                if len(seen) >= most:
                    break
                new = sorted({b for a, d in seen.items() if d == level - 1 for b in out.get(a, ())} - set(seen))
                seen |= {b: level for b in new[: most - len(seen)]}
            want |= {(root, b, d, len(seen) >= most) for b, d in seen.items()}
        assert {tuple(x) for x in G.call_graph(edges, roots, depth, most).select("root", "node", "depth", "truncated").collect()} == want


def test_call_graph_keeps_no_more_of_a_start_than_the_budget(spark, monkeypatch):
    from ledgerloom.operators import graph as G

    tables, plain = [], G.written
    monkeypatch.setattr(G, "written", lambda df: tables.append((df.columns, (done := plain(df)).count())) or done)
    edges = spark.createDataFrame([(0, k) for k in range(1, 30)] + [(1, k) for k in range(30)] * 2 + [(2, k) for k in range(40, 50)], "src long, dst long")
    got = sorted(map(tuple, G.call_graph(edges, spark.createDataFrame([(0,), (1,)], "root long"), 3, 5).collect()))
    assert got == [(0, 0, 0, True), *((0, k, 1, True) for k in (1, 2, 3, 4)), (1, 0, 1, True), (1, 1, 0, True), (1, 2, 1, True), (1, 3, 1, True), (1, 4, 1, True)]
    assert tables[0] == (["src", "dst"], 15)
