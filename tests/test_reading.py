"""Reading scores, summaries by levels and the time limit of ad-hoc SQL on hard cases."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import metrics, reading as R
from ledgerloom.operators import summaries as M
from ledgerloom.sources.sql import read_within

DOCS, LABELS, FOUND = "doc_id long, text string, section string", "doc_id long, label string, section string, place long, quote string", "doc_id long, label string, quote string, section int"
AMBIGUITIES, QUESTIONS = "doc_id long, ambiguity string, place long", "doc_id long, ambiguity string, worth_asking boolean"


def scores(spark, docs, labels=(), found=(), ambiguities=(), questions=()):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((docs, DOCS), (labels, LABELS), (found, FOUND), (ambiguities, AMBIGUITIES), (questions, QUESTIONS))]
    return {r.doc_id: r for r in R.reading_scores(*frames).collect()}


def test_reading_scores(spark):
    text = "The user\n must log in. An admin may remove any user at all."
    got = scores(
        spark, [(1, text, "x"), (2, None, "x"), (3, "", "x")],
        [(1, "b", "S2", 5, ""), (1, "a", "S1", 2, ""), (1, "c", "S2", 7, ""), (1, "d", "S0", 9, ""), (1, "a", "S9", 3, ""), (1, None, "S5", 1, ""), (2, "a", "S1", 0, "")],
        [(1, "a", " The user must log in.", 0), (1, "a", "admin may remove any", 0), (1, "b", "the user must log in.", 0), (1, "z", "log in", 0), (1, None, "  ", 0), (2, "a", "The user must log in.", 0), (9, "a", "q", 0)],
        [(1, "A", 3), (1, "B", 1), (1, "B", 1), (1, None, 0)], [(1, "A", True), (1, "A", False), (1, None, None), (1, "Z", True), (3, None, True)],
    )
    assert sorted(got) == [1, 2, 3]
    one, two, three = got[1], got[2], got[3]
    assert (one.labelled, one.extracted, one.matched, one.repeats, one.invalid, one.labelled_sections, one.covered_sections) == (4, 5, 2, 1, 1, 3, 2)
    assert one.missed_sections == ["S0"] and one.missed_labels == ["c", "d"] and one.missed_ambiguities == ["B"]
    assert (one.questions, one.worth_asking, one.ambiguities, one.ambiguities_raised, one.quoted, one.quotes_verified) == (4, 2, 2, 1, 4, 2)
    assert (one.recall, one.precision, one.section_coverage, one.question_precision, one.ambiguity_recall, one.quote_accuracy) == pytest.approx((0.5, 0.4, 2 / 3, 0.5, 0.5, 0.5))
    assert (two.recall, two.precision, two.quote_accuracy, two.question_precision, two.missed_sections) == (1.0, 1.0, 0.0, None, [])
    assert (three.labelled, three.recall, three.precision, three.questions, three.question_precision) == (0, None, None, 1, 1.0)


def test_reading_scores_of_nothing(spark):
    assert scores(spark, []) == {}
    alone = scores(spark, [(4, "t", "x")])[4]
    assert (alone.extracted, alone.matched, alone.recall, alone.missed_labels) == (0, 0, None, [])


def plain_summary(text, most):
    if len(text) <= most:
        return text
    parts = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    if len(parts) <= 2:
        return text[:most]
    kept = {m[0] for p in M.ENTITIES for m in re.finditer(p, text, re.A)}
    score = lambda i, s: 10 * (i == 0) + 8 * (i == len(parts) - 1) + 3 * any(e in s for e in kept) + 2 * (len(s) < 100 and bool(re.search("[0-9]", s)))
    taken, used = [], 0
    for i, s in sorted(enumerate(parts), key=lambda x: (-score(*x), x[0])):
        if used + len(s) <= most:
            taken.append((i, s))
            used += len(s) + 1
    return " ".join(s for _, s in sorted(taken))


def plain_levels(chunks, budget, max_depth):
    tokens = lambda t: math.ceil(len(t) / 4)
    merged = "\n\n".join(chunks)
    if tokens(merged) <= 2 * budget:
        return 0, merged
    level = [plain_summary(c, 4 * max(50, math.ceil(tokens(c) / 4))) for c in chunks]
    for depth in range(1, max_depth + 1):
        merged = "\n\n".join(level)
        if tokens(merged) <= budget or depth == max_depth:
            return depth, merged if tokens(merged) <= budget else plain_summary(merged, 4 * budget)
        per = max(2, math.ceil(len(level) / 4))
        groups = ["\n\n".join(level[k : k + per]) for k in range(0, len(level), per)]
        level = [plain_summary(g, 4 * math.ceil(budget / len(groups))) for g in groups]


@pytest.mark.parametrize("budget,max_depth", [(40, 3), (90, 3), (60, 2), (60, 1)])
def test_summaries_against_plain_levels(spark, budget, max_depth):
    r = random.Random(budget + max_depth)
    fact = lambda: r.choice(["2024-01-02", "15ms", "a@b.co", "/a/b.c", '"so it is"', "https://x.org/y", "20%", "x1", "no", "yes"])
    sentence = lambda: " ".join(r.choice(["aa", "bbb", "cccc", fact()]) for _ in range(r.randrange(1, 30))) + r.choice(".!?")
    texts = {d: [r.choice([" ", "\n", "  "]).join(sentence() for _ in range(r.randrange(0, 12))) for _ in range(r.choice([1, 2, 5, 9, 30]))] for d in range(40)}
    rows = [(d, 10 * i - 7, t or None, "x") for d, chunks in texts.items() for i, t in enumerate(chunks)]
    got = {x.doc_id: x for x in M.hierarchical_summaries(spark.createDataFrame(rows, "doc_id long, i long, text string, n string"), budget, max_depth).collect()}
    assert {d: (x.depth, x.content) for d, x in got.items()} == {d: plain_levels(chunks, budget, max_depth) for d, chunks in texts.items()}
    assert all(x.chunks == len(texts[d]) and x.output_tokens == math.ceil(len(x.content) / 4) for d, x in got.items())
    assert len({x.depth for x in got.values()}) >= min(3, max_depth + 1)


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, i long, text string")
    assert M.hierarchical_summaries(empty).count() == 0
    assert M.hierarchical_summaries(spark.createDataFrame([(1, 0, None)], empty.schema)).first()[:] == (1, 1, 0, 0, 0, "")


def test_read_within(spark):
    rows, truncated = read_within(spark, "SELECT id FROM range(5) ORDER BY id", 3, 60)
    assert [x.id for x in rows] == [0, 1, 2] and truncated
    assert read_within(spark, "SELECT id FROM range(3)", 3, 60)[1] is False
    with pytest.raises(ValueError):
        read_within(spark, "DROP TABLE x", 3, 60)


def test_slow_queries_are_stopped(spark):
    start, tracker = time.monotonic(), spark.sparkContext.statusTracker()
    with pytest.raises(TimeoutError):
        read_within(spark, "SELECT sum(hash(a.id, b.id)) AS s FROM range(4000000) a JOIN range(4000000) b ON a.id % 7 < b.id", 3, 2)
    assert time.monotonic() - start < 40
    until = time.monotonic() + 10
    while time.monotonic() < until and (tracker.getActiveJobsIds() or any(tracker.getStageInfo(k).numActiveTasks for k in tracker.getActiveStageIds())):
        time.sleep(0.2)
    assert not tracker.getActiveJobsIds() and not tracker.getActiveStageIds()
    assert read_within(spark, "SELECT 1 AS x", 3, 60) == ([(1,)], False)


def test_label_metrics_equal_metrics_of_all_pairs(spark):
    r = random.Random(5)
    items = [(k, r.choice(["a", "b", "c", None])) for k in range(60)] + [(60, "alone")]
    ranked = [(q, item, rank) for q in [*range(0, 60, 5), 60] for rank, item in enumerate(r.sample([k for k in range(61) if k != q], 15), 1)]
    labels = spark.createDataFrame(items, "item long, label string")
    queries = labels.where("item % 5 = 0").withColumnRenamed("item", "query")
    near = spark.createDataFrame(ranked, "query long, item long, rank int")
    pairs = queries.join(labels, "label").where("query <> item").select("query", "item")
    want = sorted(map(tuple, metrics.ranking_metrics(near, pairs, 10).collect()))
    assert sorted(map(tuple, metrics.label_metrics(near, queries, labels, 10).collect())) == want and len(want) > 5
    assert metrics.label_metrics(near.limit(0), queries, labels, 10).count() == len(want)
    assert metrics.label_metrics(near, queries.limit(0), labels.limit(0), 10).count() == 0
