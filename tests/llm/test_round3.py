"""Jaccard join, fill-in-middle and periodic runs against brute force, and their edges."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import infill, jaccard, queries, runs
from tests.oracle import connect, rows

from . import brute

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
ODD = [(1, ""), (2, None), (None, ""), (3, "a b"), (4, "A  b"), (5, " \t\n "), (6, "a b c d e"), (7, "A B C D E f"), (8, LONG), (9, LONG + " end"), (None, "a b"), (None, LONG), (3, "a b"), (10, "a " * 100), (11, "x " + "a b " * 40 + "y"), (12, "é漢😀\n" * 60), (13, "p<P>q\nr"), (14, "<"), (15, "no line feed"), (16, "a b c d e"), (None, "a b c d e")]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeated rows, very long texts, and columns with names used inside."""
    clash = "key body cell node root asked shingle size part digest text_key rep_id rep_key cut n_units form output runs kept start length period low high width ids".split()
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(clash)]).repartition(3)


def test_op11(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op11_jaccard_join(spark, SF).collect()}
    assert got == brute.jaccard_components(texts)


def near_copies(r, groups=6, copies=50, words=120):
    """Groups of copies with edits from none to too many, all of which hold one passage."""
    passage = [f"common{i}" for i in range(30)]
    out = {}
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)] + passage
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6])):
                own[r.randrange(len(own))] = f"e{r.random()}"
            out[len(out)] = " ".join(own)
    for k in range(200):
        out[len(out)] = " ".join([f"d{k}w{i}" for i in range(r.randrange(60))] + passage)
    return out


@pytest.mark.parametrize("long,cell,broadcast", [(32, 1 << 20, 16 << 20), (4, 1 << 11, 16 << 20), (400, 1 << 12, 0)])
def test_jaccard_of_near_copies(spark, monkeypatch, long, cell, broadcast):
    """Long lists, split cells and joins without broadcast give what comparing all pairs does."""
    for name, value in (("LONG", long), ("CELL", cell), ("BROADCAST_BYTES", broadcast)):
        monkeypatch.setattr(jaccard, name, value)
    docs = near_copies(random.Random(long))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute.jaccard_components(docs)


def test_search_decides(spark, monkeypatch, texts):
    """Without the search no two different sets are joined."""
    monkeypatch.setattr(jaccard, "search", lambda sets, roots, asked: [])
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200))), (2, " ".join(f"w{i}" for i in range(201))), (3, " ".join(f"W{i}" for i in range(200)))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_divide_skip():
    r = random.Random(5)
    for _ in range(300):
        lists = [np.array(sorted(r.sample(range(40), r.randrange(1, 40)))) for _ in range(r.randrange(1, 12))]
        least = r.randrange(1, len(lists) + 1)
        want = sorted(d for d in range(40) if sum(d in x for x in lists) >= least)
        assert all(sorted(jaccard.divide_skip(lists, least, skip)) == want for skip in range(-1, len(lists) + 2))


def test_jaccard_of_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()), key=str)
    one = lambda ids, n, c: [(d, n, c) for d in ids]
    want = one([1], 0, 1) + one([2], 0, 2) + one([None], 0, None) + one([5], 0, 5) + one([3, 3, 4, None], 1, 3) + one([6, 16, None], 1, 6) + one([7], 2, 7) + one([8, None], 29_996, 8) + one([9], 29_997, 8)
    want += one([10], 1, 10) + one([11], 4, 11) + one([12], 1, 12) + one([13], 1, 13) + one([14], 1, 14) + one([15], 1, 15)
    assert got == sorted(want, key=str)
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0


def test_op12(spark, texts):
    got = queries.op12_fill_in_middle(spark, SF)
    want = connect(SF).execute(queries.ORACLE_SQL["op12_fill_in_middle"]).df()
    assert rows(got.toPandas()) == rows(want)
    for r in got.collect():
        n, form, p, m, output = brute.infill(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(output), sha(texts[r.doc_id]))


def test_infill_of_odd_rows(spark, odd):
    done = infill.infill(odd).withColumn("back", infill.restore(F.col("output"), F.col("form")))
    got = done.collect()
    assert len(got) == len(ODD) and infill.infill(odd.limit(0)).count() == 0
    for r in got:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == brute.infill("" if r.doc_id is None else r.doc_id, r.text) and r.back == r.text


def test_automaton_forgets():
    """The state after three bytes is the same from every state, which lets blocks start anywhere."""
    goto = infill.GOTO.reshape(7, 10)
    for a in range(9):
        for b in range(9):
            for c in range(9):
                assert len({int(goto[goto[goto[s, a], b], c]) for s in range(7)}) == 1


def test_cuts_across_blocks():
    """Random texts of characters of all lengths, line feeds and sentinels, longer and shorter than a block."""
    import pyarrow as pa

    r = random.Random(9)
    texts = ["".join(r.choice(["a", "é", "漢", "😀", "\n", "<", "P", "<S>", ">", " b"]) for _ in range(r.randrange(900))) for _ in range(200)]
    draws = np.array([[r.randrange(1 << 32), r.randrange(1 << 32)] for _ in texts])
    got = infill.cut(pa.array([t.encode() for t in texts], pa.binary()).slice(7), draws[7:])
    import re

    for k, t in enumerate(texts[7:]):
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        a, b = sorted(int(x) % (len(units) + 1) for x in draws[7 + k])
        p, m = "".join(units[:a]), "".join(units[:b])
        want = (len(units), len(t), len(re.findall("<[PSM]>", t)), len(p.encode()), len(p), len(m.encode()), len(m))
        assert tuple(int(got[x][k]) for x in ("n_units", "n_chars", "n_marks", "prefix_bytes", "prefix_chars", "middle_bytes", "middle_chars")) == want


def test_op13(spark, texts):
    for r in queries.op13_periodic_runs(spark, SF).collect():
        w = brute.plant(r.doc_id, brute.words(texts[r.doc_id]))
        own = brute.runs(w)
        best = min(own, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(own), *best, 1000 * best[1] // best[2] if own else None)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in own)) and r.collapsed_sha256 == sha(brute.collapsed(w, own))


def test_ranges_of_lags(spark, texts):
    """Lags dealt out by ranges give the same runs as texts scanned where they are read."""
    r = random.Random(2)
    own = {k: " ".join(([f"w{r.randrange(30)}" for _ in range(r.randrange(1, 9))] * r.randrange(1, 60)) + [f"x{r.randrange(9)}" for _ in range(r.randrange(40))]) for k in range(60)}
    df = spark.createDataFrame([*own.items(), (None, own[3]), (3, own[3]), (70, None)], "doc_id long, text string")
    plain = sorted((str(r) for r in runs.periodic_runs(df).collect()))
    assert plain == sorted(str(r) for r in runs.periodic_runs(df, work=64).collect())
    for x in runs.periodic_runs(df.where("doc_id < 60")).collect():
        w = brute.words(own[x.doc_id])
        assert [tuple(y) for y in x.runs] == brute.runs(w) and x.text == brute.collapsed(w, brute.runs(w))


def test_runs_of_odd_rows(spark, odd):
    got = runs.periodic_runs(odd).collect()
    assert len(got) == len(ODD) and runs.periodic_runs(odd.limit(0)).count() == 0
    by = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by[10].runs] == [(0, 100, 1)] and by[10].text == "a"
    assert [tuple(x) for x in by[11].runs] == [(1, 80, 2)] and by[11].text == "x a b y"
    assert by[8].n_words == 30_000 and not by[8].runs and by[2].n_words == 0 and by[2].text == ""
