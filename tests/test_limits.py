"""Limits with feedback: the rules, their batches against plain runs, and their streams against their batches."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import limits as plans
from ledgerloom.streaming import limits

SF = "/root/testdata/sf0.001"


def test_denied_hits_are_not_recorded():
    w = limits.SlidingWindow(2, 100)
    assert [w.hit(t) for t in (0, 10, 20, 99, 100, 105, 110)] == [(True, 1, 0), (True, 0, 0), (False, 0, 80), (False, 0, 1), (True, 0, 0), (False, 0, 5), (True, 0, 0)]
    assert len(w.times) == 2


def test_reservations():
    r = limits.Reservations(100, 50)
    step = lambda now, op, call, tokens=0, month="m": (r.step(now, month, op, call, tokens), r.used, r.calls)
    assert step(0, "reserve", 1, 60) == ("reserved", 60, 1)
    assert step(1, "reserve", 1, 5) == ("repeated", 60, 1)
    assert step(2, "reserve", 2, 41) == ("exceeded", 60, 1)
    assert step(3, "settle", 2, 1) == ("unknown", 60, 1)  # denied
    assert step(4, "settle", 1, 90) == ("settled", 90, 1)  # more than was reserved
    assert step(5, "settle", 1, 90) == ("unknown", 90, 1)  # again
    assert step(6, "reserve", 3, 10) == ("reserved", 100, 2)
    assert step(7, "refund", 3) == ("refunded", 90, 1)
    assert step(8, "reserve", 4, 10) == ("reserved", 100, 2)
    assert step(58, "settle", 4, 10) == ("unknown", 90, 1)  # expired
    assert step(59, "reserve", 5, -3) == ("reserved", 90, 2)
    assert step(60, "settle", 5, 0, "n") == ("unknown", 0, 0)  # of last month
    assert limits.Reservations(0, 1).step(0, "m", "reserve", 1, 0) == "no budget"


def test_groups_over_batches(spark):
    """Groups that go on over Arrow batches, a null user, ties and an empty table."""
    r = random.Random(1)
    data = [(r.choice([None, 1, 2, 3]), r.randrange(300), i) for i in range(400)]
    df = spark.createDataFrame(data, "user_id long, at long, event_id long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {x.event_id: tuple(x)[1:] for x in limits.admitted(df, 3, 20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for user in (None, 1, 2, 3):
        w = limits.SlidingWindow(3, 20)
        want |= {i: w.hit(t) for t, i in sorted((t, i) for u, t, i in data if u == user)}
    assert got == want
    assert limits.admitted(df.limit(0), 3, 20).count() == 0


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def streamed(spark, rows, job, tmp_path, parts=4):
    """The rows of ``job`` over the table as a stream of ``parts`` files in the order of time."""
    n = rows.count()
    ordered = rows.orderBy("at").collect()
    for k in range(parts):
        spark.createDataFrame(ordered[n * k // parts : n * (k + 1) // parts], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = job(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert run.exception() is None and len({p["batchId"] for p in run.recentProgress}) >= parts
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_stream_of_hits(spark, rocksdb, tmp_path):
    rows = plans.hits(spark, SF).where("user_id < 8")
    got = streamed(spark, rows, lambda s: limits.stream_admitted(s, 1, plans.DAY), tmp_path)
    want = sorted(map(tuple, limits.admitted(rows, 1, plans.DAY).collect()))
    assert got == want and len({x[1] for x in want}) == 2


def test_stream_of_reservations(spark, rocksdb, tmp_path):
    rows = plans.operations(spark, SF).where("user_id < 8")
    got = streamed(spark, rows, lambda s: limits.stream_reservations(s, 20_000, plans.KEEP), tmp_path)
    want = sorted(map(tuple, limits.reservations(rows, 20_000, plans.KEEP).collect()))
    assert got == want and {x[2] for x in want} == {"reserved", "exceeded", "settled", "refunded", "unknown"}
