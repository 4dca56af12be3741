"""The content guard over every string leaf of a schema."""

import pytest

from ledgerloom.operators import guards

SCHEMA = "id long, reason string, call struct<tool string, args array<struct<judge string, parts array<string>>>>, notes map<string, string>"
LONG = "secret text " * 20
GOOD = (1, LONG, ("t" * 128, [("j", ["a", None]), (None, None)]), {"reason": LONG, "k": "v"})


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_report(spark):
    bad = (2, "x" * 2001, (None, [("j" * 129, []), ("j", ["p", "p" * 129])]), {"k": LONG})
    got = {r.path: (r.n_rows, r.n_over) for r in guards.leaf_report(frame(spark, GOOD, bad, (3, None, None, None))).collect()}
    assert got == {"reason": (2, 1), "call.tool": (1, 0), "call.args[].judge": (2, 1), "call.args[].parts[]": (2, 1), "notes.*": (2, 1)}
    assert {(r.n_rows, r.n_over) for r in guards.leaf_report(frame(spark, GOOD).limit(0)).collect()} == {(0, 0)}
    assert guards.leaf_report(spark.range(3)).count() == 0


def test_passing_table(spark):
    odd = frame(spark, GOOD, GOOD, (None, None, None, None))
    assert guards.content_free(odd).collect() == odd.collect()
    assert guards.content_free(spark.range(3)).count() == 3


@pytest.mark.parametrize("row, path", [
    ((1, None, (LONG, []), {}), "call.tool"),
    ((1, None, ("t", [("j", ["p"]), ("j", ["p", LONG])]), {}), "call.args[].parts[]"),
    ((1, None, None, {"reason": "r", "k": LONG}), "notes.*"),
])
def test_failing_table_names_the_path(spark, tmp_path, row, path):
    with pytest.raises(Exception) as error:
        guards.content_free(frame(spark, GOOD, row)).write.parquet(str(tmp_path / "out"))
    assert f"content at {path}" in str(error.value) and LONG not in str(error.value)
