"""JSON of any depth against a plain walk."""

import json
import random

from pyspark.sql import functions as F

from ledgerloom.operators import nested as N


def walk(value, path="$"):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if k.isidentifier() else f'{path}."{k}"')
    elif isinstance(value, list):
        yield f"{path}[#]", str(len(value))
        for k, v in enumerate(value):
            yield from walk(v, f"{path}[{k}]")
    else:
        yield path, json.dumps(value)


def test_leaves_and_diff(spark):
    r = random.Random(8)

    def some(depth):
        kind = r.randrange(7) if depth else r.randrange(4)
        if kind < 4:
            return r.choice([None, True, 7, "q", -3])
        return [some(depth - 1) for _ in range(r.randrange(3))] if kind == 4 else {r.choice(["a", "b", "c d", "x.y"]): some(depth - 1) for _ in range(r.randrange(3))}

    docs = {k: some(7) for k in range(150)} | {200: {"a": {"b": [[{"c": [1, [2, {"d": {}}]]}]]}}}
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [(300, '{"a":'), (301, None), (302, "")]
    df = spark.createDataFrame(rows, "id long, j string")
    got = sorted(tuple(x) for x in N.leaves(df, "id", "j").select("id", "path", "leaf").collect())
    assert got == sorted((k, p, leaf) for k, v in docs.items() for p, leaf in walk(v))
    other = {k: docs[k] if k % 2 else docs[(k * 7) % 150] for k in range(150)}
    after = spark.createDataFrame([(k, json.dumps(v)) for k, v in other.items()], "id long, j string")
    diff = {tuple(x) for x in N.path_diff(N.leaves(df.where("id < 150"), "id", "j"), N.leaves(after, "id", "j"), "id").select("id", "path", "before", "after").collect()}
    want = set()
    for k in range(150):
        a, b = dict(walk(docs[k])), dict(walk(other[k]))
        want |= {(k, p, a.get(p), b.get(p)) for p in a.keys() | b.keys() if a.get(p) != b.get(p)}
    assert diff == want and want
    both = df.where("id < 150").join(after.withColumnRenamed("j", "b"), "id")
    assert {tuple(x) for x in N.document_diff(both, "id", "j", "b").collect()} == want
    assert N.leaves(df.limit(0), "id", "j").count() == 0


def test_canonical(spark):
    df = spark.createDataFrame([('{"b": {"y": [2, 1], "x": 1}, "a": null}',), ('{"a":null,"b":{"x":1,"y":[2,1]}}',), ("{",), (None,)], "j string")
    assert [r[0] for r in df.select(N.canonical(F.col("j"))).collect()] == ['{"a":null,"b":{"x":1,"y":[2,1]}}'] * 2 + [None] * 2


def test_document_diff_equals_the_diff_of_leaves(spark):
    """Deeper than one round of levels, equal at the root, leaf against branch, malformed and null sides, and keys that come twice."""
    deep = lambda leaf: '{"a":' * 15 + f'[1,{leaf}]' + "}" * 15
    pairs = [(deep(2), deep(3)), (deep("{}"), deep("[]")), ('{"x":1,"y":2}', '{"y": 2, "x": 1}'), ('{"x":{"y":null}}', '{"x":7}'), ('{"x":{}}', '{"x":[[]]}'), ("[", '{"x":1}'), (None, "3"), ("4", None), ('"q"', '"q"'), (None, None), ('{"a b":1.50,"a":"é\\n"}', '{"a b":1.5,"a":null}')]
    rows = [(k, *p) for k, p in enumerate(pairs)] + [(None, "[1]", "[2]"), (None, "[3]", "[1,2]"), (50, "[1,5]", "[1]"), (50, "[1]", "[1,7]")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    want = sorted(map(str, N.path_diff(N.leaves(df, "id", "a"), N.leaves(df, "id", "b"), "id").collect()))
    got = N.document_diff(df, "id", "a", "b")
    assert got.columns == ["id", "path", "before", "after"] and sorted(map(str, got.collect())) == want and len(want) > 15
    once = N.document_diff(df.where("id < 50"), "id", "a", "b")
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert N.document_diff(df.limit(0), "id", "a", "b").count() == 0
