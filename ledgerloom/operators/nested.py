"""Nested JSON as paths: flattened level by level, compared leaf by leaf, or in step where both sides stand in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graph import discard, written

#: So many levels are opened before what is left is looked at. It changes no result.
LEVELS = 6


def canonical(json: Column) -> Column:
    """The text of a JSON value with its keys sorted at every depth and no space; null where malformed."""
    return F.to_json(F.try_parse_json(json))


def leaves(rows: DataFrame, key: str, json: str) -> DataFrame:
    """``key, path, leaf`` of every scalar, empty object and array (its length) within the JSON texts, at any depth.

    Paths read ``$.name[0]."odd name"``; a leaf is its canonical text. Malformed and null texts have no path. Each
    level explodes what the one before left open, until nothing is: the data decide the number of levels, and a text's
    leaves are rows from then on.
    """
    open_ = written(rows.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(json).alias("value")).where("value IS NOT NULL"))
    spark, done, old = rows.sparkSession, None, []
    while True:
        kind = F.schema_of_variant("value")
        typed = open_.select("key", "path", "value", kind.startswith("ARRAY<").alias("is_array"), (kind.startswith("OBJECT<") & (kind != "OBJECT<>")).alias("is_object"))
        scalars = typed.where("NOT is_array AND NOT is_object").select("key", "path", F.to_json("value").alias("leaf"))
        inner = typed.where("is_array OR is_object").lateralJoin(spark.tvf.variant_explode_outer(F.col("value").outer()).toDF("pos", "name", "item"))
        # A sized array is told by its last place; an empty one has none.
        lengths = inner.where("is_array").groupBy("key", "path").agg(F.coalesce(F.max("pos") + 1, F.lit(0)).cast("string").alias("leaf"))
        sized = lengths.select("key", F.concat("path", F.lit("[#]")).alias("path"), "leaf")
        step = F.when(F.col("is_array"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit('."'), "name", F.lit('"')))
        level = scalars.unionByName(sized)
        done = level if done is None else done.unionByName(level)
        old.append(open_)
        open_ = written(inner.where("item IS NOT NULL").select("key", F.concat("path", step).alias("path"), F.col("item").alias("value")))
        if open_.limit(1).count() == 0:
            break
    done = written(done)
    for table in (*old, open_):
        discard(table)
    return done.withColumnRenamed("key", key)


def path_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, path, before, after`` of the leaves that two tables of :func:`leaves` do not share; the missing side is null."""
    both = before.select(key, "path", F.col("leaf").alias("before"), F.lit(None).cast("string").alias("after")).unionByName(after.select(key, "path", F.lit(None).cast("string").alias("before"), F.col("leaf").alias("after")))
    merged = both.groupBy(key, "path").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    return merged.where(~F.col("before").eqNullSafe(F.col("after")))


def _child(value: Column, text: Column) -> Column:
    return F.struct(value.alias("value"), text.alias("text"))


def _named(name: Column) -> Column:
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit('."'), name, F.lit('"')))


def _is_open(text: Column) -> Column:
    """Whether a canonical text is an array or an object with a key; null texts are not."""
    return F.coalesce(text.startswith("[") | (text.startswith("{") & (text != "{}")), F.lit(False))


def _children(value: Column, text: Column) -> Column:
    """Map of step to (value, text) of what a value holds; an array's length is the step ``[#]``, a leaf is its own child."""
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    items = F.try_variant_get(value, "$", "array<variant>")
    by_name = F.transform_values(F.transform_keys(fields, lambda k, _: _named(k)), lambda _, v: _child(v, F.to_json(v)))
    placed = F.transform(items, lambda v, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), _child(v, F.to_json(v)).alias("child")))
    length = F.struct(F.lit("[#]").alias("step"), _child(F.lit(None).cast("variant"), F.size(items).cast("string")).alias("child"))
    leaf = F.create_map(F.lit(""), _child(F.lit(None).cast("variant"), text))
    none = F.map_filter(leaf, lambda k, _: k != "")
    return F.when(text.isNull(), none).when(~_is_open(text), leaf).when(text.startswith("["), F.map_from_entries(F.concat(placed, F.array(length)))).otherwise(by_name)


def _opened(pairs: DataFrame, key: str) -> DataFrame:
    """``key, path, a, b, before, after`` one level deeper, without what is equal on both sides; pairs of leaves stay."""
    pair = lambda path, a, b, x, y: F.struct(path.alias("path"), a.alias("a"), b.alias("b"), x.alias("before"), y.alias("after"))
    both = F.map_zip_with(_children(F.col("a"), F.col("before")), _children(F.col("b"), F.col("after")), lambda k, x, y: pair(F.concat("path", k), x["value"], y["value"], x["text"], y["text"]))
    differ = F.filter(F.map_values(both), lambda p: ~p["before"].eqNullSafe(p["after"]))
    own = F.array(pair(*map(F.col, ("path", "a", "b", "before", "after"))))
    # The outer form, since from the inner one Spark infers a filter that computes the array once more.
    return pairs.select(key, F.inline_outer(F.when(_is_open(F.col("before")) | _is_open(F.col("after")), differ).otherwise(own))).where("path IS NOT NULL")


def document_diff(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """:func:`path_diff` of the leaves of two JSON texts of one row.

    Both are opened in step, and of a part that is equal on both sides nothing is opened, so that only what differs becomes rows
    and nothing is shuffled. The data decide the number of levels. Keys that come more than once, whose rows are compared as
    one, are left to the tables of leaves.
    """
    twice = written(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("twice")))
    repeated = F.col(key).eqNullSafe(F.col("twice"))
    some = not twice.isEmpty()
    once = rows.join(twice, repeated, "left_anti") if some else rows
    parsed = once.select(key, F.lit("$").alias("path"), F.try_parse_json(before).alias("a"), F.try_parse_json(after).alias("b"))
    pairs = parsed.select("*", F.to_json("a").alias("before"), F.to_json("b").alias("after"))
    still, done = _is_open(F.col("before")) | _is_open(F.col("after")), None
    while True:
        for _ in range(LEVELS):
            pairs = _opened(pairs, key)
        pairs = written(pairs)
        leaf = pairs.where(~still & ~F.col("before").eqNullSafe(F.col("after"))).select(key, "path", "before", "after")
        done = leaf if done is None else done.unionByName(leaf)
        pairs = pairs.where(still)
        if pairs.isEmpty():
            break
    if some:
        many = rows.join(twice, repeated, "left_semi")
        done = done.unionByName(path_diff(leaves(many, key, before), leaves(many, key, after), key))
    discard(twice)
    return done
