"""Joins, set operations, ranking and paging over any tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import written


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """Full outer join by key: added, removed, changed or unchanged, comparing with nulls equal."""
    a = before.select(F.col(key), F.struct(*compared).alias("_a"))
    b = after.select(F.col(key), F.struct(*compared).alias("_b"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; the order must settle ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def top_overall(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows, taken per partition before they meet."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page with ``total``; a page below 1 is the first. Only the pages up to this one are sorted together."""
    number = max(1, number)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).limit(number * size)
    rows = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where(F.col("_n") > (number - 1) * size).drop("_n")
    return rows.crossJoin(F.broadcast(total))


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """``size`` rows behind the cursor, and in ``next_cursor`` the last key if more rows follow."""
    rows = df.where(F.col(key) > after).orderBy(key).limit(size + 1)
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(key))).withColumn("_all", F.count("*").over(Window.partitionBy()))
    last = F.max(F.when(F.col("_n") == size, F.col(key))).over(Window.partitionBy())
    return numbered.withColumn("next_cursor", F.when(F.col("_all") > size, last)).where(F.col("_n") <= size).drop("_n", "_all")


def two_key_reconcile(used: DataFrame, catalog: DataFrame) -> DataFrame:
    """``used(name)`` against ``catalog(qualified)``: by qualified name, else by bare name (smallest first), else phantom.

    Catalog entries that nothing uses come as ``unused``. Names compare in lower case.
    """
    bare = lambda c: F.substring_index(F.lower(c), ".", -1)
    names = used.select(F.lower("name").alias("name")).distinct()
    known = catalog.select(F.lower("qualified").alias("qualified")).distinct()
    by_bare = known.groupBy(bare(F.col("qualified")).alias("bare")).agg(F.min("qualified").alias("by_bare"))
    hit = names.join(known.withColumn("name", F.col("qualified")), "name", "left").withColumn("bare", bare(F.col("name"))).join(by_bare, "bare", "left")
    target = F.coalesce("qualified", "by_bare")
    status = F.when(F.col("qualified").isNotNull(), "qualified").when(F.col("by_bare").isNotNull(), "bare").otherwise("phantom")
    found = hit.select("name", target.alias("qualified"), status.alias("status"))
    unused = known.join(found.select("qualified").where("qualified IS NOT NULL"), "qualified", "left_anti")
    return found.unionByName(unused.select(F.lit(None).cast("string").alias("name"), "qualified", F.lit("unused").alias("status")))


def override_merge(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """``rows(target, class)`` with the first override (by ``at``) of each target, the class before it, and overrides without a row."""
    chosen = first_by(overrides, ["target"], F.col("at")).select("target", F.col("class").alias("_class"))
    both = rows.join(chosen, "target", "full")
    return both.select("target", F.coalesce("_class", "class").alias("class"), F.when(F.col("_class").isNotNull(), F.col("class")).alias("prior_class"))


def numbered(df: DataFrame, group: str, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``: each row's place in its group, from 1. A group of any size is numbered by many tasks.

    Rows are dealt out by ranges of (group, order) and written; each range numbers its own rows, and what its group
    has in the ranges before is added.
    """
    rows = written(df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), before.alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    joined = own.join(offsets, own[group].eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_group", "_at", "_before", "_own")


def budget_prefix(df: DataFrame, cost: str, budget: int, keys: Sequence[str], *order: Column) -> DataFrame:
    """Rows of each key in order until one would exceed the budget; nothing behind it is taken."""
    running = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).where(F.col("running") <= budget)


def canonical_json(value: Column) -> Column:
    """Keys of a flat JSON object in order, so that equal objects are equal strings; null where malformed."""
    entries = F.map_entries(F.from_json(value, "map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(entries)))
