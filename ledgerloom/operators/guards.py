"""A guard against content in tables that must hold none: every string leaf has a most length."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Code points of a string leaf, and those of the fields that may hold free text, by name (fixed values).
LIMIT = 128
ALLOWED = {"reason": 2000, "judge": 128}


def _excess(column: Column, kind: DataType, path: str, limit: Column, allowed: Mapping[str, int], default: int) -> Iterator[tuple[str, Column]]:
    """(path, code points beyond the limit of the longest string there) of all string leaves under a column."""
    if isinstance(kind, StringType):
        yield path, F.length(column) - limit
    elif isinstance(kind, StructType):
        for field in kind.fields:
            yield from _excess(column.getField(field.name), field.dataType, f"{path}.{field.name}", F.lit(allowed.get(field.name, default)), allowed, default)
    elif isinstance(kind, ArrayType | MapType):
        named = isinstance(kind, MapType)
        inner = kind.valueType if named else kind.elementType
        entries = F.map_entries(column) if named else column
        own = F.lit(default)
        below = f"{path}.*" if named else f"{path}[]"

        def at(leaf: int) -> Column:
            def one(x: Column) -> Column:
                most = own
                if named and isinstance(kind.keyType, StringType):
                    for name, size in allowed.items():
                        most = F.when(x.getField("key") == name, F.lit(size)).otherwise(most)
                return list(_excess(x.getField("value") if named else x, inner, below, most, allowed, default))[leaf][1]

            return F.array_max(F.transform(entries, one))

        for leaf, (name, _) in enumerate(_excess(F.lit(None).cast(inner), inner, below, own, allowed, default)):
            yield name, at(leaf)


def string_leaves(df: DataFrame, allowed: Mapping[str, int] = ALLOWED, default: int = LIMIT) -> list[tuple[str, Column]]:
    """(path, excess) of every string leaf of the schema, elements of arrays (``[]``) and values of maps (``.*``) included.

    The limit is that of the leaf's own name, or of its key in a map; elements of arrays have no name and so the default.
    """
    return [x for f in df.schema.fields for x in _excess(F.col(f"`{f.name}`"), f.dataType, f.name, F.lit(allowed.get(f.name, default)), allowed, default)]


def leaf_report(df: DataFrame, allowed: Mapping[str, int] = ALLOWED, default: int = LIMIT) -> DataFrame:
    """``path, n_rows, n_over``: rows that have a string at the path, and those with one beyond its limit, in one aggregation.

    Nulls and empty arrays hold no string. An empty table has a row of zeros a path; without string leaves there is no row.
    """
    leaves = string_leaves(df, allowed, default)
    if not leaves:
        return df.sparkSession.createDataFrame([], "path string, n_rows long, n_over long")
    totals = df.agg(*[F.struct(F.lit(path).alias("path"), F.count(x).alias("n_rows"), F.count_if(x > 0).alias("n_over")).alias(f"p{k}") for k, (path, x) in enumerate(leaves)])
    return totals.select(F.inline(F.array(*[f"p{k}" for k in range(len(leaves))])))


def content_free(df: DataFrame, name: str = "content_free", allowed: Mapping[str, int] = ALLOWED, default: int = LIMIT) -> DataFrame:
    """``df``, whose action fails with the path of the first leaf beyond its limit, so that nothing of it is written.

    The number of rows checked is observed under ``name``. The message holds the path and never the text.
    """
    df = df.observe(name, F.count(F.lit(1)).alias("n_checked"))
    bad = F.coalesce(*[F.when(x > 0, F.lit(path)) for path, x in string_leaves(df, allowed, default)], F.lit(None).cast("string"))
    return df.where(F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("content at "), bad)).cast("boolean")).otherwise(True))
