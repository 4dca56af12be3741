"""Tables and columns from mapping code: Prisma models, JPA entities, EF sets. By built-in functions within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prisma's own types; a field of any other type is a relation or an enum, which is no column of its own.
PRISMA_TYPES = ("BigInt", "Boolean", "Bytes", "DateTime", "Decimal", "Float", "Int", "Json", "String")


def _or(found: Column, default: Column) -> Column:
    return F.when(found == "", default).otherwise(found)


def prisma_columns(schema: Column) -> Column:
    """Array of (table, column, type, nullable, primary_key): scalar fields of every model; ``@@map`` and ``@map`` rename."""
    model = r"(?s)\bmodel\s+(\w+)\s*\{(.*?)\n\s*\}"
    names, bodies = (F.regexp_extract_all(schema, F.lit(model), F.lit(k)) for k in (1, 2))
    field = r"^\s*(\w+)\s+(\w+)(\?|\[\])?(.*)$"

    def columns(name: Column, body: Column) -> Column:
        table = _or(F.regexp_extract(body, r'@@map\("([^"]*)"\)', 1), name)
        lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(field) & F.regexp_extract(x, field, 2).isin(*PRISMA_TYPES) & (F.regexp_extract(x, field, 3) != "[]"))
        part = lambda x, k: F.regexp_extract(x, field, k)
        return F.transform(lines, lambda x: F.struct(table.alias("table"), _or(F.regexp_extract(x, r'@map\("([^"]*)"\)', 1), part(x, 1)).alias("column"), part(x, 2).alias("type"), (part(x, 3) == "?").alias("nullable"), x.rlike(r"@id\b").alias("primary_key")))

    return F.flatten(F.zip_with(names, bodies, columns))


def jpa_columns(source: Column) -> Column:
    """The same of the first entity of a Java source; ``@Table`` and ``@Column`` or ``@JoinColumn`` rename.

    Transient fields and collections are no columns; a source without ``@Entity`` has none.
    """
    field = r"((?:@\w+(?:\([^)]*\))?\s+)*)(?:private|protected|public)\s+([\w<>\[\], ]+?)\s+(\w+)\s*[;=]"
    marks, kinds, names = (F.regexp_extract_all(source, F.lit(field), F.lit(k)) for k in (1, 2, 3))
    table = _or(F.regexp_extract(source, r'@Table\s*\([^)]*name\s*=\s*"([^"]*)"', 1), F.regexp_extract(source, r"\bclass\s+(\w+)", 1))
    every = F.transform(F.arrays_zip(marks.alias("marks"), kinds.alias("kind"), names.alias("name")), lambda x: F.struct(x.marks.alias("marks"), x.kind.alias("kind"), x["name"].alias("name")))
    own = F.filter(every, lambda x: ~x.marks.rlike(r"@(Transient|OneToMany|ManyToMany)\b"))
    row = lambda x: F.struct(
        table.alias("table"), _or(F.regexp_extract(x.marks, r'@(?:Join)?Column\s*\([^)]*name\s*=\s*"([^"]*)"', 1), x["name"]).alias("column"), x.kind.alias("type"),
        (~x.marks.rlike(r"nullable\s*=\s*false|@Id\b")).alias("nullable"), x.marks.rlike(r"@Id\b").alias("primary_key"),
    )
    return F.when(source.rlike(r"@Entity\b"), F.transform(own, row)).otherwise(F.slice(F.transform(own, row), 1, 0))


def ef_tables(source: Column) -> Column:
    """Array of (entity, table) of a context class: the name of the set, or what ``Entity<T>().ToTable`` says."""
    entities, sets = (F.regexp_extract_all(source, F.lit(r"\bDbSet<(\w+)>\s+(\w+)"), F.lit(k)) for k in (1, 2))
    fluent, named = (F.regexp_extract_all(source, F.lit(r'(?s)\bEntity<(\w+)>\s*\([^;]*?ToTable\(\s*"([^"]*)"'), F.lit(k)) for k in (1, 2))
    return F.zip_with(entities, sets, lambda e, s: F.struct(e.alias("entity"), F.coalesce(F.get(named, (F.array_position(fluent, e) - 1).cast("int")), s).alias("table")))
