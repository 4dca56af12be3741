"""Summaries of many chunks to a fixed budget, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import written
from ledgerloom.operators.matching import fitting

CHARS_PER_TOKEN = 4
LEAST_TOKENS = 50
PARAGRAPH = "\n\n"
#: What a summary must keep: dates, numbers with units, addresses, paths and quoted strings.
ENTITIES = (
    r"\b[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\b", r"\b[0-9]+(?:\.[0-9]+)?(?:%|K|M|B|GB|MB|KB|ms|s|min|hr)?\b", r"""https?://[^\s"'<>]+""",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"(?:/[A-Za-z0-9_.-]+){2,}", r'"[^"]{3,80}"',
)


def tokens(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN)


def entities(text: Column) -> Column:
    """Each entity of a text once."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ENTITIES])))


def summarised(text: Column, most: Column) -> Column:
    """The best sentences that fit ``most`` characters, in their order; a text that fits stays, one or two sentences are cut.

    The first scores 10, the last 8, one in which an entity of the whole text stands 3, a short one with a digit 2; ties by place.
    A sentence that no longer fits is passed over, so the summary of long sentences can be empty.
    """
    parts = F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")

    def scored(x: Column) -> Column:
        """Sentences, best first, of a struct of sentences and entities: the entities are found once a text."""

        def score(s: Column, i: Column) -> Column:
            named = F.exists(x["kept"], lambda e: F.contains(s, e))
            return F.when(i == 0, 10).otherwise(0) + F.when(i == F.size(x["parts"]) - 1, 8).otherwise(0) + F.when(named, 3).otherwise(0) + F.when((F.length(s) < 100) & s.rlike("[0-9]"), 2).otherwise(0)

        return F.array_sort(F.transform(x["parts"], lambda s, i: F.struct((-score(s, i)).alias("less"), i.alias("i"), s.alias("s"))))

    # A lambda binds what it is given, where a column used twice would be computed twice.
    best = F.get(F.transform(F.array(F.struct(parts.alias("parts"), entities(text).alias("kept"))), scored), F.lit(0))
    taken = F.array_sort(F.transform(fitting(best, lambda x: F.length(x.s), most, 1), lambda x: F.struct(x.i.alias("i"), x.s.alias("s"))))
    return F.when(F.length(text) <= most, text).when(F.size(parts) <= 2, F.substring(text, F.lit(1), most.cast("int"))).otherwise(F.array_join(F.transform(taken, lambda x: x.s), " "))


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), PARAGRAPH)


def hierarchical_summaries(chunks: DataFrame, budget: int = 4096, max_depth: int = 3) -> DataFrame:
    """``doc_id, chunks, input_tokens, depth, output_tokens, content`` of every document of ``chunks(doc_id, i, text)``.

    A document of up to twice the budget stays as it is, at depth 0. Of others every chunk is summarised to a quarter, and while
    the summaries exceed the budget, quarters of them are joined and summarised to their share of it. The data decide how
    many levels are run, ``max_depth`` at most; what still exceeds the budget then is summarised once more as one text.
    Null texts count as empty; equal (doc_id, i) are in the order of their texts; further columns are ignored.

    Each level is one table of the summaries of those documents that are not done, in one grouping by document and quarter.
    A quarter's texts meet in one row, which is a sixteenth of a document at the first level and the budget at most later on.
    """
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "text")) - 1
    source = chunks.select("doc_id", "i", F.coalesce("text", F.lit("")).alias("text"))
    size = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("n"), (F.sum(F.length("text")) + len(PARAGRAPH) * (F.count("*") - 1)).alias("chars"))
    whole = size(source).select("doc_id", F.col("n").alias("chunks"), tokens(F.col("chars")).alias("input_tokens"))
    sized = source.join(whole, "doc_id")
    done = [sized.where(F.col("input_tokens") <= 2 * budget).groupBy("doc_id").agg(_joined().alias("content")).withColumn("depth", F.lit(0))]
    share = F.greatest(F.lit(LEAST_TOKENS), F.ceil(tokens(F.length("text")) * 0.25))
    level = written(sized.where(F.col("input_tokens") > 2 * budget).select("doc_id", rank.alias("i"), summarised(F.col("text"), share * CHARS_PER_TOKEN).alias("text")))
    for depth in range(1, max_depth + 1):
        if level.isEmpty():
            break
        here = level.join(size(level), "doc_id")
        fits = tokens(F.col("chars")) <= budget
        ended = here.where(fits).groupBy("doc_id").agg(_joined().alias("content"))
        if depth == max_depth:
            cut = here.where(~fits).groupBy("doc_id").agg(_joined().alias("t")).select("doc_id", summarised(F.col("t"), F.lit(budget * CHARS_PER_TOKEN)).alias("content"))
            ended = ended.unionByName(cut)
        done.append(ended.withColumn("depth", F.lit(depth)))
        if depth < max_depth:
            per = F.greatest(F.lit(2), F.ceil(F.col("n") / 4))
            groups = here.where(~fits).groupBy("doc_id", F.floor(F.col("i") / per).cast("int").alias("g"), F.ceil(F.col("n") / per).alias("groups")).agg(_joined().alias("t"))
            level = written(groups.select("doc_id", F.col("g").alias("i"), summarised(F.col("t"), F.ceil(F.lit(budget) / F.col("groups")) * CHARS_PER_TOKEN).alias("text")))
    rows = reduce(DataFrame.unionByName, done).join(whole, "doc_id")
    return rows.select("doc_id", "chunks", "input_tokens", "depth", tokens(F.length("content")).alias("output_tokens"), "content")
