"""Scores of what was read from a document against what is labelled in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.spans import LEAST_WORDS, SPACES, flat


def _ratio(part: str, whole: str, name: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.nullif(F.col(whole), F.lit(0))).alias(name)


def _in_order(value: str, when: Column, place: str) -> Column:
    """The values of a group for which ``when`` holds, by place."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col(place).alias("place"), F.col(value).alias("value"))))), lambda x: x["value"])


def reading_scores(docs: DataFrame, labels: DataFrame, found: DataFrame, ambiguities: DataFrame, questions: DataFrame) -> DataFrame:
    """One row of scores for every ``docs(doc_id, text)``; ids of documents are distinct and not null.

    ``labels(doc_id, label, section, place)`` are what should be found, ``found(doc_id, label, quote)`` is what was, each row with the
    label that it states or null. The first that states a label claims it; further ones are ``repeats`` and count against precision.
    A label that the document doesn't have is ``invalid`` and states nothing. A section is covered once one of its labels is claimed.
    ``ambiguities(doc_id, ambiguity, place)`` are what should be asked about, ``questions(doc_id, ambiguity, worth_asking)`` what was asked;
    an ambiguity asked about twice is raised once. A quote counts as verified if the text has it word for word, white space
    aside, and it has LEAST_WORDS words; null and blank quotes are none. A ratio of nothing is null; lists are by place, repeated
    label rows count once at their least place, and null labels, sections and ambiguities are left out.

    Sums by (document, label) come first, so no row of what was found is kept; the lists hold labels of one document only.
    """
    wanted = labels.where(F.col("label").isNotNull() & F.col("section").isNotNull()).select("doc_id", "label", F.struct("place", F.col("section").cast("string").alias("section")).alias("at"))
    stated = found.where(F.col("label").isNotNull()).select("doc_id", "label", F.lit(1).alias("hits"))
    met = wanted.unionByName(stated, allowMissingColumns=True).groupBy("doc_id", "label").agg(F.min("at").alias("at"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).select("doc_id", "label", "at.place", "at.section", "hits")
    known, claimed = F.col("section").isNotNull(), F.col("hits") > 0
    # By section, of which null is that of the labels that the document hasn't.
    parts = met.groupBy("doc_id", "section").agg(
        F.min("place").alias("place"), F.count_if(known).alias("labelled"), F.count_if(known & claimed).alias("matched"), F.sum(F.when(known & claimed, F.col("hits") - 1).otherwise(0)).alias("repeats"),
        F.sum(F.when(~known, F.col("hits")).otherwise(0)).alias("invalid"), F.collect_list(F.when(known & ~claimed, F.struct("place", "label"))).alias("missed"),
    )
    reqs = parts.groupBy("doc_id").agg(
        *[F.sum(c).alias(c) for c in ("labelled", "matched", "repeats", "invalid")], F.count_if(known).alias("labelled_sections"), F.count_if(known & (F.col("matched") > 0)).alias("covered_sections"),
        _in_order("section", known & (F.col("matched") == 0), "place").alias("missed_sections"), F.transform(F.array_sort(F.flatten(F.collect_list("missed"))), lambda x: x["label"]).alias("missed_labels"),
    )
    named = ambiguities.where(F.col("ambiguity").isNotNull()).select("doc_id", "ambiguity", "place", F.lit(True).alias("named"))
    asked = questions.select("doc_id", "ambiguity", F.lit(1).alias("asked"), F.when(F.col("worth_asking"), 1).alias("worth"))
    both = named.unionByName(asked, allowMissingColumns=True).groupBy("doc_id", "ambiguity").agg(F.min("place").alias("place"), F.coalesce(F.max("named"), F.lit(False)).alias("named"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("asked", "worth")])
    raised = F.col("named") & (F.col("asked") > 0)
    ambs = both.groupBy("doc_id").agg(F.sum("asked").alias("questions"), F.sum("worth").alias("worth_asking"), F.count_if("named").alias("ambiguities"), F.count_if(raised).alias("ambiguities_raised"), _in_order("ambiguity", F.col("named") & ~raised, "place").alias("missed_ambiguities"))
    # The text meets the quotes of its own document; what leaves the join is a flag.
    quote = F.regexp_replace(flat(F.col("quote")), f"^[{SPACES}]+|[{SPACES}]+$", "")
    quotes = found.select("doc_id", quote.alias("quote"))
    inside = (F.size(F.split("quote", " ")) >= LEAST_WORDS) & F.contains("flat", "quote")
    seen = docs.select("doc_id", flat(F.col("text")).alias("flat")).join(quotes, "doc_id").groupBy("doc_id").agg(F.count("*").alias("extracted"), F.count_if(F.col("quote") != "").alias("quoted"), F.count_if((F.col("quote") != "") & inside).alias("quotes_verified"))
    rows = docs.select("doc_id").join(reqs, "doc_id", "left").join(ambs, "doc_id", "left").join(seen, "doc_id", "left")
    counts = ("labelled", "extracted", "matched", "repeats", "invalid", "labelled_sections", "covered_sections", "questions", "worth_asking", "ambiguities", "ambiguities_raised", "quoted", "quotes_verified")
    lists = ("missed_sections", "missed_labels", "missed_ambiguities")
    rows = rows.fillna(0, list(counts)).select("doc_id", *counts, *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists])
    return rows.select(
        "*", _ratio("matched", "labelled", "recall"), _ratio("matched", "extracted", "precision"), _ratio("covered_sections", "labelled_sections", "section_coverage"), _ratio("worth_asking", "questions", "question_precision"),
        _ratio("ambiguities_raised", "ambiguities", "ambiguity_recall"), _ratio("quotes_verified", "quoted", "quote_accuracy"),
    )
