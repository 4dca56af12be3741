"""Raw documents to token ids in five written stages: quality, line dedup, near dedup, decontamination, BPE.

``STAGES`` lists them; each takes (spark, docs, sf_dir), all but the last return the columns of
``documents``, and each works on what the one before kept.

Every stage takes the columns of ``documents`` out of whatever columns there are. Null texts count as empty: the quality rules reject
them, the other stages handle them as empty texts. Null ids stay null; rows equal in id and text are one document, of which line dedup
keeps every row and near dedup one. An empty table gives an empty one. Without labels the quality stage has its base rule alone, and
without benchmark items nothing is dropped for them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, lines, quality, simhash
from ledgerloom.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the rules reject. Cutoffs come from the labelled documents' measures.

    The measures are written once, before anything is learned from them or judged by them: a filter on them would
    be pushed into their arrays and compute each array anew for every element of the next. The join with
    the labels reads only the measures' columns, so no text is shuffled.
    """
    measured = materialize(quality.features(docs.select(COLUMNS)))
    cutoffs = materialize(quality.calibrate(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.judge(measured, cutoffs).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated runs of lines; ``n_chars`` counts what is left. Rows stay, even with an empty text."""
    done = lines.dedup_lines(docs.select(COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, the one of the smallest id."""
    return simhash.keep_one(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.remove_leaks(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    coded = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("byte-level BPE", tokenize)]
#: SimHash has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
