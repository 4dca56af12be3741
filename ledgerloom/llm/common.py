"""What the operators of this subpackage share: written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The most rows and bytes of an Arrow batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
WHITESPACE = r"[\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``, or a folder of this machine where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base.rstrip('/')}/ledgerloom"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts the lineage.

    A lost executor loses none of it. The shuffle files of the write are removed when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of a batch that goes to a Python worker, which bounds what both sides hold.

    A setting of the session: it is read when a plan runs, and only lowered.
    """
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and the named columns of ``docs``; no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each end of ``links(a, b)``; root is the smallest node reachable.

    Large-star and small-star rounds: each links every neighbour of a node to the smallest one, so a group's
    links stay linear in its nodes and the rounds grow with the logarithm of its diameter. Each round is
    written to the shared folder. A node with very many neighbours is met by a window-free minimum
    (``groupBy`` with map-side combine) and a join that adaptive execution can split.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        small = materialize(small.where("a <> b").distinct())
        discard(large)
        # Done when every node has one neighbour and no neighbour has one of its own.
        tops = small.select(F.col("b").alias("a")).distinct()
        stars = small.join(tops, "a", "left_semi").limit(1).count() == 0 and small.groupBy("a").count().where("count > 1").limit(1).count() == 0
        discard(links)
        links = small
        if stars:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
