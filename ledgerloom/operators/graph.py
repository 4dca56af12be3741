"""Reach, neighbours and structural similarity over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; without that, on one machine only, in a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.conf.get("spark.app.id")
        base = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base.rstrip('/')}/ledgerloom/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a path of :func:`scratch` and read back, so that lineage stays short and nothing is computed twice."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table of :func:`written` that no later plan reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def call_graph(edges: DataFrame, roots: DataFrame, depth: int, most: int) -> DataFrame:
    """``root, node, depth, truncated``: what each of ``roots(root)`` reaches along ``edges(src, dst)`` in ``depth`` steps, ``most`` nodes at most.

    A level takes its new nodes in the order of their keys until the root's budget is used; then the root is ``truncated`` and goes no
    further. The root counts as a node. No node of a level is beyond the first ``most`` of an edge's start: of these no more are known than
    the root has used, so what is left fills its budget. A start with very many edges, and a root with a very wide level, stay bounded. Null keys are no nodes.
    """
    first = Window.partitionBy("src").orderBy("dst")
    near = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).select("src", "dst")
    near = written(near)
    seen = written(roots.where("root IS NOT NULL").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    old = [near]
    for level in range(1, depth + 1):
        used = seen.groupBy("root").agg(F.count("*").alias("used")).where(F.col("used") < most)
        frontier = seen.where(F.col("depth") == level - 1).join(used.select("root"), "root", "left_semi")
        new = frontier.join(near, frontier["node"] == near["src"]).select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
        new = new.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("node"))).where(F.col("k") <= most)
        taken = new.join(used, "root").where(F.col("k") <= most - F.col("used")).select("root", "node", F.lit(level).alias("depth"))
        old.append(seen)
        seen = written(seen.unionByName(taken))
    for table in old:
        discard(table)
    full = seen.groupBy("root").agg((F.count("*") >= most).alias("truncated"))
    return seen.join(full, "root")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, decay: float = 0.7, least: float = 0.4) -> DataFrame:
    """``node, depth, confidence, relation`` within ``depth`` steps along ``edges(src, dst, weight, relation)`` from ``seeds(node, weight)``.

    A node is claimed once, at its shortest depth, by the strongest parent (then the smallest). Its confidence
    is the seed's times the edge's weight, decayed per further step; those below ``least`` are cut before the
    seed's weight scales them. The relation is the one of the first step. Each level is one join with
    the edges and one anti-join with what is claimed, written before the next.
    """
    start = seeds.select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("raw"), F.col("weight").cast("double").alias("seed"), F.lit(None).cast("string").alias("relation"))
    claimed = frontier = written(start)
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier.node == edges.src).select(
            F.col("dst").alias("node"), (F.col("weight") * (decay ** (level - 1))).alias("raw"), "seed", F.coalesce(frontier.relation, edges.relation).alias("relation"), F.col("src").alias("parent")
        )
        first = step.groupBy("node").agg(F.max_by(F.struct("raw", "seed", "relation"), F.struct("raw", "seed", (-F.col("parent")).alias("p"))).alias("b"))
        frontier = written(first.join(claimed, "node", "left_anti").select("node", F.lit(level).alias("depth"), "b.raw", "b.seed", "b.relation"))
        claimed = written(claimed.unionByName(frontier))
    kept = claimed.where((F.col("depth") == 0) | (F.col("raw") >= least))
    return kept.select("node", "depth", F.round(F.col("raw") * F.col("seed"), 6).alias("confidence"), "relation")


def twins(members: DataFrame, least: float, least_size: int) -> DataFrame:
    """``kind, a, b, similarity``: keys whose item sets in ``members(key, item)`` overlap enough (Jaccard).

    Keys of equal sets are one before anything is paired: a ``member`` row names each key's representative (the smallest
    of them), a ``pair`` row two representatives. An inverted index with a prefix filter: a pair that similar shares
    an item among the rarest ``n - ceil(t n) + 1`` of each, so only those are indexed; pairs whose sizes, what follows
    the shared items, or 64 bits of each set leave too few to share are dropped where they meet, before they are verified.
    """
    sets = members.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")).where(F.size("items") >= least_size)
    keyed = written(sets.withColumn("digest", F.unhex(F.sha2(F.array_join(F.col("items").cast("array<string>"), "\0"), 256))))
    first = written(keyed.groupBy("digest").agg(F.min("key").alias("rep")))
    member = keyed.select("key", "digest").join(first, "digest").select(F.lit("member").alias("kind"), F.col("key").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    own = keyed.join(first, F.col("key") == F.col("rep"), "left_semi").select("key", F.explode("items").alias("item"))
    rarity = own.groupBy("item").agg(F.count("*").alias("df"))
    ranked = own.join(rarity, "item").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("s"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    bits = F.aggregate("s", F.lit(0).cast("long"), lambda have, x: have.bitwiseOR(bit(x["item"])))
    listed = written(ranked.select("key", F.size("s").alias("size"), bits.alias("bits"), F.transform("s", lambda x: x["item"]).alias("items")))
    most = (F.col("size") - F.ceil(F.col("size") * least) + 1).cast("int")
    prefix = listed.select("key", "size", "bits", F.posexplode(F.slice("items", F.lit(1), most)).alias("at", "item"))
    b = prefix.withColumnsRenamed({"key": "b", "size": "size_b", "bits": "bits_b", "at": "at_b"})
    sizes = (F.col("a") < F.col("b")) & (F.least("size", "size_b") >= least * F.greatest("size", "size_b"))
    # All that two sets can still share: the items from the shared one on.
    left = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b")) + F.least("at", "at_b")
    # A bit that the other lacks is an item at least that it lacks.
    alike = lambda n, x, y: F.col(n) - F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y)))
    left = F.least(left, alike("size", "bits", "bits_b"), alike("size_b", "bits_b", "bits"))
    met = prefix.withColumnRenamed("key", "a").join(b, "item").where(sizes & (left * (1 + least) >= least * (F.col("size") + F.col("size_b")) - 1e-9)).select("a", "b").distinct()
    side = lambda k, x: listed.select(F.col("key").alias(k), F.col("items").alias(x))
    both = met.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("hit", F.size(F.array_intersect("x", "y")))
    similarity = F.col("hit") / (F.size("x") + F.size("y") - F.col("hit"))
    return member.unionByName(both.where(similarity >= least).select(F.lit("pair").alias("kind"), "a", "b", F.round(similarity, 6).alias("similarity")))
