"""Benchmark decontamination: item-sized windows, weighted SimHash, blocked Hamming search, weighted similarity.

Built-in functions only: words and shingles are arrays of a row, windows and candidates are joins. Where an
array comes from nested lambdas the outer form of explode is used: for the inner one the optimizer adds a
filter on the array's size, whose push-down would evaluate the inner arrays again for every element.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import WHITESPACE, materialize

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints differ in RADIUS bits at most; of the blocks, of so many bits each, one then differs in FLIPS bits at most.
RADIUS, BLOCKS = 19, (13, 13, 13, 13, 12)
FLIPS = RADIUS // len(BLOCKS)
#: A shingle's vote is a whole number, its root times this.
VOTE = 1000
#: What is made from the benchmark is broadcast up to this many bytes, as JSON text; beyond, it is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def _small(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcast if its measured size is small enough. The result is the same either way."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITESPACE), "")


def shingles(df: DataFrame, text_col: str, name: str, lengths: bool) -> DataFrame:
    """``df`` with ``name``: hashes of the text's 5-word shingles, in order (fewer words: one of them all).

    With ``lengths`` each is (h, w), where w, the weight of a shingle, is the code points of its words.
    """
    df = df.withColumn("_w", words(F.col(text_col)))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    at = lambda column, i: [F.get(column, i + k) for k in range(1, SHINGLE)]
    count = F.greatest(F.size("_h") - (SHINGLE - 1), F.least(F.size("_h"), F.lit(1)))
    if not lengths:
        value = F.transform("_h", lambda h, i: F.xxhash64(h, *at("_h", i)))
    else:
        df = df.withColumn("_l", F.transform("_w", lambda w: F.length(w)))
        value = F.transform("_h", lambda h, i: F.struct(F.xxhash64(h, *at("_h", i)).alias("h"), (F.get("_l", i) + sum((F.coalesce(x, F.lit(0)) for x in at("_l", i)), F.lit(0))).alias("w")))
    return df.withColumn(name, F.slice(value, F.lit(1), count)).drop("_w", "_h", "_l")


def votes(bag: str) -> Column:
    """(h, v) of an array of shingles (h, w), repeats included: each distinct one votes with the root of its weight times its count.

    Two bags of weighted Jaccard similarity j then have a cosine of 2j / (1 + j) at least, whatever the weights
    are: one heavy shingle counts in the fingerprint as it does in the similarity.
    """
    vote = lambda s, n: F.struct(s.h.alias("h"), F.round(F.sqrt(s.w * n) * VOTE).cast("long").alias("v"))
    own = F.array_distinct(F.col(bag))
    counted = F.transform(own, lambda s: vote(s, F.size(F.filter(bag, lambda x: x.h == s.h))))
    return F.when(F.size(own) == F.size(bag), F.transform(bag, lambda s: vote(s, F.lit(1)))).otherwise(counted)


def fingerprint(voters: str) -> Column:
    """Weighted SimHash of an array of (h, v): a bit is 1 if the votes of the hashes that have it exceed the others'.

    The array is bound once, as the one element of another, lest it be computed anew for each bit.
    """
    total = "aggregate(own, 0L, (n, x) -> n + CASE WHEN shiftrightunsigned(x.h, b) & 1L = 1L THEN x.v ELSE -x.v END)"
    return F.expr(f"transform(array({voters}), own -> aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE WHEN {total} > 0 THEN shiftleft(1L, b) ELSE 0L END))[0]")


def block_keys(fp: str, flips: int) -> Column:
    """(block, value) of every block of a fingerprint and all values that differ from it in ``flips`` bits at most."""
    keys, low = [], 0
    for k, width in enumerate(BLOCKS):
        masks = [sum(1 << b for b in on) for n in range(flips + 1) for on in itertools.combinations(range(width), n)]
        value = F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        keys.append(F.transform(F.lit(masks).cast("array<int>"), lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value"))))  # noqa: B023
        low += width
    return F.concat(*keys)


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, shingles, size, weights, total, fp`` of the items that have a word. Equal items stay apart."""
    items = shingles(benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("_text")), "_text", "shingles", True).drop("_text")
    items = materialize(items).where(F.size("shingles") > 0)
    items = items.withColumn("size", F.size("shingles")).withColumn("_own", F.array_distinct("shingles"))
    items = items.withColumn("counts", F.transform("_own", lambda s: F.struct(s.h.alias("h"), s.w.alias("w"), F.size(F.filter("shingles", lambda x: x.h == s.h)).alias("n")))).drop("_own")
    items = items.withColumn("total", F.aggregate("shingles", F.lit(0).cast("long"), lambda a, s: a + s.w)).withColumn("_votes", votes("shingles"))
    return items.withColumn("fp", fingerprint("_votes")).drop("_votes")


def windows_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, size, shingles, fp``: the item-sized windows that share a shingle with an item.

    A window similar enough to an item shares shingles with it, so only windows laid over a shared
    shingle as the item lies over it are taken; the others need no fingerprint. The benchmark's shingles are
    broadcast if measured small. Positions travel without texts; only documents with a hit are read again.
    """
    anchors = items.select("size", F.posexplode(F.transform("shingles", lambda s: s.h)).alias("offset", "h")).distinct()
    anchors = materialize(anchors.groupBy("h").agg(F.collect_list(F.struct("size", "offset")).alias("at")))
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    hashed = shingles(source, "text", "hashes", False).select("doc_id", "text_hash", F.size("hashes").alias("n"), F.posexplode_outer("hashes").alias("pos", "h"))
    hits = hashed.join(_small(anchors), "h").select("doc_id", "text_hash", "n", "pos", F.explode("at").alias("a"))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("a.offset"), F.col("n") - F.col("a.size")))
    wanted = materialize(hits.select("doc_id", "text_hash", F.struct(start.alias("start"), F.col("a.size").alias("size")).alias("w")).groupBy("doc_id", "text_hash").agg(F.collect_set("w").alias("wanted")))
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "wanted")
    again = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).dropDuplicates(["doc_id", "text_hash"])
    again = shingles(again.select("doc_id", "text_hash", "text", "wanted"), "text", "all", True).drop("text")
    cut = again.select("doc_id", "text_hash", F.explode_outer(F.transform("wanted", lambda w: F.struct(w.start.alias("start"), w["size"].alias("size"), F.slice("all", w.start + 1, w["size"]).alias("shingles")))).alias("w")).select("doc_id", "text_hash", "w.*")
    return cut


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, item_id, start, similarity``: documents that hold an item, one row a pair.

    The similarity of a window and an item is the weighted Jaccard of their bags of 5-word shingles (lower
    case, words apart at ASCII white space; a shingle weighs its letters); pairs of 0.8 or more are leaks. A
    row keeps the best window, the first on ties, counted in shingles. Windows of equal content, of one hot
    passage say, are fingerprinted and verified once. Null and empty texts and items match nothing, repeated
    rows are one document, null ids are kept as null; a very long text is one row of hashes. The Hamming search
    returns every pair within 19 bits, and only these are verified. A pair of similarity 0.8 has a cosine of 0.889
    at least and so differs in 9.7 bits on average; 3 in 10,000 such pairs lie further than 19 bits apart, and
    fewer of more similar ones. An item whose words stand in a text as they are differs in none.
    """
    items = materialize(items_of(benchmark))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    windows = materialize(windows_of(docs, items))
    contents = windows.groupBy("size", "shingles").agg(F.count("*").alias("n")).drop("n").withColumn("_votes", votes("shingles"))
    contents = materialize(contents.withColumn("fp", fingerprint("_votes")).drop("_votes").withColumn("content", F.monotonically_increasing_id()))
    left = contents.select("content", "size", "fp", F.explode(block_keys("fp", 0)).alias("k"))
    right = items.select("item_id", "size", F.col("fp").alias("item_fp"), F.explode(block_keys("fp", FLIPS)).alias("k"))
    near = left.join(_small(materialize(right)), ["size", "k"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = near.select("content", "size", "item_id").distinct()
    met = pairs.join(contents.select("content", "shingles"), "content").join(_small(items.select("item_id", "size", "counts", "total")), ["item_id", "size"])
    shared = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c.w * F.least(c.n, F.size(F.filter("shingles", lambda s: s.h == c.h))))
    own = F.aggregate("shingles", F.lit(0).cast("long"), lambda a, s: a + s.w)
    scored = met.withColumn("_shared", shared).withColumn("_own", own).withColumn("similarity", F.col("_shared") / (F.col("total") + F.col("_own") - F.col("_shared")))
    verified = scored.where(F.col("similarity") >= SIMILARITY).select("size", "shingles", "item_id", "similarity")
    found = windows.join(verified, ["size", "shingles"])
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("b")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", F.col("b.start").cast("long").alias("start"), F.col("b.similarity").alias("similarity"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, text) without the documents that hold a benchmark item.

    Repeated rows go or stay together, null ids compare equal, null and empty texts stay; an empty table or benchmark
    removes nothing. Columns of ``docs`` may have any name, as they travel in a struct.
    """
    bad = leaks(docs, benchmark).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.col("text_hash").alias("hash")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    return own.join(materialize(bad), ["id", "none", "hash"], "left_anti").select("row.*")
