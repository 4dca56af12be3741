"""SimHash near-duplicates by an inverted index over the bytes of the fingerprints, with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerloom.llm.common import connected_components, documents_of, materialize, small_batches

RADIUS = 3
#: Fingerprints within 3 bits differ in 3 of their 8 bytes at most, so they share 5.
LEAST_SHARED = 8 - RADIUS
SEED = 42
#: Bits counted at once, so that a very long text needs no more memory than a short one.
BLOCK = 1 << 16
#: Postings up to LIGHT are joined with themselves; longer ones are split into cells of about twice CELL rows. Either way gives the
#: same components, so the two change no result.
LIGHT, CELL = 24, 1024


def position_sets() -> list[tuple[int, ...]]:
    """14 sets of 4 byte positions such that any 5 of the 8 positions hold one of them.

    Two halves of four positions; each half, and for every way to pair up a half, each pair of one half
    with each pair of the other that the same way has. Of 5 positions one half has 4 (that half), or 3 and 2:
    the 2 are a pair of some way, and any 3 positions hold a pair of each way.
    """
    ways = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    return [(0, 1, 2, 3), (4, 5, 6, 7)] + [(*a, b[0] + 4, b[1] + 4) for way in ways for a in way for b in way]


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the text's 3-word shingles (see :func:`fingerprints`)."""
    words = text.encode().lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)``, all long, of every row: A-Z lowered, words apart at ASCII white space, 3-word shingles.

    A bit is 1 if over half of the shingles' XXH64 values have it. Texts without a word, and null texts, have
    fingerprint zero; one or two words are one shingle. ``text_hash`` is XXH64 of the text (null: empty). Python, as 64
    counters per shingle have no built-in form; texts go to it in small batches, one at a time within these.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    rows = documents_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _near(a: Column, b: Column) -> Column:
    """The tally of shared positional bytes reaches its least, and the differing bits are few."""
    x = a.bitwiseXOR(b)
    shared = sum((F.when(_byte(x, p) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))
    return (shared >= LEAST_SHARED) & (F.bit_count(x) <= RADIUS)


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join the same fingerprints of a cell as all its near pairs do, one per fingerprint at most."""
    fps = np.unique(group["fp"].to_numpy())
    x = fps[:, None] ^ fps[None, :]
    shared = (x.view(np.uint8).reshape(len(fps), len(fps), 8) == 0).sum(2, np.uint8)
    near = (shared >= LEAST_SHARED) & (np.bitwise_count(x.view(np.uint64)) <= RADIUS)
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    off = label != np.arange(len(fps))
    return pd.DataFrame({"a": fps[off], "b": fps[label[off]]})


def near_links(fps: DataFrame) -> DataFrame:
    """``(a, b)`` links over distinct fingerprints ``fp`` whose components are those of all pairs within the radius.

    The inverted index: a posting for every one of 14 sets of 4 byte positions and the bytes there, so a near
    pair meets in one at least. (A posting for each single byte would hold a 256th of the corpus.) Pairs
    that meet have their shared positional bytes tallied; those with 5 or more are verified bit by bit.
    A posting of over ``LIGHT`` fingerprints is not paired row by row: it is split into cells of bounded size
    that together meet every pair, and a cell returns a spanning forest of its near pairs.
    """
    keys = [F.lit(k).cast("long") * (1 << 32) + sum((F.shiftleft(_byte(F.col("fp"), p), 8 * i) for i, p in enumerate(s)), F.lit(0).cast("long")) for k, s in enumerate(position_sets())]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").count().where("count > 1")
    postings = materialize(postings.join(sizes, "key"))
    light = postings.where(F.col("count") <= LIGHT).select("key", "fp")
    pairs = light.withColumnRenamed("fp", "a").join(light.withColumnRenamed("fp", "b"), "key").where((F.col("a") > F.col("b")) & _near(F.col("a"), F.col("b"))).select("a", "b")
    heavy = postings.where(F.col("count") > LIGHT).withColumn("n", F.ceil(F.col("count") / CELL).cast("int"))
    heavy = heavy.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = heavy.select("fp", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return pairs.unionByName(cells.groupBy("key", "i", "j").applyInPandas(_forest, "a long, b long"))


def group_fingerprints(fps: DataFrame) -> DataFrame:
    """``(fp, component_id, keep_id, keep_fp)`` for each distinct fingerprint of ``fps(doc_id, fp)``.

    ``component_id`` is the smallest doc_id reachable over links (null if every id is null); ``keep_*``
    name one row of the group, the smallest id (nulls last), then fingerprint. Equal fingerprints are one
    row before anything is paired, whatever their number.
    """
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = connected_components(near_links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    groups = placed.groupBy("root").agg(first.alias("first"))
    return placed.select("fp", "root").join(groups, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.doc_id").alias("keep_id"), F.col("first.fp").alias("keep_fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``; repeated rows stay repeated, an empty table stays empty."""
    fps = materialize(fingerprints(docs, id_col, text_col))
    groups = group_fingerprints(fps)
    return fps.join(groups, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, text) without all but one row of each near-duplicate group.

    The row of the smallest id stays (null ids last); of different texts with that id the one of the smaller
    fingerprint, then text hash. Equal rows count as one, null texts as empty, and no column of ``docs`` can clash: its columns
    travel in a struct. Which texts stay is decided from the written fingerprints; texts are hashed once more and
    shuffled once.
    """
    fps = materialize(fingerprints(docs))
    kept = group_fingerprints(fps).select(F.col("keep_id").alias("id"), F.col("keep_fp").alias("keep")).distinct()
    rows = fps.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("keep")), "left_semi")
    rows = rows.groupBy("doc_id", "fp").agg(F.min("text_hash").alias("text_hash"))
    key = lambda hash_: [F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("none"), hash_.alias("hash")]
    own = docs.select(F.struct("*").alias("row"), *key(F.xxhash64(F.coalesce("text", F.lit("")))))
    return own.join(rows.select(*key(F.col("text_hash"))), ["id", "none", "hash"], "left_semi").dropDuplicates(["id", "none", "hash"]).select("row.*")
