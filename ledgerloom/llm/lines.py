"""Line dedup by winnowing: repeated runs of lines are deleted where they come again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ledgerloom.llm.common import discard, documents_of, materialize, small_batches

#: A repeated run has this many lines at least: the guarantee of the winnowing, and its window of line hashes.
MIN_LINES = 3
SPACE = " \t\n\x0b\x0c\r"
LINES_SCHEMA = "doc_id long, text_hash long, hashes array<long>"
PRINT_SCHEMA = "fp long, around long, doc_id long, text_hash long, start int"
RUN_SCHEMA = "doc_id long, text_hash long, first int, n_lines int, source_id long, source_hash long, source_first int"


def content_lines(text: str) -> tuple[list[str], list[int], list[str]]:
    """All lines, the indexes of those with a word, and these trimmed of ASCII white space."""
    lines = text.split("\n")
    trimmed = [x.strip(SPACE) for x in lines]
    where = [i for i, x in enumerate(trimmed) if x]
    return lines, where, [trimmed[i] for i in where]


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the index of its least one, the rightmost on ties."""
    n = len(hashes) - width + 1
    best, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, width):
        lower = hashes[k : k + n] <= best
        best = np.where(lower, hashes[k : k + n], best)
        at = np.where(lower, np.arange(k, k + n), at)
    return at


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, hashes``: 64-bit hashes of the lines with a word, in order, once for each id and text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[xxh3_64_intdigest(x.encode()) for x in content_lines(t.as_py())[2]] for t in batch.column(1)]
            flat = np.fromiter((h for x in own for h in x), np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["doc_id", "text_hash", "hashes"])

    rows = documents_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, LINES_SCHEMA)


def fingerprints(hashed: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The selected fingerprints of every document of :func:`line_hashes`, with their places.

    Every window of ``min_lines`` line hashes selects its least one, so equal runs of ``min_lines`` lines
    select equal hashes at equal places. A row has the selected hash, ``around`` (a hash of the window that
    selected it) and the window's start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = max(len(h) - min_lines + 1, 0)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[doc]
            inside = np.flatnonzero(place[:n] + min_lines <= sizes[doc[:n]])
            chosen = winnow(h, min_lines)[inside] if n else inside
            around = np.zeros(len(inside), np.uint64)
            for k in range(min_lines):
                around = (around ^ h[inside + k]) * np.uint64(0x9E3779B97F4A7C15)
                around ^= around >> np.uint64(32)
            around += (chosen - inside).astype(np.uint64)
            owner = pa.array(doc[inside])
            yield pa.RecordBatch.from_arrays([pa.array(h[chosen].view(np.int64)), pa.array(around.view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(place[inside].astype(np.int32))], ["fp", "around", "doc_id", "text_hash", "start"])

    return hashed.mapInArrow(run, PRINT_SCHEMA)


def seeds(prints: DataFrame) -> DataFrame:
    """Places of fingerprints joined to the earliest place that agrees: ``doc_id, text_hash, start`` and ``source_*``.

    A fingerprint may stand in many documents, so a place is not joined to each of them: the earliest with the same
    window around it is taken (one row a place, however many agree). Those that agree with none are dropped.
    Earlier: smaller doc_id (nulls first), then text hash, then line.
    """
    place = F.struct("doc_id", "text_hash", "start")
    first = prints.groupBy("fp", "around").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first)
    later = prints.join(first, ["fp", "around"]).where(place > F.col("first"))
    return later.select("doc_id", "text_hash", "start", F.col("first.doc_id").alias("source_id"), F.col("first.text_hash").alias("source_hash"), F.col("first.start").alias("source_start"))


def _same(left: tuple[str, str], right: tuple[str, str]) -> Column:
    return F.col(left[0]).eqNullSafe(F.col(right[0])) & (F.col(left[1]) == F.col(right[1]))


def matches(prints: DataFrame, hashed: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, text_hash, first, n_lines, source_id, source_hash, source_first``: runs that come earlier elsewhere.

    The places of :func:`seeds` are gathered by document and source, both documents' line hashes are joined to them, and
    every match is extended to the left and right while the lines agree. The run is maximal for that source.
    """
    pair = ["doc_id", "text_hash", "source_id", "source_hash"]
    found = materialize(seeds(prints).groupBy(*pair).agg(F.collect_list(F.struct("start", "source_start")).alias("at")))
    own = hashed.dropDuplicates(["doc_id", "text_hash"])
    left = found.join(own.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), _same(("doc_id", "text_hash"), ("_id", "_hash")))
    left = left.select(*pair, "at", F.col("hashes").alias("own"))
    both = left.join(own.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), _same(("source_id", "source_hash"), ("_id", "_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], []
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (5, 6))
                at = batch.column(4)[k].values
                runs = extended(a, b, at.field(0).to_numpy(), at.field(1).to_numpy(), min_lines)
                out += runs
                rows += [k] * len(runs)
            take = pa.array(rows, pa.int64())
            first, n, source = (pa.array([x[c] for x in out], pa.int32()) for c in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), first, n, batch.column(2).take(take), batch.column(3).take(take), source], [x.split()[0] for x in RUN_SCHEMA.split(", ")])

    return both.select(*pair, "at", "own", "hashes").mapInArrow(run, RUN_SCHEMA)


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values at the front of both are equal, compared in growing blocks."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        unlike = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(unlike):
            return at + int(unlike[0])
        at, step = min(n, at + step), 2 * step
    return n


def extended(own: np.ndarray, source: np.ndarray, starts: np.ndarray, source_starts: np.ndarray, min_lines: int) -> list[tuple[int, int, int]]:
    """(first, lines, first in the source) of the maximal equal runs of two sequences from the given places on.

    A place whose window lies in a run already found is not extended again, so text that repeats itself stays cheap.
    """
    out, done = [], 0
    for i in np.argsort(starts, kind="stable").tolist():
        s, t = int(starts[i]), int(source_starts[i])
        if s + min_lines > done:
            left, right = agreeing(own[:s][::-1], source[:t][::-1]), agreeing(own[s:], source[t:])
            out.append((s - left, left + right, t - left))
            done = s + right
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with the later repeated runs deleted from its text, and ``n_lines``, ``n_removed`` (long).

    A line goes if a run of ``min_lines`` lines that holds it starts earlier too: in a smaller doc_id, or
    further up in the same text. Lines count without ASCII white space at their ends; those without a word
    are neither counted nor deleted. Null texts become empty; an empty table gives an empty one. Rows equal in id and
    text are one document: each loses the same lines and neither is earlier. Null ids come first. Other columns are
    kept and may have any name, as they travel in a struct; input columns ``n_lines`` and ``n_removed`` are replaced.
    Texts are joined once to their runs by id and text hash, by a sort-merge join at every size, as the runs grow with the
    input; a document without runs keeps its text byte for byte.
    """
    small_batches(docs.sparkSession)
    hashed = materialize(line_hashes(docs, id_col, text_col))
    prints = materialize(fingerprints(hashed, min_lines))
    runs = materialize(matches(prints, hashed, min_lines).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "n_lines")).alias("runs")))
    discard(prints)
    discard(hashed)
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    others = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), others.alias("rest"))
    joined = rows.withColumn("hash", F.xxhash64("text")).join(runs.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, own in zip(batch.column(0), batch.column(2)):
                lines, where, _ = content_lines(text.as_py())
                gone: set[int] = set()
                for r in own.as_py() or ():
                    gone.update(where[r["first"] : r["first"] + r["n_lines"]])
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text.as_py())
                n_lines.append(len(where))
                n_removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(0).type), batch.column(1), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], ["text", "rest", "n_lines", "n_removed"])

    kept = joined.select("text", "rest", "runs")
    done = kept.mapInArrow(run, T.StructType([*kept.schema.fields[:2], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
    ordered = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return done.select(*ordered, "n_lines", "n_removed")
