"""Periodic runs of words: every lag up to a third of a text is compared with the text, and stretches that agree are runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents_of, small_batches

#: A run has this many words, and this many periods, at least.
LEAST, TIMES = 24, 3
#: Comparisons of words in a range of lags, and the most ranges of a text (a longer one has longer ranges, since each takes the text's ids along).
WORK, RANGES = 1 << 25, 64
RUNS = "array<struct<start: long, length: long, period: long>>"


def word_ids(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and a number for each, equal for equal words."""
    words = text.split()  # of bytes: ASCII white space alone
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words))
    return words, ids.astype(np.uint16) if len(seen) < 1 << 16 else ids


def lag_ranges(n: int, work: int = WORK) -> list[tuple[int, int]]:
    """Ranges (from, before) of the lags that a run in ``n`` words can have; none if it is too short for any."""
    lags = n // TIMES if n >= LEAST else 0
    parts = min(RANGES, lags, max(1, -(-n * lags // work)))
    cuts = [1 + lags * k // parts for k in range(parts + 1)] if parts else []
    return list(zip(cuts, cuts[1:]))


def scan_lags(ids: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, length, lag) of the stretches that agree with themselves at a lag in range and are long enough for a run.

    A stretch found at several lags is reported at the least one in range, which divides the others.
    """
    found: dict[tuple[int, int], int] = {}
    for lag in range(low, high):
        same, least = ids[lag:] == ids[:-lag], max(LEAST - lag, (TIMES - 1) * lag)
        if np.count_nonzero(same) < least:
            continue
        edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        for k in np.flatnonzero(lengths >= least):
            found.setdefault((int(starts[k]), int(lengths[k]) + lag), lag)
    return [(start, length, lag) for (start, length), lag in found.items()]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what each run repeats after its first period, joined by spaces."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(drop[:-1]).tolist()) if not d)


def _lists(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), values)


def short_texts(rows: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, kept`` of texts whose lags are one range: scanned and collapsed where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept = [], [], []
            for text in batch.column(1):
                words, ids = word_ids(text.as_py())
                own = sorted(scan_lags(ids, 1, len(words) // TIMES + 1) if len(words) >= LEAST else [], key=lambda r: (r[0], r[2]))
                counts.append(len(words))
                runs.append(own)
                kept.append(collapse(words, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), _lists(runs), pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "kept"])

    return rows.select("doc_id", "body").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, kept binary")


def long_texts(rows: DataFrame, work: int) -> DataFrame:
    """The same of any texts: each range of lags is a row with the text's word ids, and these rows are dealt to all tasks."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["body"]):
                words, ids = word_ids(bytes(text))
                for low, high in lag_ranges(len(words), work):
                    yield pd.DataFrame({"key": [bytes(key)], "low": [low], "high": [high], "width": [ids.itemsize], "ids": [ids.tobytes()]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                found = scan_lags(np.frombuffer(row.ids, f"u{row.width}"), row.low, row.high)
                yield pd.DataFrame([(bytes(row.key), *r) for r in found], columns=["key", "start", "length", "period"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                words = bytes(row.body).split()
                runs = [(r["start"], r["length"], r["period"]) for r in (row.runs if row.runs is not None else [])]
                out.append((row.doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], collapse(words, runs)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "kept"])
            yield frame.astype({"doc_id": "Int64"})

    keyed = rows.select("doc_id", F.unhex(F.sha2("body", 256)).alias("key"), "body")
    parts = keyed.select("key", "body").dropDuplicates(["key"]).mapInPandas(ranges, "key binary, low long, high long, width int, ids binary")
    stretches = parts.repartition("key", "low").mapInPandas(scan, "key binary, start long, length long, period long")
    least = stretches.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    order = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    runs = least.groupBy("key").agg(F.transform(order, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    return keyed.join(runs, "key", "left").select("doc_id", "body", "runs").mapInPandas(cut, f"doc_id long, n_words long, runs {RUNS}, kept binary")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: int = WORK) -> DataFrame:
    """``doc_id, n_words, runs, text`` of every row: maximal periodic runs of words, and the text with each run's first period alone.

    Words lie between ASCII white space. A run is a stretch of LEAST words and TIMES smallest periods at least that no neighbouring word
    extends; ``runs`` has (start, length, period) in words, by start, then period. ``text`` has the kept words joined by spaces.
    Every lag up to a third of the words is compared with the whole text. Texts that can have more than ``work`` comparisons are split
    by ranges of lags and dealt to all tasks; ``work`` changes no result. Null texts are empty and have no run; null ids stay, and
    repeated rows give repeated results. A very long text takes quadratic time, spread over at most RANGES tasks. An empty table
    gives an empty one; other columns of ``docs`` are left behind.
    """
    small_batches(docs.sparkSession)
    rows = documents_of(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("body"))
    # n words have n * n / 3 comparisons at most and need 2 n - 1 bytes at least.
    longest = 2 * int((TIMES * work) ** 0.5) - 1
    size = F.octet_length("body")
    done = short_texts(rows.where(size <= longest)).unionByName(long_texts(rows.where(size > longest), work))
    return done.select("doc_id", "n_words", "runs", F.col("kept").cast("string").alias("text"))
