"""Quality classifier: hashed word and character n-gram vectors averaged per document, softmax output.

Trained by plain stochastic gradient descent in numpy on a bounded sample of labelled documents. After
training a feature counts only through the difference it makes to the two outputs, so scoring needs one
number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents_of


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled documents that are brought to the driver and fitted."""

    buckets: int = 1 << 18
    dims: int = 16
    min_gram: int = 3
    max_gram: int = 5
    epochs: int = 5
    rate: float = 0.5
    max_rows: int = 4000
    threshold: float = 0.3
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    """Whether the row's label is kept for testing: CRC-32 of the id as text is a multiple of 5 (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def word_features(word: str, settings: Settings) -> list[int]:
    """Buckets of the word and of its character n-grams between word marks."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(settings.min_gram, settings.max_gram + 1) for i in range(len(marked) - n + 1)]
    return [crc32(g.encode()) % settings.buckets for g in (word, *grams)]


def document_features(text: str, settings: Settings, memo: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, which sum to 1."""
    out: list[int] = []
    for w in text.split():
        if (known := memo.get(w)) is None:
            known = memo[w] = word_features(w, settings)
        out += known
    ids, counts = np.unique(np.array(out, np.int64), return_counts=True)
    return ids, counts / max(1, counts.sum())


@dataclass
class Model:
    """``weight`` of each bucket and ``bias``: log-odds of label 1 are the bias plus the mean weight of a text's features."""

    weight: np.ndarray
    bias: float
    settings: Settings


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    """Train on whole texts. Without labels of both kinds every score is the share of label 1 (a half if none)."""
    if len(set(labels)) < 2:
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        return Model(np.zeros(settings.buckets), float(np.log(share / (1 - share))), settings)
    random = np.random.default_rng(settings.seed)
    vectors = random.uniform(-1 / settings.dims, 1 / settings.dims, (settings.buckets, settings.dims)).astype(np.float32)
    output, bias = np.zeros((2, settings.dims), np.float32), np.zeros(2, np.float32)
    memo: dict[str, list[int]] = {}
    rows = [(*document_features(t, settings, memo), y) for t, y in zip(texts, labels)]
    step, steps = 0, settings.epochs * len(rows)
    for _ in range(settings.epochs):
        for k in random.permutation(len(rows)):
            ids, share, y = rows[k]
            rate = np.float32(settings.rate * (1 - step / steps))
            step += 1
            share = share.astype(np.float32)
            hidden = share @ vectors[ids] if len(ids) else np.zeros(settings.dims, np.float32)
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ output
            output -= rate * np.outer(p, hidden)
            bias -= rate * p
            if len(ids):
                # Features are averaged, so a share of the gradient reaches each; the factor keeps long texts learning.
                vectors[ids] -= rate * np.outer(share * len(ids), back).clip(-1, 1)
    return Model((vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0]), settings)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``max_rows`` labelled, not held-out documents, chosen by a hash of the id."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(settings.seed)), "doc_id").limit(settings.max_rows)
    rows = documents_of(docs).join(F.broadcast(own), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.label for r in rows]


class _Scores(dict):
    """Word to (sum of its features' weights) + (their number) * i, so that one sum adds up both."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: str) -> complex:
        ids = word_features(word, self.model.settings)
        value = complex(float(self.model.weight[ids].sum()), len(ids))
        if len(word) < 60:
            if len(self) >= 300_000:
                self.clear()
            self[word] = value
        return value


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row's whole text; texts without a word get the bias's score.

    The model is broadcast: ``buckets`` numbers, whatever the input. Nothing is shuffled; null ids and
    repeated rows stay, null texts are empty, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, bias = _Scores(shared.value), shared.value.bias
        for batch in batches:
            sums = [sum(map(scores.__getitem__, t.split())) for t in batch.column(1).to_pylist()]
            means = np.array([bias + (x.real / x.imag if x else 0.0) for x in sums])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-means.clip(-500, 500))))], ["doc_id", "score"])

    out = documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"))
