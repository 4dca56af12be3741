"""Lexical and vector retrieval, rank fusion, floors and similarity."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import written
from ledgerloom.operators.relational import top_per_group

K1, B, FUSION = 1.2, 0.75, 60
BROADCAST_ROWS = 20_000


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast only what is counted to be small; larger sides are left to the planner."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length; an error if they differ in size."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast("double")).otherwise(value)


def label(similarity: Column) -> Column:
    return F.when(similarity >= 0.8, "duplicate").when(similarity >= 0.78, "overlap").when(similarity >= 0.65, "related")


#: Queries and vectors that meet in one task at most, tasks that fewer are cut into, and queries that are multiplied at once.
QUERY_CELL, ITEM_CELL, CELLS, SLICE = 32_768, 65_536, 32, 4096


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``query, item, score, rank`` of the nearest of ``corpus(item, vector)`` to each of ``queries(query, vector)``, ids being longs.

    The cosine is rounded to six places; 0 where a vector has no length, null (last) where one is null, has a null or another size. Ties go
    by item. Every block of queries meets every part of the corpus in one task, as a product of matrices, and keeps its own k best
    there, so what is shuffled does not grow with the pairs. Of equal vectors only the first k + 1 can be among the k best.
    """
    few = top_per_group(corpus.where("item IS NOT NULL"), ["vector"], k + 1, F.col("item")).select("item", "vector")
    asked = queries.where("query IS NOT NULL")
    blocks = max(1, -(-asked.count() // QUERY_CELL))
    n = corpus.count()
    parts = max(-(-n // ITEM_CELL), min(-(-CELLS // blocks), -(-n // 256)), 1)
    size = F.when(F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull()), -1).otherwise(F.size("vector")).alias("size")
    place = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    left = asked.select("query", F.col("vector").alias("x"), size, place("query", blocks).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"))
    right = few.select("item", F.col("vector").alias("y"), size, place("item", parts).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"))

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not (len(x) and len(y)):
            return pd.DataFrame({"query": [], "item": [], "score": [], "kind": []})
        return pd.concat([_nearest(x[at : at + SLICE], y, k) for at in range(0, len(x), SLICE)])

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(near, "query long, item long, score double, kind int")
    score = F.when(F.col("kind") == 2, float("nan")).when(F.col("kind") == 0, F.round("score", 6))
    return top_per_group(met.select("query", "item", score.alias("score")), ["query"], k, F.desc("score"), F.col("item"))


def _nearest(queries: pd.DataFrame, items: pd.DataFrame, k: int, step: int = 512) -> pd.DataFrame:
    """Of a block of ``queries(query, x, size)`` and a part of ``items(item, y, size)``, x and y vectors, the k best items of each query: ``query, item, score, kind`` (1 for a null score, 2 for NaN).

    A product of matrices tells which items can be among the k best so far; only their cosines are summed in order, as :func:`cosine` does.
    """
    out = []
    for size, own in queries.groupby("size"):
        other = np.sort(items["item"].to_numpy()[(items["size"] != size).to_numpy() | (size < 0)])[: k + 1]
        same = items[items["size"] == size] if size >= 0 else items[:0]
        q, c = (np.stack(v.to_numpy()).astype(float) if len(v) and size > 0 else np.zeros((len(v), 0)) for v in (own["x"], same["y"]))
        qid, cid = own["query"].to_numpy(), same["item"].to_numpy()
        (q_unit, q_norm), (c_unit, c_norm) = _units(q), _units(c)
        row, item, score, units = _pairs(len(qid), other)
        keep = qid[row] != item
        best = [row[keep], item[keep], score[keep], units[keep]]
        floor, pool, held = np.full(len(qid), -np.inf), [best], 0
        for at in range(0, len(cid), step):
            close = q_unit @ c_unit[at : at + step].T
            if at == 0 and close.shape[1] > k + 1:
                floor = np.partition(np.where(np.isnan(close), -np.inf, close), -k - 1, axis=1)[:, -k - 1] - 2e-6
            x, y = np.nonzero(~(close < floor[:, None]))
            y += at
            keep = qid[x] != cid[y]
            x, y = x[keep], y[keep]
            score = _cosines(q, q_norm, c, c_norm, x, y)
            pool.append([x, cid[y], score, _millionths(score)])
            held += len(x)
            if held > len(qid) * k:
                best, floor = _best(pool, len(qid), k, floor)
                pool, held = [best], 0
        row, item, score, units = _best(pool, len(qid), k, floor)[0]
        out.append(pd.DataFrame({"query": qid[row], "item": item, "score": np.where(np.isnan(score), 0.0, score), "kind": np.where(units == _NULL, 1, np.where(units == _NAN, 2, 0))}))
    return pd.concat(out)


#: Units of a score: millionths, and what orders null after every score and NaN before.
_NULL, _NAN = -(1 << 60), 1 << 60


def _pairs(n: int, items: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every of ``n`` queries with every item, scoreless."""
    size = n * len(items)
    return np.repeat(np.arange(n), len(items)), np.tile(items, n), np.full(size, np.nan), np.full(size, _NULL)


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 (0 if they have none, NaN where the product would be far from the sum in order) and lengths, summed in order."""
    square = np.zeros(len(v))
    with np.errstate(all="ignore"):
        for d in range(v.shape[1]):
            square += v[:, d] * v[:, d]
        norm = np.sqrt(square)
        plain = (norm == 0) & ~v.any(axis=1) | (norm > 1e-100) & (norm < 1e100)
        return np.where(plain[:, None], v / np.where(norm == 0, 1, norm)[:, None], np.nan), norm


def _cosines(q: np.ndarray, q_norm: np.ndarray, c: np.ndarray, c_norm: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for d in range(q.shape[1]):
            total += q[x, d] * c[y, d]
        norms = q_norm[x] * c_norm[y]
        return np.where(norms == 0, 0.0, total / np.where(norms == 0, 1, norms))


def _millionths(score: np.ndarray) -> np.ndarray:
    """Scores in millionths, rounded half up as decimals, which is what ``round`` does."""
    y = np.abs(np.nan_to_num(score, nan=0.0)) * 1e6
    units = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        units[i] = int(Decimal(repr(abs(float(score[i])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(score), _NAN, np.where(score < 0, -units, units).astype(np.int64))


def _best(pool: list, n: int, k: int, floor: np.ndarray) -> tuple[list, np.ndarray]:
    """The k best of each query of a pool, and what a close product must reach to be among them."""
    row, item, score, units = (np.concatenate(x) for x in zip(*pool))
    order = np.lexsort((item, -units, row))
    row, item, score, units = row[order], item[order], score[order], units[order]
    starts = np.searchsorted(row, np.arange(n))
    place = np.arange(len(row)) - starts[row]
    full = place == k - 1
    floor = floor.copy()
    last = units[full]
    floor[row[full]] = np.maximum(floor[row[full]], np.where(last == _NULL, -np.inf, np.where(last == _NAN, -np.inf, last * 1e-6 - 2e-6)))
    keep = place < k
    return [row[keep], item[keep], score[keep], units[keep]], floor


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, item, score`` of ``docs(item, tokens)`` for ``queries(query, tokens)``; any shared token is enough.

    Documents are read once: their lengths, and the counts of tokens that some query has, are written, and document
    frequencies come from these. Only tokens of a query are ever shuffled.
    """
    asked = written(queries.select("query", F.explode(F.array_distinct("tokens")).alias("token")))
    known = small_side(asked.select("token").distinct())
    each = docs.select("item", F.size("tokens").alias("size"), F.explode_outer("tokens").alias("token"))
    tf = written(each.join(known.withColumn("known", F.lit(True)), "token", "left").groupBy("item", "size", F.when(F.col("known"), F.col("token")).alias("token")).agg(F.count("*").alias("tf")))
    stats = tf.groupBy("item").agg(F.first("size").alias("size")).agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    hits = tf.where("token IS NOT NULL")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    weighed = hits.join(df, "token").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = weighed.select("item", "token", part.alias("part"))
    return scored.join(small_side(asked), "token").groupBy("query", "item").agg(F.sum("part").alias("score"))


def fuse(*ranked: DataFrame, k: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of ``(query, item, rank)`` lists."""
    every = ranked[0].select("query", "item", "rank")
    for other in ranked[1:]:
        every = every.unionByName(other.select("query", "item", "rank"))
    return every.groupBy("query", "item").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"))


def similar_pairs(vectors: DataFrame, least: float, cell: int) -> DataFrame:
    """``a, b`` (a < b) of ``vectors(scope, id, vector)`` within a scope whose cosine is ``least`` or more.

    A scope is cut into parts of about ``cell`` vectors; every two parts meet in one task, as a product of two matrices.
    """
    sizes = vectors.groupBy("scope").agg(F.ceil(F.count("*") / cell).cast("int").alias("n"))
    placed = vectors.join(sizes, "scope").withColumn("i", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    met = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = met.select("scope", "id", "vector", F.col("i").alias("own"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = np.vstack(rows["vector"].to_numpy()).astype(float)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix /= np.where(norms == 0, 1, norms)
        ids, own = rows["id"].to_numpy(), rows["own"].to_numpy()
        one, two = np.flatnonzero(own == rows["i"].iloc[0]), np.flatnonzero(own == rows["j"].iloc[0])
        x, y = np.nonzero(matrix[one] @ matrix[two].T >= least)
        a, b = ids[one[x]], ids[two[y]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        return pd.DataFrame({"a": low[low < high], "b": high[low < high]}).drop_duplicates()

    return cells.groupBy("scope", "i", "j").applyInPandas(near, "a long, b long")


def cache_replay(rows: DataFrame, least: float, cell: int = 1024) -> DataFrame:
    """``vec_id, hit``: every row of ``rows(scope, vec_id, embedding)`` in id order against those its scope stored before.

    A row is a hit if a stored one is similar enough, else it is stored. Equal vectors are one, as all but the first hit.
    Then rows settle in rounds: stored if every similar earlier row is a hit, a hit if one of these is stored. A round is
    a join and a count of what is still open; each is written before the next.
    """
    keyed = written(rows.select("scope", "vec_id", F.col("embedding").alias("vector"), F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256).alias("digest")))
    first = written(keyed.groupBy("scope", "digest").agg(F.min("vec_id").alias("vec_id")))
    nodes = keyed.join(first, ["scope", "digest", "vec_id"], "left_semi").select("scope", F.col("vec_id").alias("id"), "vector")
    edges = written(similar_pairs(nodes, least, cell).distinct())
    stored = written(nodes.select("id").join(edges.select(F.col("b").alias("id")), "id", "left_anti"))
    while True:
        hits = written(edges.join(stored.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        open_ = nodes.select("id").join(stored, "id", "left_anti").join(hits, "id", "left_anti")
        waits = edges.join(hits.withColumnRenamed("id", "a"), "a", "left_anti").select(F.col("b").alias("id"))
        more = written(open_.join(waits, "id", "left_anti"))
        if more.isEmpty():
            break
        stored = written(stored.unionByName(more))
    own = keyed.select("vec_id").join(stored.select(F.col("id").alias("vec_id"), F.lit(False).alias("hit")), "vec_id", "left")
    return own.select("vec_id", F.coalesce("hit", F.lit(True)).alias("hit"))


def relevance_floor(hits: DataFrame, floor: float) -> DataFrame:
    """Drop hits whose dense score is below the floor; keyword-only ones (null) stay if some dense hit of the query clears it."""
    clears = F.max(F.coalesce(F.col("dense") >= floor, F.lit(False))).over(Window.partitionBy("query"))
    return hits.withColumn("_c", clears).where((F.col("dense") >= floor) | (F.col("dense").isNull() & F.col("_c"))).drop("_c")
