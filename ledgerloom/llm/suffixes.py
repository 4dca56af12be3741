"""Exact substring dedup over bytes: shared strings are found by suffix arrays of shards, sorted by induction."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ledgerloom.llm.common import discard, documents_of, materialize, small_batches

#: Strings of LENGTH bytes; a gram of GRAM bytes stands for each, the least of WIDTH neighbours.
LENGTH, GRAM = 100, 32
WIDTH = LENGTH - GRAM + 1
#: Bytes on one side of a gram that every window holds at least: HALF of them, or one more on the other side.
HALF = WIDTH // 2
#: Bytes of texts that are hashed together (their arrays stay in a core's cache), places that are compared at once, and bytes of a shard.
BLOCK, CHUNK, SHARD_BYTES = 1 << 18, 1 << 16, 1 << 20
#: Bytes of contexts that are cut out at once.
MOST = 1 << 22
#: A core with more different contexts than fill a shard is split by longer cores.
HOT = SHARD_BYTES // (2 * LENGTH)
#: Texts of more letters are sorted by doubling, with the same result.
SCALAR_FROM = 1024


# --- suffix arrays -------------------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one."""
    step = np.sign(np.diff(s))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[nearest] > 0, True)


def _induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes, sorted from the leftmost-smaller ones in the given order within each first letter."""
    letters = s[seeds]
    order = np.argsort(letters, kind="stable")
    seeds, cuts = seeds[order], np.searchsorted(letters[order], np.arange(sigma + 1))
    larger_of: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    smaller_of: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def deal(found: np.ndarray, to: list[list[np.ndarray]], c: int, want: bool) -> np.ndarray:
        """Put the suffixes one letter longer, of the wanted type, into their buckets; those of bucket c come back."""
        longer = found[found > 0] - 1
        longer = longer[smaller[longer] == want]
        first = s[longer]
        own = first == c
        rest, letter = longer[~own], first[~own]
        if len(rest):
            by = np.argsort(letter, kind="stable")
            rest, letter = rest[by], letter[by]
            cut = np.flatnonzero(np.diff(letter)) + 1
            for part, d in zip(np.split(rest, cut), letter[np.append(0, cut)].tolist()):
                to[d].append(part)
        return longer[own]

    done = []
    for c in range(sigma):
        front, all_ = np.concatenate(larger_of[c]) if larger_of[c] else seeds[:0], []
        while len(front):
            all_.append(front)
            front = deal(front, larger_of, c, False)
        done.append(np.concatenate(all_) if all_ else seeds[:0])
        deal(seeds[cuts[c] : cuts[c + 1]], larger_of, c, False)
    out = []
    for c in range(sigma - 1, -1, -1):
        front, all_ = np.concatenate(smaller_of[c]) if smaller_of[c] else seeds[:0], []
        if c == 0:  # the end mark, which no induction finds
            front = np.array([len(s) - 1])
        while len(front):
            all_.append(front)
            front = deal(front, smaller_of, c, True)
        deal(done[c][::-1], smaller_of, c, True)
        out += [*[x[::-1] for x in all_], done[c]]
    return np.concatenate(out[::-1])


def _doubled(s: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: what is still equal in ``size`` letters is told apart by the ranks ``size`` further on.

    For reduced texts, whose letters are too many to be dealt into buckets one by one. A rank is the first row of its
    equals, so rows that are alone keep theirs and take no part any more. Contexts are short, so rounds are few.
    """
    n = len(s)
    sa = np.argsort(s)
    key, live, rank, size = s[sa].astype(np.int64), np.arange(n), np.zeros(n, np.int64), 1
    while True:
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(np.append(starts, len(live)))
        rank[sa[live]] = np.repeat(live[starts], counts)
        live = live[np.repeat(counts > 1, counts)]
        if not len(live):
            return sa
        # Suffixes that share their first letters do not reach the end, whose letter is nowhere else.
        at = sa[live]
        key = rank[at] * n + rank[at + size]
        by = np.argsort(key)
        sa[live], key = at[by], key[by]
        size *= 2


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array by induced sorting of letters 0 to sigma - 1; the last one is 0 and occurs nowhere else."""
    if sigma > SCALAR_FROM:
        return _doubled(s)
    smaller = _types(s)
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(left) < 2:
        return _induce(s, smaller, left, sigma)
    sa = _induce(s, smaller, left, sigma)
    is_left = np.zeros(len(s), bool)
    is_left[left] = True
    by = sa[is_left[sa]]
    # Equal neighbours among the sorted substrings, each up to the next leftmost-smaller place, share a name.
    ends = np.zeros(len(s), np.int64)
    ends[left] = np.append(left[1:], len(s) - 1)
    sizes = ends[by] - by + 1
    equal = np.flatnonzero(sizes[1:] == sizes[:-1])
    same = np.zeros(len(by), bool)
    if len(equal):
        k = sizes[equal]
        starts = np.cumsum(k) - k
        inner = np.arange(k.sum()) - np.repeat(starts, k)
        same[equal + 1] = np.logical_and.reduceat(s[np.repeat(by[equal], k) + inner] == s[np.repeat(by[equal + 1], k) + inner], starts)
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < len(by):
        name = np.zeros(len(s), np.int64)
        name[by] = names
        by = left[suffix_array(name[left], int(names[-1]) + 1)]
    return _induce(s, smaller, by, sigma)


def permuted_lcp(data: np.ndarray, sa: np.ndarray, at: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place in ``at`` the bytes it shares with its predecessor in ``sa``, up to ``most``.

    In text order (permuted), eight bytes at a step. ``data`` has ``most + 8`` bytes to spare behind every place.
    """
    before = np.zeros(len(data), np.int64)
    before[sa[1:]] = sa[:-1]
    eights = np.zeros(len(data), np.uint64)
    for k in range(8):
        eights[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for k in range(0, most, 8):
        x = eights[at[live] + k] ^ eights[before[at[live]] + k]
        low = x & (~x + np.uint64(1))
        shared = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        out[live] = k + shared
        live = live[x == 0]
    return np.minimum(out, most)


def later_windows(contexts: list[bytes], order: np.ndarray) -> list[np.ndarray]:
    """Per context the starts of its LENGTH-byte windows that an earlier window of any context equals.

    ``order``: for each context the rank of its first window; windows of one context follow on.
    """
    counts = np.array([len(c) - LENGTH + 1 for c in contexts])
    data = np.frombuffer(b"\0".join(contexts) + b"\0" * (LENGTH + 16), np.uint8)
    first = np.cumsum([0, *[len(c) + 1 for c in contexts[:-1]]])
    text = data.astype(np.int64) + 2
    text[(first + [len(c) for c in contexts])] = 1
    end = int(first[-1]) + len(contexts[-1]) + 1
    text = np.append(text[:end], 0)
    sa = suffix_array(text, 258)
    sa = sa[sa < end]
    at = np.repeat(first, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    rank = np.repeat(order, counts) + (at - np.repeat(first, counts))
    shared = np.zeros(len(data), np.int64)
    shared[at] = permuted_lcp(data, sa, at)
    ranks = np.full(len(data), -1)
    ranks[at] = rank
    group = np.cumsum(shared[sa] < LENGTH)
    is_window = ranks[sa] >= 0
    places, group = sa[is_window], group[is_window]
    starts = np.flatnonzero(np.append(True, np.diff(group) != 0))
    least = np.repeat(np.minimum.reduceat(ranks[places], starts), np.diff(np.append(starts, len(places))))
    later = np.zeros(len(data), bool)
    later[places[ranks[places] > least]] = True
    return [np.flatnonzero(later[a : a + n]) for a, n in zip(first, counts)]


# --- anchors -------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every place on: a polynomial by doubling, then mixed."""
    h = data.astype(np.uint64)
    h += np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    size, factor = 1, 0x94D049BB133111EB
    while size < GRAM:
        further = h[size:]
        h = h[:-size] * np.uint64(factor)
        h += further
        factor = factor * factor % (1 << 64)
        size *= 2
    for shift in (29, 32):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def window_minima(h: np.ndarray) -> np.ndarray:
    """For each place the index of the least of the WIDTH values from it on, by their upper halves, the rightmost on ties."""
    low = np.uint64(0xFFFFFFFF)
    best, size = h & ~low, 1
    best |= low - np.arange(len(h), dtype=np.uint64)
    while size * 2 <= WIDTH:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < WIDTH:
        best = np.minimum(best[: size - WIDTH], best[WIDTH - size :])
    return (low - (best & low)).astype(np.int64)


ANCHORS = "gram long, left int, right int, doc_id long, text_hash long, at int, n int, lead int"
PLACES = "doc_id long, text_hash long, core long, at int, n int, lead int"
CONTEXTS = "doc_id long, text_hash long, core long, at int, n int, lead int, size int, n_contexts long, key binary, context binary"
SPANS = "doc_id long, text_hash long, start long, end long"


def _mixed(*hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(docs: DataFrame) -> DataFrame:
    """Windows ``at`` to ``at + n - 1`` of a text select the same gram, which starts ``lead`` bytes after ``at``.

    Equal windows of LENGTH bytes select equal grams at equal places, so a string that occurs twice has a gram
    that occurs twice. ``left`` and ``right`` are hashes of the gram with HALF bytes before it and HALF + 1 behind it; every
    window holds one of the two.
    """
    small_batches(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        block, size = [], 0
        for batch in batches:
            for doc_id, text, text_hash in zip(*(batch.column(i) for i in range(3))):
                data = text.as_py().encode()
                if len(data) >= LENGTH:
                    block.append((doc_id.as_py(), text_hash.as_py(), data))
                    size += len(data)
                if size >= BLOCK:
                    yield block
                    block, size = [], 0
        if block:
            yield block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sizes = np.array([len(x[2]) for x in block])
            first = np.cumsum(sizes) - sizes
            h = gram_hashes(np.frombuffer(b"".join(x[2] for x in block), np.uint8))
            chosen = window_minima(h)
            doc = np.repeat(np.arange(len(block)), sizes)[: len(chosen)]
            place = np.arange(len(chosen)) - first[doc]
            inside = place <= sizes[doc] - LENGTH
            new = inside.copy()
            new[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
            starts = np.flatnonzero(new)
            ends = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False))
            owner, gram = doc[starts], chosen[starts]
            # Places beyond the block's ends belong to no window, so what is hashed for them does not matter.
            near = lambda k: h[np.clip(gram + k, 0, len(h) - 1)]  # noqa: E731,B023
            left, right = _mixed(near(-HALF), near(-HALF + GRAM), near(0)), _mixed(near(0), near(GRAM), near(HALF + 1))
            columns = [
                pa.array(h[gram].view(np.int64)), pa.array(left), pa.array(right), pa.array([x[0] for x in block], pa.int64()).take(pa.array(owner)), pa.array([x[1] for x in block], pa.int64()).take(pa.array(owner)),
                pa.array(place[starts].astype(np.int32)), pa.array((ends - starts + 1).astype(np.int32)), pa.array((gram - starts).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ANCHORS.split(", ")])

    return docs.mapInArrow(run, ANCHORS)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeated_places(found: DataFrame) -> DataFrame:
    """The windows of :func:`anchors` whose longer half, the gram with its left or right neighbours, may occur again.

    Only a filter, so places may be kept in vain, but none that matters is dropped. Places are dealt out in order of
    their grams, those of a frequent gram over several tasks, and read as a sorted stream. A gram at the edge of a
    task, and one with over CHUNK places there, keeps all its places, since the others are not in sight.
    """

    def kept(t: pa.Table, edges: set[int]) -> pa.RecordBatch | None:
        gram, left, right, at, n, lead = (t.column(c).to_numpy() for c in ("gram", "left", "right", "at", "n", "lead"))
        same = gram[1:] == gram[:-1]
        again = np.append(False, same) | np.append(same, False)
        edge = np.isin(gram, np.fromiter(edges, np.int64))
        halves = []
        for own, has in ((left, lead >= HALF), (right, lead - n + 1 < HALF)):
            good = np.flatnonzero(again & has)
            ok = edge & has
            key = gram[good].view(np.uint64) ^ (own[good].view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ok[good[_repeated(key)]] = True
            halves.append(ok)
        some = np.flatnonzero(halves[0] | halves[1])
        if not len(some):
            return None
        in_left, in_right = halves[0][some], halves[1][some]
        skip = np.where(in_left, 0, np.maximum(0, lead[some] - HALF + 1))
        stop = np.where(in_right, n[some], np.minimum(n[some], lead[some] - HALF + 1))
        own = t.take(pa.array(some))
        columns = [own.column("doc_id").combine_chunks(), own.column("text_hash").combine_chunks(), own.column("gram").combine_chunks(), *(pa.array(x.astype(np.int32)) for x in (at[some] + skip, stop - skip, lead[some] - skip))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PLACES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, edges = [], 0, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            if not edges:
                edges.add(batch.column(0)[0].as_py())
            held.append(batch)
            size += batch.num_rows
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            whole = int(np.searchsorted(gram, gram[-1]))
            if not whole:
                edges.add(int(gram[-1]))
                whole = len(gram)
            if (out := kept(table.slice(0, whole), edges)) is not None:
                yield out
            held = table.slice(whole).to_batches()
            size = len(gram) - whole
        if size:
            table = pa.Table.from_batches(held)
            edges.add(table.column("gram")[-1].as_py())
            if (out := kept(table, edges)) is not None:
                yield out

    return found.repartitionByRange("gram", "doc_id", "at").sortWithinPartitions("gram").mapInArrow(run, PLACES)


def _same_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})


def contexts(docs: DataFrame, places: DataFrame, whole: bool) -> DataFrame:
    """``places`` with the 128-bit key of the bytes that their windows cover, and, if ``whole``, these bytes themselves.

    The core of a place is its gram. Texts meet their places once; a key is a fifth of what the bytes need.
    """
    lists = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("core", "at", "n", "lead", "n_contexts")).alias("own"))
    joined = docs.dropDuplicates(["doc_id", "text_hash"]).join(_renamed(lists), _same_document()).select("doc_id", "text_hash", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(3)
            offsets = places.offsets.to_numpy()
            core, at, n, lead, n_contexts = (places.values.field(k) for k in range(5))
            starts, stops = at.to_numpy(), at.to_numpy() + n.to_numpy() + (LENGTH - 1)
            reach = np.append(0, np.cumsum(stops - starts, dtype=np.int64))
            row = 0
            while row < batch.num_rows:
                # Rows whose contexts are MOST bytes together, one row at least.
                stop = max(row + 1, int(np.searchsorted(reach[offsets], reach[offsets[row]] + MOST, side="right")) - 1)
                cut = []
                for k in range(row, stop):
                    data, own = batch.column(2)[k].as_py().encode(), slice(offsets[k], offsets[k + 1])
                    cut += [data[a:b] for a, b in zip(starts[own].tolist(), stops[own].tolist())]
                part = [x.slice(offsets[row], len(cut)) for x in (core, at, n, lead)]
                take = pa.array(np.repeat(np.arange(row, stop), np.diff(offsets[row : stop + 1])))
                size = pa.array(np.full(len(cut), GRAM, np.int32))
                keys = pa.nulls(len(cut), pa.binary()) if whole else pa.array([xxh3_128_digest(c) for c in cut], pa.binary())
                found = pa.array(cut, pa.binary()) if whole else pa.nulls(len(cut), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *part, size, n_contexts.slice(offsets[row], len(cut)), keys, found], [x.split()[0] for x in CONTEXTS.split(", ")])
                row = stop

    return joined.mapInArrow(run, CONTEXTS)


def longer_cores(spread: DataFrame) -> DataFrame:
    """Every context in two, by the side on which its windows reach further beyond the core, with cores longer by that side's bytes.

    Equal windows keep equal cores. After seven steps at most a core is a whole window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CONTEXTS.split(", ")]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rest, lead, n, c = LENGTH - row["size"], row["lead"], row["n"], bytes(row["context"])
                half = (rest + 1) // 2
                skip = max(0, lead - half + 1)
                parts = [(0, min(n, skip), lead - half, row["size"] + half), (skip, n, lead - skip, row["size"] + rest - half + 1)] if rest else [(0, n, lead, LENGTH)]
                for a, b, first, size in parts:
                    if b > a:
                        own = c[a : b + LENGTH - 1]
                        out.append(row | {"at": row["at"] + a, "n": b - a, "lead": first, "size": size, "core": xxh3_64_intdigest(own[first : first + size]) - (1 << 63), "key": xxh3_128_digest(own), "context": own})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([(x, batch.schema.field(x).type) for x in names]))

    return spread.mapInArrow(run, CONTEXTS)


def _sorted_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """Spans of a shard's contexts that come earlier elsewhere in it."""
    shard = shard.sort_values(["doc_id", "text_hash", "at"], na_position="first", kind="stable").reset_index(drop=True)
    document = shard.groupby(["doc_id", "text_hash"], dropna=False, sort=False).ngroup().to_numpy()
    later = later_windows([bytes(c) for c in shard["context"]], document.astype(np.int64) * (1 << 40) + shard["at"].to_numpy())
    rows, starts, ends = [], [], []
    for k, (found, at) in enumerate(zip(later, shard["at"].to_numpy())):
        if len(found):
            cut = np.flatnonzero(np.diff(found) > 1)
            a, b = found[np.append(0, cut + 1)], found[np.append(cut, len(found) - 1)]
            rows += [k] * len(a)
            starts.append(a + at)
            ends.append(b + at + LENGTH)
    none = np.empty(0, np.int64)
    return pd.DataFrame({"doc_id": shard["doc_id"].iloc[rows].astype("Int64").to_numpy(dtype=object, na_value=None), "text_hash": shard["text_hash"].iloc[rows].to_numpy(), "start": np.concatenate(starts) if starts else none, "end": np.concatenate(ends) if ends else none})


def repeated_spans(docs: DataFrame) -> list[DataFrame]:
    """Written tables ``doc_id, text_hash, start, end``: bytes of ``docs(doc_id, text, text_hash)`` in strings that start earlier too.

    Places whose longer half occurs once are dropped. Places whose whole context is equal are one before anything is
    sorted: all but the first are repeated throughout; their keys tell, and only what is left is read from the texts
    again. The different contexts of a core go to one shard, whose suffix array and permuted common prefixes give the
    classes of equal windows. Only a core that has over ``HOT`` of them, which fill a shard, is split by longer cores, and
    its parts take their turn again, so no shard grows with a hot string.
    """
    found = materialize(anchors(docs))
    places = materialize(repeated_places(found))
    discard(found)
    spread = materialize(contexts(docs, places.withColumn("n_contexts", F.lit(0).cast("long")), False))
    discard(places)
    place = F.struct("doc_id", "text_hash", "at")
    out, names = [], [x.split()[0] for x in CONTEXTS.split(", ")]
    for level in itertools.count():
        first = materialize(spread.groupBy("key").agg(F.min("core").alias("core"), F.min(place).alias("first"), F.count("*").alias("n_places")))
        many = first.where("n_places > 1").select("key", "first")
        copies = spread.drop("context").join(many, "key").where(place > F.col("first"))
        out.append(materialize(copies.select("doc_id", "text_hash", F.col("at").cast("long").alias("start"), (F.col("at") + F.col("n") + LENGTH - 1).cast("long").alias("end"))))
        shared = materialize(first.groupBy("core").agg(F.count("*").alias("n_contexts")).where("n_contexts > 1"))
        chosen = first.join(shared, "core").select("key", "first", "n_contexts")
        unlike = materialize(spread.drop("n_contexts").join(chosen, "key").where(place == F.col("first")).select(*names))
        for done in (spread, first, shared):
            discard(done)
        if not level:
            unlike, few = materialize(contexts(docs, unlike, True)), unlike
            discard(few)
        cold = unlike.where(F.col("n_contexts") <= HOT)
        n_shards = max(1, -(-(cold.agg(F.sum(F.length("context"))).first()[0] or 0) // SHARD_BYTES))
        shards = cold.withColumn("shard", F.pmod(F.xxhash64("core"), F.lit(n_shards))).select("shard", "doc_id", "text_hash", "at", "context")
        out.append(materialize(shards.groupBy("shard").applyInPandas(_sorted_shard, SPANS)))
        hot = unlike.where(F.col("n_contexts") > HOT)
        if hot.isEmpty():
            discard(unlike)
            return out
        spread = materialize(longer_cores(hot))
        discard(unlike)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of runs, as apart runs in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1])) if len(starts) else np.empty(0, np.int64)
    return starts[new], reach[np.append(new[1:] - 1, len(reach) - 1)] if len(new) else reach


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: every row's removed byte runs (start, end) and its remaining bytes.

    A byte goes if a LENGTH-byte string that covers it starts earlier too: in a smaller doc_id (nulls first, then
    by text hash), or further up in the same text. Matches stay within texts; null texts are empty. Rows
    equal in id and text are one document: each loses the same bytes and neither is earlier. An empty table gives an
    empty one; other columns of ``docs`` are not read.
    """
    rows = documents_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    spans = functools.reduce(DataFrame.unionByName, repeated_spans(rows))
    lists = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(_renamed(lists), _same_document(), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, firsts, lasts, counts, kept = [], [], [], [0], []
            for text, own in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                sizes.append(len(data))
                a = b = np.empty(0, np.int64)
                if own.is_valid:
                    a, b = merged(*(own.values.field(k).to_numpy() for k in range(2)))
                edges = [0, *np.column_stack((a, b)).ravel().tolist(), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2])) if len(a) else data)
                firsts.append(a)
                lasts.append(b)
                counts.append(counts[-1] + len(a))
            runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (firsts, lasts)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), runs), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
