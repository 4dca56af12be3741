"""N-gram Jaccard join by T-occurrence search: documents meet over an inverted index, DivideSkip decides which are alike.

A document is the set of its 5-word shingles. Two of similarity 0.8 share four fifths of the larger one (T), so they share ``slack``
shingles of the least ``size - T + slack`` of each by hash: only these are indexed. Lists of over ``LONG`` documents are skipped as
far as the slack lets them be, so a passage that very many documents hold brings none of them together.
Documents that meet are put into cells of bounded size, in which every one is searched for in an inverted index of whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import merge
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerloom.llm.common import connected_components, discard, documents_of, materialize, small_batches

SHINGLE = 5
#: Links need a similarity of NEAR / OF.
NEAR, OF = 4, 5
#: One more shingle is indexed, and one more long list can be skipped, for every so many shingles of a set.
SLACK = 8
#: Lists of more documents are long. They are skipped where possible; the others are met in cells.
LONG = 32
#: Shingles of a cell, about. It changes no result.
CELL = 1 << 20
#: What says which texts go to which cells is broadcast up to so many bytes; a row takes MEMBER_BYTES at most.
BROADCAST_BYTES, MEMBER_BYTES = 16 << 20, 120


def shingle_hashes(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the text's 5-word shingles (fewer words: one of them all; none: none), in order."""
    words = text.lower().split()  # of bytes, both know ASCII only
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64).view(np.int64)
    own = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(own) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ own[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def required(size: Column | int) -> Column | int:
    """Shingles that a set of this size shares with any one like it, at least: four fifths, rounded up."""
    return (NEAR * size + OF - 1) // OF if isinstance(size, int) else F.floor((size * NEAR + (OF - 1)) / OF).cast("int")


def slack(size: Column | int) -> Column | int:
    """Shingles of its index part that a set of this size shares with any one like it that is no smaller, at least."""
    return 1 + size // SLACK if isinstance(size, int) else F.floor(size / SLACK).cast("int") + 1


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, digest, size, part``: a digest of each row's set, its size and its index part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, parts = [], [], []
            for text in batch.column(2):
                own = shingle_hashes(text.as_py())
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(own))
                parts.append(own[: max(0, len(own) - required(len(own)) + slack(len(own)))] if len(own) else own)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.array([], np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists], ["doc_id", "text_key", "digest", "size", "part"])

    return docs.select("doc_id", "text_key", "body").mapInArrow(run, "doc_id long, text_key binary, digest binary, size int, part array<long>")


def divide_skip(lists: list[np.ndarray], least: int, skip: int) -> list[int]:
    """Members of ``least`` of the sorted lists at least: DivideSkip.

    The ``skip`` longest lists (fewer than ``least``) are set aside and the others merged by a heap; members that the merge
    gives ``least - skip`` times are looked up in the long lists by binary search until they have enough or cannot.
    """
    lists = sorted(lists, key=len)
    skip = max(0, min(skip, least - 1, len(lists)))
    short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
    met = [(d, n) for d, n in ((d, sum(1 for _ in g)) for d, g in groupby(merge(*[x.tolist() for x in short]))) if n >= least - skip]
    members, counts = np.array([d for d, _ in met], np.int64), np.array([n for _, n in met], np.int64)
    for left, own in zip(range(len(long), 0, -1), long):
        open_ = np.flatnonzero((counts < least) & (counts + left >= least))
        if not len(open_):
            break
        place = np.searchsorted(own, members[open_])
        counts[open_] += own[np.minimum(place, len(own) - 1)] == members[open_]
    return members[counts >= least].tolist()


def search(sets: list[np.ndarray], roots: np.ndarray, asked: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets (by place) that join what all links of ``asked`` sets with any join, given the components ``roots``.

    Each asked set is a query to an inverted index of the sets in other components than its own: T-occurrence search for its
    required overlap, then the exact test. Sets whose size differs too much are left out before. If all are asked, four go
    first, and the others only if they are not in the largest component then: a pair within it needs no link.
    """
    sizes = np.array([len(s) for s in sets])
    label = np.unique(roots, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links: list[tuple[int, int]] = []

    def ask(q: int) -> None:
        size, least = int(sizes[q]), required(int(sizes[q]))
        fits = (label != label[q]) & (sizes * OF >= size * NEAR) & (size * OF >= sizes * NEAR)
        if not fits.any():
            return
        low, high = np.searchsorted(flat, sets[q]), np.searchsorted(flat, sets[q], side="right")
        counts = high - low
        place = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        members, which = owner[place], np.repeat(np.arange(size), counts)
        members, which = members[fits[members]], which[fits[members]]
        cuts = np.flatnonzero(np.diff(which)) + 1
        if len(cuts) + 1 < least or not len(members):
            return
        lists = np.split(members, cuts)
        # Of the lists beyond the overlap, half go to the merge's threshold: it stays selective, and short.
        for d in divide_skip(lists, least, least - 1 - (len(lists) - least) // 2):
            if label[d] != label[q]:
                both = len(np.intersect1d(sets[q], sets[d], assume_unique=True))
                if OF * both >= NEAR * (size + int(sizes[d]) - both):
                    links.append((q, d))
                    label[label == label[d]] = label[q]

    queries = np.flatnonzero(asked)
    if len(queries) == len(sets):
        for q in queries[:4].tolist():
            ask(q)
        queries = queries[4:]
        queries = queries[label[queries] != np.bincount(label).argmax()]
    for q in queries.tolist():
        ask(q)
    return links


def search_cells(members: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cell, a, b`` links of all cells, written; ``members`` has (cell, node, root, asked) with a row for each set of a cell.

    The texts of the nodes are read again and shuffled to the cells. Which texts are needed where is broadcast up to
    BROADCAST_BYTES (every row has a fixed size); beyond, texts are shuffled to these rows first.
    """

    def links(rows: list[tuple]) -> list[tuple]:
        found = search([shingle_hashes(r[4]) for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
        return [(rows[0][0], rows[x][1], rows[y][1]) for x, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stream sorted by cell and node, of which one cell is held; a node that comes again is asked if one of its rows is."""
        own: list[tuple] = []
        for row in chain((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))), [None]):
            if own and (row is None or row[0] != own[0][0]):
                out = links(own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), *(pa.array([r[k] for r in out], pa.int64()) for k in (1, 2))], ["cell", "a", "b"])
                own = []
            if own and row and row[1] == own[-1][1]:
                own[-1] = (*row[:3], row[3] or own[-1][3], row[4])
            elif row:
                own.append(row)

    where = materialize(members.join(nodes.select("node", "rep_id", "rep_key"), "node"))
    small = where.count() * MEMBER_BYTES <= BROADCAST_BYTES
    found = docs.join(F.broadcast(where) if small else where, F.col("rep_id").eqNullSafe(F.col("doc_id")) & (F.col("rep_key") == F.col("text_key")))
    dealt = found.select("cell", "node", "root", "asked", "body").repartition("cell").sortWithinPartitions("cell", "node")
    out = materialize(dealt.mapInArrow(run, "cell binary, a long, b long"))
    discard(where)
    return out


def _key(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])))


def _cells(total: str) -> Column:
    return F.ceil(F.col(total) / CELL).cast("int")


def indexed(nodes: DataFrame) -> DataFrame:
    """``node, size, most_long, short, long``: of each set that can have a like one, the indexed shingles it must be met by.

    ``short`` are those in lists of 2 to LONG sets. ``long`` are those in longer lists without the last ones by hash, as many as
    the slack of the smallest set like it lets be skipped; ``n_long`` counts them all. Sets with fewer shared shingles than any like one has go.
    """
    postings = nodes.where("size > 0").select("node", "size", F.explode("part").alias("shingle"))
    lengths = materialize(postings.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"))
    shared = postings.join(lengths, "shingle").groupBy("node", "size").agg(F.collect_list(F.struct((F.col("n") > LONG).alias("is_long"), "shingle")).alias("own"))
    of = lambda flag: F.array_sort(F.transform(F.filter("own", lambda x: x["is_long"] == flag), lambda x: x["shingle"]))
    shared = shared.where(F.size("own") >= slack(required(F.col("size")))).select("node", "size", of(False).alias("short"), of(True).alias("every"))
    stay = F.greatest(F.lit(0), F.size("every") - slack(required(F.col("size"))) + 1)
    index = materialize(shared.select("node", "size", F.size("every").alias("n_long"), "short", F.slice("every", F.lit(1), stay).alias("long")))
    discard(lengths)
    return index


def first_links(index: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b`` links among the sets that have their first shingle in short, or in long, lists in common.

    A list is split into cells; then what stands for the components of a cell goes on to the next round, as long as that halves
    the sets of split lists. So a group of near copies of any size is one component, or nearly so, at a cost linear in its size.
    """
    firsts = F.filter(F.array(F.get("short", F.lit(0)), F.get("long", F.lit(0))), lambda x: x.isNotNull())
    now, before, links = index.select("node", "size", F.explode(firsts).alias("shingle")), None, None
    while True:
        lists = materialize(now.groupBy("shingle").agg(F.sum(F.col("size").cast("long")).alias("total"), F.count("*").alias("n")).where("n > 1"))
        dealt = now.join(lists, "shingle").withColumn("cell", _key(F.col("shingle"), F.pmod(F.xxhash64("node", F.lit(7)), _cells("total"))))
        dealt = materialize(dealt.select("node", "size", "shingle", "cell", (_cells("total") > 1).alias("split")))
        found = search_cells(dealt.select("cell", "node", F.col("node").alias("root"), F.lit(True).alias("asked")), docs, nodes)
        links = found.select("a", "b") if links is None else links.unionByName(found.select("a", "b"))
        split = dealt.where("split")
        # Of the sets of a component of a cell one at least is no link's second.
        now = split.join(found.select("cell", F.col("b").alias("node")), ["cell", "node"], "left_anti").select("node", "size", "shingle")
        n, left = split.count(), now.count()
        discard(lists)
        if n == 0 or 2 * left > n:
            return links


def rest_members(index: DataFrame, roots: DataFrame) -> DataFrame:
    """Cells for all pairs of different components so far that share indexed shingles enough to be alike.

    Short lists: pairs are tallied over the lists, and those that reach their slack less the long shingles that they may share are put
    into cells by their smaller set. Long lists: the members outside of a list's largest component are asked in every part of the list.
    """
    own = index.join(roots, index["node"] == roots["of"], "left").select("node", "size", "n_long", "short", "long", F.coalesce("root", "node").alias("root"))
    own = materialize(own)
    posted = lambda column: own.select("node", "size", "n_long", "root", F.explode(column).alias("shingle"))
    apart = lambda rows: rows.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("shingle")
    short = materialize(posted("short").join(apart(posted("short")), "shingle"))
    b = short.select("shingle", F.col("node").alias("node_b"), F.col("size").alias("size_b"), F.col("n_long").alias("n_long_b"), F.col("root").alias("root_b"))
    near = ((F.col("size") < F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("node") < F.col("node_b")))) & (F.col("size") * OF >= F.col("size_b") * NEAR)
    pairs = short.join(b, "shingle").where((F.col("root") != F.col("root_b")) & near)
    pairs = pairs.groupBy("node", "size", "root", "node_b", "root_b").agg(F.count("*").alias("shared"), F.least(F.first("n_long"), F.first("n_long_b")).alias("rest"), F.first("size_b").alias("size_b"))
    # Below the smaller of the two hashes at which the index parts end all that is shared is known: the rest of that set must make up the overlap.
    a, b = F.col("size"), F.col("size_b")
    overlap = F.ceil((a + b) * NEAR / (NEAR + OF)).cast("int")
    least = overlap + F.least(slack(a) - required(a), slack(b) - required(b)) - F.col("rest")
    pairs = materialize(pairs.where(F.col("shared") >= F.greatest(F.lit(1), least)))
    load = pairs.groupBy("node").agg(F.sum(F.col("size_b").cast("long")).alias("total"))
    dealt = pairs.join(load, "node").withColumn("cell", _key(F.lit("pair"), F.col("node"), F.pmod(F.xxhash64("node_b", F.lit(7)), _cells("total"))))
    cells = dealt.select("cell", F.col("node_b").alias("node"), F.col("root_b").alias("root"), F.lit(False).alias("asked")).unionByName(dealt.select("cell", "node", "root", F.lit(True).alias("asked")).distinct())

    parts = posted("long").groupBy("shingle", "root").agg(F.count("*").alias("n"))
    lists = parts.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("bulk"), F.count("*").alias("n_roots")).where("n_roots > 1")
    lists = materialize(lists.select("shingle", F.col("bulk.root").alias("bulk")))
    # Lists with the same bulk, as those of a group of near copies, are one: a set is in it once.
    rows = materialize(posted("long").join(lists, "shingle").select("bulk", "node", "size", "root").distinct())
    outside = F.when(F.col("root") != F.col("bulk"), F.col("size").cast("long")).otherwise(0)
    totals = rows.groupBy("bulk").agg(F.sum(F.col("size").cast("long")).alias("total"), F.sum(outside).alias("asked"))
    rows = rows.join(materialize(totals.select("bulk", _cells("total").alias("n_all"), _cells("asked").alias("n_asked"))), "bulk")
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = rows.where("root <> bulk").select("bulk", "node", "root", part("n_asked").alias("i"), every("n_all").alias("j"), F.lit(True).alias("asked"))
    index_ = rows.select("bulk", "node", "root", every("n_asked").alias("i"), part("n_all").alias("j"), F.lit(False).alias("asked"))
    crossed = ask.unionByName(index_).select(_key(F.lit("list"), F.col("bulk"), F.col("i"), F.col("j")).alias("cell"), "node", "root", "asked")
    return cells.unionByName(crossed)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``: the smallest doc_id reachable over links of similarity 0.8.

    Words lie between ASCII white space and A-Z are lowered; a text of under five words is one shingle. Texts without words, and null
    ones, have no shingle and link with nothing: their component is their own id. Rows of equal sets are one set before
    anything is paired, whatever their number; null ids link but count as no id (a component of such alone has none). Repeated rows give
    repeated results, an empty table an empty one, and other columns are left behind. Texts are shingled whole, one at a time.
    Shingles are told apart by 64-bit hashes, sets by 128 bits. No pair is left out: lists are skipped only where the
    overlap that a pair needs is met without them.
    """
    small_batches(docs.sparkSession)
    rows = documents_of(docs, id_col, text_col)
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), F.col("text").cast("binary").alias("body"))
    whole = materialize(sketches(rows))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    sets = whole.groupBy("digest", "size").agg(rep.alias("rep"), F.first("part").alias("part"))
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("node"), "digest", "size", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), "part"))
    sketched, nodes = materialize(whole.drop("part")), materialize(sets.drop("part"))
    discard(whole)
    index = indexed(sets)
    discard(sets)
    if sketched.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "text_key"])  # the same row again would be the same set of a cell again
    roots = connected_components(first_links(index, rows, nodes)).select(F.col("node").alias("of"), "root")
    rest = search_cells(rest_members(index, roots), rows, nodes)
    every = connected_components(roots.select(F.col("of").alias("a"), F.col("root").alias("b")).unionByName(rest.select("a", "b")))
    placed = nodes.join(every.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left").select("digest", "size", "rep_id", F.coalesce("root", "node").alias("root"))
    placed = materialize(placed)
    least = placed.groupBy("root").agg(F.min("rep_id").alias("component_id"))
    groups = placed.join(least, "root").select("digest", "size", "component_id")
    own = sketched.select("doc_id", "digest", "size").join(groups, ["digest", "size"])
    return own.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
