"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one last token is valid: the encoding of the prefix is the encoding
of what stands before that token, then the token. Storing it per prefix gives the tokens by walking back,
lets bytes be appended exactly, and lets an edit recompute only the prefixes near it.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import documents_of, small_batches

#: Unicode White_Space, which is what the split pattern means by white space.
SPACE = "\t-\r \x85\xa0  -     　"
#: Every match of the split pattern lies within one match of this, and splits alike on its own.
SEGMENT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: White space of more than one byte.
WIDE = re.compile(f"(?![\t-\r ])[{SPACE}]")
#: Segments and pieces, prefixes, and pairs of tokens that a task remembers before it starts anew; they bound its memory.
MEMO, PREFIXES, PAIRS = 150_000, 100_000, 200_000
MARKS = (4, 7, 10, 13)
#: Pieces of at most SHORT bytes (three words of 8) are coded side by side, SIDE at once; answers about pairs that are kept meanwhile, a power of two.
SHORT, SIDE, ANSWERS = 24, 1 << 15, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def last_merges(ranks: dict[bytes, int]) -> np.ndarray | None:
    """The two tokens that merge last in every token, by id (a byte, or an id without token: itself twice).

    None if some token does not come out of its own bytes by merges of lower ranks.
    """
    get, none = ranks.get, 1 << 60
    out = np.arange(max(ranks.values()) + 1, dtype=np.int64).repeat(2).reshape(-1, 2)
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        costs = [get(token[i : i + 2], none) for i in range(len(token) - 1)]
        while len(parts) > 2:
            if (low := min(costs)) >= rank:
                return None
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
        if len(parts) == 2:
            out[rank] = [get(x, none) for x in parts]
            if out[rank].max() >= rank:
                return None
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """For every place the 8 bytes that end there as one number, the last byte lowest; bytes before the first are 0."""
    out = np.zeros(len(data), np.uint64)
    for k in range(min(8, len(data))):
        out[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


class ShortPieces:
    """The prefix step for many short pieces side by side: each prefix length is one step over all pieces that reach it."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray) -> None:
        self.left, self.right = merges[:, 0].copy(), merges[:, 1].copy()
        merged = np.flatnonzero(self.left != np.arange(len(merges)))
        keys = self.left[merged] << 32 | self.right[merged]
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], merged[order]
        self.sizes = np.ones(len(merges), np.int64)
        by_size: dict[int, list[bytes]] = {}
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
            if len(token) <= SHORT:
                by_size.setdefault(len(token), []).append(token)
        #: By length the tokens in the order of their keys: keys, words and ids.
        self.tables: dict[int, tuple[np.ndarray, list[np.ndarray], np.ndarray]] = {}
        for size, tokens in by_size.items():
            words = _words(np.frombuffer(b"".join(tokens), np.uint8))
            own = self.masked(words, np.arange(1, len(tokens) + 1) * size - 1, size)
            keys = self.key(own)
            order = np.argsort(keys)
            ids = np.array([ranks[t] for t in tokens])
            self.tables[size] = keys[order], [w[order] for w in own], ids[order]
        self.asked = np.full(ANSWERS, -1)
        self.answers = np.zeros(ANSWERS, bool)

    @staticmethod
    def masked(words: np.ndarray, end: np.ndarray, size: int) -> list[np.ndarray]:
        """The ``size`` bytes up to ``end`` as words."""
        out = []
        for k in range(0, size, 8):
            word = words[end - k]
            out.append(word if size - k >= 8 else word & np.uint64((1 << 8 * (size - k)) - 1))
        return out

    @staticmethod
    def key(words: list[np.ndarray]) -> np.ndarray:
        """The word itself up to 8 bytes, else a mixture, which does not tell all strings apart."""
        out = words[0]
        for word in words[1:]:
            out = (out ^ word >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) ^ word
        return out

    def tokens(self, words: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        """The token that the ``size`` bytes up to each ``end`` are, or -1."""
        if size not in self.tables:
            return np.full(len(end), -1)
        keys, stored, ids = self.tables[size]
        own = self.masked(words, end, size)
        key = self.key(own)
        # Tokens whose keys are equal stand side by side; there is one of each key but for chance.
        out, at = np.full(len(end), -1), np.searchsorted(keys, key)
        live = np.arange(len(end))
        while len(live):
            near = at < len(keys)
            near[near] = keys[at[near]] == key[live[near]]
            live, at = live[near], at[near]
            same = np.ones(len(live), bool)
            for a, b in zip(own, stored):
                same &= a[live] == b[at]
            out[live[same]] = ids[at[same]]
            live, at = live[~same], at[~same] + 1
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of a then b encode as just these two.

        Merges are undone from the last one on, and at each state the tokens on both sides of the border must not have
        merged before what is undone already.
        """
        out, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 60)
        while len(live):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            joins = (self.merge_keys[at] == key) & (self.merge_ranks[at] < limit)
            out[live[joins]] = False
            left, right = self.left[b], self.right[a]
            one_a, one_b = right == a, left == b
            undo_a = ((a > b) & ~one_a) | one_b
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, right, a), np.where(undo_a, b, left)
            more = ~(joins | one_a & one_b)
            live, limit, a, b = live[more], limit[more], a[more], b[more]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`apart`, with answers kept."""
        key = a << 32 | b
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - ANSWERS.bit_length())).view(np.int64)
        out = self.answers[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            out[new] = self.apart(asked >> 32, asked & 0xFFFFFFFF)[back]
            # Of several new pairs of a slot the last stays, with its own answer.
            self.asked[slot[new]] = key[new]
            last = self.asked[slot[new]] == key[new]
            self.answers[slot[new[last]]] = out[new[last]]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Native 32-bit ids of each piece of 1 to SHORT bytes."""
        sizes = np.array(list(map(len, pieces)))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        words = _words(np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), np.uint8))
        first, longest = np.cumsum(sizes) - sizes, int(sizes[0])
        last = np.zeros((longest, len(pieces)), np.int64)
        reach = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        for end in range(1, longest + 1):
            open_ = np.arange(reach[end - 1])
            for size in range(1, end + 1):
                token = self.tokens(words, first[open_] + (end - 1), size)
                ok = token >= 0
                if size < end:
                    some = np.flatnonzero(ok)
                    ok[some] = self.compatible(last[end - size - 1, open_[some]], token[some])
                last[end - 1, open_[ok]] = token[ok]
                open_ = open_[~ok]
                if not len(open_):
                    break
            else:
                raise ValueError("a byte has no token")
        out, n, live, left = np.zeros((len(pieces), longest), np.int32), np.zeros(len(pieces), np.int64), np.arange(len(pieces)), sizes
        while len(live):
            token = last[left - 1, live]
            n[live] += 1
            out[live, longest - n[live]] = token
            left = left - self.sizes[token]
            live, left = live[left > 0], left[left > 0]
        data, coded = out.tobytes(), [b""] * len(pieces)
        stop = np.arange(1, len(pieces) + 1) * (4 * longest)
        for i, a, b in zip(order.tolist(), (stop - 4 * n).tolist(), stop.tolist()):
            coded[i] = data[a:b]
        return coded


class PrefixBpe:
    """The encoder: ranks, the memo of token pairs that may stand side by side, and the prefix step."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        #: Token bytes by id, the same objects as the keys of ``ranks``.
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        #: The last tokens of prefixes of MARKS bytes, which other pieces append to.
        self.prefixes: dict[bytes, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a then b encode as just these two."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.stay_apart(self.bytes_of[a], self.bytes_of[b])
        return known

    def stay_apart(self, a: bytes, b: bytes) -> bool:
        """Merge the bytes of both, lowest rank first and leftmost on ties, until nothing merges or a merge joins a with b."""
        get, data, none = self.ranks.get, a + b, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        border = len(a) - 1
        while (low := min(costs)) < none:
            i = costs.index(low)
            if i == border:
                return False
            border -= i < border
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
        return True

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Append to ``last`` the last token of every prefix of ``data`` it does not have yet.

        Tokens that end the prefix are tried from the shortest; a prefix whose own bytes are a token ends with it
        if none shorter is valid.
        """
        rank, pairs, longest = self.ranks.get, self.pairs, self.longest
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            for start in range(end - 1, max(end - longest, 0) - 1, -1):
                token = rank(data[start:end])
                if token is not None:
                    if not start:
                        break
                    ok = pairs.get(last[start - 1] << 32 | token)
                    if ok or ok is None and self.compatible(last[start - 1], token):
                        break
            else:
                raise ValueError("a byte has no token")
            last.append(token)

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the whole data, from its prefixes' last tokens."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last: list[int] = []
        for at in reversed(MARKS):
            if at < len(data) and (known := self.prefixes.get(data[:at])):
                last = np.frombuffer(known, np.int32).tolist()
                break
        for at in MARKS:
            if len(last) < at < len(data):
                if len(self.prefixes) >= PREFIXES:
                    self.prefixes.clear()
                self.extend(data, last, at)
                self.prefixes[data[:at]] = struct.pack(f"{at}i", *last)
        self.extend(data, last)
        return self.walk(last)


class PrefixState:
    """One piece under edit: its bytes and the last token of each prefix."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b"") -> None:
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: prefixes already stored do not change."""
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` for bytes start to end; returns how many prefixes were computed again.

        A prefix depends on the ``longest`` prefixes before it, so once that many behind the edit have
        their old tokens all the rest keep theirs.
        """
        old, tail = self.last[end:], start + len(new)
        self.data, self.last = self.data[:start] + new + self.data[end:], self.last[:start]
        self.bpe.extend(self.data, self.last, tail)
        alike = 0
        for i, token in enumerate(old):
            self.bpe.extend(self.data, self.last, tail + i + 1)
            alike = alike + 1 if self.last[-1] == token and len(self.bpe.bytes_of[token]) <= i + 1 else 0
            if alike >= self.bpe.longest:
                done = len(self.last) - start
                self.last += old[i + 1 :]
                return done
        return len(self.last) - start

    def tokens(self) -> list[int]:
        return self.bpe.walk(self.last)


def segments_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The matches of SEGMENT in all ``texts`` (strings without nulls) one after the other as bytes, and for each text and the end the number before it."""
    texts = texts.cast(pa.string())
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first[0] : first[-1]]
    first = first - first[0]
    space = ((data >= 9) & (data <= 13)) | (data == 32)
    cut = space.copy()
    # A run of white space leaves its last one apart, which goes to the next word if it is a space.
    cut[1:] &= ~space[:-1]
    cut[1:-1] |= space[1:-1] & space[:-2] & ~space[2:]
    cut[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
    full = np.flatnonzero(first[1:] > first[:-1])
    last = first[full + 1] - 1
    last = last[last > first[full]]
    cut[last] &= ~space[last] | ~space[last - 1]
    cut[first[full]] = True
    if len(data) and data.max() > 127:
        for k in np.flatnonzero(np.maximum.reduceat(data, first[full]) > 127).tolist():
            k = int(full[k])
            if WIDE.search(text := texts[k].as_py()):
                sizes = [len(x.encode()) for x in SEGMENT.findall(text)]
                cut[first[k] : first[k + 1]] = False
                cut[first[k] + np.cumsum([0, *sizes[:-1]])] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(starts, first)


class TextEncoder:
    """Splits texts by the pattern and encodes their pieces, remembering segments and pieces already met.

    Ids are kept as native 32-bit integers in bytes. One memo holds both, as a piece that stands alone splits into
    itself. A full memo becomes the older one, and what is met again moves from the older to the newer, so at
    most twice ``MEMO`` are kept, and what one call adds. Short pieces that a call meets first are coded side by side.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: np.ndarray | None = None) -> None:
        """``merges``: :func:`last_merges` of the ranks; without it every piece is coded by itself, with the same ids."""
        self.bpe, self.pattern = PrefixBpe(ranks), regex.compile(pattern)
        self.short = ShortPieces(ranks, merges) if merges is not None else None
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def pieces(self, s: bytes) -> list[bytes]:
        """A word of ASCII letters, with a space before it or not, is one piece by each alternative of the pattern."""
        if s.isalpha() or s[0] == 32 and s[1:].isalpha():
            return [s]
        return [x.encode() for x in self.pattern.findall(s.decode())]

    def coded(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces not met yet."""
        out, short, rank = {}, [], self.bpe.ranks.get
        for s in pieces:
            if (whole := rank(s)) is not None:
                out[s] = struct.pack("i", whole)
            elif self.short is not None and len(s) <= SHORT:
                short.append(s)
            else:
                ids = self.bpe.encode_piece(s)
                out[s] = struct.pack(f"{len(ids)}i", *ids)
        for at in range(0, len(short), SIDE):
            part = short[at : at + SIDE]
            out.update(zip(part, self.short.encode(part)))
        return out

    def found(self, segments: list[bytes]) -> list[bytes]:
        """Ids of each of different segments; the memo then holds them and their pieces."""
        memo, older = self.memo, self.older
        out = list(map(memo.get, segments))
        split, new = [], set()
        for k, (s, known) in enumerate(zip(segments, out)):
            if known is None:
                out[k] = known = older.get(s)
                if known is None:
                    own = self.pieces(s)
                    split.append((k, own))
                    new.update([x for x in own if x not in memo and x not in older])
                elif len(s) < 80:
                    memo[s] = known
        coded = self.coded(new)
        get = lambda x: coded.get(x) or memo.get(x) or older[x]
        for k, own in split:
            out[k] = ids = get(own[0]) if len(own) == 1 else b"".join(map(get, own))
            if len(segments[k]) < 80:
                memo[segments[k]] = ids
        memo.update((s, ids) for s, ids in coded.items() if len(s) < 80)
        if len(memo) >= MEMO:
            self.older, self.memo = memo, {}
        return out

    def ids_of(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text (strings without nulls)."""
        segments, first = segments_of(texts)
        different = segments.dictionary_encode()
        found = self.found(different.dictionary.to_pylist())
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))
        ids = lists.take(different.indices)
        return pa.ListArray.from_arrays(ids.offsets.take(pa.array(first)), ids.values)

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of(pa.array([text]))[0].values.to_numpy()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row of ``docs``; null and empty texts give no ids.

    Rows are independent, so nothing is shuffled; repeated rows stay repeated and null ids stay null. The
    rank table is read once by the driver and broadcast: its size is the vocabulary's, whatever the input.
    A task remembers ``MEMO`` segments or so, and drops them at its end; a very long piece takes time linear in its
    bytes. An empty table gives an empty one.
    """
    return _mapped(docs, ranks_path, pattern, id_col, text_col, False)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode` with ``decoded`` (binary), the bytes of the ids, in the same pass over the rows."""
    return _mapped(docs, ranks_path, pattern, id_col, text_col, True)


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    ranks = read_ranks(ranks_path)
    table = docs.sparkSession.sparkContext.broadcast((ranks, last_merges(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, merges = table.value
        encoder = TextEncoder(ranks, pattern, merges)
        tokens = pa.array(encoder.bpe.bytes_of, pa.binary())
        for batch in batches:
            ids = encoder.ids_of(batch.column(1))
            out = [batch.column(0), ids]
            if decoded:
                # The tokens of all rows lie one after the other, so a row's bytes are a stretch of theirs.
                every = tokens.take(ids.values)
                offsets = np.frombuffer(every.buffers()[1], np.int32)[ids.offsets.to_numpy()]
                out.append(pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), every.buffers()[2]]))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    return documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary): the bytes of its ids; an unknown id is an error.

    Null ids decode to no bytes; an empty table gives an empty one. A column that is named ``decoded`` is replaced.
    """
    spark = encoded.sparkSession
    encoded = encoded.drop("decoded")
    small_batches(spark)
    table = {i: b for b, i in read_ranks(ranks_path).items()}
    tokens = spark.sparkContext.broadcast([table.get(i) for i in range(max(table) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = tokens.value.__getitem__
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False).tolist(), column.offsets.to_numpy()
            offsets = offsets - offsets[0] if len(offsets) else offsets
            out = [b"".join(map(get, flat[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(coded: DataFrame) -> DataFrame:
    """Per row of :func:`round_trip` the number of ids, and SHA-256 of the ids and of what they decode to."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
