"""Fill-in-middle: a byte automaton scans texts for their units and for sentinels; documents are cut between units and rearranged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ledgerloom.llm.common import documents_of, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes: line feed, the characters of sentinels, other ASCII, UTF-8 continuation and lead bytes of 2 to 4, and no byte.
LINE_FEED, OPEN, NAME, CLOSE, OTHER, REST, LEAD2, LEAD3, LEAD4, NOTHING = range(10)
#: States: before a unit, in one, after ``<``, after ``<P`` (or S, M), and with 1 to 3 continuation bytes to come.
START, TEXT, OPENED, NAMED, MORE1, MORE2, MORE3 = range(7)
#: What a transition emits, packed into one number: code points from bit 0, units begun from bit 20, sentinels from bit 40.
CHAR, UNIT, MARK, FIELD = 1, 1 << 20, 1 << 40, (1 << 20) - 1
#: Bytes of a block, which count from 0; the state after any 3 bytes does not depend on the state before them, so a block starts there.
BLOCK, WARM = 256, 3
#: Blocks scanned in step, which bounds memory.
LANES = 4096


def byte_classes() -> np.ndarray:
    """The class of each byte; bytes that UTF-8 never has count as one character each."""
    out = np.full(256, OTHER, np.uint8)
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:0xF8] = REST, LEAD2, LEAD3, LEAD4
    out[ord("\n")], out[ord("<")], out[ord(">")] = LINE_FEED, OPEN, CLOSE
    out[list(b"PSM")] = NAME
    return out


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and what is emitted, by state and class. A stray continuation byte is a character of its own."""
    goto, emit = np.full((7, 10), TEXT, np.uint8), np.full((7, 10), CHAR, np.int64)
    for kind, state in ((LINE_FEED, START), (OPEN, OPENED), (LEAD2, MORE1), (LEAD3, MORE2), (LEAD4, MORE3)):
        goto[:, kind] = state
    goto[OPENED, NAME] = NAMED
    goto[MORE2, REST], goto[MORE3, REST] = MORE1, MORE2
    emit[[MORE1, MORE2, MORE3], REST] = 0
    emit[START] += UNIT
    emit[NAMED, CLOSE] += MARK
    goto[:, NOTHING], emit[:, NOTHING] = range(7), 0
    return goto, emit


CLASS, (GOTO, EMIT) = byte_classes(), (t.ravel() for t in transitions())


def scan(data: np.ndarray, at: np.ndarray, end: np.ndarray, first: np.ndarray, unit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run blocks of ``data`` in step: block k is ``at[k]`` up to BLOCK bytes on, at most to ``end[k]``; ``first`` blocks begin a text.

    Returns what each block emits in all and, if ``unit`` is given, the byte at which its ``unit``-th unit (from 1) begins
    and the code points before it in the block.
    """
    totals, place, chars = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
    for a in range(0, len(at), LANES):
        own = slice(a, a + LANES)
        where = at[own] + np.arange(-WARM, BLOCK)[:, None]
        inside = (where < end[own]) & ((where >= at[own]) | ~first[own])
        kinds = np.where(inside, CLASS[data[np.where(inside, where, 0)]] if len(data) else NOTHING, NOTHING).astype(np.uint8)
        state = np.where(first[own], START, TEXT).astype(np.uint8)
        total = totals[own]
        for step in range(WARM + BLOCK):
            cell = state * np.uint8(10) + kinds[step]
            state = GOTO[cell]
            if step >= WARM:
                given = EMIT[cell]
                total += given
                if unit is not None:
                    hit = (given >> 20 & FIELD != 0) & (total >> 20 & FIELD == unit[own])
                    place[own][hit], chars[own][hit] = where[step][hit], (total[hit] & FIELD) - 1
    return totals, place, chars


def cut(texts: pa.BinaryArray, draws: np.ndarray) -> dict[str, np.ndarray]:
    """Units, sentinels and the two cuts of every text; ``draws`` has two numbers a text, whose remainders by units + 1 are the units before the cuts.

    The first scan counts what each block emits; the second goes only to the blocks in which a cut lies.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    blocks = -(-size // BLOCK)
    before = np.concatenate(([0], np.cumsum(blocks)))
    doc = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(doc)) - before[doc]
    at, end = offsets[doc] + nth * BLOCK, offsets[doc + 1]
    totals, _, _ = scan(data, at, end, nth == 0)
    sums = {name: np.concatenate(([0], np.cumsum(totals >> shift & FIELD))) for name, shift in (("chars", 0), ("units", 20), ("marks", 40))}
    of = {name: s[before[1:]] - s[before[:-1]] for name, s in sums.items()}
    wanted = np.sort(draws % (of["units"] + 1)[:, None], axis=1)
    out = {"n_units": of["units"], "n_chars": of["chars"], "n_marks": of["marks"]}
    for k, name in ((0, "prefix"), (1, "middle")):
        ends, ends_chars = size.copy(), of["chars"].copy()
        inner = np.flatnonzero(wanted[:, k] < of["units"])
        target = sums["units"][before[inner]] + wanted[inner, k] + 1
        block = np.searchsorted(sums["units"], target) - 1
        _, place, chars = scan(data, at[block], end[block], nth[block] == 0, target - sums["units"][block])
        ends[inner] = place - offsets[inner]
        ends_chars[inner] = sums["chars"][block] - sums["chars"][before[inner]] + chars
        out |= {f"{name}_bytes": ends, f"{name}_chars": ends_chars}
    return out


CUTS = T.StructType([T.StructField(name, T.LongType()) for name in ("n_units", "n_chars", "n_marks", "prefix_bytes", "prefix_chars", "middle_bytes", "middle_chars")])


@arrow_udf(CUTS)
def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = cut(texts, np.stack([first.to_numpy(), second.to_numpy()], axis=1))
    return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], list(found))


def infill(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_units, form, prefix_chars, middle_chars, output`` of every row: texts as prefix, suffix and middle.

    Units are lines with their line feed. Four numbers from the SHA-256 of ``seed:doc_id`` decide: the first two where the
    middle begins and ends (between units), the third whether the text is rearranged (``rate`` of 100), the fourth whether the suffix
    comes first (``spm`` of 100). A text that is empty (null counts as such) or holds a sentinel stays ``plain``, with null
    counts. Null ids draw as empty ones; repeated rows stay repeated, with equal results; an empty table gives an empty one. Texts of any
    length are scanned in blocks; other columns of ``docs`` are left behind and cannot clash.
    """
    small_batches(docs.sparkSession)
    rows = documents_of(docs, id_col, text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    own = F.col("text").cast("binary")
    rows = rows.select("doc_id", "text", cuts(own, draw[0], draw[1]).alias("cut"), (draw[2] % 100 < rate).alias("moved"), (draw[3] % 100 < spm).alias("suffix_first"))
    plain = (F.col("text") == "") | (F.col("cut.n_marks") > 0) | ~F.col("moved")
    form = F.when(plain, "plain").when(F.col("suffix_first"), "spm").otherwise("psm")
    a, b = F.col("cut.prefix_bytes"), F.col("cut.middle_bytes")
    piece = lambda start, n: F.substring(own, (start + 1).cast("int"), n.cast("int")).cast("string")
    prefix, middle, suffix = piece(F.lit(0), a), piece(a, b - a), piece(b, F.octet_length(own) - b)
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    output = F.when(form == "plain", F.col("text")).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    count = lambda x: F.when(~plain, x)
    return rows.select("doc_id", "text", F.col("cut.n_units").alias("n_units"), form.alias("form"), count(F.col("cut.prefix_chars")).alias("prefix_chars"), count(F.col("cut.middle_chars") - F.col("cut.prefix_chars")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of the given form came from: its parts, found by their sentinels, in their old order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = F.when(form == "spm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))), F.when(form == "spm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))
