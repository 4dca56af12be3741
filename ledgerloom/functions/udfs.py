"""The few pandas UDFs: algorithms that are sequential within one value."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What a Python worker and the JVM hold of a batch: long texts in batches of the default 10,000 rows fill an executor.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batches to BATCH, for queries that send whole texts to Python."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def split_bytes(budget: int):
    """UDF: a text as parts of at most ``budget`` UTF-8 bytes, whole lines where they fit; null stays null."""

    def parts(text: str) -> list[str]:
        out, now, size = [], [], 0
        for line in text.splitlines(keepends=True):
            pieces = [line]
            if len(line.encode()) > budget:
                pieces, part, used = [], [], 0
                for c in line:
                    n = len(c.encode())
                    if used + n > budget:
                        pieces.append("".join(part))
                        part, used = [], 0
                    part.append(c)
                    used += n
                pieces.append("".join(part))
            for piece in pieces:
                n = len(piece.encode())
                if size + n > budget and now:
                    out.append("".join(now))
                    now, size = [], 0
                now.append(piece)
                size += n
        return [*out, "".join(now)] if now or not out else out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(parts, na_action="ignore")

    return run


@F.pandas_udf(T.StringType())
def nfkc_key(texts: pd.Series) -> pd.Series:
    """Lower case, NFKC, every run of other than letters and digits as one space."""
    return texts.map(lambda t: re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", t.lower())).strip(), na_action="ignore")


@F.pandas_udf(T.StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """FNV-1a, 32 bits, over UTF-16 units, as eight hex digits."""

    def one(text: str) -> str:
        h = 0x811C9DC5
        units = text.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    return texts.map(one, na_action="ignore")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by rows of the table, each as a bit set (one integer per row)."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = where.get(w, 0) | row
        row = x & ((x - ((row << 1) | 1)) ^ x)
    return row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of precision and recall of the longest common subsequence of words; 0 if either has none."""

    def one(x: str | None, y: str | None) -> float:
        p, q = (x or "").lower().split(), (y or "").lower().split()
        n = lcs_length(p, q)
        return 2 * n / (len(p) + len(q)) if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_tables(pages: pd.Series) -> pd.Series:
    """Every table of a page without a table inside, as Markdown: cells flattened, bars escaped, rows padded."""

    def one(html: str) -> list[str]:
        out = []
        for body in re.findall(r"(?is)<table[^>]*>((?:(?!<table).)*?)</table>", html):
            rows = [[re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", c)).strip().replace("\\", "\\\\").replace("|", "\\|") for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", body)]
            width = max(map(len, rows), default=0)
            if width:
                lines = [f"| {' | '.join([*r, *[''] * (width - len(r))])} |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        return out

    return pages.map(one, na_action="ignore")
