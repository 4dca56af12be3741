"""Places in texts: quotes found again, hidden characters, redaction by claimed spans, innermost tables first."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ledgerloom.operators.graph import written

#: What counts as white space in a quote, within a character class of Java, RE2 and, but for the braces, Python.
SPACES = r"\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: A quote of fewer words pins nothing.
LEAST_WORDS = 4
#: Inner words that a long quote's candidates share with it.
KEY_WORDS = 6

#: Hidden characters by code point.
HIDDEN = {
    0x00AD: "SHY", 0x180E: "MVS", 0x200B: "ZWSP", 0x200C: "ZWNJ", 0x200D: "ZWJ", 0x200E: "LRM", 0x200F: "RLM", 0x202A: "LRE", 0x202B: "RLE", 0x202C: "PDF", 0x202D: "LRO", 0x202E: "RLO",
    0x2060: "WJ", 0x2061: "FA", 0x2062: "IT", 0x2063: "IS", 0x2064: "IP", 0x2066: "LRI", 0x2067: "RLI", 0x2068: "FSI", 0x2069: "PDI", 0xFEFF: "BOM",
}
#: Ranges of hidden characters, ends included.
HIDDEN_RANGES = ((0xFE00, 0xFE0F, "VS"), (0xE0000, 0xE007F, "TAG"))
HIDDEN_CLASS = "".join(rf"\x{{{c:x}}}" for c in HIDDEN) + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b, _ in HIDDEN_RANGES)


#: Quotes are broadcast up to so many bytes, as JSON text; beyond, they are joined by shuffle, and short ones by Spark's own plan.
BROADCAST_BYTES = 16 << 20


def small(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcast if its measured bytes are few. The result is the same either way."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def flat(text: Column) -> Column:
    """Every run of white space as one space. Texts of ASCII alone need the short class only, which is matched much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.regexp_replace(text, r"[\x20\x09-\x0d]+", " ")).otherwise(F.regexp_replace(text, f"[{SPACES}]+", " "))


def locate_quotes(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """``doc_id, quote_id, start, end`` of each quote in each text that has it word for word, white space aside.

    ``docs(doc_id, text, section_start, section_end)``, ``quotes(quote_id, quote)``. Places are code points of the original text, so
    that ``text[start:end]`` is the quote as the text has it. Of several occurrences the first that starts within the section
    is taken, else the first. Quotes of under LEAST_WORDS words are found nowhere; null quotes and texts neither. Case and
    punctuation must agree; the first and the last word may be parts of words.

    Quotes meet texts by a join on their inner words, KEY_WORDS of them at most; of the quotes only the numbers of such words are collected.
    """
    word = F.split(F.trim(flat(F.col("quote"))), " ")
    quotes = quotes.withColumn("words", word).where(F.size("words") >= LEAST_WORDS)
    quoted = F.transform("words", lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    quotes = quotes.select("quote_id", "words", F.array_join("words", " ").alias("needle"), F.array_join(quoted, f"[{SPACES}]+").alias("pattern"))
    # The inner words of a quote are whole words of the text: hashes of words, then of KEY_WORDS such in a row.
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    # Short quotes have fewer inner words, two at least; their number is a quote's kind, and each kind meets the texts by keys of its length.
    inner = F.least(F.size("words") - 2, F.lit(KEY_WORDS))
    keyed = quotes.select("quote_id", inner.alias("n"), hashes("words").alias("h"))
    key = lambda h, i, n: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
    kinds = sorted(r.n for r in keyed.select("n").distinct().collect()) or [KEY_WORDS]
    sought = keyed.select("quote_id", "n", F.coalesce(*[F.when(F.col("n") == n, key(F.col("h"), F.lit(1), n)) for n in kinds]).alias("key"))
    keys = lambda n: F.struct(F.lit(n).alias("n"), F.transform("h", lambda _, i: key(F.col("h"), i, n)).alias("keys"))
    words = docs.select("doc_id", hashes(F.split(flat(F.col("text")), " ")).alias("h"))
    grams = words.select("doc_id", F.explode(F.array(*map(keys, kinds))).alias("x")).select("doc_id", "x.n", F.explode_outer("x.keys").alias("key"))
    met = written(grams.join(small(sought), ["n", "key"]).select("doc_id", "quote_id").distinct())
    pairs = docs.join(small(met), "doc_id").join(small(quotes), "quote_id").where(F.contains(flat(F.col("text")), F.col("needle")))
    columns = ["doc_id", "quote_id", "text", "section_start", "section_end", "pattern"]
    return pairs.select(columns).select("doc_id", "quote_id", _place().alias("p")).select("doc_id", "quote_id", "p.start", "p.end")


def _place() -> Column:
    """(start, end) of the pattern in the text: what matches first is found as a literal, since no equal string stands before it."""
    text, pattern, a, b = F.col("text"), F.col("pattern"), F.col("section_start"), F.col("section_end")
    tail = F.substring(text, a + 1, F.length(text))
    first, later = (F.call_function("regexp_extract", x, pattern, F.lit(0)) for x in (text, tail))
    at = lambda whole, part: F.call_function("instr", whole, part) - 1
    place = lambda start, part: F.struct(start.cast("int").alias("start"), (start + F.length(part)).cast("int").alias("end"))
    within = (later != "") & (at(tail, later) + a < b)
    return F.when(within, place(at(tail, later) + a, later)).otherwise(place(at(text, first), first))


def hidden_label(code: int) -> str | None:
    return HIDDEN.get(code) or next((label for a, b, label in HIDDEN_RANGES if a <= code <= b), None)


@udtf(returnType=T.StructType([T.StructField("start", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("label", T.StringType())]))
class HiddenCharacters:
    """Table function: place (in code points), code point and label of every hidden character of a text; none for null."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        for start, c in enumerate(text or ""):
            label = hidden_label(ord(c)) if c > "\x7f" else None
            if label:
                yield start, ord(c), label


def hidden_characters(docs: DataFrame) -> DataFrame:
    """``doc_id, start, code, label`` of every hidden character of ``docs(doc_id, text)``; only texts with one reach Python."""
    some = docs.select("doc_id", "text").where(F.col("text").rlike(f"[{HIDDEN_CLASS}]"))
    return some.lateralJoin(HiddenCharacters(F.col("text").outer())).select("doc_id", "start", "code", "label")


def show_hidden(text: Column) -> Column:
    """The text with ``[LABEL]`` in the place of every hidden character."""
    out = text
    for pattern, label in [(rf"\x{{{c:x}}}", name) for c, name in HIDDEN.items()] + [(rf"[\x{{{a:x}}}-\x{{{b:x}}}]", name) for a, b, name in HIDDEN_RANGES]:
        out = F.regexp_replace(out, pattern, f"[{label}]")
    return F.when(text.rlike(f"[{HIDDEN_CLASS}]"), out).otherwise(text)


def luhn(match: str, kind: str) -> bool:
    """Luhn's check of a match's digits: 13 to 19 of them in personal data, any number that are not all zero in a safety scan."""
    digits = [int(c) for c in match if c in "0123456789"]
    total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0 and (13 <= len(digits) <= 19 if kind == "cc" else total > 0)


#: Secrets, which go before personal data, each (kind, pattern): an earlier one's span is closed to the later ones.
SECRETS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"), ("url_credentials", r"[a-z][a-z0-9+]*://[^\s:/@]*:[^\s/@]+@"), ("bearer", r"\bBearer [A-Za-z0-9._~+/-]{8,}=*"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("aws_key", r"\bAKIA[0-9A-Z]{16}\b"), ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"), ("hex", r"\b[0-9a-f]{32,}\b"),
)
#: An address begins where a run of its characters does, or a long run without an @ would be tried from each of them.
RUN_START = r"(?<![A-Za-z0-9_.+-])"
#: Patterns of personal data.
PERSONAL = (
    ("email", RUN_START + r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"), ("phone", r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"), ("cc", r"\b(?:[0-9][ -]?){13,19}\b"),
)
#: Patterns of a safety scan. In the standard mode telephone numbers are counted and stay, and addresses are not looked for.
SAFETY = (
    ("ssn", r"\b[0-9]{3}[-\s][0-9]{2}[-\s][0-9]{4}\b"), ("credit_card", r"\b(?:[0-9]{4}[-\s]){2,4}[0-9]{1,4}\b|\b[0-9]{13,19}\b"),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"), ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
)
#: Kinds whose matches must pass Luhn's check.
CHECKED = ("cc", "credit_card")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def claims(text: str, rules: tuple[tuple[str, re.Pattern], ...]) -> list[tuple[int, int, str]]:
    """Spans that the rules claim, by start. A rule sees only the gaps between the spans claimed before it."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in rules:
        edges, new = [0, *(x for a, b, _ in taken for x in (a, b)), len(text)], []
        for low, high in zip(edges[::2], edges[1::2]):
            # A gap is cut out, so that its ends bound words as a marker in the claimed span's place would.
            gap = text[low:high] if taken else text
            new += [(low + m.start(), low + m.end(), kind) for m in pattern.finditer(gap) if kind not in CHECKED or luhn(m[0], kind)]
        taken = sorted(taken + new)
    return taken


def claimed_spans(rules: tuple[tuple[str, str], ...]):
    """UDF: the spans (start, end, kind) of a text that the rules claim in their order; empty for null.

    Python, since which places are left to a rule depends on all before it; one pass of each pattern over a text.
    """

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        compiled = tuple((kind, re.compile(p, re.A)) for kind, p in rules)
        return texts.map(lambda t: [dict(zip(("start", "end", "kind"), s)) for s in claims(t or "", compiled)])

    return run


def covered(text: Column, spans: Column, marker: Callable[[Column], Column]) -> Column:
    """The text with ``marker(kind)`` in the place of each span; spans are sorted and apart."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    gaps = F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a))
    marks = F.concat(F.transform(spans, lambda s: marker(s["kind"])), F.array(F.lit("")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, m)), ""))


class _Tables(HTMLParser):
    """One pass over a page that keeps a stack of open tables. A table that ends is laid out and becomes text of the cell around it.

    What is outside of tables, and text within them, is taken from the source as it stands, never built again from its parts.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.page: list[str] = []
        self.open: list[list[list[list[str]]]] = []  # tables, rows, cells, parts
        self.keep = True  # whether the piece of the source that is being handled stays

    def put(self, text: str) -> None:
        if not self.open:
            self.page.append(text)
        elif self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1].append(text)

    def updatepos(self, i: int, j: int) -> int:
        """Every piece of the source passes here once, after its handler."""
        if self.keep:
            self.put(self.rawdata[i:j])
        self.keep = not self.open
        return super().updatepos(i, j)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.open.append([])
            self.keep = False
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append([])
        elif self.open and tag == "br":
            self.put(" ")

    def handle_startendtag(self, tag: str, attrs) -> None:
        if self.open:
            self.put(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag == "table":
            self.put_table(self.open.pop())
            self.keep = False
        elif self.open and tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.put(" ")

    def put_table(self, table: list[list[list[str]]]) -> None:
        rows = [[" ".join("".join(cell).split()).replace("\\", "\\\\").replace("|", "\\|") for cell in row] for row in table if row]
        width = max(map(len, rows), default=0)
        lines = [f"| {' | '.join(row + [''] * (width - len(row)))} |" for row in rows]
        if lines:
            self.put("\n" + "\n".join([lines[0], f"|{' --- |' * width}", *lines[1:]]) + "\n")

    def handle_data(self, data: str) -> None:
        self.keep = True

    def handle_entityref(self, name: str) -> None:
        self.keep = True

    def handle_charref(self, name: str) -> None:
        self.keep = True


def tables_as_markdown(html: str) -> str:
    """A page with its tables, nested ones too, as Markdown; the rest stays as it is. A table that never ends is laid out at the end."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    parser.put(parser.rawdata)  # of a script that never ends
    while parser.open:
        parser.put_table(parser.open.pop())
    return "".join(parser.page)


@F.pandas_udf(T.StringType())
def markdown_tables(pages: pd.Series) -> pd.Series:
    return pages.map(tables_as_markdown, na_action="ignore")
