"""Secret scans: fixed patterns, and a randomness battery over other tokens with false-discovery control."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: These runs are greedy, so asking for the length within the pattern finds the same matches.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the narrowest: name, pattern of the whole token, alphabet.
ENCODINGS = (
    ("decimal", "[0-9]+", DIGITS),
    ("hex", "[0-9a-f]+", DIGITS + "abcdef"),
    ("hex_upper", "[0-9A-F]+", DIGITS + "ABCDEF"),
    ("lower", "[a-z]+", LOWER),
    ("upper", "[A-Z]+", UPPER),
    ("base32", "[A-Z2-7]+", UPPER + "234567"),
    ("lower36", "[a-z0-9]+", LOWER + DIGITS),
    ("upper36", "[A-Z0-9]+", UPPER + DIGITS),
    ("base62", "[A-Za-z0-9]+", UPPER + LOWER + DIGITS),
    ("base64url", "[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_"),
    ("base64", "[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/"),
)
#: Per mille, how often ordinary text has each letter: means of common figures for English, French, German and Spanish. A fifth of
#: the weight is dealt evenly, so that names and abbreviations count as text too.
LETTERS = dict(zip(LOWER, (85, 14, 33, 43, 148, 12, 16, 23, 73, 4, 5, 46, 27, 76, 56, 24, 6, 67, 73, 71, 44, 13, 10, 3, 7, 8)))
TEXT_LETTERS = tuple(0.8 * n / sum(LETTERS.values()) + 0.2 / 26 for n in LETTERS.values())
#: How often a vowel follows a consonant and a vowel in ordinary text, with the same fifth dealt evenly.
VOWELS, VOWEL_AFTER = "aeiou", (0.48, 0.18)
#: Padding ends a token; any other "=" stands between a name and its value and belongs to neither.
PADDING = "(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Matches whose places are summed at once; changes no result.
CHUNK = 256


@dataclass(frozen=True)
class Battery:
    """Limits of the tests. ``text_changes`` is the rate of changes between character classes in ordinary text.

    ``random_p``: the combined p-value of the three tests below which a token is not taken for random.
    """

    min_length: int = 20
    text_changes: float = 0.12
    random_p: float = 0.001
    false_discovery: float = 0.01
    length_edges: tuple[int, ...] = (32, 48, 64)
    #: p-values are counted by steps of a tenth of a decade, rounded up, down to this many steps; smaller ones count as 1e-100,
    #: which is below any threshold that the number of tokens could ask for, so no result changes by it.
    most_steps: int = 1000


def _spans(df: DataFrame, name: str, pattern: str, where: Column, keep: tuple[str, int] | None = None) -> DataFrame:
    """``df`` with ``name``: array of (start, end, token) of the matches in ``_text``, in code points.

    ``keep``: a pattern group (by ``regexp_extract_all``) and the length it needs. Positions are running sums
    of the pieces between matches and of the matches; sums go by blocks of ``CHUNK``, so that appending to an
    array stays cheap in texts with very many matches.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("_hit", where & F.col("_text").rlike(pattern))
    df = df.withColumn("_found", F.when(F.col("_hit"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_gaps", F.when(F.col("_hit"), F.split("_text", pattern, -1)).otherwise(none))
    if keep:
        df = df.withColumn("_group", F.when(F.col("_hit"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(int(keep[0])))).otherwise(none))
    good = (lambda i: F.length(F.get("_group", i)) >= keep[1]) if keep else (lambda i: F.lit(True))
    row = lambda m, i: F.struct(F.length(F.get("_gaps", i)).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("token"), good(i).alias("good"))
    df = df.withColumn("_rows", F.transform("_found", row))
    df = df.withColumn("_blocks", F.when(F.size("_rows") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / CHUNK).cast("int")), lambda b: F.slice("_rows", b * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<struct<gap:bigint,len:bigint,token:string,good:boolean>>>")))
    zero = F.lit(0).cast("long")
    width = lambda block: F.aggregate(block, zero, lambda s, x: s + x.gap + x.len)
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
    df = df.withColumn("_bases", F.aggregate("_blocks", start, lambda a, b: F.struct((a.at + width(b)).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")), lambda a: a.out))
    span = "array<struct<start:bigint,end:bigint,token:string,good:boolean>>"

    def place(block: Column, base: Column) -> Column:
        first = F.struct(base.alias("at"), F.array().cast(span).alias("out"))
        one = lambda a, x: F.array(F.struct((a.at + x.gap).alias("start"), (a.at + x.gap + x.len).alias("end"), x.token.alias("token"), x.good.alias("good")))
        return F.aggregate(block, first, lambda a, x: F.struct((a.at + x.gap + x.len).alias("at"), F.concat(a.out, one(a, x)).alias("out")), lambda a: a.out)

    df = df.withColumn(name, F.filter(F.flatten(F.zip_with("_blocks", "_bases", place)), lambda x: x.good))
    return df.drop("_hit", "_found", "_gaps", "_group", "_rows", "_blocks", "_bases")


def encoding(token: Column) -> Column:
    """Index of the narrowest encoding whose alphabet holds the token, or null."""
    out = F.lit(None).cast("int")
    for k, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(token.rlike(f"^{pattern}$"), F.lit(k)).otherwise(out)
    return out


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable, to seven digits (the rational approximation of Abramowitz and Stegun, 26.2.17)."""
    u = F.abs(z)
    t = 1 / (1 + 0.2316419 * u)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-u * u / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def combined(*p: Column) -> Column:
    """Cauchy's combination of p-values, which holds for dependent tests too."""
    sure = [F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12)) for x in p]
    mean = sum((F.tan((0.5 - x) * math.pi) for x in sure), F.lit(0.0)) / len(p)
    return 0.5 - F.atan(mean) / math.pi


def battery(token: Column, battery_: Battery) -> Column:
    """The p-value that ordinary text has such a token, as steps of a tenth of a decade (0: no evidence).

    Three tests over the code values of the inferred encoding ask whether the token can be random: chi-squared over
    the alphabet (Wilson and Hilferty's normal form), the runs above and below the alphabet's middle, and the serial
    correlation of neighbours. Their p-values are combined; a token below ``random_p`` gets no evidence. For the rest the
    same three traits are weighed against ordinary text, each as a likelihood ratio: how often each letter occurs
    (``TEXT_LETTERS``), the runs of lower case, upper case and digits, which in text change at a low rate, and the order of
    neighbours (``VOWEL_AFTER``). The inverse of their product bounds the chance under that text model (Markov); the
    choice among encodings is paid for by their number.
    """
    body = F.rtrim(token, F.lit("="))
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    first = F.transform(F.array(F.struct(body.alias("s"), F.get(alphabets, encoding(body)).alias("alphabet"))), lambda x: F.struct(x.s.alias("s"), x.alphabet.alias("alphabet"), F.length(x.s).cast("double").alias("n"), F.length(x.alphabet).cast("double").alias("size")))

    logs = F.array(*[F.lit(math.log(p)) for p in (0.1, *TEXT_LETTERS)])

    vowels = sum(TEXT_LETTERS[LOWER.index(c)] for c in VOWELS)
    consonant, vowel = f"[a-z&&[^{VOWELS}]]", f"[{VOWELS}]"

    def pairs(s: Column) -> Column:
        """Log of how much likelier text makes the order of vowels and consonants than letters drawn apart."""
        out = F.lit(0.0)
        for before, p in ((consonant, VOWEL_AFTER[0]), (vowel, VOWEL_AFTER[1])):
            for after, ratio in ((vowel, p / vowels), (consonant, (1 - p) / (1 - vowels))):
                out = out + F.regexp_count(s, F.lit(f"{before}(?={after})")) * math.log(ratio)
        return out

    def sums(x: Column) -> Column:
        start = F.struct(*[F.lit(0.0).alias(k) for k in ("v", "vv", "vw", "head", "last", "text", "changes", "highs", "runs", "high")], F.lit(0).alias("kind"), F.lit(0).alias("i"))

        kind = lambda c: F.when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)

        def step(a: Column, c: Column) -> Column:
            value = F.call_function("instr", x.alphabet, c).cast("double")
            high = F.when(2 * value > x["size"], 1.0).otherwise(0.0)
            return F.struct(
                (a.v + value).alias("v"), (a.vv + value * value).alias("vv"), (a.vw + a["last"] * value).alias("vw"), F.when(a.i == 0, value).otherwise(a["head"]).alias("head"), value.alias("last"),
                (a.text + F.get(logs, F.call_function("instr", F.lit(LOWER), F.lower(c)))).alias("text"), (a.changes + F.when((a.i > 0) & (a.kind != kind(c)), 1.0).otherwise(0.0)).alias("changes"), (a.highs + high).alias("highs"), (a.runs + F.when((a.i == 0) | (a.high != high), 1.0).otherwise(0.0)).alias("runs"), high.alias("high"), kind(c).alias("kind"), (a.i + 1).alias("i"),
            )

        squares = F.aggregate(F.split(x.alphabet, ""), F.lit(0.0), lambda s, c: s + F.pow(x.n - F.length(F.replace(x.s, c, F.lit(""))), F.lit(2.0)))
        kinds = sum((F.when(x.alphabet.rlike(c), 1).otherwise(0) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
        return F.struct(x.n.alias("n"), x["size"].alias("size"), kinds.alias("kinds"), pairs(F.lower(x.s)).alias("pairs"), squares.alias("squares"), F.aggregate(F.split(x.s, ""), start, step).alias("t"))

    def verdict(y: Column) -> Column:
        k = y["size"] - 1
        chi = y.squares * y["size"] / y.n - y.n
        uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        t = y.t
        cross = t.vw + t["last"] * t["head"]
        spread = y.n * t.vv - t.v * t.v
        serial = F.when(spread > 0, F.abs((y.n * cross - t.v * t.v) / spread) * F.sqrt(y.n)).otherwise(F.lit(1e9))
        # Runs of values above and below the middle: mean and variance given how many are above.
        both = 2 * t.highs * (y.n - t.highs)
        spread_runs = both * (both - y.n) / (y.n * y.n * (y.n - 1))
        runs = F.when(spread_runs > 0, F.abs(t.runs - both / y.n - 1) / F.sqrt(spread_runs)).otherwise(F.lit(1e3))
        rate = battery_.text_changes
        text = t.text + y.pairs + t.changes * F.log(rate / F.greatest(y.kinds - 1, F.lit(1))) + (y.n - 1 - t.changes) * math.log(1 - rate)
        nats = F.greatest(-y.n * F.log(y["size"]) - text - math.log(len(ENCODINGS)), F.lit(0.0))
        ok = combined(upper_tail(uniform), 2 * upper_tail(runs), 2 * upper_tail(F.least(serial, F.lit(1e3)))) >= battery_.random_p
        return F.when(ok, F.least(F.floor(nats * 10 / math.log(10)), F.lit(battery_.most_steps))).otherwise(F.lit(0)).cast("int")

    fit = F.filter(first, lambda x: x.alphabet.isNotNull() & (x.n >= battery_.min_length) & (x["size"] > 10))
    return F.coalesce(F.get(F.transform(F.transform(fit, sums), verdict), F.lit(0)), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Battery = Battery()) -> DataFrame:
    """``doc_id, base, candidates``: spans of the fixed patterns, and tokens with their length stratum and evidence.

    ``base``: array of (start, rank of kind, kind, end), by start, then kind. Tokens are the runs of base64's alphabet
    and those of base64url's; where a run mixes both, its parts are candidates. Null texts are empty, null ids and
    repeated rows stay as they are; nothing is shuffled, and no text leaves the scan.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    folded = F.lower("_text")
    named = F.lit(False)
    for word in ASSIGN_WORDS:
        named = named | F.contains(folded, F.lit(word))
    df = _spans(df, "_assign", ASSIGN, named, ("2", 8))
    df = _spans(df, "_access", ACCESS, F.contains("_text", F.lit("AKIA")))
    df = _spans(df, "_hex", HEX, F.lit(True))
    df = _spans(df, "_plain", rf"[A-Za-z0-9+/]{{{limits.min_length},}}{PADDING}", F.lit(True))
    df = _spans(df, "_url", rf"[A-Za-z0-9_-]{{{limits.min_length},}}{PADDING}", F.lit(True))
    df = df.withColumn("_token", F.array_union("_plain", "_url")).drop("_text", "_plain", "_url")
    as_kind = lambda column, k: F.transform(column, lambda x: F.struct(x.start.alias("start"), F.lit(k).alias("rank"), F.lit(KINDS[k]).alias("kind"), x.end.alias("end")))
    df = df.withColumn("base", F.sort_array(F.concat(*[as_kind(c, k) for k, c in enumerate(("_assign", "_access", "_hex"))])))
    stratum = lambda x: sum((F.when(x.end - x.start >= edge, 1).otherwise(0) for edge in limits.length_edges), F.lit(0))
    apart = F.filter("_token", lambda x: ~F.exists("base", lambda b: (b.start < x.end) & (x.start < b.end)))
    df = df.withColumn("candidates", F.transform(apart, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), stratum(x).alias("stratum"), battery(x.token, limits).alias("steps"))))
    return df.select("doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"), "base", "candidates")


def discoveries(scanned: DataFrame, limits: Battery = Battery()) -> DataFrame:
    """``stratum, least``: the weakest evidence that Benjamini and Hochberg's rule accepts at each length.

    Counts by stratum and step come first, so the ordered window sees at most ``(edges + 1) * (steps + 1)`` rows.
    """
    counts = scanned.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.steps").count()
    by = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "steps", F.sum("count").over(by).alias("tests"), F.sum("count").over(by.orderBy(F.desc("steps"))).alias("found"))
    return ranked.where(F.pow(F.lit(10.0), -F.col("steps") / 10) * F.col("tests") <= limits.false_discovery * F.col("found")).groupBy("stratum").agg(F.min("steps").alias("least"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Battery = Battery()) -> DataFrame:
    """``scan`` with ``spans``: base ones and, as kind ``random``, the tokens that the battery finds.

    The scan is written once (ids and spans, no texts) and read twice; an empty table gives no rows. The
    thresholds are one row of at most ``edges + 1`` numbers, broadcast. Of found tokens that lie in another only the
    outer one is reported.
    """
    scanned = materialize(scan(docs, id_col, text_col, limits))
    least = materialize(discoveries(scanned, limits).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))).alias("_least")))
    found = F.filter("candidates", lambda x: F.coalesce(x.steps >= F.element_at("_least", x.stratum), F.lit(False)))
    inside = lambda x, y: (y.start <= x.start) & (x.end <= y.end) & (y.end - y.start > x.end - x.start)
    scanned = scanned.crossJoin(F.broadcast(least)).withColumn("_found", found)
    outer = F.filter("_found", lambda x: ~F.exists("_found", lambda y: inside(x, y)))
    random = F.transform(outer, lambda x: F.struct(x.start.alias("start"), F.lit(3).alias("rank"), F.lit(KINDS[3]).alias("kind"), x.end.alias("end")))
    return scanned.withColumn("spans", F.sort_array(F.concat("base", random))).drop("_least", "_found", "candidates")


def span_text(spans: str) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
