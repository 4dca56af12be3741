"""Text expressions: cells, tokens, redaction, hidden characters, entities, chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_cell(value: Column) -> Column:
    """A CSV cell: a leading formula character gets a quote mark before it; quoted if it needs to be."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def like_escape(literal: str, mark: str = "!") -> str:
    """A literal for LIKE ... ESCAPE: its wildcards and the mark itself are marked."""
    return "".join(mark + c if c in f"{mark}%_" else c for c in literal)


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regex: ``**/`` any directories, ``**`` anything, ``*`` and ``?`` within a name."""
    out, at = [], 0
    rules = (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]"))
    while at < len(pattern):
        for token, regex in rules:
            if pattern.startswith(token, at):
                out.append(regex)
                at += len(token)
                break
        else:
            out.append("\\" + pattern[at] if not pattern[at].isalnum() else pattern[at])
            at += 1
    return "^" + "".join(out) + "$"


#: Hidden characters by label.
HIDDEN = (("ZERO-WIDTH", "\\u200b-\\u200d\\u2060\\ufeff"), ("BIDI", "\\u202a-\\u202e\\u2066-\\u2069"), ("VARIATION", "\\ufe00-\\ufe0f"))
#: Phrases that weaken a requirement, by rule: vague terms, escape clauses, open-ended clauses, placeholders.
WEAK = {
    "R7": (
        "some", "several", "many", "a lot of", "a few", "almost always", "very nearly", "nearly", "close to", "almost", "approximately", "approximate", "relevant", "routine", "generic", "significant", "flexible",
        "expandable", "typical", "typically", "sufficient", "adequate", "appropriate", "efficient", "effective", "reasonable", "user-friendly", "easy", "easily", "fast", "quickly", "quick", "robust", "timely",
        "intuitive", "seamless", "seamlessly", "minimal", "large", "small",
    ),
    "R8": (
        "so far as is possible", "as far as possible", "as little as possible", "as much as possible", "where possible", "wherever possible", "if possible", "if it should prove necessary", "if necessary", "where necessary",
        "to the extent necessary", "as appropriate", "where appropriate", "as required", "to the extent practical", "if practicable", "if needed",
    ),
    "R9": ("including but not limited to", "but not limited to", "etc.", "and so on", "and/or"),
    "TBD": ("TBD", "TBC", "TBA", "to be determined", "to be confirmed", "to be decided"),
}
STOPWORDS = ("and", "are", "for", "from", "has", "that", "the", "this", "was", "with")
#: Requests that a safety scan blocks, by kind.
INJECTION = {
    "prompt_injection": r"\bignore\s+(?:all\s+)?(?:previous|prior|above|the)\s+(?:instructions?|prompts?|rules?|system\s+messages?)\b",
    "role_override": r"\byou\s+are\s+now\s+(?:a|an)\s+(?:new\s+)?(?:assistant|persona|character|model|developer|admin|root)\b",
    "system_prompt_extraction": r"\b(?:show|reveal|print|repeat|output|leak|dump|disclose)\s+(?:me\s+)?(?:the\s+)?(?:system\s+prompt|hidden\s+instructions?|developer\s+message|initial\s+prompt)\b",
    "jailbreak": r"\b(?:dan\s+mode|jailbreak|do\s+anything\s+now|developer\s+mode\s+enabled|sudo\s+mode)\b",
}
EMAIL, PHONE, SSN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", r"\b\d{3}-\d{2}-\d{4}\b"
#: The same matches as EMAIL, tried only where a run of its characters begins or the match before ended.
EMAIL_AT_RUN = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = r"\b\d(?:[ -]?\d){12,18}\b"


def tokenize(text: Column) -> Column:
    """Lower-case ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def content_tokens(text: Column) -> Column:
    """Words of three letters or more that are not stop words, in order."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: F.length(w) >= 3)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def stem(word: Column) -> Column:
    return F.when((F.length(word) > 3) & word.endswith("s"), F.substring(word, 1, F.length(word) - 1)).otherwise(word)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def identifier(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r'["`\[\]]', "")))


def composite_key(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them, so that no two splits of a string agree."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def luhn_ok(digits: Column) -> Column:
    """Luhn's check over a string of 13 to 19 digits."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return digits.rlike(r"^\d{13,19}$") & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def redact_cards(text: Column, label: str = "[CARD]") -> Column:
    """Numbers of 13 to 19 digits, spaced or dashed, that pass Luhn's check; others stay as they are."""
    found, rest = F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), F.split(text, CARD, -1)
    shown = F.transform(found, lambda m: F.when(luhn_ok(F.regexp_replace(m, "[ -]", "")), F.lit(label)).otherwise(m))
    pieces = F.zip_with(rest, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(CARD), F.array_join(pieces, "")).otherwise(text)


def redact(text: Column) -> Column:
    """Emails, phone numbers, social security numbers, then card numbers; the order decides what overlaps become.

    Texts without an @ or three digits in a row are not searched for what needs them.
    """
    out = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL_AT_RUN, "[EMAIL]")).otherwise(text)
    numbers = redact_cards(F.regexp_replace(F.regexp_replace(out, PHONE, "[PHONE]"), SSN, "[SSN]"))
    return F.when(out.rlike(r"\d{3}|\d[ -]\d"), numbers).otherwise(out)


def redact_value(value: Column, kind: T.DataType, depth: int = 8) -> Column:
    """Every string within a value redacted, down to ``depth`` levels of arrays, structs and map values."""
    if isinstance(kind, T.StringType):
        return redact(value)
    if depth and isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, kind.elementType, depth - 1))
    if depth and isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: redact_value(v, kind.valueType, depth - 1))
    if depth and isinstance(kind, T.StructType):
        fields = [redact_value(value.getField(f.name), f.dataType, depth - 1).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def weak_phrases(text: Column) -> Column:
    """Distinct phrases of ``WEAK`` in a text, lower case, the longest at each place; letters and digits bound them."""
    every = sorted((p for phrases in WEAK.values() for p in phrases), key=lambda p: (-len(p), p))
    pattern = "|".join(re.escape(p.lower()).replace(r"\ ", r"\s+") for p in every)
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{pattern})(?![\p{{L}}\p{{N}}])"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"\s+", " ")))


def weak_rule(phrase: Column) -> Column:
    out = F.lit(None).cast("string")
    for rule, phrases in WEAK.items():
        out = F.when(phrase.isin(*[p.lower() for p in phrases]), rule).otherwise(out)
    return out


def redact_keys(props: Column, *sensitive: str) -> Column:
    """A flat JSON object with the values of sensitive keys replaced; null where malformed."""
    return F.to_json(F.transform_values(F.from_json(props, "map<string,string>"), lambda k, v: F.when(F.lower(k).isin(*sensitive), F.lit("[REDACTED]")).otherwise(v)))


def annotate_hidden(text: Column) -> Column:
    for label, chars in HIDDEN:
        text = F.regexp_replace(text, f"[{chars}]", f"[{label}]")
    return text


#: Patterns and what they become, in order: headings, emphasis, links, list items, breaks, other tags, entities (``&amp;`` last).
MARKDOWN = (
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), (r"(?s)<!--.*?-->", ""), *((rf"(?i)<h{n}[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)),
    (r"(?i)</?(b|strong)(\s[^>]*)?>", "**"), (r"(?i)</?(i|em)(\s[^>]*)?>", "_"), (r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', r"[$2]($1)"), (r"(?i)<li[^>]*>", "\n- "), (r"(?i)<br[^>]*>|</(p|div|h[1-6]|ul|ol|tr)>", "\n"), (r"<[^>]*>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
)


def html_to_markdown(html: Column) -> Column:
    """Headings, emphasis, links, list items and breaks; other tags go, entities last and ``&amp;`` after all others."""
    for pattern, to in MARKDOWN:
        html = F.regexp_replace(html, pattern, to)
    return html


def clean_pdf(text: Column) -> Column:
    """Line ends unified, lines all in capitals made headings, and runs of blank lines collapsed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(?m)^([A-Z][A-Z .!,]{3,})$", "## $1")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def sentences(text: Column) -> Column:
    """Statements of eight characters or more: lines without bullets or heading marks, cut after full stops."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s*([-*#>]+|\d+[.)])\s*", ""))
    return F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"([.!?]) +", "$1\u0001"), "\u0001"))), lambda s: F.trim(s)), lambda s: F.length(s) >= 8)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """(position, text) windows of ``size`` characters that share ``overlap`` (half of them at most); one empty window for an empty text, a null one for null.

    The text is cut into steps once, and a window is a step with the opening of the next, so that the time is linear in its length.
    """
    step = size - overlap
    if overlap > step:
        raise ValueError("windows share half of their characters at most")
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step).cast("int") - 1)
    at = lambda steps, i: F.coalesce(F.get(steps, i), F.lit(""))
    window = lambda steps, i: F.struct(i.alias("position"), F.when(steps.isNotNull(), F.concat(at(steps, i), F.substring(at(steps, i + 1), 1, overlap))).alias("text"))
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return F.get(F.transform(F.array(steps), lambda s: F.transform(F.sequence(F.lit(0), last), lambda i: window(s, i))), F.lit(0))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.format_string(f"[{most} of %d]", F.length(text)))).otherwise(text)


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Of two sets as arrays; ``empty`` is the value for two empty ones, which callers define differently."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def extractive_summary(text: Column, most: int) -> Column:
    """The best sentences that fit ``most`` characters, in their order; short texts stay, one or two sentences are cut.

    The first scores 10, the last 8, one that names an entity or a number 3, a short one with a digit 2; ties by place.
    """
    from ledgerloom.operators.matching import fitting

    parts = F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")

    def scored(all_: Column) -> Column:
        last = F.size(all_) - 1
        score = lambda s, i: F.when(i == 0, 10).otherwise(0) + F.when(i == last, 8).otherwise(0) + F.when(s.rlike(r"[A-Z][A-Za-z]+[^.!?]* [A-Z][a-z]+|\d"), 3).otherwise(0) + F.when((F.length(s) < 100) & s.rlike(r"\d"), 2).otherwise(0)
        return F.transform(all_, lambda s, i: F.struct((-score(s, i)).alias("less"), i.alias("i"), s.alias("s")))

    taken = fitting(F.array_sort(scored(parts)), lambda x: F.length(x.s), most, 1)
    chosen = F.array_join(F.transform(F.array_sort(F.transform(taken, lambda x: F.struct(x.i.alias("i"), x.s.alias("s")))), lambda x: x.s), " ")
    return F.when(F.length(text) <= most, text).when(F.size(parts) <= 2, F.substring(text, 1, most)).otherwise(chosen)


def code_terms(text: Column) -> Column:
    """Identifiers in lower case and their camel- and snake-case parts, distinct, stemmed lightly, without stop words."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.split(snake_case(w), "_")))
    every = F.filter(F.concat(F.transform(words, lambda w: F.lower(w)), parts), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)

    def root(w: Column) -> Column:
        n = F.length(w)
        out = F.when((n > 4) & w.endswith("ies"), F.concat(cut(w, 3), F.lit("y"))).when((n > 5) & w.endswith("ing"), cut(w, 3)).when((n > 4) & w.endswith("ed"), cut(w, 2))
        return out.when((n > 3) & w.endswith("s") & ~w.endswith("ss"), cut(w, 1)).otherwise(w)

    return F.array_distinct(F.transform(every, root))


def branch_issues(branch: Column) -> Column:
    """Numbers over zero of a branch name (``issue-12``, ``gh-12`` or bare between separators), each once, in order."""
    found = F.regexp_extract_all(branch, F.lit(r"(?:^|[/_-])(?:issue-?|gh-?)?(\d+)(?=$|[/_-])"), F.lit(1)).cast("array<bigint>")
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n > 0)))


def normalise_criterion(text: Column) -> Column:
    """A criterion without code citations, lower case, letters and digits apart by single spaces."""
    citation = r"[(\[]?[\w./-]+\.\w+:\d+(?:-\d+)?[)\],.;]*"
    out = F.regexp_replace(text, rf"\((?=[^()]*\b[\w./-]+\.\w+:\d)[^()]*\)", " ")
    out = F.regexp_replace(out, rf"(?<!\S){citation}(?!\S)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def hash_embedding(text: Column, size: int, model: str) -> Column:
    """``size`` numbers (a multiple of 8) from the SHA-256 of model, counter and text, as a vector of length 1."""
    if size <= 0 or size % 8:
        raise ValueError("the size must be a positive multiple of 8")
    blocks = [F.sha2(F.concat(F.lit(f"{model}|{k}|"), text), 256) for k in range(-(-size // 32))]
    digits = F.concat(*blocks)
    values = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(values, lambda x: x / F.when(length == 0, 1.0).otherwise(length))


def code_fence(text: Column) -> Column:
    """Back quotes, one more than the longest run in the text and three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda x: F.length(x)))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+!|<>-])", r"\\$1")


def markdown_row(*cells: Column) -> Column:
    """One line of a table: cells in a line each, bars escaped, nulls empty."""
    flat = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *flat), F.lit(" |"))


def patch_lines(patch: Column) -> Column:
    """Distinct added and removed lines of a patch, without its file headers."""
    return F.array_distinct(F.filter(F.split(patch, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)")))


def json_contains(whole: Column, part: Column) -> Column:
    """Whether every entry of a flat JSON object is in another one; false where either is malformed."""
    a, b = (F.from_json(x, "map<string,string>") for x in (whole, part))
    return F.coalesce(F.forall(F.map_entries(b), lambda e: F.coalesce(F.element_at(a, e["key"]) == e["value"], F.lit(False))), F.lit(False))
