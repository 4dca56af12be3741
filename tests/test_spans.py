"""Located quotes, hidden characters, claimed spans and nested tables on hard cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import spans as S


def located(spark, texts, quotes):
    """texts: (id, text, section start, section end); quotes: {id: quote}."""
    docs = spark.createDataFrame(texts, "doc_id long, text string, section_start int, section_end int")
    return {(r.doc_id, r.quote_id): (r.start, r.end) for r in S.locate_quotes(docs, spark.createDataFrame(list(quotes.items()), "quote_id long, quote string")).collect()}


def test_quotes_keep_the_places_of_the_text(spark):
    text = "😀 A\tquoted\n\n clause of\u00a0five. Again: A quoted clause of five, and (one) more [x] \\E end of a very long clause here."
    quotes = {1: "A quoted  clause of five", 2: "quoted clause of", 3: "a quoted clause of five", 4: "(one) more [x] \\E end of a very long", 5: " ", 6: None, 7: "uoted clause of fiv"}
    got = located(spark, [(1, text, 0, len(text)), (2, text, 30, len(text)), (3, text, 90, 95), (4, None, 0, 0)], quotes)
    assert {k: text[a:b] for k, (a, b) in got.items()} == {
        (1, 1): text[2:27], (2, 1): "A quoted clause of five", (3, 1): text[2:27], **{(d, 4): "(one) more [x] \\E end of a very long" for d in (1, 2, 3)}, (1, 7): text[5:26], (2, 7): "uoted clause of fiv", (3, 7): text[5:26],
    }
    assert text[2:27] == "A\tquoted\n\n clause of\u00a0five"


def test_quotes_against_a_plain_search(spark):
    r = random.Random(4)
    word = lambda: r.choice("ab cd ef gh ij".split())
    texts = [(k, "".join(word() + r.choice([" ", "  ", "\n", "\t "]) for _ in range(60)), *sorted((r.randrange(100), r.randrange(200)))) for k in range(40)]
    quotes = {q: " ".join(word() for _ in range(r.choice([3, 4, 5, 9]))) for q in range(60)}
    want = {}
    for d, t, a, b in texts:
        for q, quote in quotes.items():
            found = [(m.start(1), m.end(1)) for m in re.finditer(r"(?=(" + r"\s+".join(map(re.escape, quote.split())) + "))", t)]
            if found and len(quote.split()) >= 4:
                want[d, q] = next((x for x in found if a <= x[0] < b), found[0])
    assert located(spark, texts, quotes) == want and len(want) > 50


def test_hidden_characters(spark):
    df = spark.createDataFrame([(1, "a\u200b😀\U000e0041b\ufe0f"), (2, "plain é"), (3, None), (4, ""), (5, "\u00ad\u00ad")], "doc_id long, text string")
    assert sorted(map(tuple, S.hidden_characters(df).collect())) == [(1, 1, 0x200B, "ZWSP"), (1, 3, 0xE0041, "TAG"), (1, 5, 0xFE0F, "VS"), (5, 0, 0xAD, "SHY"), (5, 1, 0xAD, "SHY")]
    shown = {r.doc_id: r.t for r in df.select("doc_id", S.show_hidden(F.col("text")).alias("t")).collect()}
    assert shown == {1: "a[ZWSP]😀[TAG]b[VS]", 2: "plain é", 3: None, 4: "", 5: "[SHY][SHY]"}
    assert S.hidden_characters(df.limit(0)).count() == 0


def test_claims_keep_later_patterns_out(spark):
    rules = S.SECRETS + S.PERSONAL
    texts = {
        "x://u:555-123-4567@h.org 555-123-4567": [(0, 19, "url_credentials"), (25, 37, "phone")],
        "card 4111 1111 1111 1111": None,
        "😀 a@b.c.d@e.f": [(2, 9, "email")],
        "deadbeef" * 4 + " me@x.org": [(0, 32, "hex"), (33, 41, "email")],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").withColumn("spans", S.claimed_spans(rules)("text"))
    got = df.withColumn("shown", S.covered(F.col("text"), F.col("spans"), lambda k: F.concat(F.lit("<"), k, F.lit(">")))).collect()
    for r in got:
        if r.text is None:
            assert r.spans == [] and r.shown is None
            continue
        spans = [tuple(s) for s in r.spans]
        assert all(b <= c for (_, b, _), (c, _, _) in zip(spans, spans[1:]))
        if texts[r.text] is not None:
            assert spans == texts[r.text]
        want = r.text
        for a, b, k in reversed(spans):
            want = want[:a] + f"<{k}>" + want[b:]
        assert r.shown == want


def test_invalid_cards_do_not_split_a_gap():
    """A number that fails Luhn's check is left whole for the rules after it."""
    rules = tuple((k, re.compile(p, re.A)) for k, p in S.SAFETY)
    assert S.claims("4111-1111-1111-1111", rules) == [(0, 19, "credit_card")]
    assert [k for _, _, k in S.claims("4111-1111-1111-1112", rules)] == []
    assert [k for _, _, k in S.claims("12345678901234567 555 123 4567", rules)] == ["phone"]
    assert S.claims("078 05 1120 0000 0000 0000", rules)[0] == (0, 11, "ssn")


def test_nested_tables():
    deep = "<p>a</p><table><tr><td>1</td><td><table><tr><td>2<table><tr><th>3 | x</th></tr></table></td></tr></table></td></tr><tr><td>4</td></tr></table>z"
    assert S.tables_as_markdown(deep) == "<p>a</p>\n| 1 | \\| 2 \\\\\\| 3 \\\\\\\\\\\\\\| x \\\\\\| \\\\\\| --- \\\\\\| \\| \\| --- \\| |\n| --- | --- |\n| 4 |  |\nz"
    assert S.tables_as_markdown("a<table></table>b<table><tr><td>c") == "ab\n| c |\n| --- |\n"
    plain = '<!DOCTYPE html><a href="x">&amp;&#39;</a><!-- <table> --><br/><script>if (a < b) {}</script>'
    assert S.tables_as_markdown(plain) == plain and S.tables_as_markdown("") == ""


@pytest.mark.parametrize("plain", ["AT&T &amp &lt;b> &#65 &copy", "<DIV>a</DIV><p>b</P ></ b></>c", "<?php x ?><!-- a --!>b<!doctype HTML ><![CDATA[c]]>d", "<BR/ ><SCRIPT>if (a < b) {}</SCRIPT >", "\r\nx\ry", "<![if x]>y<![endif]>"])
def test_pages_are_kept_as_they_are(plain):
    """Not parsed and built again: case, entities without a semicolon and odd markup stay, before and behind a table and in its text."""
    assert S.tables_as_markdown(plain) == plain
    assert S.tables_as_markdown(f"{plain}<table><tr><td>A&T &#65 &lt;</table>{plain}") == f"{plain}\n| A&T &#65 &lt; |\n| --- |\n{plain}"
    for open_end in ("<script>if (a < b) {}", "a <", "a <b", "&#", "</"):
        assert S.tables_as_markdown(plain + open_end) == plain + open_end


def test_short_quotes_meet_texts_by_their_words(spark):
    """No text is compared with every quote, however short the quotes are."""
    docs = spark.createDataFrame([(k, f"w{k} a b c d e f", 0, 20) for k in range(50)], "doc_id long, text string, section_start int, section_end int")
    quotes = spark.createDataFrame([(k, f"w{k} a b c") for k in range(50)], "quote_id long, quote string")
    found = S.locate_quotes(docs, quotes)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.quote_id) for r in found.collect()} == {(k, q) for k in range(50) for q in range(50) if f"w{k}".endswith(f"w{q}")}
