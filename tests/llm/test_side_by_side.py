"""Work done for many pieces or suffixes at once gives what the plain ways give."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from ledgerloom.llm import bpe, suffixes


def test_bpe_short_pieces_side_by_side(monkeypatch):
    """op10: short pieces take no step of their own, ids and answers about pairs stay those of the plain ways."""
    ranks, r = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(2)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges = bpe.last_merges(ranks)
    encoder = bpe.TextEncoder(ranks, public_tokenizers.PATTERN, merges)
    plain, single = bpe.PrefixBpe(ranks).encode_piece, []
    monkeypatch.setattr(encoder.bpe, "encode_piece", lambda data: single.append(data) or plain(data))
    odd = "ab \n\t\r\x0b\x1c\x85\xa0 'stre12é漢😀.,!$# 　"
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    texts += [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 30))) for _ in range(40)) for _ in range(50)]
    monkeypatch.setattr(bpe, "MEMO", 500)
    for part in (texts[:700], texts[700:2010], texts[2010:]):
        assert encoder.ids_of(pa.array(["x", *part]).slice(1)).to_pylist() == [own.encode_ordinary(t) for t in part]
    assert single and min(map(len, single)) > bpe.SHORT
    tokens = [r.choice(list(ranks.values())) for _ in range(4000)] + merges[1000:3000].ravel().tolist()
    a, b = np.array(tokens[::2]), np.array(tokens[1::2])
    assert encoder.short.apart(a, b).tolist() == [encoder.bpe.stay_apart(encoder.bpe.bytes_of[x], encoder.bpe.bytes_of[y]) for x, y in zip(a.tolist(), b.tolist())]
    # A token that its own bytes do not give makes the merges unknown, and pieces go one by one.
    assert bpe.last_merges({b"a": 0, b"b": 1, b"c": 2, b"abc": 3}) is None


@pytest.mark.parametrize("limit", [2, 20])
def test_suffixes_by_doubling(monkeypatch, limit):
    """op7: reduced texts of many letters are sorted by doubling, in few rounds, below a level that is induced."""
    monkeypatch.setattr(suffixes, "SCALAR_FROM", limit)
    r, sorts, plain = random.Random(3), [], np.argsort
    for k in (1, 2, 3, 30):
        for n in (0, 1, 2, 50, 700):
            some = [r.randint(1, k) for _ in range(n)]
            s = np.array((some * 3 if n < 300 else some + some[:200] * 3) + [0])
            assert suffixes.suffix_array(s, k + 1).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    monkeypatch.setattr(suffixes.np, "argsort", lambda *a, **b: sorts.append(1) or plain(*a, **b))
    s = np.append(np.tile(np.arange(2000, 0, -1), 8), 0)
    assert suffixes._doubled(s)[:2].tolist() == [16000, 15999] and len(sorts) == 15


def test_hashes_of_grams_and_windows():
    """op7: equal grams have equal hashes whatever block they stand in, equal windows choose equal places, the rightmost of equal ones."""
    r = random.Random(4)
    text = bytes(r.choice(b"ab") for _ in range(3000)) + b"a" * 300
    data = np.frombuffer(text + b"#" + text, np.uint8)
    h = suffixes.gram_hashes(data)
    assert len({(text[i : i + suffixes.GRAM], int(h[i])) for i in range(len(text) - suffixes.GRAM)}) == len({text[i : i + suffixes.GRAM] for i in range(len(text) - suffixes.GRAM)}) == len({int(x) for x in h[: len(text) - suffixes.GRAM]})
    chosen = suffixes.window_minima(h)
    n = len(text) - suffixes.LENGTH + 1
    assert (chosen[:n] + len(text) + 1 == chosen[len(text) + 1 : len(text) + 1 + n]).all()
    for i in range(0, n, 7):
        own = h[i : i + suffixes.WIDTH] >> np.uint64(32)
        assert chosen[i] == i + np.flatnonzero(own == own.min())[-1]


def test_contexts_are_cut_by_the_batch(spark, monkeypatch):
    """op7: contexts of many rows come in one batch, and in parts of bounded bytes with the same rows."""
    text = "".join(random.Random(5).choice("abcd ") for _ in range(400))
    docs = spark.createDataFrame([(i, text[i:] + "é", i) for i in range(40)], "doc_id long, text string, text_hash long").repartition(1)
    places = spark.createDataFrame([(i, i, 7, at, 1 + at % 3, 0, 0) for i in range(40) for at in (0, 50, 101)], "doc_id long, text_hash long, core long, at int, n int, lead int, n_contexts long")
    want = {(i, at, text[i + at : i + at + at % 3 + 100]) for i in range(40) for at in (0, 50, 101)}
    for most in (1 << 22, 700):
        monkeypatch.setattr(suffixes, "MOST", most)
        whole = suffixes.contexts(docs, places, True).collect()
        assert len(whole) == 120 and {(r.doc_id, r["at"], bytes(r.context).decode()) for r in whole} == want
        keys = {bytes(r.key) for r in suffixes.contexts(docs, places, False).collect()}
        assert len(keys) == len({c for _, _, c in want})
