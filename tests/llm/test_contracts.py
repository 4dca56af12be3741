"""The registered queries against their contracts, and edges of operators and pipeline stages, on small tables."""

import hashlib
import json
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bpe, chat, classifier, decontaminate, licenses, lines, quality, queries, secrets, simhash, suffixes

from . import brute

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    done = queries.QUERIES[name](spark, SF)
    return done, {r.doc_id: r for r in done.collect()}


def test_op2(spark, texts):
    done, got = rows_of(spark, "op2_secret_scan")
    assert done.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and set(got) == set(texts)
    for d, t in texts.items():
        base = brute.secrets(t)
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in base) for k in ("assign", "access", "hex"))
        spelled = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == sha(",".join(spelled)) and set(spelled) <= {x for x in r.spans.split(",") if x}


def test_op3(spark, texts):
    done, got = rows_of(spark, "op3_quality_rules")
    assert done.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for d, t in texts.items():
        f, r = brute.features(t), got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 10 or 100 * f[4] > 20 * f[0]) and not (r.base_failed and r.kept)


def test_op4(spark, texts):
    done, got = rows_of(spark, "op4_simhash")
    fps = [(d, brute.simhash(t)) for d, t in sorted(texts.items())]
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{f:016x}", c) for (d, f), c in zip(fps, brute.components(fps))}


def test_op5(spark, texts):
    done, got = rows_of(spark, "op5_license_scan")
    assert set(got) == set(texts) and {r.origin for r in got.values()} <= {"own", "inherited", "none"}
    assert all((r.license is None) == (r.origin == "none") for r in got.values())


def test_op6(spark, texts):
    done, got = rows_of(spark, "op6_quality_classifier")
    assert done.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and set(got) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())


def test_op6_ranks_held_out_documents(spark):
    """Area under the curve of the held-out labels of sf0.1, by ranks; none of them is fitted."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op6_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    good, n = got.quality == 1, len(got)
    ranks = got.score.rank()
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (n - good.sum()))
    assert n > 500 and auc > 0.88


def test_op7(spark, texts):
    done, got = rows_of(spark, "op7_suffix_array")
    for d, (kept, spans) in brute.dedup_bytes(texts).items():
        n = len(texts[d].encode())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (n, n - len(kept), spans, sha(kept))


def test_op9(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, SF).collect()}
    assert got == brute.leaks(texts, items)


def test_op10(spark, texts):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done, got = rows_of(spark, "op10_byte_bpe")
    for d, t in texts.items():
        ids = own.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t))


CLASHES = "_id _hash _runs _text _words _hashes _fp _keep _stratum _c0 id hash none row text_hash rest key runs words hashes lines windows sorted again m0 cut fp n_lines spans kept decoded ids".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Odd rows under columns with the names that operators use inside."""
    data = [(1, "a b c\nd\ne f\n" * 4, "en"), (1, "a b c\nd\ne f\n" * 4, "en"), (2, None, None), (None, "", "en"), (None, "x y z\nd\ne f\n" * 4, "fr"), (3, " ".join(f"w{i}" for i in range(40)), "en")]
    df = spark.createDataFrame([(*r, "src", 3) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(CLASHES)])


def values(df, *without):
    columns = [c for c in CLASHES if c not in without]
    return {tuple(r) for r in df.select(*columns).distinct().collect()}, {tuple(f"v{k}" for k, c in enumerate(CLASHES) if c in columns)}


def test_clashing_names(spark, clashing):
    got, want = values(lines.dedup_lines(clashing), "n_lines")
    assert got == want and lines.dedup_lines(clashing).count() == 6
    measured = quality.features(clashing)
    got, want = values(measured)
    assert got == want and measured.count() == 6
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    judged = quality.judge(measured.drop("kept"), quality.calibrate(measured, labels))
    got, want = values(judged, "kept")
    assert got == want and judged.count() == 6
    kept = simhash.keep_one(clashing)
    got, want = values(kept)
    assert got == want and kept.columns == clashing.columns and kept.where("doc_id = 1").count() == 1
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    clean = decontaminate.remove_leaks(clashing, bench)
    got, want = values(clean)
    assert got == want and clean.columns == clashing.columns and clean.where("doc_id = 3").count() == 0 and clean.count() == 5
    assert secrets.find_secrets(clashing).count() == suffixes.dedup_bytes(clashing).count() == simhash.near_duplicates(clashing).count() == 6
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.decode(bpe.encode(clashing, path, public_tokenizers.PATTERN), path)
    assert sorted(bytes(r.decoded).decode() for r in back.collect()) == sorted(r.text or "" for r in clashing.collect())
    assert licenses.scan(clashing, "doc_id", "source", "text").count() == 6
    model = classifier.fit(["a", "b"], [0, 1])
    assert classifier.score(clashing, model).where("doc_id IS NULL").count() == 2


def test_empty_tables(spark, clashing):
    none = clashing.limit(0)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = classifier.fit(["a", "b"], [0, 1])
    for df in (bpe.encode(none, path, public_tokenizers.PATTERN), bpe.round_trip(none, path, public_tokenizers.PATTERN), classifier.score(none, model), quality.features(none), lines.dedup_lines(none), simhash.near_duplicates(none), suffixes.dedup_bytes(none)):
        assert df.count() == 0
    assert classifier.training_rows(none, spark.createDataFrame([], "doc_id long, quality int")) == ([], [])
    assert chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("labels,items", [("none", "none"), ("some", "some")])
def test_stages_on_odd_rows(spark, clashing, tmp_path, labels, items):
    """Every stage on null texts and ids, repeated rows, clashing columns and an empty table; without labels or items nothing is rejected for them."""
    own = [(1, 1, 0), (None, 0, 0), (3, None, 1)] if labels == "some" else []
    bench = [(1, " ".join(f"w{i}" for i in range(40))), (2, None), (3, "")] if items == "some" else []
    spark.createDataFrame(own, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (clashing, clashing.limit(0)):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert at.columns == corpus_pipeline.COLUMNS
        n = at.count()
        assert n == 0 if docs is not clashing else n == (1 if items == "none" else 0)


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "byte-level BPE"]
    assert json.dumps(corpus_pipeline.COLUMNS) == json.dumps(["doc_id", "text", "lang", "source", "n_chars"])
