"""The registered queries against DuckDB, or against brute force where SQL cannot say it."""
import zlib

import numpy as np
import public_tokenizers
import pytest

from cuewright.llm.queries import ORACLES, QUERIES, held_out  # noqa: F401
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == ""


@pytest.fixture(scope="module")
def docs(spark):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


def test_packing_is_the_tokenizer_cut_into_windows(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in docs.items()}
    rows = QUERIES["op5_packing"](spark, SF_DIR).collect()
    pieces, places = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == len(x)
    for s, x in places.items():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at == 2048 or s == max(places)


def test_pieces_round_trip_and_decode_like_the_library(spark, docs):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = QUERIES["op3_sentencepiece"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() and r.n_ids == len(r.ids)
        assert sp.decode(list(r.ids)) == docs[r.doc_id]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = QUERIES["op6_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    yes, no = ([r.score for r in held if labels[r.doc_id] == k] for k in (1, 0))
    assert np.mean([a > b for a in yes for b in no]) + np.mean([a == b for a in yes for b in no]) / 2 > 0.75
    assert sum(r.predicted for r in held if labels[r.doc_id] == 0) <= 0.03 * len(no)


def test_toxicity_recall_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    known = {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{sf}/labels.parquet").join(
        spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").select("doc_id", "toxic", "lang").collect()}
    held = [(r.predicted, *known[r.doc_id]) for r in QUERIES["op6_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in known]
    share = lambda rows: sum(p for p, *_ in rows) / len(rows)
    assert share([x for x in held if x[1] == 1]) >= 0.85 and share([x for x in held if x[1] == 0]) <= 0.03
    for lang in ("en", "fr", "de", "es"):
        assert share([x for x in held if x[1] == 1 and x[2] == lang]) >= 0.7


def test_licence_base_by_brute_force(spark, docs):
    import re

    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for r in QUERIES["op10_license_scan"](spark, SF_DIR).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", docs[r.doc_id].translate(lower))
        at = sorted((i, k) for k, p in phrases.items() for i in range(len(words)) if words[i:i + len(p)] == p)
        want = (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({k for _, k in at})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    planted = [(10**6, "A quiet note on the release: password = hunter2hunter2 and nothing more.", "en", "src1", 72)]  # this size has no secret
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    before, steps = {r.doc_id: r for r in docs.collect()}, {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps[name] = {r.doc_id: r for r in docs.collect()}
    squeeze = lambda t: __import__("re").sub(r"[\x20\x09-\x0d]+", " ", t or "")
    left = steps["toxicity"]
    assert 0.8 * len(before) < len(left) < len(before)
    first = {}
    for d in sorted(left):
        first.setdefault(squeeze(left[d].text), d)
    assert set(steps["exact_dedup"]) == set(first.values())
    assert set(steps["minhash_dedup"]) == set(steps["secret_scan"]) < set(steps["exact_dedup"])
    changed = [r for d, r in steps["secret_scan"].items() if r.text != before[d].text]
    assert changed and all("[secret]" in r.text and r.n_chars == len(r.text) for r in changed)
    packed = P.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in packed} == set(steps["secret_scan"])
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())
