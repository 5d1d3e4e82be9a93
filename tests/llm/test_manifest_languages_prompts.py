"""The operators on lines, transcripts and chat requests against brute force, and on awkward rows."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from cuewright.llm import languages, manifest, midstates, prompts
from cuewright.llm.common import Scratch
from cuewright.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
LINE = "vid string, id bigint, start_ms bigint, end_ms bigint, text string, en string, at bigint, tree string, lone boolean, digest string"
MESSAGE = "request bigint, turn bigint, role string, content string, place bigint, length bigint, words bigint, base bigint"


@pytest.fixture
def scratch(spark):
    s = Scratch(spark)
    yield s
    s.drop()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_prefix_trie"])
def test_queries_same_as_duckdb(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == ""


# ---- manifest ---------------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fanout):
    """Levels from the leaves to the top, and each leaf's siblings."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i:i + fanout])) for i in range(0, len(now), fanout)])
    proofs = []
    for i in range(len(leaves)):
        out = ""
        for level in levels[:-1]:
            run = level[i // fanout * fanout:i // fanout * fanout + fanout]
            out += "".join(run[:i % fanout] + run[i % fanout + 1:])
            i //= fanout
        proofs.append(out)
    return levels[-1][0], proofs


def expected(rows, fanout, edit):
    videos = {}
    for r in rows:
        videos.setdefault(r[0], []).append(r)
    out, tops, kept = [], [], {}

    def root_of(change=None):
        subs = []
        for vid in sorted(videos, key=lambda v: (v is not None, (v or "").encode())):
            lines = sorted(videos[vid], key=lambda r: (r[1] is not None, r[1] or 0, sha("".join(map(enc, r)))))
            leaves = [sha("".join(map(enc, r))) for r in lines]
            if change and change[0] == vid:
                leaves[change[1]] = change[2]
            subs.append((vid, lines, leaves, *tree(leaves, fanout)))
        return tree([s[3] for s in subs], fanout), subs

    (root, above), subs = root_of()
    for (vid, lines, leaves, sub, proofs), up in zip(subs, above, strict=True):
        for k, (r, leaf, proof) in enumerate(zip(lines, leaves, proofs, strict=True)):
            now = sha("".join(map(enc, edit(r))))
            folded = root if now == leaf else root_of((vid, k, now))[0][0]
            out.append((vid, r[1], leaf, sub, root, sha(proof + up), folded, folded == root))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_is_the_trees_hashes(spark, scratch, fanout):
    r = random.Random(fanout)
    rows = [(v, i, 100 * i, 100 * i + 90, f"Línea {i} of {v}", r.choice([None, "", "A line"]))
            for v, n in (("hot", 75), ("b", 17), ("a", 1), ("ü", 16), (None, 5)) for i in range(n)]
    rows += [("dup", None, None, None, None, None)] * 2 + [("dup", 4, 1, 2, "same", "id"), ("dup", 4, 1, 2, "twice", "id"), ("long", 1, 0, 9, "x" * 300_000, "")]
    edit = lambda t: t[:4] + ((t[4].upper() if t[4] is not None and t[1] is not None and t[1] % 5 == 1 else t[4]),) + t[5:]
    df = spark.createDataFrame([(*t, 1, "t", True, "d") for t in rows], LINE)
    now = {"text": F.when(F.col("id") % 5 == 1, F.upper("text")).otherwise(F.col("text"))}
    got = manifest.manifest(df, scratch, now=now, fanout=fanout).select(
        "vid", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows, fanout, edit)))
    assert not all(x.verified for x in got)


def test_manifest_of_one_line_of_none_and_unchanged(spark, scratch):
    row = [("v", 1, 0, 5, None, "", 1, "t", True, "d")]
    one = manifest.manifest(spark.createDataFrame(row, LINE), scratch).collect()
    assert [(x.leaf, x.subroot, x.root, x.folded_root, x.proof_sha256, x.verified) for x in one] == [(one[0].leaf,) * 4 + (sha(""), True)]
    assert manifest.manifest(spark.createDataFrame([], LINE), Scratch(spark)).collect() == []


def test_states_are_those_of_the_hash():
    rng = np.random.default_rng(3)
    children, sizes = rng.integers(0, 256, (40, 16, 32), dtype=np.uint8), rng.integers(1, 17, 40)
    digest, states = midstates.parents(children, sizes)
    text = lambda i, a, b: b"".join(children[i, j].tobytes().hex().encode() for j in range(a, b))
    for i, n in enumerate(sizes):
        assert digest[i].tobytes() == hashlib.sha256(text(i, 0, n)).digest()
        s = rng.integers(0, n)
        new = rng.integers(0, 256, (1, 32), dtype=np.uint8)
        right = np.zeros((1, 16, 32), np.uint8)
        right[0, :n - s - 1] = children[i, s + 1:n]
        got = midstates.refold(states[i, s][None], new, right, np.array([n - s - 1]), np.array([n]))
        assert got[0].tobytes() == hashlib.sha256(text(i, 0, s) + new.tobytes().hex().encode() + text(i, s + 1, n)).digest()


# ---- spoken language --------------------------------------------------------------------
def test_language_on_held_out_rows(spark):
    known = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    for lang in ("en", "fr", "de", "es"):
        held = [r for r in rows if r.held_out and known[r.doc_id] == lang]
        assert np.mean([r.lang_pred == lang for r in held]) > 0.97
    held = [r for r in rows if r.held_out]
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == known[r.doc_id] for r in held])) < 0.03  # calibrated


def test_held_out_languages_are_never_learned(spark, scratch):
    """A wrong language on rows that may not be learned from changes nothing."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("doc_id").alias("vid"), "text", F.col("lang").alias("source_lang"))
    out = lambda df: sorted(map(tuple, languages.spoken_language(df, Scratch(spark), learn=F.col("vid") % 4 != 2).collect()))
    assert out(docs) == out(docs.withColumn("source_lang", F.when(F.col("vid") % 4 == 2, "xx").otherwise(F.col("source_lang"))))


def test_language_of_awkward_rows(spark, scratch):
    schema = "vid string, text string, source_lang string, bucket int, n int, deal bigint, letters boolean, learn boolean"
    rows = [("v1", None, "en"), ("v2", "", "en"), ("v3", " 12 …!", "fr"), (None, "one more line", None), ("v4", "one more line", "en"), ("v4", "one more line", "en"),
            ("v5", "encore une ligne là " * 20_000, "fr"), ("v6", "a", None)]
    df = spark.createDataFrame([(*r, 1, 1, 1, False, False) for r in rows], schema)
    got = {(r.vid, r.source_lang): r.score for r in languages.spoken_language(df, scratch).collect()}
    assert {k[0] for k in got} == {r[0] for r in rows}
    assert all(got[v, "und"] == 0 for v in ("v1", "v2", "v3")) and all(k[1] in ("en", "fr") for k in got if k[0] in (None, "v4", "v5", "v6"))
    assert languages.spoken_language(df.limit(0), Scratch(spark)).collect() == []
    assert {r.source_lang for r in languages.spoken_language(df, Scratch(spark), learn=F.lit(False)).collect()} == {"und"}
    single = languages.spoken_language(df.where("source_lang = 'en' OR source_lang IS NULL"), Scratch(spark)).where("vid = 'v6'").first()
    assert (single.source_lang, single.score) == ("en", 1.0)


def test_penalty_leaves_weights_at_zero():
    z, n = np.zeros((8, 2), np.float32), np.zeros((8, 2), np.float32)
    p = {"alpha": 1.0, "beta": 1.0, "l1": 0.3, "l2": 0.1}
    for k in range(40):
        languages.learn_one(z, n, np.array([k % 2, 2 + k % 5]), np.array([1.0, 0.05], np.float32), k % 2, p)
    w = languages.weights(z, n, p)
    assert (w[2:] == 0).all() and w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]


# ---- chat requests ----------------------------------------------------------------------
def trie(rows, base, shared):
    asked = {}
    for c, turn, role, text in rows:
        if c is not None:
            asked.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    asked = {c: [t[2:] for t in sorted(v)] for c, v in asked.items()}
    full = {c: asked.get(base(c), [])[:shared(c)] + v[shared(c):] for c, v in asked.items()}
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    childless = [s for s in members if not any(len(o) == len(s) + 1 and o[:len(s)] == s for o in members)]
    own = {s: (len(m) - 1) * len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", s[-1][1])]) if s else 0 for s, m in members.items()}
    out = []
    for s, m in members.items():
        below = [o for o in members if o[:len(s)] == s]
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), sum(len(o) == len(s) + 1 for o in below),
                    sum(o in childless for o in below), sum(own[o] for o in below),
                    sha(",".join(map(str, sorted(c for c in m if len(full[c]) == len(s)))))))
    return sorted(out, key=str)


NODE = ("request", "depth", "parent_request", "requests", "children", "leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("block", [2, 4096])
def test_trie_is_that_of_all_prefixes(spark, scratch, monkeypatch, block):
    monkeypatch.setattr(prompts, "BLOCK", block)  # long requests cross blocks
    monkeypatch.setattr(prompts, "CHUNK", 4)      # end lists cross chunks
    r = random.Random(block)
    rows = [(c, t, r.choice(["user", "model"]), r.choice(["yes", "no more", "", None])) for c in range(-30, 60) for t in range(r.randrange(1, 8))]
    rows += [(c, t, "system", "the same\tcall of all") for c in range(100, 140) for t in (None, 3, 7)]  # a third of all requests
    rows += [(7, None, None, None), (None, 1, "user", "nobody's"), (240, 0, "user", "x " * 50_000), (261, 0, "user", "replaced"), (262, 0, None, "x")]
    base, shared = (lambda c: c - (c % 20 if c >= 0 else -(-c % 20))), (lambda c: abs(c) % 4)
    df = spark.createDataFrame([(*t, 1, 1, 1, 1) for t in rows], MESSAGE)
    c = F.col("request")
    got = prompts.prompt_trie(df, scratch, base=c - c % 20, shared=F.abs(c) % 4).select(*NODE).collect()
    assert sorted(map(tuple, got), key=str) == trie(rows, base, shared)
    plain = prompts.prompt_trie(df.where("request < 20"), Scratch(spark)).select(*NODE).collect()
    assert sorted(map(tuple, plain), key=str) == trie([t for t in rows if t[0] is not None and t[0] < 20], lambda c: c, lambda c: 0)


def test_trie_of_nothing(spark, scratch):
    assert prompts.prompt_trie(spark.createDataFrame([], MESSAGE), scratch).collect() == []
    lost = spark.createDataFrame([(1, 0, "user", "x", 1, 1, 1, 1)], MESSAGE)  # its opening is not there
    got = prompts.prompt_trie(lost, Scratch(spark), base=F.lit(0), shared=F.lit(1)).select(*NODE).collect()
    assert list(map(tuple, got)) == [(1, 0, None, 1, 0, 1, 0, sha("1"))]
