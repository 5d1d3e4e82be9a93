"""Small transcripts with every awkward case: NULL, empty, very long, tied and repeated rows."""
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cuewright.llm import exact, licences, lines, near, packing, passages, pieces, queries, secrets, shingles, spans, toxicity, voices
from cuewright.llm.common import Scratch, components
from pyspark.sql import functions as F

ROWS = "vid bigint, text string, doc bigint, mark bigint, node bigint, key string, rank int, lost int"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


def scripts(spark, *rows):
    """Transcripts with columns whose names the operators use themselves."""
    return spark.createDataFrame([(v, t, 1, 1, 1, "k", 1, 1) for v, t in rows], ROWS)


def voice(seed, n=300):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}{r.randrange(900)}" for _ in range(n)]


LONG = " ".join(voice(1, 30_000))
AWKWARD = [(1, None), (2, ""), (3, ""), (None, "Take one, please."), (None, "Take two."), (4, "Take one, please."), (4, "Take one, please."), (5, LONG), (6, " \n ")]


@pytest.fixture
def scratch(spark):
    s = Scratch(spark)
    yield s
    s.drop()


OPERATORS = {
    "secrets": lambda df, s: secrets.report(df, secrets.scan(df)),
    "lines": lines.dedup_lines, "exact": exact.exact_copies, "near": near.near_classes, "passages": passages.shared_passages,
    "pieces": lambda df, s: pieces.decode(pieces.encode(df, model=PIECE_FILE), model=PIECE_FILE),
    "packing": lambda df, s: packing.pack(df, s, tokenizer=WORD_FILE), "licences": lambda df, s: licences.licence_scan(df),
    "toxicity": lambda df, s: toxicity.score(df, df.select("vid", F.lit(1).alias("toxic")), s),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_awkward_rows(spark, scratch, name):
    run = OPERATORS[name]
    assert run(scripts(spark), Scratch(spark)).count() == 0
    got = run(scripts(spark, *AWKWARD), scratch).collect()
    if name == "packing":
        assert sum(r.opens for r in got) == sum(r.closes for r in got) == len(AWKWARD)
    elif name == "passages":
        assert got == []
    else:
        assert sorted(str(r.vid) for r in got) == sorted(str(v) for v, _ in AWKWARD)


def test_exact_copies_of_awkward_rows(spark, scratch):
    got = sorted((str(r.vid), str(r.keep_vid), r.copies, r.kept) for r in exact.exact_copies(scripts(spark, *AWKWARD), scratch).collect())
    assert got == sorted([("1", "1", 3, True), ("2", "1", 3, False), ("3", "1", 3, False), ("None", "4", 3, False), ("None", "None", 1, True),
                          ("4", "4", 3, True), ("4", "4", 3, True), ("5", "5", 1, True), ("6", "6", 1, True)])


def test_index_takes_in_and_lets_go(spark, scratch):
    digests = lambda *rows: scripts(spark, *rows).select("vid", exact.digest_of(F.col("text")).alias("digest"))
    index = exact.DigestIndex(scratch, shard_rows=8)
    index.insert(digests(*[(i, f"line {i % 30}") for i in range(60)]))
    assert index.shards > 1 and index.entries().count() == 30
    index.insert(digests(*[(100 + i, f"line {i}") for i in range(40)]))
    assert index.entries().count() == 40
    live = [(i, f"line {i % 30}") for i in range(60) if i != 3] + [(100 + i, f"line {i}") for i in range(40) if i != 35]
    index.delete(digests((3, "line 3"), (135, "line 35")), digests(*live))
    kept = {bytes(r.digest): (r.vid, r.copies) for r in index.entries().collect()}
    of = lambda t: hashlib.sha256(t.encode()).digest()
    assert len(kept) == 39 and kept[of("line 3")] == (33, 2) and of("line 35") not in kept


def test_cuckoo_filter_overflows_and_is_rebuilt():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    small = exact.CuckooFilter(64)
    assert not all(small.insert(k) for k in keys)
    full = exact.CuckooFilter.of(keys, 64)
    assert all(k in full for k in keys)
    others = sum(hashlib.sha256(f"x{i}".encode()).digest() in full for i in range(5000))
    assert others < 25
    full.delete(keys[0])
    assert sum(k in full for k in keys) >= 2999


def test_lines_stay_in_the_largest_vid(spark, scratch):
    long = "This line is far longer than forty code points, surely."
    rows = [(i, f"{i} own\n  {long.upper()} \t\nend" if i % 2 else f"{long}\n{long}") for i in range(1, 13)] + [(20, None), (21, "")]
    for batches in (1, 3, 5):
        got = {r.vid: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(scripts(spark, *rows), Scratch(spark), batches=batches).collect()}
        assert got[12] == (2, 0, f"{long}\n{long}") and got[2] == (2, 2, "") and got[1] == (3, 1, "1 own\nend")
        assert got[20] == got[21] == (1, 0, "")


def test_runs_are_compacted(spark, scratch):
    runs = lines.LineRuns(scratch, fanout=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(bytes([k]), 1, 10 - i) for k in range(i, i + 3)], "hash binary, docs bigint, last bigint"))
    assert [level for level, _, _ in runs.runs] == [2]
    got = {r.hash[0]: (r.docs, r.keeper) for r in runs.merged().collect()}
    assert got == {0: (1, 10), 1: (2, 10), 2: (3, 10), 3: (3, 9), 4: (2, 8), 5: (1, 7)}


def test_spans_are_those_of_finditer(spark):
    text = "é ab12 " * 300 + "𝒳 zz9"
    row = spark.createDataFrame([(text,)], "t string").select(spans.spans(F.col("t"), F.lit("[a-z]+[0-9]+")).alias("s")).first()
    assert [(x.start, x.end, x.match) for x in row.s] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a-z]+[0-9]+", text)]


def test_ledger_scans_only_what_is_new(spark):
    one = scripts(spark, (1, "password: secret: abcdefghij"), (2, "Token = 'abcdefgh1'"), (3, "clean"))
    two = scripts(spark, (4, "Token = 'abcdefgh1'"), (5, "AKIA" + "Z" * 12), (6, None))
    ledger = secrets.scan(one)
    more = secrets.scan(two, ledger)
    assert more.count() == 5
    found = {r.vid: [(f.kind, f.start, f.end) for f in r.findings] for r in secrets.report(two, more).collect()}
    assert found == {4: [("assign", 0, 18)], 5: [("access", 0, 16)], 6: []}
    assert secrets.report(one, more).where("vid = 1").first().findings == []
    newer = tuple(secrets.Rule(r.kind, r.regex.replace("16", "16"), 99, r.tail, r.gate, 2) if r.kind == "access" else r for r in secrets.RULES)
    later = secrets.scan(two, more, rules=newer)
    assert {r.vid: len(r.findings) for r in secrets.report(two, later).collect()} == {4: 1, 5: 0, 6: 0}
    masked = {r.vid: r.text for r in secrets.redact(two, more).collect()}
    assert masked == {4: "[secret]'", 5: "[secret]", 6: None}


def test_licence_rules(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "SPDX-License-Identifier: GPL-3.0"), (3, "the MIT\nLicense"),
            (4, "Licensed under CC BY-NC 4.0."), (5, "GNU Lesser General Public License v2.1"), (6, None), (7, "no such thing")]
    got = {r.vid: (r.labels, r.score) for r in licences.licence_scan(scripts(spark, *rows)).collect()}
    assert [got[i][0] for i in range(1, 8)] == [["apache", "apache-2.0"], ["gpl-3.0"], ["mit"], ["cc-by-nc"], ["gpl", "lgpl-2.1"], [], []]
    assert got[1][1] > got[3][1] >= got[6][1] == got[7][1] == 0


def test_viterbi_is_the_best_path_of_the_whole_text():
    m = pieces._model(PIECE_FILE)
    r = random.Random(3)

    def whole(text):
        best = [0.0] + [-1e18] * len(text)
        for end in range(1, len(text) + 1):
            for i in range(max(0, end - m.longest), end):
                hit = m.ids.get(text[i:end])
                score = hit[0] if hit else m.fallback if end - i == 1 else None
                if score is not None:
                    best[end] = max(best[end], best[i] + score)
        return best[-1]
    score = {i: s for s, i in m.ids.values()}
    for n in (1, 5, 40, 700):
        text = "".join(r.choice("aeinrst▁hd") for _ in range(n))
        ids = m.viterbi(text)
        assert "".join(m.text[i] for i in ids) == text
        assert abs(sum(score[i] for i in ids) - whole(text)) < 1e-6 * n
    for text in ("", " ", "  a  b ", "日本 \U0001f600 é\t\n", "x" * 5000):
        assert m.decode(np.frombuffer(m.encode(text), np.int32).tolist()) == text


def jaccard(texts):
    """Weighted Jaccard of tf-idf five-word shingles, by dictionaries."""
    import collections
    import math

    bags = []
    for t in texts:
        w = re.findall(r"[^\x00-\x20]+", (t or "").lower())
        bags.append(collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else {})
    df = collections.Counter(s for b in bags for s in b)
    n = len(texts)
    bags = [{s: c * (1 + near.IDF_RANGE * math.log1p(n / df[s]) / math.log1p(n)) for s, c in b.items()} for b in bags]

    def sim(x, y):
        both = sum(min(v, y[s]) for s, v in x.items() if s in y)
        return both / (sum(x.values()) + sum(y.values()) - both) if x and y else 0.0
    return bags, sim


def test_near_classes_by_brute_force(spark, scratch):
    rows, r = [], random.Random(5)
    for base in range(12):
        w = voice(base + 10, r.choice([40, 200, 600]))
        for copy in range(5):
            x = list(w)
            for _ in range(copy * len(w) // 150):
                x[r.randrange(len(x))] = "changed"
            rows.append((len(rows) + 1, " ".join(x)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "One  two"), (None, "one two")]
    bags, sim = jaccard([t for _, t in rows])
    group = list(range(len(rows)))
    sure = True
    for i in range(len(rows)):
        for j in range(i):
            s = sim(bags[i], bags[j])
            sure &= not 0.795 < s < 0.805
            if s >= 0.8:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = near.near_classes(scripts(spark, *rows), scratch).collect()
    index = {v: i for i, (v, _) in enumerate(rows)}
    wrong = [g.vid for g in got if g.vid is not None and g.class_vid != rows[group[index[g.vid]]][0]]
    assert len(got) == len(rows) and len(wrong) <= (0 if sure else 10), wrong
    assert [(g.class_vid, g.kept) for g in got if g.vid is None] == [(102, False)]


def test_weighted_samples_agree_as_often_as_jaccard_says():
    r = np.random.default_rng(4)
    h = r.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = (np.sort(h[:3600]), np.ones(3600, np.float16)), (np.sort(h[400:]), np.ones(3600, np.float16))
    keys = near.band_keys([a, b])
    assert keys.shape == (2, near.BANDS) and (near.band_keys([a])[0] == keys[0]).all()


@pytest.mark.parametrize(("words", "more"), [(13, 1), (15, 0), (15, 2), (20, 3), (25, 5), (40, 6)])
def test_recall_of_bands_on_short_texts(words, more):
    texts = []
    for k in range(1500):
        w = voice(10**6 + k, words)
        texts += [" ".join(w), " ".join(w + voice(2 * 10**6 + k, more) if more else w[:-1] + ["changed"])]
    found = [(h, np.ones(len(h), np.float16)) for h, _ in near.counted(texts)]
    keys = near.band_keys(found)
    sims = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for (a, _), (b, _) in zip(found[::2], found[1::2], strict=True)]
    assert min(sims) >= 0.8 and (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.985


def test_weights_of_a_line_repeated_very_often():
    vectors = [near._vector(h, near._weights(n, bytes(len(h)), 10)) for h, n in near.counted([" ".join(voice(3, 7)) + "\n", (" ".join(voice(3, 7)) + "\n") * 100_000,
                                                                                            (" ".join(voice(3, 7)) + "\n") * 110_000, (" ".join(voice(3, 7)) + "\n") * 200_000])]
    assert near._similarity(vectors[1], vectors[1]) == 1 and abs(near._similarity(vectors[1], vectors[2]) - 10 / 11) < 1e-3
    assert abs(near._similarity(vectors[1], vectors[3]) - 0.5) < 1e-3 and vectors[1] != vectors[3]


def test_passages_by_construction(spark, scratch):
    shared = voice(99, 60)
    fuzzy = [w if i % 9 else "other" for i, w in enumerate(shared)]
    near_miss = voice(77, 45)
    rows = [(1, " ".join(voice(1) + shared + voice(2))), (2, " ".join(voice(3) + shared)), (3, " ".join(fuzzy + voice(4))),
            (4, " ".join(voice(5) + near_miss)), (5, " ".join(near_miss + voice(6))), (6, " ".join(voice(7))), (6, " ".join(voice(7)))]
    got = passages.shared_passages(scripts(spark, *rows), scratch).collect()
    assert {r.vid for r in got} | {r.other_vid for r in got} == {1, 2, 3}
    text = dict(rows)
    for r in got:
        assert r.identity >= 0.8 and text[r.vid][r.start:r.end].split()[5:50:9] and r.words >= 50
        assert abs(len(text[r.vid][r.start:r.end].split()) - 60) <= 3


def test_passages_whose_parts_others_own(spark, scratch):
    shared = voice(500, 60)
    rows = [(1, " ".join(voice(501) + shared + voice(502))), (2, " ".join(shared + voice(503)))]
    for k in range(20):
        rows += [(10 + k, " ".join(voice(600 + k, 60) + shared[:30])), (40 + k, " ".join(shared[30:] + voice(700 + k, 60)))]
    for few in (4, 40):  # seeds of few texts, and of many
        got = passages.shared_passages(scripts(spark, *rows[:2 + few]), scratch.__class__(spark)).collect()
        assert [(*sorted((r.vid, r.other_vid)), r.words, r.other_words) for r in got] == [(1, 2, 60, 60)]


def fuzzy_pairs(n, words, identity, seed, inserted=0):
    """Texts 2k and 2k + 1 share a passage of so many words, of which a share of 1 - identity differs."""
    r, rows = random.Random(seed), []
    for k in range(n):
        x = voice(seed * 10**6 + k, words)
        y = list(x)
        for at in r.sample(range(1, words - 1), round(words * (1 - identity))):
            y[at] = f"changed{r.randrange(10**6)}"
        for _ in range(inserted):
            y.insert(r.randrange(4, words - 4), f"inserted{r.randrange(10**6)}")
        rows += [(2 * k, " ".join(voice(seed * 10**6 + 10**4 + k, 40) + x + voice(seed * 10**6 + 2 * 10**4 + k, 40))),
                 (2 * k + 1, " ".join(voice(seed * 10**6 + 3 * 10**4 + k, 30) + y + voice(seed * 10**6 + 4 * 10**4 + k, 30)))]
    return rows


@pytest.mark.parametrize(("words", "identity", "inserted", "least"), [(52, 0.8, 0, 0.97), (50, 0.85, 0, 0.98), (60, 0.9, 2, 0.98)])
def test_recall_of_fuzzy_passages(spark, scratch, words, identity, inserted, least):
    got = passages.shared_passages(scripts(spark, *fuzzy_pairs(150, words, identity, words, inserted)), scratch).collect()
    assert all(r.vid // 2 == r.other_vid // 2 and min(r.words, r.other_words) >= 50 and r.identity >= 0.8 for r in got)
    assert len({r.vid // 2 for r in got}) >= least * 150


def test_text_that_repeats_a_line(spark, scratch):
    line, other = voice(800, 12), voice(801, 60)
    rows = [(1, " ".join(line * 3000 + other)), (2, " ".join(other + line * 5)), (3, " ".join(voice(802) + line * 2000)), (4, " ".join(other)), (5, " ".join(other))]
    got = passages.shared_passages(scripts(spark, *rows), scratch).collect()
    assert {tuple(sorted((r.vid, r.other_vid))) for r in got} >= {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (4, 5)}


def test_chains_and_common_words_by_brute_force():
    assert passages.chains([(0, 50), (10, 60), (5, 3), (20, 70), (30, 81)], 20) == [(0, 35, 50, 86)]
    r = random.Random(8)
    for _ in range(30):
        x, y = ([r.randrange(4) for _ in range(r.randrange(1, 40))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        assert passages.common_words(x, y) == table[-1][-1]


def test_voices_by_brute_force(spark, scratch, monkeypatch):
    monkeypatch.setattr(voices, "BLOCK", 16)  # so that buckets are cut into blocks
    r = np.random.default_rng(2)
    base, rows = r.standard_normal((12, 32)), []
    for i in range(240):
        x = base[i % 12] * r.uniform(0.5, 3) + r.standard_normal(32) * 0.12
        rows.append((i, "en" if i % 12 < 8 else "fr", [float(v) for v in x]))
    rows += [(300, "en", rows[0][2]), (300, "en", rows[0][2]), (301, None, rows[0][2]), (302, "en", None), (303, "en", [0.0] * 32), (None, "en", rows[0][2]),
             (304, "en", [float("nan")] * 32), (305, "en", [1.0, None]), (306, "en", []), (307, "en", [1.0, 2.0]), (308, "en", [2.0, 4.0])]
    df = spark.createDataFrame([(*x, 1, 1) for x in rows], "voice bigint, language string, embedding array<double>, rep int, copies int")
    got = voices.near_voices(df, scratch).collect()
    assert len(got) == len(rows)
    good = [(v, g, np.array(e)) for v, g, e in rows if v is not None and g and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = {}
    for i, (v, g, x) in enumerate(good):
        links[i] = [j for j, (_, h, y) in enumerate(good) if i != j and g == h and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98]
    label = list(range(len(good)))
    for _ in good:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(good))]
    want = sorted((good[i][0], len(links[i]), good[label[i]][0]) for i in range(len(good)))
    usable = {v for v, _, _ in good}
    assert sorted((x.voice, x.n_links, x.component) for x in got if x.voice in usable) == want
    assert all(x.n_links == 0 and x.component == x.voice and x.kept for x in got if x.voice not in usable)
    assert voices.near_voices(df.limit(0), scratch.__class__(spark)).count() == 0


def test_components(spark, scratch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (101, 102), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(edges, scratch).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in (100, 101, 102)}}


def test_reach_loses_no_link(spark):
    """Every pair at the threshold is within each other's reach, and its lighter text reaches its own weight."""
    r, t = random.Random(8), 0.8
    bags = []
    for _ in range(60):
        w = voice(3, 60)
        for _ in range(r.randrange(9)):
            i = r.randrange(len(w))
            w[i:i + r.choice([1, 1, 3])] = r.choice([[], [f"edit{r.randrange(6)}"], [f"own{r.random()}"]])
        bags.append(" ".join(w))
    weighted, sim = jaccard(bags)
    df = {}
    for b in weighted:
        for s in b:
            df[s] = df.get(s, 0) + 1
    rows = [(sum(b.values()), sum(x for s, x in b.items() if df[s] > 1)) for b in weighted]
    got = [x["reach"] for x in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, size double, common double")
           .orderBy("i").select(near._reach(t).alias("reach")).collect()]
    links = [(i, j) for i in range(60) for j in range(i) if sim(weighted[i], weighted[j]) >= t]
    assert links and any(reach < size for reach, (size, _) in zip(got, rows, strict=True))
    for i, j in links:
        light = min(i, j, key=lambda k: rows[k][0])
        assert rows[i][0] <= got[j] and rows[j][0] <= got[i] and got[light] >= rows[light][0]
        assert min(got[i] / rows[i][0], got[j] / rows[j][0]) >= t


def test_a_short_notice_in_many_texts_costs_no_pairs_of_all(spark):
    """Forty common words are no passage: what is compared grows with the texts, not with their square."""
    notice, sizes = " ".join(voice(5, 40)), {}
    for n in (40, 80):
        s = Scratch(spark)
        rows = [(k, f"{' '.join(voice(900 + k, 80))} {notice} {' '.join(voice(9000 + k, 80))}") for k in range(n)]
        assert passages.shared_passages(scripts(spark, *rows), s).collect() == []
        sizes[n] = sum(spark.read.parquet(f"{s.folder}/chains-{name}").count() for name in ("owned", "every"))
        s.drop()
    assert sizes[80] <= 4 * 80 and sizes[80] <= 2.5 * sizes[40]


def test_runs_of_common_shingles():
    x, y = np.arange(40), np.r_[np.arange(100, 105), np.arange(10, 30), 7, np.arange(30, 38)]
    assert passages.common_runs(x, y)[:2] == [(20, 10, 5), (8, 30, 26)]
    assert passages.common_runs(x[:3], y) == []


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_that_are_no_numbers(spark, name):
    """Videos are named by strings; an operator gives them what it gives their ranks."""
    rows = [(k, " ".join(voice(k // 2, 60)) + f"\npassword = hunter{k // 4}hunter MIT license") for k in range(8)] + [(8, None), (None, "a b c d e f"), (9, LONG[:9000])]
    named = lambda v: None if v is None else f"v{v}"
    numbers = OPERATORS[name](scripts(spark, *rows), Scratch(spark))
    strings = OPERATORS[name](spark.createDataFrame([(named(v), t) for v, t in rows], "vid string, text string"), Scratch(spark))
    ids = [c for c in numbers.columns if c.endswith("vid")]
    assert strings.columns == numbers.columns and all(dict(strings.dtypes)[c] == "string" for c in ids)
    left = [c for c in numbers.columns if c not in ("sequence_id", "offset")]
    want = numbers.select(*[F.concat(F.lit("v"), F.col(c).cast("string")).alias(c) if c in ids else F.col(c) for c in left])
    assert sorted(map(str, strings.select(*left).collect())) == sorted(map(str, want.collect()))


def test_voices_named_by_strings(spark, scratch):
    rows = spark.createDataFrame([("b", "en", [1.0, 0.0]), ("a", "en", [1.0, 0.001]), ("c", "fr", [1.0, 0.0])], "voice string, language string, embedding array<double>")
    assert {tuple(r) for r in voices.near_voices(rows, scratch).select("voice", "n_links", "component", "kept").collect()} == {
        ("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)}


def test_masking_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "password = hunter2hunter2", "mine", "too")], "vid bigint, text string, _blob string, _found string")
    assert list(map(tuple, secrets.redact(df, secrets.scan(df)).collect())) == [(1, "[secret]", "mine", "too")]


def test_seeds_of_few_texts_are_moved_once(spark):
    """Pairs of holders come from one grouping, an anchor is one number, and a worker gets a bounded part of the texts."""
    seeds = spark.createDataFrame([(7, 1, 4), (7, 2, 9), (7, 2, 30), (8, 1, 5), (9, 3, 0), (9, 3, 8)], "seed bigint, doc bigint, pos int")
    pairs = passages._all_pairs(seeds)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, 4, 9), (1, 2, 4, 30)]
    assert pairs._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    big = spark.createDataFrame([(2**31 - 1, 0), (3, 2**31 - 1)], "p int, q int").select(passages._anchor("p", "q").alias("a"))
    assert [(r.a >> 32, r.a & 0xFFFFFFFF) for r in big.collect()] == [(2**31 - 1, 0), (3, 2**31 - 1)]
    s, before = Scratch(spark), spark.conf.get(passages.RECORDS)
    sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda bs: (b.slice(0, 1).set_column(0, "id", __import__("pyarrow").array([b.num_rows])) for b in bs), "id bigint")
    assert max(r.id for r in s.keep(sizes, "sizes").collect()) <= 1000 and spark.conf.get(passages.RECORDS) == before
    s.drop()


def test_every_holder_of_a_passage_has_rows_of_its_own(spark, tmp_path):
    """A notice of 60 words in 40 documents: op8 names it by the doc_id of all of them, with the place in that document."""
    notice = voice(5, 60)
    rows = [(k, " ".join(voice(900 + k, 30 + k % 7) + notice + voice(9000 + k))) for k in range(40)] + [(40, " ".join(voice(7))), (41, None)]
    rows += [(50, " ".join(voice(8, 70))), (51, " ".join(voice(8, 70)))]  # equal texts
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op8_substring_dedup"](spark, str(tmp_path)).collect()
    text = dict(rows)
    assert {r.doc_id for r in got} == {*range(40), 50, 51}
    assert all(set(notice) <= set(text[r.doc_id][r.start:r.end].split()) for r in got if r.doc_id < 40)
    turned = {(r.other_id, r.other_start, r.other_end, r.other_words, r.doc_id, r.start, r.end, r.words, r.identity) for r in got}
    assert turned == {tuple(r) for r in got} and len(turned) == len(got)


def test_only_the_ends_of_a_run_are_moved():
    """A shared run of 200 seeds is two anchors, not 200; what is chained is the same as of all anchors."""
    r, rows = random.Random(4), []
    for doc in (3, 8, 5):
        word = np.array([hash(w) & 0xFFFFFFFF for w in voice(70 + doc, 20) + voice(1, 204) + voice(80 + doc, r.randrange(20)) + voice(2, 30)], np.uint64)
        h = passages.shingles(word)
        side = np.r_[np.uint64(0), h & passages.LOW, np.uint64(0)]
        rows += [(int(s), doc, p, int(a)) for p, (s, a) in enumerate(zip(h.view(np.int64), (side[:-2] << passages.HALF | side[2:]).view(np.int64), strict=True))]
    rows.sort()
    table = pa.table(dict(zip(("seed", "doc", "pos", "around"), zip(*rows, strict=True), strict=True)), schema=pa.schema(
        [("seed", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("around", pa.int64())]))
    batches = lambda t: iter(t.to_batches(max_chunksize=7))
    ends = pa.Table.from_batches(passages._edges(batches(table))).to_pandas()
    every = pa.Table.from_batches(passages._edges(batches(table.drop_columns("around")))).to_pandas()
    assert len(every) == 3 * (200 + 26) and len(ends) == 3 * 2 * 2
    for pair, some in ends.groupby(["doc", "other"]):
        whole = every[(every.doc == pair[0]) & (every.other == pair[1])]
        p, q = whole.pos.to_numpy(np.int64), whole.opos.to_numpy(np.int64)
        assert passages.thinned(some.pos.to_numpy(np.int64), some.opos.to_numpy(np.int64), some.edge.to_numpy()) == \
            passages.thinned(p, q) == passages.thinned(np.r_[p, p], np.r_[q, q])


def test_chains_within_a_chain():
    """Two texts that repeat one word: one chain to look at, the others only where its passages leave words out."""
    anchors = [(p, q) for p in range(0, 80, 4) for q in range(0, 80, 4)]
    nested = passages.nested_chains(anchors, 15)
    assert len(nested) < 5 < sum(map(len, nested.values()))
    x, y = [1] * 60 + list(range(100, 130)), list(range(200, 230)) + [1] * 68
    first = (0, 60, 30, 90)
    got = passages.with_inner(x, y, [first], np.array([(0, 60, 30, 90), (0, 60, 34, 94), (0, 60, 38, 98), (0, 56, 36, 92)]), 50, 0.8)
    assert got[0] == first and max(p[3] for p in got) == 98 and len(got) <= 3
    assert passages.with_inner(x, y, [], np.array([(0, 60, 30, 90)]), 50, 0.8)


def test_places_of_words():
    texts = ["", "  a\u00e9 \U0001f600b\n\x00c\ud800 ", "\u3042\u3044 z", " "]
    assert list(map(tuple, shingles.places(texts).tolist())) == [m.span() for t in texts for m in re.finditer(r"[^\x00-\x20]+", t)]


def test_voices_send_no_table_through_the_driver(spark):
    """What grows with the vectors is joined by shuffles, however small the files make it look."""
    plans = {}

    class Spy(Scratch):
        def keep(self, df, name, *by):
            plans[name] = df._jdf.queryExecution().sparkPlan().toString()
            return super().keep(df, name, *by)

    rng = np.random.default_rng(3)
    rows = [(k, "en", [float(x) for x in rng.standard_normal(16).round(2) + (k % 2)]) for k in range(40)]
    rows += [(100 + k, "en", [x + 0.001 for x in v]) for k, _, v in rows[:20]]
    df = spark.createDataFrame(rows, "voice bigint, language string, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        got = {r.voice: r.component for r in voices.near_voices(df, Spy(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(got[100 + k] <= k for k in range(20)) and len(got) == 60
    for name in ("undecided", "linked"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]
