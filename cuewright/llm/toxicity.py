"""Toxicity of whole transcripts: boosted trees over dense features, calibrated isotonically.

Two lexicons give densities: a short hand-written one, and one learned from the labelled rows, of the words
and word beginnings that toxic rows have far more often, whatever the language. A row that the trees learn
from gets its densities from a lexicon learned without the row's own fold.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, any_ids, transcripts

# Words that insult, in the four languages the transcripts come in.
INSULTS = frozenset("""
idiot idiots idiotic stupid moron morons moronic scum loser losers clown trash garbage worthless pathetic disgusting
dumb dumbass imbecile cretin fool jerk bastard bitch asshole shit bullshit crap fuck fucking fucker whore slut pig
vermin freak retard retarded ugly filthy useless coward degenerate parasite scumbag lowlife
idiote imbécile crétin débile ordure salaud salope connard connasse con merde pourriture minable pauvre dégoûtant
idioten dumm dummkopf blöd blödmann trottel arschloch scheiße scheisse abschaum versager schwachkopf drecksau widerlich
idiota estúpido estúpida imbécil basura escoria mierda cabrón puta puto gilipollas asqueroso inútil payaso perdedor
""".split())
THREATS = frozenset("kill die hate hurt destroy burn hang shoot beat tuer mourir töten sterben hasse matar morir odio".split())
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta vous votre du dich dir dein ihr euch usted tú ustedes vosotros".split())
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
NEAR = 5  # words between an insult and a second person that still count as near
FEATURES = ("insults", "insult_kinds", "insult_share", "threat_share", "near_second", "second_share", "disguised",
            "capitals", "shouted", "punctuation", "exclamations", "symbols", "digits", "repeats", "stretched",
            "mean_word", "log_words", "first_insult", "learned", "learned_kinds", "learned_share", "learned_weight", "learned_near")
BEGINNINGS = (3, 4, 5, 6)  # letters of a word beginning, which is marked by a star
FOLDS = 4
LEAST_ODDS, LEAST_ROWS = 2.5, 3  # log odds of a term of the learned lexicon, and toxic rows that have it
SPACE = 400_000  # words a worker remembers


def terms_of(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in BEGINNINGS if len(word) > k]]


class Lexicon:
    """Log odds of learned terms; a word has that of its strongest term."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.known = odds, {}

    def __getitem__(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            got = max((self.odds.get(t, 0.0) for t in terms_of(word)), default=0.0)
            if len(self.known) < SPACE:
                self.known[word] = got
        return got


def plain_words(words: list[str]) -> list[str]:
    """Lower-cased words, digits and signs that stand for letters read as letters."""
    low = [w.lower() for w in words]
    return [w if w.isalpha() or not any(map(str.isalpha, w)) else w.translate(LETTERS).replace("*", "") for w in low]


def features(text: str, lexicon: Lexicon | None = None) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES."""
    words = WORD.findall(text)
    n = max(len(words), 1)
    low = [w.lower() for w in words]
    read = plain_words(words)
    learned, heavy, close, spoken_to, learned_at = set(), 0.0, 0, -10**9, []
    known = lexicon.known if lexicon else {}
    for i, w in enumerate(read if lexicon else ()):
        if w in SECOND:
            spoken_to = i
        odds = known.get(w)
        if odds is None:
            odds = lexicon[w]
        if odds:
            learned.add(w)
            learned_at.append(i)
            heavy += odds
            close += i - spoken_to <= NEAR
    hits, kinds, near, threats, second, disguised, last_second, last_hit, first = 0, set(), 0, 0, 0, 0, -10**9, -10**9, -1
    for i, (w, plain) in enumerate(zip(low, read, strict=True)):
        if w in SECOND:
            second += 1
            last_second = i
            near += i - last_hit <= NEAR
        elif w in THREATS:
            threats += 1
        elif plain in INSULTS:
            hits += 1
            kinds.add(plain)
            disguised += plain != w
            near += i - last_second <= NEAR
            last_hit = i
            if first < 0:
                first = i
    chars = max(len(text), 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    marks = int(((codes == 46) | (codes == 44) | (codes == 59) | (codes == 58)).sum())
    cries = int(((codes == 33) | (codes == 63)).sum())
    symbols = int(((codes >= 35) & (codes <= 38) | (codes == 42) | (codes == 64) | (codes == 124) | (codes == 94)).sum())
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    same = codes[1:] == codes[:-1]
    stretched = int((same[1:] & same[:-1]).sum()) if len(same) > 1 else 0
    repeats = sum(a == b for a, b in zip(low, low[1:], strict=False))
    shouted = sum(w.isupper() and len(w) > 2 for w in words)
    return [float(hits), float(len(kinds)), hits / n, threats / n, float(near), second / n, float(disguised), upper / chars, shouted / n, marks / chars,
            cries / chars, symbols / chars, digits / chars, repeats / n, stretched / chars,
            sum(map(len, words)) / n, float(np.log1p(len(words))), first / n if first >= 0 else -1.0,
            float(len(learned_at)), float(len(learned)), len(learned_at) / n, heavy / n, float(close)]


def dense(rows: DataFrame, odds: list[dict[str, float]] | None = None) -> DataFrame:
    """``rows`` with ``features array<double>`` in place of ``text``; ``fold`` chooses the lexicon."""
    names = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def run(batches):
        lexicons = [Lexicon(o) for o in odds or []]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [features(t, lexicons[k] if lexicons else None)
                         for t, k in zip(part.column("text").to_pylist(), part.column("fold").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(found, pa.list_(pa.float64()))], [*names, "features"])
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", features array<double>")


def _terms(batches):
    """Per term of a task's rows: in how many clean and toxic rows of every fold it is."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
            at = 2 * fold + int(label)
            for term in {t for w in set(plain_words(WORD.findall(text))) for t in terms_of(w)}:
                if term not in seen:
                    seen[term] = np.zeros(2 * FOLDS, np.int64)
                seen[term][at] += 1
    counts = np.array(list(seen.values()), np.int64).reshape(-1, 2 * FOLDS)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array(c) for c in counts.T]],
                                     ["term", *[f"n{k}" for k in range(2 * FOLDS)]])


def lexicons(learn: DataFrame, max_terms: int) -> list[dict[str, float]]:
    """Log odds of the terms of every lexicon: without fold 0, 1, ..., and of all rows.

    ``learn``: ``text, label, fold``. The ``max_terms`` terms with most toxic rows come back to the driver.
    """
    sizes = {(r[0], int(r[1])): r[2] for r in learn.groupBy("fold", "label").count().collect()}
    ns = [f"n{k}" for k in range(2 * FOLDS)]
    counted = learn.select("text", "label", "fold").mapInArrow(_terms, "term string, " + ", ".join(f"{n} bigint" for n in ns)) \
        .groupBy("term").agg(*[F.sum(n).alias(n) for n in ns])
    toxic = sum((F.col(f"n{2 * f + 1}") for f in range(FOLDS)), F.lit(0))
    clean = sum((F.col(f"n{2 * f}") for f in range(FOLDS)), F.lit(0))
    every = [sum(n for (_, label), n in sizes.items() if label == k) for k in (0, 1)]
    # a term of any lexicon has enough toxic rows in all, and odds that no fold's clean rows can hide
    some = counted.where((toxic >= LEAST_ROWS) & (toxic / max(every[1], 1) > 2 * clean / max(every[0], 1)))
    found = some.orderBy(toxic.desc(), clean, "term").limit(max_terms).collect()
    out: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    for row in found:
        n = np.array(row[1:], np.int64).reshape(FOLDS, 2)
        for left in range(FOLDS + 1):
            keep = [f for f in range(FOLDS) if f != left]
            (c, t), (c_all, t_all) = n[keep].sum(axis=0), (sum(sizes.get((f, k), 0) for f in keep) for k in (0, 1))
            odds = np.log((t + 0.5) / (t_all - t + 0.5)) - np.log((c + 0.5) / (c_all - c + 0.5))
            if t >= LEAST_ROWS and odds > LEAST_ODDS:
                out[left][row[0]] = float(odds)
    return out


@any_ids("vid")
def score(rows: DataFrame, flagged: DataFrame, scratch: Scratch, *, max_rows: int = 20_000, max_terms: int = 20_000, trees: int = 20, depth: int = 3,
          threshold: float = 0.3, seed: int = 7) -> DataFrame:
    """Per transcript: ``vid, score, toxic``; ``toxic`` where the calibrated score reaches ``threshold``.

    ``flagged``: ``vid, toxic`` (0 or 1; NULL is no label) of the transcripts to learn from; rows
    of other vids are ignored and a vid that comes twice counts twice. At most ``max_rows`` of them, those
    with the smallest hash of the vid, are learned from: three quarters grow the trees, the rest calibrate them,
    and the lexicon of at most ``max_terms`` terms is learned from all. Only the
    text enters a score. A NULL or empty text is scored like any other (all rates 0), repeated rows
    get equal scores, a NULL vid is passed on but not learned from. Without labels, or with one
    class only, every score is that class's share (0 without labels). An empty table gives no rows.
    """
    labelled = flagged.where(F.col("toxic").isin(0, 1) & F.col("vid").isNotNull()) \
        .select(F.col("vid").alias("_vid"), F.col("toxic").cast("double").alias("label"), F.xxhash64("vid").alias("deal"))
    texts = transcripts(rows)
    # ids of max_rows rows at most: a bounded broadcast
    chosen = scratch.keep(labelled.orderBy("deal", "label").limit(max_rows), "chosen")
    learn = texts.join(F.broadcast(chosen), F.col("vid") == F.col("_vid")) \
        .select("text", "label", "deal", F.pmod("deal", F.lit(FOLDS)).cast("int").alias("fold"))
    learn = scratch.keep(learn, "labelled")
    odds = lexicons(learn, max_terms)
    learn = scratch.keep(dense(learn, odds), "learn-features")  # a sort reads its input twice
    learn = learn.select("deal", "label", array_to_vector("features").alias("features"), (F.col("fold") == 0).alias("calibrate"))
    learn = scratch.keep(learn.orderBy("deal", "label").coalesce(1), "learn").coalesce(1)  # bounded by max_rows: the fit is the same wherever it runs
    dim = scratch.keep(dense(texts.withColumn("fold", F.lit(FOLDS)), odds).drop("fold"), "features")
    classes = [r[0] for r in learn.where("NOT calibrate").groupBy("label").count().orderBy("label").collect()]
    if len(classes) < 2 or not learn.where("calibrate").take(1):
        share = learn.agg(F.avg("label")).first()[0] or 0.0
        return dim.select("vid", F.lit(float(share)).alias("score"), F.lit(int(share >= threshold)).alias("toxic"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=seed, minInstancesPerNode=5) \
        .fit(learn.where("NOT calibrate").select("features", "label"))
    raw = vector_to_array("rawPrediction")[1]
    held = model.transform(learn.where("calibrate")).select("label", raw.alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
    rated = model.transform(dim.select("vid", array_to_vector("features").alias("features"))).select("vid", raw.alias("raw"))
    rated = curve.transform(rated)
    # a thousandth of the uncalibrated margin keeps the order where the curve is flat
    value = 0.999 * F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)) + 0.001 / (1 + F.exp(-2 * F.col("raw")))
    return rated.select("vid", value.alias("score")).withColumn("toxic", (F.col("score") >= threshold).cast("int"))
