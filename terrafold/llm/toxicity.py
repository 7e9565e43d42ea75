"""Toxic passages by maximum-scoring segment search (operator 7).

Training: words of labelled texts are counted by class, with their prefixes of 4 to 6 letters as back-off, each word once
for each different word before it, so that copies of one text count once. Log-odds of a feature between the classes have
an informative Dirichlet prior with the corpus's own distribution. A token's score is that of its most specific known
feature, lowered by SURE standard deviations and by DRIFT; unknown ones score -DRIFT, so that scores drift down outside
toxic passages and rare features need more evidence.

Scoring: all maximal scoring segments of a text are found in one linear pass. Chance maxima of random sequences follow an
extreme-value law; the expected number of chance segments, E = K * words * exp(-lambda * segment score), is what a segment's
significance is measured by (those with E < E_MAX are reported). The r best segments of a text together have
E = exp(-s) s^(r-1) / (r! (r-1)!) with s the sum of lambda * score - log(K * words); the least E over r is the text's, and a
logistic fit on the training rows turns -log E into a score from 0 to 1.

Words are those of ``tokens`` in training and in scoring. What is learned comes from the sampled rows alone, so the model
that is broadcast has at most a feature for each LEAST words of the sample.

Edge cases: null and wordless texts have no segment and get the score of a text without positive tokens; rows with a null
id or label aren't learned from; an id with both labels counts as toxic; without labels of both classes every score is near
0; repeated rows count once in training and are scored alike; equal segments of a text are told in the order of the text.
Texts of any length are scanned whole; other columns than doc_id, text and toxic are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import crc_mod, drop, keep, near_share, small_batches

#: Labelled rows learned from per class, about; strength of the prior as a share of the tokens; least count of a feature;
#: fall per token; standard deviations taken off.
ROWS_PER_CLASS, PRIOR, LEAST, DRIFT, SURE = 2500, 0.1, 4, 1.0, 1.64
#: Reported segments have fewer chance copies expected; score from which a text is called toxic.
E_MAX, CUT = 0.01, 0.3
PREFIXES = (6, 5, 4)
#: Words are runs of letters and marks. For texts of characters below U+0250 only the letters are written out, as the re
#: module is faster; there are no marks among them.
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_PLAIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-\u024f]+")
_OTHER = re.compile("[^\x00-\u024f]")
SEGMENTS = "struct<n_words:bigint,surprise:double,segments:array<struct<a:int,b:int,s:double>>>"


def tokens(text: str) -> list[str]:
    low = text.lower()
    return (_WORD if _OTHER.search(low) else _PLAIN).findall(low)


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    a: float = 0.0
    b: float = -30.0

    def score(self, word: str) -> float:
        """Log-odds of the most specific known feature of a word, less the drift."""
        for f in (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)):
            if (s := self.odds.get(f)) is not None:
                return s - DRIFT
        return -DRIFT

    def surprise(self, scores: list[float], n: int) -> float:
        """-log E of the scores of a text's segments among n words, by the r best of them for that r at which it is highest."""
        one, best, total = math.log(self.k * max(n, 1)), 0.0, 0.0
        for r, x in enumerate(sorted(scores, reverse=True), 1):
            total += self.lam * x - one
            if total > 0:
                best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return best


class Scores(dict):
    """Scores of the words met so far; a bounded memory."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = s = self.model.score(word)
        return s


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence of scores, in linear time.

    Runs between positive scores are summed beforehand; a list of candidates with their left and right cumulative sums is
    kept, and each new positive score is joined to the earlier candidates that it extends.
    """
    pos = np.flatnonzero(s > 0)
    if not len(pos):
        return []
    total = np.concatenate([[0.0], np.cumsum(s)])
    cand: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at end
    back: list[int] = []  # for each candidate, the last earlier one with a smaller sum before it
    for i in pos.tolist():
        a, b, left, right = i, i + 1, total[i], total[i + 1]
        j = len(cand) - 1
        while True:
            while j >= 0 and cand[j][2] >= left:
                j = back[j]
            if j < 0 or cand[j][3] >= right:
                break
            a, left = cand[j][0], cand[j][2]
            del cand[j:], back[j:]
            j = len(cand) - 1
        cand.append((a, b, left, right))
        back.append(j)
    return [(a, b, float(r - l)) for a, b, l, r in cand]


def sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """Texts and labels y (0 or 1) of about ``rows_per_class`` labelled documents of each class, chosen by a hash of the id.

    The chosen labels are bounded, so they are broadcast; the documents aren't shuffled.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    chosen = F.lit(False)
    for y, n in sizes.items():
        chosen |= (F.col("y") == y) & near_share(known, "doc_id", rows_per_class / n)
    return docs.select("doc_id", "text").join(F.broadcast(known.filter(chosen)), "doc_id").select("y", "text").filter(F.col("text").isNotNull()).distinct()


def _features(w: str) -> list[str]:
    return [w, *(f"{w[:n]}*" for n in PREFIXES if len(w) >= n)]


def odds(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Lower bounds of the log-odds of features; counts: of each feature in clean and in toxic rows, LEAST or more in sum.

    Kept are the features over DRIFT and those that hide the toxic prefix of their words.
    """
    n0, n1 = (sum(n[y] for f, n in counts.items() if not f.endswith("*")) for y in (0, 1))
    if not n0 or not n1:
        return {}
    a0, out = PRIOR * (n0 + n1), {}
    for f, (c0, c1) in counts.items():
        a = PRIOR * (c0 + c1)
        value = math.log((c1 + a) / (n1 + a0 - c1 - a)) - math.log((c0 + a) / (n0 + a0 - c0 - a))
        out[f] = value - SURE * math.sqrt(1 / (c1 + a) + 1 / (c0 + a))
    high = {f for f, s in out.items() if s > DRIFT}
    return {f: s for f, s in out.items() if f in high or any(p in high and p != f for p in _features(f.rstrip("*"))[1:])}


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """The model learned from a bounded sample of labelled documents; features with their counts come to the driver."""
    rows = keep(sample(docs, labels, rows_per_class), "labelled")  # the documents are read once for it

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = tokens(t)
                found = sorted(set(zip(ws, ["", *ws])))
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(found), pa.int32()), pa.array([w for w, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], ["y", "w", "p"])

    word = rows.select(F.col("y").cast("int"), "text").mapInArrow(pairs, "y int, w string, p string").distinct()
    word = word.groupBy("w").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    prefixes = [F.when(F.length("w") >= k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in PREFIXES]
    feats = word.select(F.explode(F.array_compact(F.array("w", *prefixes))).alias("f"), "n0", "n1").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    m = Model(odds({r.f: (float(r.n0), float(r.n1)) for r in feats.filter(F.col("n0") + F.col("n1") >= LEAST).collect()}))
    if not m.odds:
        drop(rows)
        return Model()
    found = rows.select("y", scan(rows.sparkSession, m, F.col("text"), all_segments=True).alias("h")).select("y", "h.n_words", F.transform("h.segments", lambda x: x["s"]).alias("s"))
    m = calibrate(m, [(r.y, r.n_words, r.s) for r in found.collect()])
    drop(rows)
    return m


def calibrate(m: Model, seen: list[tuple[int, int, list[float]]]) -> Model:
    """Extreme-value parameters from the clean rows and a logistic fit on all; seen: (label, words, segment scores)."""
    clean = [(n, s) for y, n, s in seen if not y and n]
    chance = [x for _, s in clean for x in s]
    m.lam = 1.0 / max(0.25, sum(chance) / len(chance)) if chance else 1.0
    # K so that the expected number of chance segments over the clean rows is that observed
    m.k = (len(chance) + 1) / max(1, sum(n for n, _ in clean))
    x = np.array([m.surprise(s, n) for _, n, s in seen])
    y = np.array([float(v) for v, _, _ in seen])
    w = np.zeros(2)
    f = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        g = f.T @ (p - y) + 1e-2 * np.array([w[0], 0.0])
        h = (f * (p * (1 - p))[:, None]).T @ f + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    m.a, m.b = max(0.0, float(w[0])), float(w[1])
    return m


def scan(spark: SparkSession, model: Model, text: Column, all_segments: bool = False) -> Column:
    """A struct column: words of the text, its surprise, and its significant (or all) segments, in words."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("n_words", pa.int64()), ("surprise", pa.float64()), ("segments", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("s", pa.float64())])))])

    @F.arrow_udf(SEGMENTS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        get = Scores(m).__getitem__
        for texts in batches:
            out = []
            for t in texts:
                ws = tokens(t.as_py() or "")
                found = segments(np.fromiter(map(get, ws), np.float64, len(ws)))
                told = [{"a": a, "b": b, "s": s} for a, b, s in found if all_segments or m.surprise([s], len(ws)) > -math.log(E_MAX)]
                out.append({"n_words": len(ws), "surprise": m.surprise([s for _, _, s in found], len(ws)), "segments": told})
            yield pa.array(out, kind)

    return find(text)


def probability(model: Model, surprise: Column) -> Column:
    """The calibrated score as an expression on a text's surprise."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.a) * surprise + F.lit(model.b))))


def op7(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments of every whole text; a null id is not held out nor learned from."""
    small_batches(spark)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    m = fit(docs.filter(~held_out), labels.filter(~held_out))
    d = docs.select("doc_id", held_out.alias("held_out"), scan(spark, m, F.col("text")).alias("h"))
    d = d.select("doc_id", "held_out", probability(m, F.col("h.surprise")).alias("score"), F.size("h.segments").alias("n_segments"))
    return d.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_segments")
