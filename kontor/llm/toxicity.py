"""Toxicity: maximum-scoring segments of token log-odds.

Learning: document frequencies of words and of their first letters (stems) in
toxic and clean labelled rows give log-odds under a Dirichlet prior that
follows the pooled frequencies; a feature's score is the lower end of its
confidence interval, so rare features count little. Scoring: a word has the
score of its best feature, any other word costs ``DRIFT``. One linear scan
(Ruzzo and Tompa) finds all maximal segments; their scores are set against the
extreme-value law of clean text, E = K * words * exp(-lambda * score), the
normalised scores of the significant segments are summed, and a logistic curve
turns the sum into a probability.

Defined results
---------------
* null text counts as empty; a text without words gets the score of no evidence.
* repeated rows are scored alike. Repeated label rows: toxic if any says so;
  null labels are not used.
* no labelled row, or only one class: no evidence anywhere, score = the share of
  toxic rows among the labelled ones (0 without any).
* empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import hash_fraction, map_rows, remainder

WORD = regex.compile(r"\w+")
GAP = regex.compile(r"\W")
STEMS = (4, 5, 6, 7)
DRIFT = 0.05
CHUNK = 1 << 20
MEMO = 300_000


def word_lists(text: str | None):
    """The lower-cased words, in lists of bounded size."""
    text = text or ""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield WORD.findall(text[at:end].lower())
        at = max(end, at + 1)


def features(word: str):
    yield word
    for n in STEMS:
        if len(word) > n:
            yield f"{word[:n]}*"


def maximal_segments(places, scores, n: int, drift: float = DRIFT):
    """All maximal-scoring segments (score, first, last) of ``n`` tokens.

    ``places`` and ``scores`` list the tokens of positive score; all others
    score ``-drift``. Linear: every candidate knows the nearest earlier one
    that starts lower, so no candidate is passed twice.
    """
    left, right, first, last, back = [], [], [], [], []
    total = 0.0
    for i, (place, score) in enumerate(zip(places, scores)):
        lo = total - drift * (place - i)
        total += score
        hi, begin = total - drift * (place - i), place
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            lo, begin = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], back[j:]
        left.append(lo), right.append(hi), first.append(begin), last.append(place), back.append(j)
    return [(r - l, f, e) for l, r, f, e in zip(left, right, first, last)]


class Scorer:
    """Segments of a text; remembers the scores of words it has seen, up to MEMO of them."""

    def __init__(self, weights: dict):
        self.weights, self.memo = weights, {}

    def score(self, word: str) -> float:
        got = max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = got
        return got

    def segments(self, text):
        places, scores, n = [], [], 0
        for words in word_lists(text):
            found = list(map(self.memo.get, words))
            for i, s in enumerate(found):
                if s is None:
                    s = self.score(words[i])
                if s:
                    places.append(n + i)
                    scores.append(s)
            n += len(words)
        return maximal_segments(places, scores, n), n


def evidence(segments, n: int, law) -> float:
    """Sum of normalised scores of the segments that clean text of this length would seldom show."""
    scale, shift = law
    above = [scale * s - shift - np.log(max(n, 1)) for s, _, _ in segments]
    return float(sum(x for x in above if x > 0))


def learn_weights(sample: DataFrame, sizes: dict, prior: float = 20.0, z: float = 1.64,
                  least: float = 1.0, vocabulary: int = 20_000) -> dict:
    """{feature: score} from sampled rows (text, toxic); at most ``vocabulary`` features, those that score highest."""
    def count(batches):
        seen = {0: Counter(), 1: Counter()}

        def rows():
            for toxic, counter in seen.items():
                if counter:
                    yield pd.DataFrame({"feature": list(counter), "toxic": toxic, "n": list(counter.values())})
                    counter.clear()

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                words = set()
                for part in word_lists(text):
                    words.update(part)
                seen[int(toxic)].update({f for w in words for f in features(w)})
                if sum(map(len, seen.values())) > 400_000:
                    yield from rows()
        yield from rows()

    counts = (sample.mapInPandas(count, "feature string, toxic int, n long").groupBy("feature")
              .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
                   F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")))
    nt, nc = float(sizes[1]), float(sizes[0])
    # prior: `prior` pseudo documents of each class, spread like the pooled document frequency
    share = (F.col("t") + F.col("c")) / F.lit(nt + nc)
    t, c = F.col("t") + prior * share, F.col("c") + prior * share
    odds = F.log(t / (nt + prior - t + 1)) - F.log(c / (nc + prior - c + 1))
    low = (odds - z * F.sqrt(1 / t + 1 / c)).alias("low")
    kept = counts.where("t >= 3").select("feature", low).where(F.col("low") >= least)
    rows = kept.orderBy(F.desc("low"), "feature").limit(vocabulary).collect()
    return {r["feature"]: float(r["low"]) for r in rows}


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3):
    """Weighted logistic regression of ``y`` on one variable by Newton steps: (intercept, slope >= 0)."""
    a = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - ridge * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0,
          toxic_docs: int = 4000, clean_docs: int = 8000):
    """(weights, extreme-value law, logistic curve) from labelled rows outside the held-out fold.

    Fitted on a sample of about ``toxic_docs`` toxic and ``clean_docs`` clean
    rows chosen by a hash of the id; these bounds also bound what is broadcast
    (the sampled ids) and brought to the driver (one row per sampled document).
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                          & (remainder("doc_id", modulus) != held))
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        base = 1.0 if 1 in total else 0.0
        return {}, (1.0, 0.0), (40.0 * (base - 0.5), 0.0)
    chosen = known.where(F.when(F.col("toxic") == 1, hash_fraction("doc_id", toxic_docs / total[1]))
                         .otherwise(hash_fraction("doc_id", clean_docs / total[0])))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sizes = {t: min(n, {1: toxic_docs, 0: clean_docs}[t]) for t, n in total.items()}
    weights = learn_weights(sample, sizes)

    def scan(batches):
        scorer = Scorer(weights)
        for pdf in batches:
            found = [scorer.segments(t) for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "n": [n for _, n in found],
                                "scores": [[s for s, _, _ in f] for f, _ in found]})

    got = sample.mapInPandas(scan, "toxic int, n long, scores array<double>").toPandas()
    clean = got[got["toxic"] == 0]
    scores = np.concatenate([np.zeros(0), *[np.asarray(s, float) for s in clean["scores"]]])
    floor = float(np.median(scores)) if len(scores) else 1.0
    top = scores[scores >= floor]
    scale = len(top) / max(float((top - floor).sum()), 1e-9) if len(top) >= 10 else 1.0
    scale = min(scale, 5.0)
    shift = np.log(max(len(top), 1) / max(int(clean["n"].sum()), 1)) + scale * floor
    law = (scale, float(shift))
    x = np.array([evidence([(s, 0, 0) for s in ss], n, law) for ss, n in zip(got["scores"], got["n"])])
    y = got["toxic"].to_numpy(float)
    weight = np.where(y == 1, total[1] / max((y == 1).sum(), 1), total[0] / max((y == 0).sum(), 1))
    return weights, law, logistic(np.log1p(x), y, weight)


RESULT = "doc_id long, held_out boolean, score double, predicted int, passages array<struct<score:double,first:long,last:long>>"


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages): passages are the significant segments, in words."""
    weights, law, (intercept, slope) = learn(docs, labels, modulus, held, **options)
    state = {}

    def judge(batch):
        if "scorer" not in state:
            state["scorer"] = Scorer(weights)
        scorer = state["scorer"]
        score, passages = [], []
        for text in batch["text"]:
            found, n = scorer.segments(text.as_py())
            x = np.log1p(evidence(found, n, law))
            score.append(float(1 / (1 + np.exp(-np.clip(intercept + slope * x, -30, 30)))))
            passages.append([{"score": float(s), "first": f, "last": e} for s, f, e in found
                             if law[0] * s - law[1] - np.log(max(n, 1)) > 0])
        return batch["doc_id"], batch["held_out"], score, [int(s >= 0.5) for s in score], passages

    return map_rows(docs.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "text"),
                    RESULT, judge)
