"""Language identification by mixture inference.

Each document is a mixture of languages over character trigrams. Trigram
distributions per language are learned from labelled rows; the proportions of
a document come from expectation-maximisation, and the set of languages from a
penalised likelihood: a further language stays only if it raises the
log-likelihood by more than ``penalty * log(number of trigrams)``.

Defined results
---------------
* null text or text without a letter: ``lang_pred = 'und'``, score 0, empty mixture.
* repeated rows: each row is judged by itself, so copies agree.
* ties between languages: the alphabetically first language wins.
* empty table: empty result. No labelled row at all: every row is ``und``.
* further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import remainder

UNDETERMINED = "und"
MODEL_CELLS = 1 << 20
MOST_LANGUAGES = 8192  # 64 MB of probabilities, beyond the number of written languages
CHUNK = 1 << 20
LETTER = regex.compile(r"\p{L}")
_ALPHA = None


def _alpha() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _ALPHA


def trigram_counts(text: str, bits: int) -> np.ndarray:
    """Counts of hashed trigrams of the lower-cased text; runs of non-letters are one blank."""
    counts = 0
    for at in range(0, len(text), CHUNK):
        part = text[max(at - 2, 0):at + CHUNK].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_alpha()[codes], codes, np.uint32(32))
        codes = np.concatenate(([np.uint32(32)], codes, [np.uint32(32)])).astype(np.uint32)
        codes = codes[_keep(codes)]
        if len(codes) < 3:
            continue
        key = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77)
               + codes[2:] * np.uint32(0xC2B2AE3D))
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        counts = counts + np.bincount(key >> np.uint32(32 - bits), minlength=1 << bits)
    return counts if isinstance(counts, np.ndarray) else np.zeros(1 << bits, np.int64)


def _keep(codes: np.ndarray) -> np.ndarray:
    """Positions without the second and later blanks of a run."""
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return keep


def learn(labelled: DataFrame, docs_per_language: int = 2000, smoothing: float = 0.2):
    """(languages, matrix of trigram probabilities [bucket, language]) from rows ``(doc_id, text, lang)``.

    Fitted on a sample of at most about ``docs_per_language`` rows of each
    language, chosen by a hash of the id. The matrix has at most MODEL_CELLS
    cells, or 1,024 for each of at most MOST_LANGUAGES languages, whatever the
    input, so it may travel with the tasks.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], None
    bits = max(10, min(14, (MODEL_CELLS // len(langs)).bit_length() - 1))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages exceed the model's bound of {MOST_LANGUAGES}")
    spark = labelled.sparkSession
    # one row a language, at most MOST_LANGUAGES: the hashes of ids below which a row is in the sample
    shares = spark.createDataFrame([(lang, int(min(1.0, docs_per_language / n) * 2**62)) for lang, n in sizes.items()],
                                   "lang string, below long")
    sampled = (labelled.select("doc_id", "text", "lang").where("text IS NOT NULL").join(F.broadcast(shares), "lang")
               .where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < F.col("below")))
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        totals = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                i = place[lang]
                if i not in totals:
                    totals[i] = np.zeros(1 << bits, np.int64)
                totals[i] += trigram_counts(text, bits)
        for i, total in totals.items():
            at = total.nonzero()[0]
            yield pd.DataFrame({"lang": i, "bucket": at, "n": total[at]})

    found = (sampled.select("lang", "text")
             .mapInPandas(count, "lang int, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    matrix = np.full((1 << bits, len(langs)), smoothing)
    matrix[found["bucket"].to_numpy(np.int64), found["lang"].to_numpy(np.int64)] += found["n"].to_numpy(float)
    return langs, (matrix / matrix.sum(axis=0)).astype(np.float64)


def _expectation(p: np.ndarray, n: np.ndarray, rounds: int, tolerance: float = 1e-4):
    """Proportions and log-likelihood of the mixture of the columns of ``p``."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        new = share * ((n / (p @ share)) @ p) / total
        done = np.abs(new - share).max() < tolerance
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(counts: np.ndarray, matrix: np.ndarray, logs: np.ndarray, penalty: float, rounds: int):
    """{column: proportion} of the chosen languages of one document.

    A language whose share over all languages is below one trigram is not tried.
    """
    at = np.flatnonzero(counts > 0)
    n, p = counts[at].astype(float), matrix[at]
    total = n.sum()
    alone = n @ logs[at]
    best = int(alone.argmax())
    chosen, shares, value = [best], np.ones(1), float(alone[best])
    cost = penalty * np.log(total + 1)
    if p.shape[1] > 1:
        everywhere, _ = _expectation(p, n, rounds, 1e-3)
        for nxt in np.argsort(-everywhere, kind="stable"):
            if nxt in chosen:
                continue
            if everywhere[nxt] * total < 1:
                break
            trial = chosen + [int(nxt)]
            share, got = _expectation(p[:, trial], n, rounds)
            if got - value <= cost:
                break
            chosen, shares, value = trial, share, got
    return dict(zip(chosen, shares))


def judge(model, penalty: float, rounds: int):
    """A function from a text to (language, share, mixture)."""
    langs, matrix = model
    bits = 0 if matrix is None else matrix.shape[0].bit_length() - 1
    logs = None if matrix is None else np.log(matrix)

    def one(text):
        counts = None
        if matrix is not None and text is not None and LETTER.search(text):
            counts = trigram_counts(text, bits)
        if counts is None or not counts.any():
            return UNDETERMINED, 0.0, []
        shares = infer(counts, matrix, logs, penalty, rounds)
        top = max(sorted(shares), key=lambda i: shares[i])
        mixture = [{"lang": langs[i], "share": float(s)} for i, s in sorted(shares.items(), key=lambda x: -x[1])]
        return langs[top], float(min(1.0, shares[top])), mixture

    return one


RESULT = "lang_pred string, score double, mixture array<struct<lang:string,share:double>>"


def identify(docs: DataFrame, model, penalty: float = 3.0, rounds: int = 25) -> DataFrame:
    """``docs`` with lang_pred, score (its language's share) and mixture for every row; no shuffle."""
    @F.pandas_udf(RESULT)
    def mixtures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = judge(model, penalty, rounds)
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score", "mixture"])

    return docs.withColumn("found_", mixtures("text")).select(*docs.columns, "found_.*")


def language_id(docs: DataFrame, modulus: int = 4, held: int = 2, docs_per_language: int = 2000,
                penalty: float = 3.0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture): learn from the labelled rows outside the held-out fold, judge all."""
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & (remainder("doc_id", modulus) != held))
    return identify(docs.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "text"),
                    learn(labelled, docs_per_language), penalty).drop("text")
