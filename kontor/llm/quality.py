"""Quality rules: repetition coverage from rolling hashes.

Words are white-space separated (space and ``\\t \\n \\v \\f \\r``). Rolling hashes
of several n-gram lengths mark the words that lie in an n-gram found twice or
more; the coverage of a length is the share of word characters so marked, and
lines count the characters of lines equal to an earlier one. A document is
kept if it passes the base rules and no coverage exceeds its limit.

Defined results
---------------
* null text counts as empty: no words, base_failed, not kept.
* fewer words than an n-gram length: coverage 0 for that length.
* a coverage equal to its limit passes. Repeated rows are judged alike.
* empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from kontor.llm.common import map_rows, mix64

# Largest share of word characters inside duplicated n-grams, by n.
NGRAM_LIMITS = {5: 0.50, 6: 0.45, 7: 0.40, 8: 0.35, 9: 0.32, 10: 0.30}
# Largest share of word characters inside lines equal to an earlier line.
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
BASE = np.uint64(0x9E3779B97F4A7C15)


def _covered(keys: np.ndarray, n: int, words: int) -> np.ndarray:
    """Mask of the words inside windows of ``n`` words whose key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    marks = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + n, -1)
    return np.cumsum(marks[:-1]) > 0


def _exact_triples(ids: np.ndarray, distinct: int) -> np.ndarray:
    """A number for each window of three words, equal only for equal windows."""
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct < 1 << 21:
        return pairs[:-1] * distinct + ids[2:]
    ranks = np.unique(pairs, return_inverse=True)[1]
    return ranks[:-1] * distinct + ids[2:]


def measure(text: str | None, lengths=tuple(NGRAM_LIMITS)):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {n: coverage}, line coverage)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, sum(data.count(s) for s in SYMBOLS), 0, 0, dict.fromkeys(lengths, 0.0), 0.0
    number = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    distinct = list(number)
    if len(text) == len(data):
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    else:
        sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in distinct), np.int64, len(distinct))
    chars = sizes[ids]
    total = int(chars.sum())
    symbols = sum(data.count(s) for s in SYMBOLS)
    repeat = int(_covered(_exact_triples(ids, len(distinct)), 3, n).sum()) if n >= 3 else 0

    lines, dup_lines, dup_chars = set(), 0, 0
    for line in data.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in lines:
            dup_lines += 1
            dup_chars += sum(int(sizes[number[w]]) for w in parts)
        else:
            lines.add(line)

    values = mix64(np.arange(1, len(distinct) + 1, dtype=np.uint64))[ids]
    coverage, rolled = {}, values
    for length in range(2, max(lengths) + 1):
        if length > n:
            break
        rolled = rolled[:-1] * BASE + values[length - 1:]
        if length in lengths:
            coverage[length] = float(chars[_covered(rolled, length, n)].sum() / total)
    return (n, total, symbols, dup_lines, repeat, {k: coverage.get(k, 0.0) for k in lengths}, dup_chars / total)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, line_coverage double, ngram_coverage array<double>")


def quality(docs: DataFrame, limits: dict = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Counts, base verdict and verdict of every document; no shuffle."""
    def judge(batch):
        found = [measure(t.as_py(), tuple(limits)) for t in batch["text"]]
        columns = [list(c) for c in zip(*found)] if found else [[] for _ in range(7)]
        failed = [base_failed(f[0], f[4]) for f in found]
        kept = [not bad and f[6] <= line_limit and all(f[5][n] <= limits[n] for n in limits)
                for bad, f in zip(failed, found)]
        return (batch["doc_id"], *columns[:5], failed, kept, columns[6], [list(c.values()) for c in columns[5]])

    return map_rows(docs.select("doc_id", "text"), RESULT, judge)
