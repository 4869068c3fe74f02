"""Spelling variants by a dynamic program over sorted word lists.

Words within one edit of each other share a half: if u has L code points and v
has L or L + 1, the edit leaves the first half of u, or the rest of it, as it
is. Words are therefore joined on (L, the half); a crowded block is cut again
at the middle of its open part until it is small or one code point is open, so
the size of a block is bounded and no pair is lost.

A block's open parts are a sorted list. Adjacent common prefixes cut the list
into ranges that share a prefix; for each query the row of the edit matrix at
the end of that prefix, banded to the three cells that one edit can reach, is
computed once for the range and reused by everything below it. A range whose
row exceeds one edit is skipped with all its words. All queries of a batch
descend together, one depth at a time.

A word's form is its near word of largest count, if at least twice as frequent
as itself; forms are followed by pointer doubling (counts rise at least
twofold along them, so they end).

Defined results
---------------
* null text has no words; a null id counts as the empty id.
* repeated rows are counted one by one. Ties of the count go to the word that
  is smallest in code-point order.
* words of any length are compared whole. Empty table: empty result. Further
  columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import saved

MODULUS = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
BLOCK = 4096        # words a block may hold before it is cut
ENTRIES = 1 << 19   # words counted before they leave a task
BATCH = 1 << 15     # words whose blocks descend together
QUERIES = 1 << 13   # queries that descend together

# Every letter is one byte of Latin-1; A-Z are lower-cased, all else is a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """The lower-cased runs of letters, as Latin-1 bytes."""
    return (text or "").encode("latin-1", "replace").translate(_FOLD).split()


def words_of(doc_id, text: str | None, modulus: int = MODULUS, min_length: int = MIN_LENGTH):
    """(word, occurrences) of one document; some runs lose one code point, as their checksum says."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in Counter(runs_of(text)).items():
        if len(run) < min_length:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < min_length:
                continue
        yield run, n


def word_counts(docs: DataFrame, modulus: int = MODULUS, min_length: int = MIN_LENGTH,
                entries: int = ENTRIES) -> DataFrame:
    """(word, n) of the whole table; tasks send partial counts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        held = {}

        def leave():
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())],
                                              schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for word, n in words_of(doc_id.as_py(), text.as_py(), modulus, min_length):
                    held[word] = held.get(word, 0) + n
                if len(held) >= entries:
                    yield leave()
                    held.clear()
        if held:
            yield leave()

    return (docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


# ---------------------------------------------------------------- blocks

_FIXED = ("concat(substring(word, 1, lo), '/', "
          "substring(word, length(word) - (size - hi) + 1, size - hi))")


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the part of the open range before its middle fixed, and with the part behind it."""
    return (rows.withColumn("mid", F.expr("cast((lo + hi) div 2 AS int)"))
            .withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("lo", F.when(F.col("half") == 0, F.col("mid")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("half") == 1, F.col("mid")).otherwise(F.col("hi")))
            .drop("mid", "half"))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(size, lo, hi, fixed, word, n): words of one (size, lo, hi, fixed) may be within one edit.

    They have ``size`` or ``size`` + 1 code points and agree outside of the open
    range [lo, hi) of the shorter one. Every pair within one edit shares a block.
    """
    key = ["size", "lo", "hi", "fixed"]
    length = F.length("word")
    rows = words.withColumn("size", F.explode(F.array(length, length - 1))).withColumn("lo", F.lit(0)).withColumn(
        "hi", F.col("size")).where("size > 0")
    done = []
    while True:
        rows = saved(_halves(rows).withColumn("fixed", F.expr(_FIXED)), "spelling-rows")
        sizes = rows.groupBy(*key).agg(F.count("*").alias("held"), F.expr("count_if(length(word) = size)").alias("short"))
        # a pair needs two words, one of them a short one
        sizes = saved(sizes.where("held > 1 AND short > 0").drop("short").withColumn("crowded", F.expr(f"held > {block} AND hi - lo > 1")),
                      "spelling-sizes")
        shared = rows.join(sizes.drop("held"), key)
        done.append(shared.where("NOT crowded").drop("crowded"))
        if sizes.where("crowded").isEmpty():
            break
        rows = shared.where("crowded").select("word", "n", "size", "lo", "hi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- the sorted list

class SortedList:
    """Words of some blocks in the order of block and text, with adjacent common prefixes."""

    def __init__(self, block: np.ndarray, texts: list[bytes]):
        self.order = np.array(sorted(range(len(texts)), key=lambda i: (block[i], texts[i])), np.int64)
        self.block = block[self.order]
        own = [texts[i] for i in self.order]
        self.length = np.fromiter(map(len, own), np.int64, len(own))
        self.start = np.cumsum(self.length) - self.length + 1
        self.flat = np.frombuffer(b"\0" + b"".join(own) + b"\0\0", np.uint8)
        self.common = self._common()

    def chars(self, words, at):
        """Code points at ``at`` of ``words``; 0 beyond either end."""
        inside = (at >= 0) & (at < self.length[words])
        return np.where(inside, self.flat[np.where(inside, self.start[words] + at, 0)], 0)

    def _common(self) -> np.ndarray:
        """Length of the prefix that a word shares with the one before it; -1 at the start of a block."""
        common = np.full(len(self.length), -1)
        open_ = np.flatnonzero(self.block[1:] == self.block[:-1]) + 1
        common[open_] = 0
        depth = 0
        while len(open_):
            a, b = self.chars(open_ - 1, np.full(len(open_), depth)), self.chars(open_, np.full(len(open_), depth))
            open_ = open_[(a == b) & (a != 0)]
            depth += 1
            common[open_] = depth
        return common

    def near(self, queries: np.ndarray):
        """(query, word) of all words of the query's block within one edit, as long as the query or one longer."""
        heads = np.flatnonzero(self.common < 0)
        ends = np.append(heads[1:], len(self.length))
        of = np.searchsorted(heads, queries, "right") - 1
        # a state is a range of the list that shares its first ``depth`` code points, a query, and the
        # cells (depth, depth - 1), (depth, depth), (depth, depth + 1) of their edit matrix
        lo, hi, query = heads[of], ends[of], queries
        size = len(queries)
        left, mid, right = np.full(size, 2, np.int8), np.zeros(size, np.int8), np.ones(size, np.int8)
        found, depth = [], 0
        while len(lo):
            over = self.length[lo] == depth
            longer = self.length[query] == depth - 1
            hit = over & (((self.length[query] == depth) & (mid <= 1)) | (longer & (left <= 1))) & (lo != query)
            found.append((query[hit], lo[hit]))
            lo = lo + over
            starts = np.flatnonzero(self.common <= depth)
            first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
            n = last - first
            parent = np.repeat(np.arange(len(lo)), n)
            child = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(parent))
            hi = np.where(child + 1 == last[parent], hi[parent], starts[np.minimum(child + 1, len(starts) - 1)])
            lo, query = starts[child], query[parent]
            left, mid, right = left[parent], mid[parent], right[parent]
            depth += 1
            char = self.chars(lo, np.full(len(lo), depth - 1))
            new_left = np.minimum(mid + 1, left + (char != self.chars(query, np.full(len(lo), depth - 2))))
            new_mid = np.minimum(np.minimum(mid + (char != self.chars(query, np.full(len(lo), depth - 1))), right + 1),
                                 new_left + 1)
            right = np.minimum(right + (char != self.chars(query, np.full(len(lo), depth))), new_mid + 1)
            left, mid = new_left, new_mid
            open_ = np.minimum(np.minimum(left, mid), right) <= 1
            lo, hi, query = lo[open_], hi[open_], query[open_]
            left, mid, right = (np.minimum(c[open_], 2).astype(np.int8) for c in (left, mid, right))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*found))


def _pairs(size, lo, hi, word, n, block):
    """Arrow columns (a, a_n, b, b_n) of the near pairs of whole blocks."""
    coded = [w.encode("latin-1") for w in word]
    own = SortedList(block, [w[l:len(w) - (s - h)] for w, s, l, h in zip(coded, size, lo, hi)])
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))[own.order]
    short = np.flatnonzero(lengths == np.asarray(size)[own.order])
    left, right = [], []
    for at in range(0, len(short), QUERIES):
        a, b = own.near(short[at:at + QUERIES])
        keep = (lengths[a] != lengths[b]) | (a < b)  # pairs of one length are met from both sides
        left.append(own.order[a[keep]])
        right.append(own.order[b[keep]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    words, counts = pa.array(word, pa.string()), pa.array(n, pa.int64())
    return words.take(pa.array(a)), counts.take(pa.array(a)), words.take(pa.array(b)), counts.take(pa.array(b))


def near_pairs(words: DataFrame, block: int = BLOCK, batch_words: int = BATCH) -> DataFrame:
    """(a, a_n, b, b_n): every pair of distinct words that differ by one edit, once."""
    names = ["a", "a_n", "b", "b_n"]
    schema = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])
    key = ["size", "lo", "hi", "fixed"]

    def scan(batches):
        held = {c: [] for c in (*key, "word", "n")}

        def leave(last: bool):
            """The pairs of all blocks that are complete; the last block may go on in the next batch."""
            keys = list(zip(*(held[c] for c in key)))
            change = np.fromiter((a != b for a, b in zip(keys, keys[1:])), bool, max(len(keys) - 1, 0))
            block = np.concatenate(([0], np.cumsum(change))) if keys else np.zeros(0, np.int64)
            end = len(keys) if last or not keys else int(np.searchsorted(block, block[-1]))
            if end:
                columns = _pairs(held["size"][:end], held["lo"][:end], held["hi"][:end], held["word"][:end],
                                 held["n"][:end], block[:end])
                for c in held:
                    held[c] = held[c][end:]
                whole = pa.RecordBatch.from_arrays(list(columns), schema=schema)
                for at in range(0, len(whole), 1 << 16):
                    yield whole.slice(at, 1 << 16)

        for batch in batches:
            for c in held:
                held[c] += batch[c].to_pylist()
            if len(held["word"]) >= batch_words:
                yield from leave(False)
        yield from leave(True)

    placed = blocks(words, block).repartition(*key).sortWithinPartitions(*key)
    found = placed.select(*key, "word", "n").mapInArrow(scan, "a string, a_n long, b string, b_n long")
    ordered = found.select(F.least("a", "b").alias("a"), F.expr("IF(a < b, a_n, b_n)").alias("a_n"),
                           F.greatest("a", "b").alias("b"), F.expr("IF(a < b, b_n, a_n)").alias("b_n"))
    return ordered.dropDuplicates(["a", "b"]).select(*names)


def roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root): from every word of ``links`` (word, form) along the forms to the last. Raises if forms go round."""
    at = saved(links.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        ahead = at.select(F.col("word").alias("via"), F.col("root").alias("further"))
        moved = saved(at.join(ahead, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots")
        if moved.where("moved").isEmpty():
            return at
        at = moved.drop("moved")
    raise RuntimeError(f"forms did not end in {max_rounds} doublings")


def spelling_variants(docs: DataFrame, modulus: int = MODULUS, min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the table."""
    words = saved(word_counts(docs, modulus, min_length).where(F.col("n") >= min_count), "spelling-words")
    pairs = saved(near_pairs(words, block), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("best")) \
        .unionByName(pairs.select(F.col("b").alias("word"),
                                  F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("best")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    takes = -F.col("best.less") >= ratio * F.col("n")
    formed = saved(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")),
        "spelling-forms")
    last = roots(formed.where("form IS NOT NULL"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
