"""Alignment of two tokenizers by token-byte incidence matrices.

Two tokenizers cut the same bytes. Each cut is an incidence matrix in CSR form,
one row a token, one column a byte. A row-by-row (Gustavson) product A.Bt has
an entry for every pair of tokens that share bytes, the overlap links; its
value is the number of bytes shared. Offsets where tokens of both end cut the
bytes into groups. The product of the group-incidence matrices, whose rows are
the token ids of a document and whose values count occurrences, has an entry
for every linked pair of ids; its value is the number of links.

Documents are encoded once and their ids saved. One pass over the ids counts
in how many documents each id pair is linked, a second one looks the counts
up. The pairs found in most documents, at most ``head`` of them, reach the
tasks as a broadcast array; pairs outside it are rare, so joining them on the
pair moves few rows and has no hot key.

Defined results
---------------
* a text that is null, empty, or whose joined token bytes are not space+text
  has no tokens: counts zero, ``groups_sha256`` ''.
* repeated rows, also rows that share an id, are documents of their own; a
  null id stays null.
* special tokens' strings in a text are plain text.
* very long texts are encoded in pieces cut at a space between two non-spaces,
  where no token reaches across.
* empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import map_rows, saved

PIECE = 1 << 15      # characters encoded at once
BLOCK = 1 << 19      # bytes whose matrices are held at once
FLOPS = 1 << 22      # products of a block of rows
BUFFER = 1 << 22     # pairs counted before they leave a task
CACHE = 200_000      # words whose ids are remembered, twice
HEAD = 1 << 20       # id pairs in the broadcast table, 16 bytes each
WORD_START = "▁"
# Letters, digits and spaces of these are the same in every Unicode version the libraries were built with.
SETTLED = re.compile("[^\0-ɏ‐-‧‰-⁞€™]")
CUT = re.compile(r"(?<=\S)(?= \S)")
SPACES = re.compile(r"\s | \s")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- sparse matrices

class CSR:
    """A sparse matrix by rows: the entries of row i are ``cols[ptr[i]:ptr[i + 1]]`` and their values."""

    def __init__(self, ptr, cols, vals, width: int):
        self.ptr, self.cols, self.vals, self.width = ptr, cols, vals, width

    @classmethod
    def of(cls, rows, cols, vals, height: int, width: int) -> "CSR":
        """From entries already ordered by row."""
        ptr = np.zeros(height + 1, np.int64)
        np.cumsum(np.bincount(rows, minlength=height), out=ptr[1:])
        return cls(ptr, cols, vals, width)

    @property
    def height(self) -> int:
        return len(self.ptr) - 1

    def transposed(self) -> "CSR":
        rows = np.repeat(np.arange(self.height), np.diff(self.ptr))
        order = np.argsort(self.cols, kind="stable")
        return CSR.of(self.cols[order], rows[order], self.vals[order], self.width, self.height)


def product(left: CSR, right: CSR, flops: int = FLOPS):
    """Entries (rows, cols, vals) of ``left . right``, ordered, one block of rows at a time.

    Gustavson: row i of the product is the sum of the rows of ``right`` named by
    the entries of row i of ``left``. A block holds rows with at most ``flops``
    products together, or a single row.
    """
    sizes = np.diff(right.ptr)[left.cols]
    upto = np.concatenate(([0], np.cumsum(sizes)))[left.ptr]
    at = 0
    while at < left.height:
        end = max(int(np.searchsorted(upto, upto[at] + flops, "right")) - 1, at + 1)
        lo, hi = left.ptr[at], left.ptr[end]
        size = sizes[lo:hi]
        total = int(size.sum())
        if total:
            # place of every product within its row of ``right``
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            source = np.repeat(right.ptr[left.cols[lo:hi]] - starts, size) + np.arange(total)
            rows = np.repeat(np.arange(at, end), np.diff(left.ptr[at:end + 1]))
            keys = np.repeat(rows * right.width, size) + right.cols[source]
            vals = np.repeat(left.vals[lo:hi], size) * right.vals[source]
            if (keys[1:] < keys[:-1]).any():
                order = np.argsort(keys, kind="stable")
                keys, vals = keys[order], vals[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys = keys[first]
            yield keys // right.width, keys % right.width, np.add.reduceat(vals, first)
        at = end


def gathered(parts):
    """The parts of a product as three arrays."""
    parts = list(parts)
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*parts))


def token_bytes(ends: np.ndarray) -> CSR:
    """Incidence of tokens and bytes, from the offsets where the tokens end."""
    width = int(ends[-1]) if len(ends) else 0
    return CSR(np.concatenate(([0], ends)), np.arange(width), np.ones(width, np.int64), width)


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray):
    """(i, j, bytes shared) of every A token i and B token j that share bytes."""
    return gathered(product(token_bytes(a_ends), token_bytes(b_ends).transposed()))


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray):
    """(group of every A token, group of every B token, number of groups)."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(common, a_ends), np.searchsorted(common, b_ends), len(common)


def _incidence(types: np.ndarray, groups: np.ndarray, n_groups: int):
    """(distinct types, CSR of types by groups whose values count occurrences)."""
    keys = np.sort(types * n_groups + groups)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    types, cols = keys[first] // n_groups, keys[first] % n_groups
    start = np.concatenate(([True], types[1:] != types[:-1]))
    return types[start], CSR.of(np.cumsum(start) - 1, cols, counts, int(start.sum()), n_groups)


def shared_group_links(a_types, b_types, a_groups, b_groups, n_groups: int):
    """(A type, B type, links) of every pair of types that meet in a group; parts in order."""
    if not n_groups:
        return
    a_names, left = _incidence(a_types, a_groups, n_groups)
    b_names, right = _incidence(b_types, b_groups, n_groups)
    for rows, cols, vals in product(left, right.transposed()):
        yield a_names[rows], b_names[cols], vals


# ---------------------------------------------------------------- tokenizers

def _byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as characters: printable Latin-1 as itself, the rest from 256 upwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table = {chr(b): b for b in plain}
    table.update(zip(map(chr, range(256, 512)), (b for b in range(256) if b not in plain)))
    return table


class Encoders:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.a_path = a_path
        with open(a_path, encoding="utf-8") as file:
            stated = json.load(file)
        vocabulary = stated["model"]["vocab"]
        byte = _byte_characters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte for c in token):
                self.a_bytes[i] = bytes(byte[c] for c in token)
        special = {t["content"] for t in stated["added_tokens"]}
        import public_tokenizers
        self.fast = tiktoken.Encoding(
            "byte-level", pat_str=public_tokenizers.PATTERN, special_tokens={},
            mergeable_ranks={self.a_bytes[i]: i for t, i in vocabulary.items() if t not in special})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(WORD_START, " ").encode()
                        for i, p in enumerate(names)]
        # a space may only begin a piece, otherwise texts are not cut
        self.cuts = all(WORD_START not in p.lstrip(WORD_START) for p in names)
        self.a_first = np.array([x[:1] == b" " for x in self.a_bytes])
        self.b_first = np.array([x[:1] == b" " for x in self.b_bytes])
        self.known, self.older = {}, {}
        self.a_sizes = np.array(list(map(len, self.a_bytes)))
        self.b_sizes = np.array(list(map(len, self.b_bytes)))

    @cached_property
    def slow(self):
        """The named byte-level tokenizer; most texts never need it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.a_path)
        found.encode_special_tokens = True
        return found

    def parts(self, line: str):
        """``line`` in pieces that both tokenizers take apart alike."""
        if len(line) <= PIECE or not self.cuts:
            return [line]
        parts, at = [], 0
        while at < len(line):
            cut = CUT.search(line, at + PIECE)
            end = cut.start() if cut else len(line)
            parts.append(line[at:end])
            at = end
        return parts

    def a_ids(self, line: str) -> list[int]:
        # the two libraries know different Unicode versions; outside settled characters the named one decides
        if SETTLED.search(line):
            return self.slow.encode(line, add_special_tokens=False).ids
        return self.fast.encode_ordinary(line)

    def apart(self, word: str) -> tuple[bytes, bytes] | None:
        """Packed ids of a word after a space, from both tokenizers; None where the bytes do not come back."""
        line = " " + word
        a = self.a_ids(line)
        # an empty word is a space at the end of the text
        b = self.pieces.encode(word, num_threads=1) if word else [self.pieces.piece_to_id(WORD_START)]
        data = line.encode("utf-8", "surrogatepass")
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        return struct.pack(f"<{len(a)}i", *a), struct.pack(f"<{len(b)}i", *b)

    def fresh(self, words):
        """Adds the ids of ``words`` to the table."""
        if len(self.known) + len(words) > CACHE:
            self.known, self.older = {}, self.known
        new = [w for w in words if w not in self.older]
        plain = [w for w in new if w and " " not in w and WORD_START not in w and not SETTLED.search(w)]
        if self.cuts and plain:
            # one line of them: a token that begins with a space begins a word
            line = " " + " ".join(plain)
            data, split = line.encode("utf-8", "surrogatepass"), []
            for ids, names, first in ((self.fast.encode_ordinary(line), self.a_bytes, self.a_first),
                                      (self.pieces.encode(line[1:], num_threads=1), self.b_bytes, self.b_first)):
                if b"".join([names[i] for i in ids]) == data:
                    ids = np.array(ids, "<i4")
                    starts = np.flatnonzero(first[ids]) * 4
                    if len(starts) == len(plain):
                        packed, at = ids.tobytes(), [*starts.tolist(), 4 * len(ids)]
                        split.append([packed[x:y] for x, y in zip(at, at[1:])])
            if len(split) == 2:
                self.known.update(zip(plain, zip(*split)))
                new = [w for w in new if w not in self.known]
        for word in new:
            self.known[word] = self.apart(word)
        for word in words:
            if word not in self.known:
                self.known[word] = self.older[word]

    def words_ids(self, words) -> tuple[bytes, bytes] | None:
        """Ids of words that each follow a space."""
        a, b = [], []
        for at in range(0, len(words), 1 << 16):
            part = words[at:at + (1 << 16)]
            found = list(map(self.known.get, part))
            if None in found:
                self.fresh({w for w, f in zip(part, found) if f is None})
                found = [self.known[w] if w in self.known else self.older.get(w) for w in part]
                if None in found:
                    return None
            a += [x for x, _ in found]
            b += [y for _, y in found]
        return b"".join(a), b"".join(b)

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of both as little-endian 32-bit integers, empty where the bytes do not come back.

        No token of either kind reaches across a space between a non-space and a
        non-space, so where all spaces are of that kind, ids are those of the words.
        """
        if not text:
            return b"", b""
        if self.cuts and not text[0].isspace() and not text[-1].isspace() and not SPACES.search(text):
            return self.words_ids(text.split(" ")) or (b"", b"")
        a, b = [], []
        for part in self.parts(" " + text):
            data = part.encode("utf-8", "surrogatepass")
            for ids, names, out in ((self.a_ids(part), self.a_bytes, a),
                                    (self.pieces.encode(part[1:], num_threads=1), self.b_bytes, b)):
                if b"".join([names[i] for i in ids]) != data:
                    return b"", b""
                out.append(struct.pack(f"<{len(ids)}i", *ids))
        return b"".join(a), b"".join(b)


_ENCODERS: dict = {}


def encoders(paths) -> Encoders:
    """One pair of tokenizers a worker; the default files are found where the task runs."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoders(*(paths or default_paths()))
    return _ENCODERS[paths]


def encoded(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(row, doc_id, a, b): the ids of both tokenizers as little-endian 32-bit integers; row is a number of its own."""
    def judge(batch):
        own = encoders(paths)
        ids = [own.encode(t.as_py()) for t in batch["text"]]
        return batch["doc_id"], [a for a, _ in ids], [b for _, b in ids]

    return map_rows(docs.select("doc_id", "text"), "doc_id long, a binary, b binary", judge).withColumn(
        "row", F.monotonically_increasing_id())


# ---------------------------------------------------------------- documents

class Block:
    """Documents whose matrices are formed together; a very long document is cut at ends common to both."""

    def __init__(self, rows: list[int], a: list[np.ndarray], b: list[np.ndarray], own: Encoders):
        self.rows = np.array(rows)
        self.a, self.b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        self.a_doc = np.repeat(np.arange(len(rows)), list(map(len, a)))
        self.b_doc = np.repeat(np.arange(len(rows)), list(map(len, b)))
        self.a_ends, self.b_ends = np.cumsum(own.a_sizes[self.a]), np.cumsum(own.b_sizes[self.b])
        self.a_group, self.b_group, self.n_groups = groups_of(self.a_ends, self.b_ends)
        self.a_width, self.b_width = len(own.a_bytes), len(own.b_bytes)

    def links(self):
        """(place of the document, A id, B id, links), one row an id pair of a document."""
        for x, y, n in shared_group_links(self.a_doc * self.a_width + self.a, self.b_doc * self.b_width + self.b,
                                          self.a_group, self.b_group, self.n_groups):
            yield x // self.a_width, x % self.a_width, y % self.b_width, n

    def overlaps(self) -> np.ndarray:
        """Number of overlap links of each document."""
        rows, _, _ = overlap_links(self.a_ends, self.b_ends)
        return np.bincount(self.a_doc[rows], minlength=len(self.rows))


def blocks(a_column, b_column, own: Encoders, block: int = BLOCK):
    """Blocks of one Arrow batch. Documents stay whole but for those longer than ``block`` bytes."""
    rows, left, right, held = [], [], [], 0
    for i, (a, b) in enumerate(zip(a_column, b_column)):
        a, b = np.frombuffer(a.as_py(), "<i4"), np.frombuffer(b.as_py(), "<i4")
        if not len(a):
            continue
        a_ends = np.cumsum(own.a_sizes[a], dtype=np.int64)
        size = int(a_ends[-1])
        if held and held + size > block:
            yield Block(rows, left, right, own)
            rows, left, right, held = [], [], [], 0
        if size <= block:
            rows.append(i)
            left.append(a)
            right.append(b)
            held += size
            continue
        b_ends = np.cumsum(own.b_sizes[b], dtype=np.int64)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        at = 0
        while at < size:
            end = common[max(np.searchsorted(common, at + block, "right") - 1, np.searchsorted(common, at, "right"))]
            yield Block([i], [a[(a_ends > at) & (a_ends <= end)]], [b[(b_ends > at) & (b_ends <= end)]], own)
            at = int(end)
    if held:
        yield Block(rows, left, right, own)


def id_pairs(found: list[Block]):
    """(A id, B id, links) by document place: the links of consecutive blocks, summed where a document was cut."""
    place, a, b, n = (np.concatenate(c) for c in zip(*(
        (block.rows[doc], x, y, m) for block in found for doc, x, y, m in block.links())))
    if len(found) > 1:
        order = np.lexsort((b, a, place))
        place, a, b, n = place[order], a[order], b[order], n[order]
        first = np.flatnonzero(np.concatenate(
            ([True], (place[1:] != place[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        place, a, b, n = place[first], a[first], b[first], np.add.reduceat(n, first)
    return place, a, b, n


def _runs(found):
    """Blocks, those of one cut document together."""
    run = []
    for block in found:
        if run and block.rows[0] != run[-1].rows[-1]:
            yield run
            run = []
        run.append(block)
    if run:
        yield run


def pair_counts(ids: DataFrame, paths=None, buffer: int = BUFFER) -> DataFrame:
    """(a, b, n): in how many documents the A id and the B id are linked; partially counted in every task."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def count(batches):
        own, held, size = encoders(paths), [], 0
        width = len(own.b_bytes)

        def leave():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 17)]), pa.array(n[at:at + (1 << 17)])],
                                                 schema=schema)

        for batch in batches:
            for run in _runs(blocks(batch["a"], batch["b"], own)):
                _, a, b, _ = id_pairs(run)
                held.append(a * width + b)
                size += len(a)
                if size >= buffer:
                    yield from leave()
                    held, size = [], 0
        if held:
            yield from leave()

    width = F.lit(len(encoders(paths).b_bytes)).cast("long")
    return (ids.select("a", "b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
            .select(F.expr("pair").alias("pair"), F.floor(F.col("pair") / width).cast("long").alias("a_id"),
                    F.pmod("pair", width).alias("b_id"), "n"))


def ranked(counts: DataFrame) -> DataFrame:
    """``counts`` with ``best``: the count is the highest of its A id. An A id has at most one row a B id."""
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a_id")))


def head_threshold(counts: DataFrame, head: int) -> int:
    """The least count such that at most ``head`` pairs have it or more; of counts over 64, powers of two in eighths."""
    step = F.when(F.col("n") <= 64, F.col("n").cast("double")).otherwise(
        F.lit(64.0) + F.ceil(F.log2(F.col("n") / 64.0) * 8))
    found = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for r in sorted(found, key=lambda r: -r["step"]):
        total += r["pairs"]
        if total > head:
            break
        least = r["least"]
    return least if least is not None else np.iinfo(np.int64).max


DIGEST = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string, n_overlaps long, rare binary")


class Digests:
    """The result columns of the documents of one Arrow batch."""

    def __init__(self, own: Encoders, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
        self.own, self.pairs, self.counts, self.best = own, pairs, counts, best
        # text of every token: A first in its group, A, B first, B
        forms = [f"{mark}{i}".encode() for mark, n in ((";", len(own.a_bytes)), (",", len(own.a_bytes)),
                                                       ("|", len(own.b_bytes)), (",", len(own.b_bytes)))
                 for i in range(n)]
        self.forms = np.empty(len(forms), object)
        self.forms[:] = forms

    def lines(self, block: Block):
        """The text of the groups of each document of the block, each group led by ';'."""
        def firsts(groups):
            return np.concatenate(([True], groups[1:] != groups[:-1]))

        va, vb = block.a_width, block.b_width
        codes = np.concatenate([block.a + np.where(firsts(block.a_group), 0, va),
                                2 * va + block.b + np.where(firsts(block.b_group), 0, vb)])
        order = np.argsort(np.concatenate([2 * block.a_group, 2 * block.b_group + 1]), kind="stable")
        forms = self.forms[codes[order]].tolist()
        sizes = (np.bincount(block.a_doc, minlength=len(block.rows))
                 + np.bincount(block.b_doc, minlength=len(block.rows)))
        at = 0
        for n in sizes.tolist():
            yield b"".join(forms[at:at + n])
            at += n

    def __call__(self, batch):
        size = len(batch["row"])
        totals = {c: np.zeros(size, np.int64) for c in
                  ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_overlaps")}
        hashes, rare = [None] * size, [None] * size
        for run in _runs(blocks(batch["a"], batch["b"], self.own)):
            for block in run:
                n = len(block.rows)
                np.add.at(totals["n_a"], block.rows, np.bincount(block.a_doc, minlength=n))
                np.add.at(totals["n_b"], block.rows, np.bincount(block.b_doc, minlength=n))
                lasts = np.flatnonzero(np.append(block.a_group[1:] != block.a_group[:-1], True))
                np.add.at(totals["n_groups"], block.rows, np.bincount(block.a_doc[lasts], minlength=n))
                np.add.at(totals["n_overlaps"], block.rows, block.overlaps())
                for place, line in zip(block.rows.tolist(), self.lines(block)):
                    if hashes[place] is None:
                        hashes[place] = hashlib.sha256()
                        line = line[1:]
                    hashes[place].update(line)
            self.count(run, totals, rare)
        return (batch["row"], batch["doc_id"], *[totals[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best",
                                                                     "count_sum")],
                [h.hexdigest() if h else "" for h in hashes], totals["n_overlaps"], rare)

    def count(self, run, totals, rare):
        """Adds the counts of the pairs in the head; the other pairs of a document leave as (pair, links)."""
        place, a, b, n = id_pairs(run)
        np.add.at(totals["n_links"], place, n)
        pair = a * len(self.own.b_bytes) + b
        at = np.searchsorted(self.pairs, pair)
        known = np.zeros(len(pair), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == pair[inside]
        where, links = place[known], n[known]
        np.add.at(totals["count_sum"], where, links * self.counts[at[known]])
        np.add.at(totals["n_best"], where, links * self.best[at[known]])
        place, pair, n = place[~known], pair[~known], n[~known]
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else []
        for lo, hi in zip(starts, [*starts[1:], len(place)]):
            rare[place[lo]] = np.stack([pair[lo:hi], n[lo:hi]], axis=1).astype("<i8").tobytes()


def digests(ids: DataFrame, counts: DataFrame, head: int = HEAD, paths=None) -> DataFrame:
    """The columns of ``token_alignment``, from ids and ranked counts (saved tables)."""
    least = head_threshold(counts, head)
    top = counts.where(F.col("n") >= least).select("pair", "n", "best").toPandas().sort_values("pair")
    known = ids.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    found = []

    def judge(batch):
        if not found:
            found.append(Digests(encoders(paths), *known.value))
        return found[0](batch)

    rows = saved(map_rows(ids.select("row", "doc_id", "a", "b"), DIGEST, judge), "alignment-rows")

    def unpack(batch):
        held = [(r.as_py(), np.frombuffer(x.as_py(), "<i8").reshape(-1, 2)) for r, x in zip(batch["row"], batch["rare"])]
        pairs = np.concatenate([x for _, x in held]) if held else np.zeros((0, 2), np.int64)
        return np.repeat([r for r, _ in held], [len(x) for _, x in held]).astype(np.int64), pairs[:, 0], pairs[:, 1]

    tail = map_rows(rows.where("rare IS NOT NULL").select("row", "rare"), "row long, pair long, links long", unpack)
    tail = (tail.join(counts.where(F.col("n") < least).select("pair", "n", "best"), "pair").groupBy("row")
            .agg(F.sum(F.col("links") * F.col("n")).alias("more"),
                 F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best")))
    return (rows.drop("rare").join(tail, "row", "left")
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                    "n_overlaps"))


def token_alignment(docs: DataFrame, paths: tuple[str, str] | None = None, head: int = HEAD) -> DataFrame:
    """Counts of tokens, groups and links of every document, and the digest of its groups."""
    ids = saved(encoded(docs, paths), "alignment-ids", compression="zstd")
    counts = saved(ranked(pair_counts(ids, paths)), "alignment-counts")
    return digests(ids, counts, head, paths)


def links(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, a_id, b_id, links): the shared-group links of every document, summed by id pair."""
    def judge(batch):
        own, parts = encoders(paths), []
        for run in _runs(blocks(batch["a"], batch["b"], own)):
            parts.append(id_pairs(run))
        if not parts:
            parts = [(np.zeros(0, np.int64),) * 4]
        place, a, b, n = (np.concatenate(c) for c in zip(*parts))
        return batch["doc_id"].take(pa.array(place)), a, b, n

    return map_rows(encoded(docs, paths).select("doc_id", "a", "b"), "doc_id long, a_id long, b_id long, links long",
                    judge)
