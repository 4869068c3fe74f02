"""Best-fit packing with a swap-based local search.

Texts become token ids of a public tokenizer, then id 1; documents over the
sequence length are cut into full pieces and a rest. Full pieces are sequences
of their own. All other pieces are dealt at random to groups of bounded size
and packed best-fit, longest first; then a local search empties bins: while a
group has more bins than its tokens need, the emptiest bins move a document,
exchange one for one or one for two with other underfull bins, each step
raising the sum of squared fills, until they are empty or no step helps. Bins
left underfull by their groups are dealt again to new groups, until one group
holds them all or they cease to shrink.

Defined results
---------------
* null text counts as empty; an empty text is the single id 1.
* repeated rows are packed one by one, each a document of its own.
* sequence ids are any distinct numbers (the smallest row number in the sequence).
* empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import map_rows, saved

LENGTH = 4096
END = (1).to_bytes(4, "little")
GROUP_ROWS = 16_000
CACHE = 400_000
TRAILING = b".,;:!?#$%&*()|\"-"
CHUNK = 1 << 22


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Byte-level vocabularies write bytes as characters: printable Latin-1 as itself, the rest from 256 upwards.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTERS = dict(zip([b for b in range(256) if b not in _PLAIN], range(256, 512)))


def _ends_in_letter(word: bytes) -> bool:
    """Whether the tokenizer's form of ``word`` (composed, lower case) ends in a letter."""
    if not word or word[-1] < 128:
        return word[-1:].isalpha()
    last = word[-4:].decode("utf-8", "replace")[-1]
    return unicodedata.normalize("NFC", last).lower().isalpha()


class WordIds:
    """Ids of texts as little-endian 32-bit words.

    The tokenizer drops white space, folds case and never joins words across
    white space or a letter and the punctuation after it, so ids of a text are
    the ids of its words and of the marks behind them; words seen before are
    looked up. Two generations of at most CACHE words are remembered.
    The tokenizer must be of that kind: byte-level merges with word ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.merges = self.tokenizer.model

    def _fresh(self, word: bytes) -> bytes:
        """Ids of a word never seen. One of letters only is one piece, which the merges take as it is."""
        text = word.decode("utf-8", "replace")
        if not text.isalpha():
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif text.isascii():
            ids = [t.id for t in self.merges.tokenize(text)]
        else:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))  # no final sigma
            if text.isalpha():
                text = text.encode("utf-8").decode("latin-1").translate(LETTERS)
                ids = [t.id for t in self.merges.tokenize(text)]
            else:
                ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words):
        """Adds the ids of ``words`` to the table, stem and trailing marks apart."""
        if len(self.known) + len(words) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        def ids(word):
            got = known.get(word) or older.get(word) or self._fresh(word)
            known[word] = got
            return got

        for w in words:
            got = older.get(w)
            if got is None:
                stem = w.rstrip(TRAILING)
                if len(stem) < len(w) and _ends_in_letter(stem):
                    got = ids(stem) + ids(w[len(stem):])
                else:
                    got = self._fresh(w)
            known[w] = got

    def _part(self, words):
        found = list(map(self.known.get, words))
        try:
            return b"".join(found)
        except TypeError:  # some word is not known
            self.learn(list({w for w, f in zip(words, found) if f is None}))
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:  # a new generation began: the words known before move over
            self.learn([w for w in set(words) if w not in self.known])
        return b"".join(map(self.known.__getitem__, words))

    def ids(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace").lower()
        if len(data) <= CHUNK:
            return self._part(data.split())
        parts, at = [], 0
        while at < len(data):
            end = at + CHUNK
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            words = data[at:end].split()
            for i in range(0, len(words), CACHE // 4):
                parts.append(self._part(words[i:i + CACHE // 4]))
            at = end
        return b"".join(parts)


def cut(ids: bytes, length: int = LENGTH):
    """[(piece, start, length, crc32)] of a document's ids, which get the end id."""
    ids += END
    return [(i, at // 4, len(part) // 4, zlib.crc32(part)) for i, at in enumerate(range(0, len(ids), 4 * length))
            for part in (ids[at:at + 4 * length],)]


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; the default tokenizer's file is found on each worker."""
    state = {}
    names = ("piece", "start", "length", "ids_crc32")

    def judge(batch):
        if "words" not in state:
            state["words"] = WordIds(tokenizer or default_tokenizer())
        words = state["words"]
        return batch["doc_id"], [[dict(zip(names, p)) for p in cut(words.ids(t.as_py()), length)] for t in batch["text"]]

    return map_rows(docs.select("doc_id", "text"),
                    "doc_id long, pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>",
                    judge).select("doc_id", F.inline("pieces"))


def best_fit(lengths: np.ndarray, size: int):
    """Bins (lists of positions), longest first into the fullest bin that has room."""
    room = [[] for _ in range(size + 1)]  # bins by free space
    open_ = 0  # bit r is set if a bin with r free exists
    bins = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                open_ ^= 1 << free
        else:
            b, free = len(bins), size
            bins.append([])
        bins[b].append(i)
        free -= n
        if free:
            room[free].append(b)
            open_ |= 1 << free
    return bins


class _Bins:
    """Underfull bins during the local search: sorted lengths and free space of each."""

    def __init__(self, bins, lengths, size):
        self.items = [sorted((int(lengths[i]), i) for i in b) for b in bins]
        self.free = [size - sum(n for n, _ in b) for b in self.items]
        self.size = size
        self._table()

    def _table(self):
        one, two = [], []
        for b, items in enumerate(self.items):
            for j, (n, _) in enumerate(items):
                one.append((n, self.free[b], b, j))
                for k in range(j):
                    two.append((n + items[k][0], self.free[b], b, j, k))
        self.one = np.array(one, np.int64).reshape(-1, 4)
        self.two = np.array(two, np.int64).reshape(-1, 5)
        self.gaps = np.array(self.free, np.int64)

    def step(self, donor: int) -> bool:
        """The step that takes most from ``donor`` and raises the sum of squared fills."""
        fill = self.size - self.free[donor]
        fuller = self.size - self.gaps >= fill
        fuller[donor] = False
        best, act = 0, None
        for j, (n, _) in enumerate(self.items[donor]):
            fits = np.flatnonzero(fuller & (self.gaps >= n))
            if len(fits) and n > best:
                best, act = n, ("move", j, int(fits[self.gaps[fits].argmin()]))
            for kind, rows in (("one", self.one), ("two", self.two)):
                if n <= best or not len(rows):
                    continue
                gain = n - rows[:, 0]
                ok = (gain > best) & (gain <= rows[:, 1]) & fuller[rows[:, 2]]
                if ok.any():
                    at = int(np.where(ok, gain, 0).argmax())
                    best, act = int(gain[at]), (kind, j, *map(int, rows[at, 2:]))
        if act is None:
            return False
        kind, j, to, *back = act
        given = [self.items[donor][j]]
        taken = [self.items[to][k] for k in back]
        for x in given:
            self.items[donor].remove(x)
            insort(self.items[to], x)
        for x in taken:
            self.items[to].remove(x)
            insort(self.items[donor], x)
        self.free[donor] += best
        self.free[to] -= best
        self._table()
        return True

    def drop(self, b: int):
        del self.items[b], self.free[b]
        self._table()


def local_search(bins, lengths: np.ndarray, size: int, donors: int = 32, patience: int = 200):
    """Fewer bins by moves and exchanges among the underfull ones.

    Each round takes the best step of the emptiest bin that has one (of
    ``donors`` bins). It ends at the number the sum allows, without a step, or
    after ``patience`` steps that emptied no bin.
    """
    fills = np.array([lengths[b].sum() for b in bins], np.int64)
    least = -(-int(lengths.sum()) // size)
    if len(bins) <= least:
        return bins
    under = np.flatnonzero(fills < size)
    done = [bins[b] for b in np.flatnonzero(fills >= size)]
    work, idle = _Bins([bins[b] for b in under], lengths, size), 0
    while len(done) + len(work.items) > least and idle < patience:
        order = sorted(range(len(work.items)), key=lambda b: -work.free[b])
        # a bin can only be emptied into the space the others have
        if sum(work.free) - work.free[order[0]] < size - work.free[order[0]]:
            break
        donor = next((b for b in order[:donors] if work.step(b)), None)
        if donor is None:
            break
        idle += 1
        if not work.items[donor]:
            work.drop(donor)
            idle = 0
    return done + [[i for _, i in b] for b in work.items]


def pack_group(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Rows of one group with their sequence, offset there and the sequence's fill."""
    pdf = pdf.sort_values("row", ignore_index=True)
    lengths = pdf["length"].to_numpy(np.int64)
    bins = local_search(best_fit(lengths, size), lengths, size)
    rows = pdf["row"].to_numpy(np.int64)
    sequence, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
    for b in bins:
        at = np.sort(np.array(b, np.int64))
        ends = np.cumsum(lengths[at])
        sequence[at], offset[at], fill[at] = rows[at].min(), ends - lengths[at], ends[-1]
    return pdf.assign(sequence_id=sequence, offset=offset, fill=fill)


def pack(found: DataFrame, size: int = LENGTH, group_rows: int = GROUP_ROWS, slack: int = 16) -> DataFrame:
    """``found`` (with ``length``) and its sequence_id and offset."""
    columns = found.columns
    rows = saved(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    done = [rows.where(F.col("length") >= size).select(*columns, F.col("row").alias("sequence_id"),
                                                      F.lit(0).cast("long").alias("offset"))]
    rest = rows.where(F.col("length") < size)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema)
    n, before, level = rest.count(), None, 0
    while n:
        groups = -(-n // group_rows)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("int"))
        packed = saved(dealt.groupBy("group").applyInPandas(
            lambda pdf: pack_group(pdf.drop(columns="group"), size),
            f"{schema}, sequence_id long, offset long, fill long"), "packed")
        under = F.col("fill") < size - slack
        left = packed.where(under).count() if groups > 1 else 0
        last = groups == 1 or not left or (before is not None and 2 * left > n)
        done.append((packed if last else packed.where(~under)).select(*columns, "sequence_id", "offset"))
        if last:
            break
        rest, before, n, level = packed.where(under).select(*rest.columns), n, left, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return pack(pieces(docs, tokenizer, length), length)
