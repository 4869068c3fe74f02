"""Removal of repeated 100-byte strings by a common-prefix-aware distributed merge sort.

A byte goes if some string of ``size`` bytes that covers it also starts
earlier. Sorting every suffix of a corpus would move a hundred times its size,
so strings are first told apart by short distinguishing prefixes, as
communication-efficient string sorting does:

1. Every string of ``size`` bytes (a window) has a leader: the gram of ``gram``
   bytes with the least hash in it, the leftmost of equals. Consecutive windows
   with one leader are one item; equal windows have equal leaders at equal
   places. Items meet by the leader's hash. An item alone there is unique; an
   item whose whole context equals an earlier one's is repeated; the rest must
   be compared.
2. Contexts to compare are sorted where they are read, as suffixes that start
   at the leader, and leave as front-coded runs (common prefix length with the
   predecessor, and the remaining bytes). A loser tree merges the runs of a
   bucket; it compares common prefix lengths first and never looks again at
   bytes known to be equal. The merged order with its common prefix lengths
   gives, for each offset, the windows that are equal to the right of the
   leader; the bytes left of it settle the rest.
3. Leaders that are frequent (many contexts in one batch of one task) would
   meet in one place; their windows are spread by the hash of the whole window
   instead, after each task has kept only the first of equal ones.

Repeated items are intervals of a document, joined to the texts at the end.

Defined results
---------------
* null text counts as empty. Texts under ``size`` bytes lose nothing.
* order: doc_id, null last, then a hash of the text for rows that share an id.
* repeated rows (equal id and text) are one document: they do not repeat each
  other, and each row gets the result.
* empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import mix64, saved

SIZE, GRAM = 100, 40
LAST = (1 << 63) - 1            # place of a null id in the order
BUFFER = 1 << 20                # bytes hashed at a time
FLUSH = 200_000                 # items compared within a task before they leave
FREQUENT = 8                    # contexts of one leader in a flush that make it frequent
BASE = 0x9E3779B97F4A7C15
COVER, ITEM, FREQUENT_ITEM, NOTE, COMPARE, SPREAD = range(6)
ITEMS = ["kind", "h", "ctx", "doc", "mark", "lo", "hi", "lead"]
_ITEM_SCHEMA = "kind byte, h long, ctx long, doc long, mark long, lo int, hi int, lead int"


class Roller:
    """Polynomial hashes (modulo 2**64) of any slice of a buffer."""

    _tables: dict = {}

    def __init__(self, data: np.ndarray):
        n = len(data)
        if n + 1 > len(self._tables.get("up", ())):
            size = max(n + 1, BUFFER + 1024)
            rng = np.random.default_rng(11)
            self._tables["byte"] = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(size, np.uint64(base))
                powers[0] = 1
                self._tables[name] = np.multiply.accumulate(powers)
        self.down = self._tables["down"]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._tables["byte"][data] * self._tables["up"][:n], out=self.sums[1:])

    def all(self, k: int) -> np.ndarray:
        return mix64((self.sums[k:] - self.sums[:-k]) * self.down[:len(self.sums) - k])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def leaders(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each ``span`` consecutive values, leftmost of equals."""
    place = np.arange(len(grams), dtype=np.int32)
    least, width = grams, 1
    while width < span:
        step = min(width, span - width)
        a, b = least[:len(least) - step], least[step:]
        right = b < a
        place = np.where(right, place[step:], place[:len(place) - step])
        least = np.where(right, b, a)
        width += step
    return place


def items_of(data: np.ndarray, ends: np.ndarray, size: int, gram: int):
    """Items of a buffer of documents that end at ``ends``: lo, hi (first and last window), leader, hash, context hash."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    roll = Roller(data)
    grams = roll.all(gram)
    place = leaders(grams, size - gram + 1)
    start = np.arange(len(place))
    inside = start + size <= ends[np.searchsorted(ends, start, "right")]
    start, place = start[inside], place[inside]
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]
    lo = start[new]
    hi = start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
    lead = place[new].astype(np.int64)
    ctx = roll.some(lo, hi + size) ^ mix64(((lead - lo) * 1024 + (hi - lo)).astype(np.uint64))
    return lo, hi, lead, grams[lead], ctx


def buffers(docs, size: int):
    """(bytes, ends, owner index, offset) buffers from (index, bytes); long documents overlap by size - 1 bytes."""
    parts, held = [], 0
    for i, data in docs:
        for at in range(0, max(len(data) - size + 1, 0), BUFFER):
            part = data[at:at + BUFFER + size - 1]
            parts.append((i, at, part))
            held += len(part)
            if held >= BUFFER:
                yield parts
                parts, held = [], 0
    if parts:
        yield parts


def first_of_equal(frame: dict):
    """Order by (h, ctx, doc, mark, lo); masks in that order: first of its class, and repeats an earlier place."""
    order = np.lexsort((frame["lo"], frame["mark"], frame["doc"], frame["ctx"], frame["h"]))
    f = {k: v[order] for k, v in frame.items()}
    n = len(order)
    first = np.ones(n, bool)
    first[1:] = (f["h"][1:] != f["h"][:-1]) | (f["ctx"][1:] != f["ctx"][:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    again = (f["doc"] != f["doc"][lead]) | (f["mark"] != f["mark"][lead]) | (f["lo"] != f["lo"][lead])
    return f, first, again


def covers(f: dict, mask: np.ndarray, size: int):
    """Merged intervals (doc, mark, lo, end) of repeated items."""
    doc, mark, lo, end = f["doc"][mask], f["mark"][mask], f["lo"][mask].astype(np.int64), f["hi"][mask] + np.int64(size)
    order = np.lexsort((lo, mark, doc))
    doc, mark, lo, end = doc[order], mark[order], lo[order], end[order]
    if not len(doc):
        return doc, mark, lo, end
    # the largest end so far within the document: ends are shifted apart per document
    owner = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    reach = np.maximum.accumulate(end + (owner << 32)) - (owner << 32)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (lo[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    return doc[at], mark[at], lo[at], reach[np.r_[at[1:] - 1, len(doc) - 1]]


def _rows(kind, f, mask=slice(None)) -> pd.DataFrame:
    out = {k: f[k][mask] for k in ITEMS[1:]}
    return pd.DataFrame({"kind": np.full(len(out["h"]), kind, np.int8), **out})


def _cover_rows(f, mask, size) -> pd.DataFrame:
    doc, mark, lo, end = covers(f, mask, size)
    zero = np.zeros(len(doc), np.int64)
    return pd.DataFrame({"kind": np.full(len(doc), COVER, np.int8), "h": zero, "ctx": zero, "doc": doc, "mark": mark,
                         "lo": lo.astype(np.int32), "hi": end.astype(np.int32), "lead": zero.astype(np.int32)})


def _leave(parts, size: int, spread: bool):
    """Rows that leave a task after equal items met in it; ``spread``: items are single windows."""
    frame = {k: np.concatenate([p[k] for p in parts]) for k in ITEMS[1:]}
    f, first, again = first_of_equal(frame)
    yield _cover_rows(f, again, size)
    f = {k: v[first] for k, v in f.items()}
    if spread:
        yield _rows(SPREAD, f)
        return
    begin = np.r_[True, f["h"][1:] != f["h"][:-1]] if len(f["h"]) else np.zeros(0, bool)
    group = np.cumsum(begin) - 1
    many = np.bincount(group, minlength=1)[group] > FREQUENT if len(group) else begin
    yield _rows(ITEM, f, ~many)
    yield _rows(FREQUENT_ITEM, f, many)
    yield _rows(NOTE, f, many & begin)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
                       F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))


def find_items(docs: DataFrame, size: int, gram: int) -> DataFrame:
    def scan(batches):
        waiting, held = [], 0
        for pdf in batches:
            doc, mark = pdf["doc"].to_numpy(np.int64), pdf["mark"].to_numpy(np.int64)
            texts = ((i, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(pdf["text"]))
            for parts in buffers(texts, size):
                data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
                lengths = np.array([len(p) for _, _, p in parts])
                ends = np.cumsum(lengths)
                lo, hi, lead, h, ctx = items_of(data, ends, size, gram)
                part = np.searchsorted(ends, lo, "right")
                owner = np.array([i for i, _, _ in parts])[part] if len(lo) else lo
                shift = (np.array([at for _, at, _ in parts]) - (ends - lengths))[part] if len(lo) else lo
                waiting.append({"h": h.view(np.int64), "ctx": ctx.view(np.int64), "doc": doc[owner], "mark": mark[owner],
                                "lo": (lo + shift).astype(np.int32), "hi": (hi + shift).astype(np.int32),
                                "lead": (lead + shift).astype(np.int32)})
                held += len(lo)
                if held >= FLUSH:
                    yield from _leave(waiting, size, False)
                    waiting, held = [], 0
        if waiting:
            yield from _leave(waiting, size, False)

    return docs.select("doc", "mark", "text").where(F.octet_length("text") >= size).mapInPandas(scan, _ITEM_SCHEMA)


def settle(items: DataFrame, buckets: int, size: int) -> DataFrame:
    """Items met by their leader: covers, and items that must be compared (COMPARE) or spread (SPREAD)."""
    wide = F.col("kind").isin(FREQUENT_ITEM, SPREAD)
    bucket = (F.when(F.col("kind") == COVER, F.xxhash64("doc", "mark", "lo"))
              .when(wide, F.xxhash64("h", "ctx")).otherwise(F.xxhash64("h")))

    def meet(pdf):
        kind = pdf["kind"].to_numpy()
        out = [pdf.loc[kind == COVER, ITEMS]]
        noted = np.unique(pdf["h"].to_numpy()[kind == NOTE])
        for wanted in (ITEM, FREQUENT_ITEM, SPREAD):
            rows = pdf[kind == wanted]
            if not len(rows):
                continue
            f, first, again = first_of_equal({k: rows[k].to_numpy() for k in ITEMS[1:]})
            out.append(_cover_rows(f, again, size))
            f = {k: v[first] for k, v in f.items()}
            if wanted == FREQUENT_ITEM:
                out.append(_rows(SPREAD, f))
            elif wanted == ITEM:
                group = np.cumsum(np.r_[True, f["h"][1:] != f["h"][:-1]]) - 1
                several = np.bincount(group)[group] > 1
                frequent = np.isin(f["h"], noted)
                out += [_rows(COMPARE, f, several & ~frequent), _rows(SPREAD, f, frequent)]
        return pd.concat(out, ignore_index=True)

    return (items.withColumn("bucket", F.pmod(bucket, F.lit(buckets)).cast("int"))
            .groupBy("bucket").applyInPandas(lambda pdf: meet(pdf), _ITEM_SCHEMA))


# ---- front-coded runs and their merge ---------------------------------------------------------

RUN = ["prefix", "tails", "tail_size", "heads", "head_size", "doc", "mark", "lead"]
_TYPES = {"prefix": np.uint8, "tail_size": np.uint8, "head_size": np.uint8, "doc": np.int64, "mark": np.int64,
          "lead": np.int32}


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


def encode_run(rows) -> dict:
    """Front-coded columns of (suffix, head, doc, mark, lead) rows, which are sorted here."""
    rows = sorted(rows)
    prefix, tails, before = [], [], b""
    for suffix, *_ in rows:
        k = common_prefix(before, suffix)
        prefix.append(k)
        tails.append(suffix[k:])
        before = suffix
    columns = {"prefix": prefix, "tail_size": [len(t) for t in tails], "head_size": [len(r[1]) for r in rows],
               "doc": [r[2] for r in rows], "mark": [r[3] for r in rows], "lead": [r[4] for r in rows]}
    out = {k: np.array(v, _TYPES[k]).tobytes() for k, v in columns.items()}
    return out | {"tails": b"".join(tails), "heads": b"".join(r[1] for r in rows)}


def decode_run(run: dict):
    """Yields (suffix, common prefix with the predecessor, row) in order; row = (head, doc, mark, lead)."""
    c = {k: np.frombuffer(run[k], t).tolist() for k, t in _TYPES.items()}
    at = head_at = 0
    before = b""
    for i, k in enumerate(c["prefix"]):
        before = before[:k] + run["tails"][at:at + c["tail_size"][i]]
        at += c["tail_size"][i]
        head = run["heads"][head_at:head_at + c["head_size"][i]]
        head_at += c["head_size"][i]
        yield before, k, (head, c["doc"][i], c["mark"][i], c["lead"][i])


class LoserTree:
    """Merges sorted runs that know the common prefix of each string with its predecessor.

    Every waiting string carries its common prefix with the last output. Of two,
    the longer common prefix is the smaller string; only if they are equal are
    bytes compared, from there on, and the loser's prefix is then the one with
    the winner.
    """

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = 1
        while self.k < len(self.runs):
            self.k *= 2
        self.text: list = [None] * self.k
        self.row: list = [None] * self.k
        self.lcp = [0] * self.k
        for i, run in enumerate(self.runs):
            self._next(i, run)
            self.lcp[i] = 0
        self.loser = [0] * self.k
        self.best = self._build(1)

    def _next(self, i, run):
        got = next(run, None)
        self.text[i], self.lcp[i], self.row[i] = got if got else (None, 0, None)

    def _play(self, a: int, b: int):
        """(winner, loser); sets the loser's common prefix with the winner."""
        x, y = self.text[a], self.text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.lcp[a], self.lcp[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        k = common_prefix(x, y, p)
        if x[k:k + 1] <= y[k:k + 1]:
            self.lcp[b] = k
            return a, b
        self.lcp[a] = k
        return b, a

    def _build(self, node):
        if node >= self.k:
            return node - self.k
        won, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return won

    def __iter__(self):
        while self.text[self.best] is not None:
            best = self.best
            yield self.text[best], self.lcp[best], self.row[best]
            self._next(best, self.runs[best])
            node, won = (best + self.k) // 2, best
            while node:
                won, self.loser[node] = self._play(won, self.loser[node])
                node //= 2
            self.best = won


def repeated_windows(merged, size: int, gram: int):
    """(doc, mark, lo, end) of windows that repeat an earlier one, from the merged (suffix, lcp, row) order."""
    merged = list(merged)
    n = len(merged)
    lcp = np.fromiter((m[1] for m in merged), np.int64, n)
    right = np.fromiter((len(m[0]) for m in merged), np.int64, n)
    heads = [m[2][0] for m in merged]
    left = np.fromiter(map(len, heads), np.int64, n)
    doc, mark, lead = (np.fromiter((m[2][k] for m in merged), np.int64, n) for k in (1, 2, 3))
    back = np.zeros((n, size - gram + 1), np.uint8)  # bytes left of the leader, nearest first
    for i, h in enumerate(heads):
        back[i, :len(h)] = np.frombuffer(h[::-1], np.uint8)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((lead, mark, doc))] = np.arange(n)
    hash_ = np.zeros(n, np.uint64)
    found = np.zeros((n, size - gram + 1), bool)
    for o in range(size - gram + 1):
        if o:
            hash_ = mix64(hash_ * np.uint64(BASE) + back[:, o - 1].astype(np.uint64) + np.uint64(1))
        run = np.cumsum(lcp < size - o)
        at = np.flatnonzero((right >= size - o) & (left >= o))
        if len(at) < 2:
            continue
        order = at[np.lexsort((rank[at], hash_[at], run[at]))]
        same = (run[order[1:]] == run[order[:-1]]) & (hash_[order[1:]] == hash_[order[:-1]])
        first = np.r_[True, ~same]
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        again = (doc[order] != doc[head]) | (mark[order] != mark[head]) | (lead[order] != lead[head])
        found[order[again], o] = True
    rows, offsets = np.nonzero(found)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 4
    new = np.r_[True, (rows[1:] != rows[:-1]) | (offsets[1:] != offsets[:-1] + 1)]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(rows) - 1]
    r = rows[at]
    return doc[r], mark[r], lead[r] - offsets[last], lead[r] - offsets[at] + size


_RUN_SCHEMA = ("bucket int, prefix binary, tails binary, tail_size binary, heads binary, head_size binary, doc binary, "
               "mark binary, lead binary")
_COVER_SCHEMA = "doc long, mark long, lo int, hi int"


def compare_items(docs: DataFrame, todo: DataFrame, buckets: int, size: int, gram: int) -> DataFrame:
    """Covers (doc, mark, lo, hi) of the COMPARE items."""
    wanted = todo.groupBy("doc", "mark").agg(F.collect_list(F.struct("h", "lo", "hi", "lead")).alias("items"))

    def runs(batches):
        waiting, held = {}, 0

        def leave():
            for bucket, rows in waiting.items():
                yield {"bucket": bucket, **encode_run(rows)}
            waiting.clear()

        for pdf in batches:
            for doc, mark, text, items in zip(pdf["doc"], pdf["mark"], pdf["text"], pdf["items"]):
                data = text.encode("utf-8", "surrogatepass")
                for h, lo, hi, lead in {(i["h"], i["lo"], i["hi"], i["lead"]) for i in items}:
                    waiting.setdefault(h % buckets, []).append(
                        (data[lead:hi + size], data[lo:lead], int(doc), int(mark), lead))
                    held += 1
            if held >= FLUSH // 2:
                yield pd.DataFrame(list(leave()))
                held = 0
        if waiting:
            yield pd.DataFrame(list(leave()))

    def merge(pdf):
        tree = LoserTree([decode_run(r) for r in pdf[RUN].to_dict("records")])
        doc, mark, lo, end = repeated_windows(tree, size, gram)
        return pd.DataFrame({"doc": doc, "mark": mark, "lo": lo.astype(np.int32), "hi": end.astype(np.int32)})

    return (docs.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "items")
            .mapInPandas(runs, _RUN_SCHEMA).groupBy("bucket").applyInPandas(merge, _COVER_SCHEMA))


def spread_items(docs: DataFrame, todo: DataFrame, buckets: int, size: int) -> DataFrame:
    """Covers of the SPREAD items: every window by its own hash, the first of equals stays."""
    wanted = todo.groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("items"))

    def windows(batches):
        waiting, held = [], 0
        for pdf in batches:
            for doc, mark, text, items in zip(pdf["doc"], pdf["mark"], pdf["text"], pdf["items"]):
                data = text.encode("utf-8", "surrogatepass")
                for lo, hi in {(i["lo"], i["hi"]) for i in items}:
                    roll = Roller(np.frombuffer(data[lo:hi + size], np.uint8))
                    h = roll.all(size)
                    twin = mix64(h ^ roll.some(np.arange(len(h)) + size // 2, np.arange(len(h)) + size))
                    p = np.arange(lo, hi + 1, dtype=np.int32)
                    waiting.append({"h": h.view(np.int64), "ctx": twin.view(np.int64),
                                    "doc": np.full(len(p), doc, np.int64), "mark": np.full(len(p), mark, np.int64),
                                    "lo": p, "hi": p, "lead": p})
                    held += len(p)
            if held >= FLUSH:
                yield from _leave(waiting, size, True)
                waiting, held = [], 0
        if waiting:
            yield from _leave(waiting, size, True)

    met = settle(docs.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "items")
                 .mapInPandas(windows, _ITEM_SCHEMA), buckets, size)
    return met.where(F.col("kind") == COVER).select("doc", "mark", "lo", "hi")


def union_of(spans):
    """Sorted, merged (lo, end) intervals."""
    out = []
    for lo, end in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return out


def strip(data: bytes, spans) -> bytes:
    kept, at = [], 0
    for lo, end in spans:
        kept.append(data[at:lo])
        at = end
    return b"".join(kept) + data[at:]


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM, rows_per_task: int = 200_000) -> DataFrame:
    """(doc, mark, lo, hi): intervals of bytes to remove, as covers that may overlap. ``docs``: see ``_keyed``."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_byte = 2.0 / (size - gram + 2)
    buckets = max(1, int(n * per_byte / rows_per_task))
    met = saved(settle(find_items(docs, size, gram), buckets, size), "items")
    counts = {r["kind"]: r["count"] for r in met.groupBy("kind").count().collect()}
    out = met.where(F.col("kind") == COVER).select("doc", "mark", "lo", "hi")
    if counts.get(COMPARE):
        out = out.unionByName(compare_items(docs, met.where(F.col("kind") == COMPARE),
                                            max(1, counts[COMPARE] // 30_000), size, gram))
    if counts.get(SPREAD):
        out = out.unionByName(spread_items(docs, met.where(F.col("kind") == SPREAD),
                                           max(1, counts[SPREAD] * 30 // rows_per_task), size))
    return out


_DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, size, gram).groupBy("doc", "mark").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans"))

    @F.pandas_udf(_DIGEST)
    def digest(texts: pd.Series, covers: pd.Series) -> pd.DataFrame:
        rows = []
        for text, cover in zip(texts, covers):
            data = text.encode("utf-8", "surrogatepass")
            merged = union_of((c["lo"], c["hi"]) for c in cover) if cover is not None else []
            rows.append((len(data), sum(e - s for s, e in merged), len(merged),
                         hashlib.sha256(strip(data, merged)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (keyed.join(spans, ["doc", "mark"], "left").withColumn("d", digest("text", "spans"))
            .select("doc_id", "d.*"))
