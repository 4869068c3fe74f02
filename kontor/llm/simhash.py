"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into ``blocks`` parts. Two fingerprints that differ
in at most ``max_bits`` bits agree in at least ``blocks - max_bits`` parts, so
joining on every choice of that many parts finds every close pair; the Hamming
distance is then verified. Equal fingerprints are collapsed first, a crowded
block is cut into tiles that are compared tile against tile, and a tile returns
the links of a spanning forest, never all pairs.

Defined results
---------------
* null text counts as empty; a text without a word has fingerprint zero, which
  links like any other.
* a text of fewer words than the shingle has one shingle, the whole sequence.
* repeated shingles count repeatedly; a bit is 1 if set in over half of them.
* repeated rows (same doc_id) are one document if the text agrees; rows that
  share an id but not the text keep one row each.
* empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import components, find_roots, map_rows, saved

SEED = 42
PIECE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z only) word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - width + 1, 1)
    left, right = starts[:n].tolist(), ends[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(left[at:at + PIECE], right[at:at + PIECE])],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, marked: bool = False) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long; with ``marked`` also mark, xxhash64 of the text."""
    own = ["doc_id", "mark"] if marked else ["doc_id"]

    def judge(batch):
        values = np.fromiter((fingerprint(t.as_py(), width) for t in batch["text"]), np.uint64, len(batch))
        return *[batch[c] for c in own], values.view(np.int64)

    return map_rows(docs.withColumn("mark", F.xxhash64("text")).select(*own, "text"),
                    ", ".join(f"{c} long" for c in [*own, "print"]), judge)


def _masks(blocks: int, max_bits: int):
    """One bit mask for every choice of ``blocks - max_bits`` of the parts."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(left: np.ndarray, right: np.ndarray, max_bits: int, rows: int = 512):
    """Links of a spanning forest of the close pairs between (or within) two arrays of fingerprints."""
    nodes, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = where[:len(left)], where[len(left):]
    us, vs = [], []
    for at in range(0, len(left), rows):
        i, j = np.nonzero(np.bitwise_count(left[at:at + rows, None] ^ right[None, :]) <= max_bits)
        us.append(a[at + i])
        vs.append(b[j])
        if sum(map(len, us)) > 4_000_000:
            us, vs = _thin(len(nodes), us, vs)
    us, vs = _thin(len(nodes), us, vs)
    return nodes[us[0]], nodes[vs[0]]


def _thin(n: int, us, vs):
    """The same components with one link for each node that is not its component's smallest."""
    root = find_roots(n, np.concatenate(us), np.concatenate(vs))
    linked = np.flatnonzero(root != np.arange(n))
    return [linked], [root[linked]]


def near_links(prints: DataFrame, max_bits: int = 3, blocks: int = 5, tile: int = 2048) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``print`` at most ``max_bits`` apart."""
    masks = [_signed(m) for m in _masks(blocks, max_bits)]
    keyed = prints.select("print", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("mask", "bits"))
    keyed = keyed.select("mask", F.col("print").bitwiseAND(F.col("bits")).alias("part"), "print")
    # a block of n fingerprints is cut into ceil(n / tile) chunks; blocks of one have no pair
    sizes = (keyed.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
             .select("mask", "part", F.ceil(F.col("n") / tile).cast("int").alias("chunks")))
    placed = keyed.join(sizes, ["mask", "part"]).withColumn(
        "chunk", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "mask", "part", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
        "chunk", "print")

    def compare(pdf):
        chunk, value = pdf["chunk"].to_numpy(), pdf["print"].to_numpy(np.int64).view(np.uint64)
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        u, v = _forest(value[chunk == lo], value[chunk == hi], max_bits)
        return pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64)})

    return tiles.groupBy("mask", "part", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def grouped(docs: DataFrame, width: int = 3, max_bits: int = 3, blocks: int = 5, marked: bool = False) -> DataFrame:
    """The columns of ``fingerprints`` with ``cluster``, one print a component, and its smallest id ``component_id``."""
    prints = saved(fingerprints(docs, width, marked).distinct(), "prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    near = components(near_links(classes.select("print"), max_bits, blocks), "simhash")
    merged = (near.join(classes, near["node"] == classes["print"])
              .select("component", "first", "print"))
    # the smallest document of a component, then of each of its fingerprints
    smallest = merged.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = classes.join(merged.join(smallest, "component").select("print", "component", "component_id"), "print", "left")
    of_print = of_print.select("print", F.coalesce("component", "print").alias("cluster"),
                               F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(of_print, "print")


def simhash(docs: DataFrame, width: int = 3, max_bits: int = 3, blocks: int = 5) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    return grouped(docs, width, max_bits, blocks).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
