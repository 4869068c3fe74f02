"""Embedding near-duplicates by collision-counting projections.

Vectors are projected on many random lines. Pairs to be counted share a cell
in one of several tables; a table's cell joins a few projections cut into
wide steps, as many as keep a cell small at the given number of vectors. Inside
a cell the counting projections are sorted one by one; every vector opens a
window around its own value, and each pair counts the windows it falls in.
Pairs with enough collisions are verified by their cosine in double precision.
Number of tables and least count follow from ``recall``: at the threshold
cosine a projection difference is normal with the pair's distance as standard
deviation, which gives the chance of a shared cell and the binomial law of the
count.

Equal vectors are collapsed first. A crowded cell is cut into tiles that are
compared tile against tile. A pair is counted in the first table whose cell it
shares, and tasks return counts per vector and the links of a spanning forest,
so pairs themselves are never listed.

Defined results
---------------
* null, empty or zero vectors, or with a null or non-finite component, link
  with nothing: 0 links, a component of their own.
* vectors of different dimension never link.
* rows with equal id and vector are one vector; rows that share only the id
  stay apart and keep one row each.
* empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import components, find_roots, map_rows, mix64, saved

COUNTING = 24
STEP = 4.0     # width of a routing step, in distances of a pair at the threshold
WINDOW = 1.5   # half width of a counting window, likewise


def _normal_within(x: float) -> float:
    """P(|N(0, 1)| <= x)."""
    return math.erf(x / math.sqrt(2))


def same_step(ratio: float) -> float:
    """Chance that two values with a normal difference fall in one step; ``ratio`` = width / standard deviation."""
    return _normal_within(ratio) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def calibrate(n: int, threshold: float, recall: float, crowd: int):
    """(projections per cell, tables, least count, step width, half window)."""
    distance = math.sqrt(2 - 2 * threshold)
    near, far = same_step(STEP), same_step(STEP * distance / math.sqrt(2))
    depth = max(1, math.ceil(math.log(max(n / crowd, 1)) / -math.log(far)))
    miss = (1 - recall) / 2  # half for the cells, half for the counts
    tables = max(1, math.ceil(math.log(miss) / math.log(1 - near ** depth)))
    hit, below, least = _normal_within(WINDOW), 0.0, 0
    while True:
        below += math.comb(COUNTING, least) * hit ** least * (1 - hit) ** (COUNTING - least)
        if below > miss:
            break
        least += 1
    return depth, tables, least, STEP * distance, WINDOW * distance


def unit(rows) -> np.ndarray:
    v = np.stack([np.asarray(r, np.float64) for r in rows])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def count_collisions(left: np.ndarray, right: np.ndarray, half: float) -> np.ndarray:
    """Collisions of each pair: for each projection the right side is sorted and every left vector opens a window."""
    counts = np.zeros((len(left), len(right)), np.int8)
    rows = np.arange(len(left))
    for j in range(left.shape[1]):
        order = np.argsort(right[:, j], kind="stable")
        line = right[order, j]
        first = np.searchsorted(line, left[:, j] - half, "left")
        after = np.searchsorted(line, left[:, j] + half, "right")
        inside = np.zeros((len(left), len(right) + 1), np.int8)
        inside[rows, first] += 1
        inside[rows, after] -= 1
        counts[:, order] += np.cumsum(inside[:, :-1], axis=1, dtype=np.int8)
    return counts


def _compare(v, cells, size, left, right, table, lines, half, least, threshold, slab=512):
    """Links of one tile: (links of left, links of right, forest a, forest b); positions into the tile's arrays."""
    got = np.zeros(len(v), np.int64)
    us, vs = [], []
    x = v @ lines
    for at in range(0, len(left), slab):
        rows = left[at:at + slab]
        i, j = np.nonzero(count_collisions(x[rows], x[right], half) >= least)
        a, b = rows[i], right[j]
        one = a < b if left is right else np.ones(len(a), bool)
        a, b = a[one], b[one]
        for k in range(0, len(a), 1 << 16):
            p, q = a[k:k + (1 << 16)], b[k:k + (1 << 16)]
            ok = np.einsum("ij,ij->i", v[p], v[q]) >= threshold
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            us.append(p)
            vs.append(q)
            new = ~(cells[p, :table] == cells[q, :table]).any(axis=1)
            np.add.at(got, p[new], size[q[new]])
            np.add.at(got, q[new], size[p[new]])
        if sum(map(len, us)) > 2_000_000:
            us, vs = _thin(len(v), us, vs)
    if us:
        us, vs = _thin(len(v), us, vs)
        return got, us[0], vs[0]
    return got, np.zeros(0, np.int64), np.zeros(0, np.int64)


def _thin(n, us, vs):
    root = find_roots(n, np.concatenate(us), np.concatenate(vs))
    linked = np.flatnonzero(root != np.arange(n))
    return [linked], [root[linked]]


def near_vectors(classes: DataFrame, threshold: float = 0.9, recall: float = 0.99, crowd: int = 512,
                 tile: int = 2048, rows_per_task: int = 20_000, seed: int = 7) -> DataFrame:
    """Rows (a, b, n) of distinct unit-free vectors ``classes`` (cls, embedding, size).

    b null: vector ``a`` links with ``n`` further vectors (of size). b not null:
    a link of a spanning forest.
    """
    n, dims = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    depth, tables, least, step, half = calibrate(n, threshold, recall, crowd)
    rng = np.random.default_rng(seed)
    route = rng.standard_normal((dims or 1, tables * depth))
    shift = rng.random(tables * depth) * step
    lines = rng.standard_normal((dims or 1, COUNTING))
    salts = mix64(np.arange(1, depth + 1, dtype=np.uint64))

    def cut(batch):
        rows = batch["embedding"].to_pylist()
        sizes = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), tables), np.int64)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            steps = np.floor((unit([rows[i] for i in at]) @ route[:d] + shift) / step).astype(np.int64).view(np.uint64)
            steps = mix64(steps.reshape(len(at), tables, depth) + salts)
            key = np.full((len(at), tables), np.uint64(d))
            for k in range(depth):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, k])
            out[at] = key.view(np.int64)
        return batch["cls"], batch["embedding"], batch["size"], list(out)

    kind = classes.schema["embedding"].dataType.simpleString()
    celled = saved(map_rows(classes.select("cls", "embedding", "size"),
                            f"cls long, embedding {kind}, size long, cells array<long>", cut), "cells")
    placed = celled.select("cls", F.posexplode("cells").alias("table", "cell"))
    crowds = (placed.groupBy("table", "cell").agg(F.count("*").alias("n")).where("n > 1")
              .select("table", "cell", F.ceil(F.col("n") / tile).cast("int").alias("chunks")))
    dealt = (placed.join(crowds, ["table", "cell"])
             .withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("cls", "table", "cell", F.least("chunk", "other").alias("lo"),
                     F.greatest("chunk", "other").alias("hi"), "chunk"))
    dealt = saved(dealt, "tiles")
    tasks = max(1, -(-dealt.count() // rows_per_task))
    rows = (dealt.join(celled, "cls")
            .withColumn("task", F.pmod(F.xxhash64("table", "cell", "lo", "hi"), F.lit(tasks)).cast("int")))

    def compare(pdf):
        pdf = pdf.sort_values(["table", "cell", "lo", "hi"], kind="stable", ignore_index=True)
        keys = pdf[["table", "cell", "lo", "hi"]].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        cls, size, chunk = (pdf[c].to_numpy(np.int64) for c in ("cls", "size", "chunk"))
        a, b, count = [], [], []
        for s, e in zip(starts, np.r_[starts[1:], len(pdf)]):
            if e - s < 2:
                continue
            v = unit(pdf["embedding"].iloc[s:e])
            cells = np.stack(pdf["cells"].iloc[s:e].to_list())
            lo, hi = keys[s, 2], keys[s, 3]
            left = np.flatnonzero(chunk[s:e] == lo)
            right = left if lo == hi else np.flatnonzero(chunk[s:e] == hi)
            got, u, w = _compare(v, cells, size[s:e], left, right, int(keys[s, 0]), lines[:v.shape[1]],
                                 half, least, threshold)
            hit = np.flatnonzero(got)
            a += [cls[s:e][hit], cls[s:e][u]]
            b += [np.full(len(hit), -1), cls[s:e][w]]
            count += [got[hit], np.zeros(len(u), np.int64)]
        empty = [np.zeros(0, np.int64)]
        return pd.DataFrame({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty),
                             "n": np.concatenate(count or empty)})

    return rows.groupBy("task").applyInPandas(compare, "a long, b long, n long")


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    distinct = vectors.select("vec_id", "embedding").distinct()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = saved(distinct.where(usable).groupBy("embedding")
                    .agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
                    .withColumn("cls", F.monotonically_increasing_id()), "vectors")
    found = saved(near_vectors(classes, threshold, **options), "near")
    links = found.where("b = -1").groupBy("a").agg(F.sum("n").alias("others"))
    near = components(found.where("b >= 0").select("a", "b"), "embeddings")
    firsts = (near.join(classes.select(F.col("cls").alias("node"), "first"), "node")
              .select("component", F.col("node").alias("cls"), "first"))
    smallest = firsts.groupBy("component").agg(F.min("first").alias("smallest"))
    by_class = (classes.join(links.withColumnRenamed("a", "cls"), "cls", "left")
                .join(firsts.join(smallest, "component").select("cls", "smallest"), "cls", "left")
                .select("embedding", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                        F.coalesce("smallest", "first").alias("component_id")))
    linked = distinct.where(usable).join(by_class, "embedding").select("vec_id", "n_links", "component_id")
    alone = distinct.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                           F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
