import math

import numpy as np
import pytest

from kontor.llm import embedding_dups as ed


def brute(rows):
    usable = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(usable)
    links = {i: set() for i, _ in rows}
    for a in ids:
        for b in ids:
            if a != b and len(usable[a]) == len(usable[b]):
                u, v = usable[a], usable[b]
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.9:
                    links[a].add(b)
    comp = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += links[x]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, -1, 5) for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, cls long, n_links long")


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = rng.standard_normal(dims)
        for _ in range(rng.integers(1, 6)):
            out.append((base + rng.standard_normal(dims) * rng.choice([0, 0.1, 0.3, 0.45])).astype(np.float32))
    return [v.tolist() for v in out[:n]]


def test_equals_brute_force_within_recall(spark):
    rows = list(enumerate(vectors(700, 24, 1)))
    want, got = brute(rows), result(ed.embedding_duplicates(frame(spark, rows), crowd=32, tile=64, rows_per_task=3000))
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())


def test_crowded_group_is_tiled(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 0.05).astype(np.float32).tolist()) for i in range(300)]
    got = result(ed.embedding_duplicates(frame(spark, rows), tile=32, rows_per_task=500))
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]),
            (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0]), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-30, 0.0]),
            (12, [3e38, 0.0])]
    assert result(ed.embedding_duplicates(frame(spark, rows))) == brute(rows)
    again = ed.embedding_duplicates(frame(spark, rows + rows))
    assert again.count() == len(rows) and result(again) == brute(rows)
    assert ed.embedding_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_calibration_reaches_the_recall():
    depth, tables, least, step, half = ed.calibrate(100_000, 0.9, 0.99, 512)
    rng = np.random.default_rng(3)
    u = rng.standard_normal((4000, 32))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.standard_normal((4000, 32))
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.9 * u + math.sqrt(1 - 0.81) * w
    route, lines = rng.standard_normal((32, depth * tables)), rng.standard_normal((32, ed.COUNTING))
    shift = rng.random(depth * tables) * step
    cell = lambda x: np.floor((x @ route + shift) / step).reshape(-1, tables, depth)
    shared = (cell(u) == cell(v)).all(2).any(1)
    counted = (np.abs(u @ lines - v @ lines) <= half).sum(1) >= least
    assert (shared & counted).mean() >= 0.98


@pytest.mark.parametrize("seed", range(3))
def test_counts_windows(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((30, 5)), rng.standard_normal((40, 5))
    want = (np.abs(a[:, None] - b[None]) <= 0.5).sum(2)
    assert (ed.count_collisions(a, b, 0.5) == want).all()
