import hashlib
import random

import numpy as np
import pytest
from cases import by_id, docs, empty, odd_texts

from kontor.llm import suffix_dedup as sd


def brute(rows, size):
    """rows: (order, bytes). Equal rows of one order are one document."""
    seen, out = {}, []
    for order, data in sorted(rows):
        mask = bytearray(len(data))
        for p in range(len(data) - size + 1):
            w = data[p:p + size]
            if seen.setdefault(w, (order, p)) < (order, p):
                mask[p:p + size] = b"\1" * size
        kept = bytes(b for b, m in zip(data, mask) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (not i or not mask[i - 1]))
        out.append((order, len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got_of(df):
    return sorted((i, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in by_id(df).items())


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed, monkeypatch):
    """Small alphabets and shared passages; tiny flushes and buffers exercise every path."""
    monkeypatch.setattr(sd, "FREQUENT", 2)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a:a + rng.randint(60, 400)], " ".join(word() for _ in range(rng.randint(0, 9)))]
        texts.append(" ".join(parts))
    texts += ["ab" * 200, "a" * 350, texts[3], texts[3], texts[5][7:]]
    want = brute([(i, t.encode()) for i, t in enumerate(texts)], sd.SIZE)
    assert got_of(sd.suffix_dedup(docs(spark, texts).repartition(5))) == want


def test_odd_rows(spark):
    texts = [t for t in odd_texts() if t is None or len(t) < 10_000] + ["q" * 99, "q" * 100]
    want = brute([(i, (t or "").encode()) for i, t in enumerate(texts)], sd.SIZE)
    frame = docs(spark, texts)
    assert got_of(sd.suffix_dedup(frame)) == want
    twice = sd.suffix_dedup(frame.unionByName(frame))
    assert twice.count() == 2 * len(texts) and got_of(twice) == want
    assert sd.suffix_dedup(empty(spark)).count() == 0


def test_leaders_are_leftmost_minima():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 9, 500).astype(np.uint64)
    for span in (1, 2, 7, 61):
        want = [i + int(np.argmin(grams[i:i + span])) for i in range(len(grams) - span + 1)]
        assert sd.leaders(grams, span).tolist() == want


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(1)
    rows = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 9))), b"h", i, 0, i) for i in range(700)]
    for k in (1, 2, 5, 9):
        runs = [sd.encode_run(rows[i::k]) for i in range(k)]
        merged = list(sd.LoserTree([sd.decode_run(r) for r in runs]))
        texts = [m[0] for m in merged]
        assert texts == sorted(r[0] for r in rows)
        assert [m[1] for m in merged[1:]] == [sd.common_prefix(a, b) for a, b in zip(texts, texts[1:])]
        assert sorted(m[2][1] for m in merged) == list(range(700))


def test_long_documents_cross_buffers(spark, monkeypatch):
    monkeypatch.setattr(sd, "BUFFER", 1000)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    texts = [base, "xx" + base[500:3700] + "yy", base[::-1]]
    want = brute([(i, t.encode()) for i, t in enumerate(texts)], sd.SIZE)
    keyed = [(i, t.encode()) for i, t in enumerate(texts)]
    parts = list(sd.buffers(keyed, sd.SIZE))
    assert sum(len(p) - sd.SIZE + 1 for ps in parts for _, _, p in ps) == sum(len(t) - sd.SIZE + 1 for t in texts)
    assert got_of(sd.suffix_dedup(docs(spark, texts))) == want
