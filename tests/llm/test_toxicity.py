import random

import pytest
from cases import by_id, docs, empty, odd_texts

from kontor.llm import toxicity as tox


def brute_segments(scores):
    """All maximal segments by their definition: recursively the best segment, then both sides."""
    def best(lo, hi):
        top, where = 0.0, None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > top + 1e-9 or (where and abs(total - top) < 1e-9 and j - i < where[1] - where[0]):
                    top, where = total, (i, j)
        return top, where

    def go(lo, hi):
        top, where = best(lo, hi)
        if where is None:
            return []
        return go(lo, where[0]) + [(top, *where)] + go(where[1] + 1, hi)

    return go(0, len(scores))


@pytest.mark.parametrize("seed", range(12))
def test_segments_are_all_maximal_ones(seed):
    rng = random.Random(seed)
    drift = 0.37
    scores = [rng.choice([0, 0, 0, 1.1, 0.61, 2.3]) or -drift for _ in range(40)]
    places = [i for i, s in enumerate(scores) if s > 0]
    got = tox.maximal_segments(places, [scores[i] for i in places], len(scores), drift)
    want = brute_segments(scores)
    assert [(f, e) for _, f, e in got] == [(f, e) for _, f, e in want]
    assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(got, want))


def test_learns_and_scores(spark):
    rng = random.Random(5)
    clean = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 200))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["vilexa", "vilexo", "nastum"])
        texts.append(" ".join(words))
        labels.append((i, int(toxic), 1))
    texts += ["vilexu vilexi nastum vilexa nastum", None, ""]
    got = by_id(tox.toxicity(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, score int")))
    held = [i for i in range(600) if got[i]["held_out"]]
    assert held and sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.97 * len(held)
    assert got[600]["predicted"] == 1 and got[600]["passages"]
    assert got[601]["predicted"] == got[602]["predicted"] == 0


def test_odd_rows(spark):
    frame = docs(spark, odd_texts())
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = by_id(tox.toxicity(frame, labels))
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[4]["score"] == got[5]["score"]


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in tox.toxicity(docs(spark, ["a b", None]), labels).collect()} == {0}
    assert tox.toxicity(empty(spark), labels).count() == 0
