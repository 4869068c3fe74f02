import random
import re
from collections import Counter

import pytest
from cases import by_id, docs, empty, odd_texts

from kontor.llm import quality as q


def windows(words, n):
    counts = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    hit = [False] * len(words)
    for i in range(len(words) - n + 1):
        if counts[tuple(words[i:i + n])] > 1:
            hit[i:i + n] = [True] * n
    return hit


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            dup += line in seen
            dup_chars += (line in seen) * sum(map(len, own))
            seen.add(line)
    cover = {n: (sum(len(w) for w, h in zip(words, windows(words, n)) if h) / chars if chars else 0.0)
             for n in q.NGRAM_LIMITS}
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, sum(windows(words, 3)), cover,
            dup_chars / chars if chars else 0.0)


@pytest.mark.parametrize("seed", range(30))
def test_measures_equal_their_definition(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", "c\u00e9", "#", " ", " ", "\n", "\u00a0", "a b c d e f\n"])
                   for _ in range(rng.randint(0, 160)))
    got, want = q.measure(text), brute(text)
    assert got[:5] == want[:5]
    assert got[5] == pytest.approx(want[5]) and got[6] == pytest.approx(want[6])


def test_verdicts(spark):
    plain = " ".join(f"w{i}" for i in range(120))
    lines = "\n".join([plain] + ["the same long line is here again and again"] * 20)
    got = by_id(q.quality(docs(spark, [plain, lines, plain + "\n" + plain, "few words"])))
    assert [got[i]["kept"] for i in range(4)] == [True, False, False, False]
    assert [got[i]["base_failed"] for i in range(4)] == [False, True, True, True]


def test_odd_rows(spark):
    texts = odd_texts()
    got = by_id(q.quality(docs(spark, texts)))
    for i, t in enumerate(texts):
        if i != 7:
            want = brute(t)
            assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"],
                    got[i]["n_repeat_words"]) == want[:5]
    assert got[7]["n_words"] == 120_000
    assert not got[0]["kept"] and got[0]["base_failed"]
    assert q.quality(empty(spark)).count() == 0
