import random
import re

import numpy as np
import xxhash
from cases import by_id, docs, empty, odd_texts

from kontor.llm import simhash as sh
from kontor.llm.common import components


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits=3):
    ids, comp = sorted(prints), {}
    for i in ids:
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += [y for y in ids if y not in comp and bin(prints[x] ^ prints[y]).count("1") <= bits]
    return comp


def test_fingerprints_and_groups(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(40):
        words = [f"W{rng.randrange(500)}" for _ in range(rng.randint(1, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            words = list(words)
            words[rng.randrange(len(words))] = "other"
            texts.append("\n".join(words))
    texts += [t for t in odd_texts() if t is None or len(t) < 10_000]
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    got = by_id(sh.simhash(docs(spark, texts)))
    assert {i: got[i]["fingerprint"] for i in prints} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: got[i]["component_id"] for i in prints} == brute_groups(prints)


def test_every_close_pair_is_linked(spark):
    """Random fingerprints at planted distances, crowded blocks cut into small tiles."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = list(base)
    for p in base:
        for bits in (1, 2, 3, 3, 4, 5):
            x = p
            for b in rng.choice(64, bits, replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            prints.append(x)
    crowd = [np.uint64(7) ^ (np.uint64(i) << np.uint64(40)) for i in range(300)]
    values = {int(p): int(p) for p in prints + crowd}
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "print long")
    links = components(sh.near_links(frame, 3, 5, tile=16), "t")
    got = {}
    for r in links.collect():
        got.setdefault(r["component"], set()).add(r["node"] & (1 << 64) - 1)
    want = {}
    for x, c in brute_groups(values).items():
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_empty_and_repeated(spark):
    assert sh.simhash(empty(spark)).count() == 0
    frame = docs(spark, ["a b c d", None])
    assert sh.simhash(frame.unionByName(frame)).count() == 2


def test_long_chain_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (900, 901), (901, 900)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain, "t").collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
