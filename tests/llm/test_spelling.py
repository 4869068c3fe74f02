import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import docs, empty, odd_texts

from kontor.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = brute_counts(rows)
    near = defaultdict(set)
    gone = defaultdict(list)
    for w in counts:  # words within one edit share a word with one code point less, or one is that word
        for v in {w[:i] + w[i + 1:] for i in range(len(w))} | {w}:
            gone[v].append(w)
    for group in gone.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_words(rng, n, letters="abé"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n)]


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_pairs_equal_brute_force(spark, block):
    rng = random.Random(block)
    words = sorted(set(some_words(rng, 700)) | {"prefix" + x for x in some_words(rng, 100, "xyzw")})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = sorted((r["a"], r["b"]) for r in sp.near_pairs(table, block, batch_words=50).collect())
    assert got == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1:] if one_edit(a, b))
    for r in sp.near_pairs(table, block).collect():
        assert (words[r["a_n"]], words[r["b_n"]]) == (r["a"], r["b"])


def test_blocks_are_bounded(spark):
    words = ["same" + a + b + c + "tail" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    sizes = sp.blocks(table, 20).groupBy("size", "lo", "hi", "fixed").count().collect()
    assert max(r["count"] for r in sizes) <= 20
    assert sp.near_pairs(table, 20).count() == 512 * 21 // 2


@pytest.mark.parametrize("seed", range(3))
def test_result_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    stock += [w[:-1] for w in stock if len(w) > 5] + [w + "e" for w in stock[:20]]
    stock += ["longword", "longwerd", "lungwerd", "lungwert"]
    weights = [1 / (i + 1) for i in range(len(stock) - 4)] + [1.6, 0.7, 0.3, 0.1]
    texts = [rng.choice(["Ab ", ""]) + " ".join(w.title() if rng.random() < 0.1 else w for w in rng.choices(stock, weights, k=150))
             for _ in range(40)]
    rows = list(enumerate(texts, 100))
    want = brute(rows)
    assert len({r for r in want if r[1]}) > 5 and any(r[1] != r[2] and r[1] for r in want)
    assert result(sp.spelling_variants(docs(spark, texts, first=100))) == want
    assert result(sp.spelling_variants(docs(spark, texts, first=100), block=3)) == want


def test_runs_are_those_of_the_contract():
    text = "".join(map(chr, range(0x300))) + " A×B ÷ cafés 中 naïve_x āb"
    want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in r) for r in RUN.findall(text)]
    assert [r.decode("latin-1") for r in sp.runs_of(text)] == want


def test_small_buffers_count_alike(spark):
    texts = ["apple apples grape grapes apple melon"] * 9 + ["melon lemon apple"] * 4
    one, two = (sorted(map(tuple, sp.word_counts(docs(spark, texts), entries=n).collect())) for n in (1, 1 << 19))
    assert one == two


def test_chains_of_forms_are_followed_to_the_end(spark):
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(37)], "word string, form string")
    assert {r["root"] for r in sp.roots(links).collect()} == {"w37"}
    around = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "word string, form string")
    with pytest.raises(RuntimeError):
        sp.roots(around, max_rounds=4)


def test_odd_rows(spark):
    texts = odd_texts() + ["same " * 3 + "text", "aGAin again agaIn against", "x" * 5000, "x" * 5001, "x" * 5001, "x" * 5001]
    rows = list(enumerate(texts))
    assert result(sp.spelling_variants(docs(spark, texts))) == brute(rows)
    repeated = [(None, "banana banane"), (None, "banana banane"), (3, "banana"), (3, "banana banane"), (3, None)]
    table = spark.createDataFrame(repeated, "doc_id long, text string")
    assert result(sp.spelling_variants(table)) == brute(repeated)
    none = sp.spelling_variants(empty(spark))
    assert none.count() == 0 and set(none.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
