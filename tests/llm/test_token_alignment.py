import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import docs, empty, odd_texts

from kontor.llm import token_alignment as ta
from kontor.llm.common import saved

ALPHABET = ["a", "b", "the", "word", " ", " ", "  ", "\n", " \n", "\t", "é", "ß", "'s", "1", "23", "!", "...",
            " ", "\u0085", "\x1c", "\x00", "中", "文字", "😀", "<s>", "<|endoftext|>", "<0x41>", "ﬁ", "▁", "　"]


def random_text(rng, most=14):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, most)))


def plain(own, text):
    """Tokens as (id, start, end) of both, straight from the two libraries; empty where the bytes differ."""
    if not text:
        return [], []
    line = (" " + text).encode()
    out = []
    for ids, names in ((own.slow.encode(" " + text, add_special_tokens=False).ids, own.a_bytes),
                       (own.pieces.encode(text), own.b_bytes)):
        if b"".join(names[i] for i in ids) != line:
            return [], []
        at, tokens = 0, []
        for i in ids:
            tokens.append((i, at, at + len(names[i])))
            at += len(names[i])
        out.append(tokens)
    return out


def brute(own, texts):
    """The contract, link by link."""
    held = []
    for text in texts:
        a, b = plain(own, text)
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        for lo, hi in zip([0, *common], common):
            groups.append(([i for i, s, e in a if lo <= s and e <= hi], [i for i, s, e in b if lo <= s and e <= hi]))
        overlaps = sum(s < f and t < e for _, s, e in a for _, t, f in b) if len(a) < 2000 else None
        held.append((len(a), len(b), groups, overlaps))
    counts = Counter(p for _, _, groups, _ in held for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    for n_a, n_b, groups, overlaps in held:
        pairs = [(x, y) for ga, gb in groups for x in ga for y in gb]
        line = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        yield {"n_a": n_a, "n_b": n_b, "n_groups": len(groups), "n_links": len(pairs),
               "n_best": sum(counts[p] == highest[p[0]] for p in pairs), "count_sum": sum(counts[p] for p in pairs),
               "groups_sha256": hashlib.sha256(line.encode()).hexdigest() if n_a else "", "n_overlaps": overlaps}


@pytest.fixture(scope="module")
def own():
    return ta.encoders(None)


@pytest.mark.parametrize("seed", range(20))
def test_product_equals_the_dense_one(seed):
    rng = np.random.default_rng(seed)
    n, k, m = rng.integers(1, 9, 3)
    left, right = (rng.integers(0, 3, s) * rng.integers(0, 2, s) for s in ((n, k), (k, m)))

    def sparse(dense):
        rows, cols = np.nonzero(dense)
        return ta.CSR.of(rows, cols, dense[rows, cols], *dense.shape)

    got = np.zeros((n, m), int)
    for flops in (1, 5, 1000):
        rows, cols, vals = ta.gathered(ta.product(sparse(left), sparse(right), flops))
        got = np.zeros((n, m), int)
        got[rows, cols] = vals
        assert (got == left @ right).all()
        assert len(vals) == np.count_nonzero(left @ right)
    back = sparse(left).transposed()
    assert (np.array([[back.vals[back.ptr[i]:back.ptr[i + 1]][back.cols[back.ptr[i]:back.ptr[i + 1]] == j].sum()
                       for j in range(n)] for i in range(k)]) == left.T).all()


def test_overlap_links_and_groups():
    rows, cols, shared = ta.overlap_links(np.array([1, 4, 6]), np.array([2, 4, 5, 6]))
    assert list(zip(rows.tolist(), cols.tolist(), shared.tolist())) == [(0, 0, 1), (1, 0, 1), (1, 1, 2), (2, 2, 1), (2, 3, 1)]
    a, b, n = ta.groups_of(np.array([1, 4, 6]), np.array([2, 4, 5, 6]))
    assert (a.tolist(), b.tolist(), n) == ([0, 0, 1], [0, 0, 1, 1], 2)


@pytest.mark.parametrize("seed", range(10))
def test_ids_equal_those_of_the_two_libraries(own, seed):
    rng = random.Random(seed)
    for _ in range(300):
        text = random_text(rng)
        a, b = (np.frombuffer(x, "<i4").tolist() for x in own.encode(text))
        want = plain(own, text)
        assert (a, b) == ([i for i, _, _ in want[0]], [i for i, _, _ in want[1]]), repr(text)


def test_a_forgetful_table_of_words_gives_the_same_ids(own, monkeypatch):
    monkeypatch.setattr(ta, "CACHE", 3)
    rng = random.Random(1)
    for _ in range(300):
        text = random_text(rng, 30)
        assert [i for i, _, _ in plain(own, text)[1]] == np.frombuffer(own.encode(text)[1], "<i4").tolist()


def test_fast_splitter_equals_the_named_one_on_settled_characters(own):
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2060), 0x20AC, 0x2122]):
        for line in (f" a{c}b", f" {c}1", f" a {c} b", f"{c}{c} ", f"!{c}?", f"a\n{c}"):
            assert own.a_ids(line) == own.slow.encode(line, add_special_tokens=False).ids


def test_long_texts_in_pieces_and_blocks(own):
    rng = random.Random(3)
    text = " ".join(random_text(rng, 6) for _ in range(12_000)).replace("▁", "_")
    want = plain(own, text)
    a, b = own.encode(text)
    assert len(text) > 2 * ta.PIECE
    assert np.frombuffer(a, "<i4").tolist() == [i for i, _, _ in want[0]]
    assert np.frombuffer(b, "<i4").tolist() == [i for i, _, _ in want[1]]
    whole = list(ta.blocks(pa.array([a]), pa.array([b]), own, 1 << 30))
    cut = list(ta.blocks(pa.array([a]), pa.array([b]), own, 500))
    assert len(whole) == 1 and len(cut) > 100
    assert sum(x.n_groups for x in cut) == whole[0].n_groups
    for one, two in zip(ta.id_pairs(whole), ta.id_pairs(cut)):
        assert (one == two).all()


def test_long_texts_without_spaces(own):
    for text in ("x" * 100_000, "=" * 100_000, " " * 70_000, "中" * 20_000):
        a, b = own.encode(text)
        for ids, names in ((a, own.a_bytes), (b, own.b_bytes)):
            assert b"".join(names[i] for i in np.frombuffer(ids, "<i4")) == (" " + text).encode()


@pytest.mark.parametrize("head", [0, 3, 60, 1 << 20])
def test_result_equals_brute_force(spark, own, head):
    rng = random.Random(7)
    texts = [random_text(rng, 40) for _ in range(60)] + ["the same words here", "the same words here", None, "", "▁"]
    want = list(brute(own, texts))
    got = {r["doc_id"]: r.asDict() for r in ta.token_alignment(docs(spark, texts), head=head).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert {k: got[i][k] for k in w} == w, texts[i]


def test_small_buffers_count_alike(spark, own):
    rng = random.Random(9)
    ids = saved(ta.encoded(docs(spark, [random_text(rng, 60) for _ in range(40)])), "test-ids")
    one, two = (sorted(map(tuple, ta.pair_counts(ids, buffer=n).collect())) for n in (1, 1 << 20))
    assert one == two


def test_links_of_documents(spark, own):
    texts = ["one two", None, "one two one"]
    got = defaultdict(Counter)
    for r in ta.links(docs(spark, texts)).collect():
        got[r["doc_id"]][r["a_id"], r["b_id"]] += r["links"]
    for i, text in enumerate(texts):
        a, b = plain(own, text)
        common = {e for _, _, e in a} & {e for _, _, e in b}
        cell = lambda end: sum(c < end for c in common)
        assert got[i] == Counter((x, y) for x, _, e in a for y, _, f in b if cell(e) == cell(f))


def test_odd_rows(spark, own):
    texts = odd_texts()
    texts[7] = texts[7][:60_000]
    want = list(brute(own, texts))
    got = {r["doc_id"]: r.asDict() for r in ta.token_alignment(docs(spark, texts)).collect()}
    for i, w in enumerate(want):
        assert {k: got[i][k] for k, v in w.items() if v is not None} == {k: v for k, v in w.items() if v is not None}
    # repeated ids and null ids are documents of their own
    rows = [(5, "one two"), (5, "one two"), (None, "one two"), (None, None)]
    again = ta.token_alignment(spark.createDataFrame(rows, "doc_id long, text string"), head=0).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in again) == [
        (0, 0, 0), (0, 2, 6), (5, 2, 6), (5, 2, 6)]
    none = ta.token_alignment(empty(spark))
    assert none.count() == 0 and none.columns[:3] == ["doc_id", "n_a", "n_b"]
