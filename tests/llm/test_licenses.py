import random
import re

import pytest
from cases import docs, empty, odd_texts
from compare import compare, duck_connect

from kontor.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(folded)


def brute(text, templates, phrases, threshold):
    own = words(text)
    places = [(i, label) for phrase, label in phrases for i in range(len(own))
              if own[i:i + len(words(phrase))] == words(phrase)]
    best, labels = 0.0, {label for _, label in places}
    for label, template in templates:
        size, wanted = len(words(template)), set(words(template))
        step = 1
        while step < size:
            step *= 2
        for start in range(0, max(len(own), 1), step):
            n = len(wanted & set(own[start:start + 2 * step]))
            if n and n * 100 >= round(threshold * 100) * len(wanted):
                best = max(best, n / len(wanted))
                labels.add(label)
    starts = [i for i, _ in places]
    return (len(own), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), 1.0 if places else best)


def rows(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


def test_words_are_those_of_the_contract():
    text = "".join(map(chr, range(0x250))) + " A1-b2 ÀÉ x"
    assert [w.decode() for w in li.words_of(text)] == words(text)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_join_equals_brute_force(spark, threshold):
    rng = random.Random(3)
    templates = [("x", "a b c d e"), ("y", "a a b e f g h i j"), ("z", "q"), ("w", "c d k l m n o p a b c d e f g h i")]
    phrases = [("a b", "ab"), ("b a b", "bab"), ("q", "q1")]
    letters = "abcdefghijklmnop" * 3 + "qrstuvwxyz" + "aaabbb"
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    got = rows(li.license_scan(docs(spark, texts), templates, phrases, threshold))
    for i, text in enumerate(texts):
        assert got[i][1:] == brute(text, templates, phrases, threshold), text


def test_default_templates_in_long_texts(spark):
    rng = random.Random(5)
    common = [w for _, t in li.TEMPLATES for w in words(t)]
    texts = []
    for label, template in li.TEMPLATES:
        own = template.split()
        for _ in range(max(len(own) // 12, 1)):
            own[rng.randrange(len(own))] = "changed"
        noise = [rng.choice(common[:40]) if rng.random() < 0.3 else f"n{rng.randrange(900)}" for _ in range(700)]
        at = rng.randrange(700)
        texts.append(" ".join(noise[:at]) + "\n# " + "\n# ".join(own) + "\n" + " ".join(noise[at:]))
    got = rows(li.license_scan(docs(spark, texts)))
    for i, (label, _) in enumerate(li.TEMPLATES):
        assert got[i][1:] == brute(texts[i], li.TEMPLATES, li.PHRASES, li.THRESHOLD)
        assert label in got[i][6].split(",")


def test_odd_rows(spark):
    texts = odd_texts() + ["The MIT License, CC-BY, cc by; MIT\nlicense"]
    got = rows(li.license_scan(docs(spark, texts)))
    for i, text in enumerate(texts):
        if i != 7:
            assert got[i][1:] == brute(text, li.TEMPLATES, li.PHRASES, li.THRESHOLD)
    assert got[7][1] == 120_000
    assert got[0][1:] == (0, 0, None, None, "", "", 0.0)
    assert got[-1][2:6] == (4, 1, 7, "cc-by,mit")
    same = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "mit license")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in li.license_scan(same).collect()] == [(2, 1, 0, 0, "mit", "mit", 1.0)] * 3
    assert li.license_scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        li.Templates([("none", "--")], 0.8)


def test_sql(spark):
    from kontor.llm import catalog

    sf = "/root/testdata/sf0.001"
    out = compare(catalog.op12_license_scan(spark, sf), duck_connect(sf), catalog.oracle_sql()["op12_license_scan"])
    assert out["match"] and out["types_match"], out
