import hashlib
import random
import re

from cases import by_id, docs, empty, odd_texts

from kontor.llm import pii

# The contract's patterns, as written.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_luhn():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", "@@", ".", "..", "-", " ", "+", "(", ")", "1", "12", "255", "256", "007", "0", "9" * 14,
              "4539578763621486", "x@y.z", "1.2.3.4", "+1 (974) 555-3436", "\n", "\u00e9", "%"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("a" * 500 + "@b.c") == [("email", 0, 504)]


def test_linear_on_long_runs():
    for text in ("1" * 300_000, "a." * 150_000 + "@", "1." * 150_000, "+" + "1" * 300_000, "a" * 300_000 + "@x"):
        assert pii.base_spans(text) == brute(text[:0]) or pii.base_spans(text)[0][0] in ("email", "ip")


def test_contextual_patterns_discover_unseen_identifiers(spark):
    cards = ["4539578763621486", "4556737586899855", "4916909992637469", "4024007198964305", "4485275742308327"]
    assert all(map(pii.luhn, cards))
    texts = [f"pay with card {c} today" for c in cards] + ["pay with card 4539578763621487 today", "number 4539578763621488 here"]
    got = by_id(pii.digest(pii.pii_spans(docs(spark, texts))))
    assert all(got[i]["n_card"] == 1 and got[i]["spans"] == "card:14:30" for i in range(5))
    assert got[5]["n_card"] == 0 and got[5]["spans"] == "card:14:30"  # found by its context only
    assert got[6]["spans"] == ""


def test_unseen_formats_are_found_by_their_context(spark):
    seeds = [f"please call +1 (9{70 + i}) 555-34{70 + i} tonight or later" for i in range(12)]
    new = ["(974) 555-3436", "555-713-2044", "974.555.3436"]
    texts = (seeds + [f"please call {n} tonight or later" for n in new] + [f"order {n} shipped" for n in new[:1]]
             + ["other 2024-01-02 words", "please call ab12cd34 tonight"])
    got = by_id(pii.digest(pii.pii_spans(docs(spark, texts))))
    assert [got[i]["spans"] for i in range(12)] == ["phone:12:29"] * 12
    for i, n in enumerate(new, 12):
        assert got[i]["spans"] == f"phone:12:{12 + len(n)}" and got[i]["n_phone"] == 0
    assert [got[i]["spans"] for i in (15, 16, 17)] == ["phone:6:20", "", ""]  # a found value counts everywhere
    text = by_id(pii.redact(docs(spark, texts)))
    assert [text[i]["text"] for i in range(15)] == ["please call [PHONE] tonight or later"] * 15


def test_rounds_go_on_to_the_last_hop(spark):
    hops, texts, unseen = 5, [], {}
    for h in range(hops):  # without the value of the hop before, 8 of 11 are too few
        values = [f"seed{h}x{i}@mail.org" for i in range(9 if h == 0 else 8)] + [f"new{h}x{i}@host" for i in range(2)]
        values += [f"new{h - 1}x0@host"] if h else []
        for v in values:
            unseen[len(texts)] = v.endswith("@host")
            texts.append(f"left{h} {v} right{h}")
    got = by_id(pii.digest(pii.pii_spans(docs(spark, texts))))
    assert all(got[i]["spans"] == f"email:6:{6 + len(texts[i].split()[1])}" for i in unseen)
    assert sum(unseen.values()) == 14 and all(got[i]["n_email"] == 0 for i in unseen if unseen[i])


def test_one_weak_pattern_is_not_enough(spark):
    texts = [f"write w{i}@mail.org r{i}" for i in range(6)] + ["write some1@host q1", "write some2@host q2"]  # 6 of 8
    texts += [f"seed{i}@mail.org" for i in range(9)] + ["alone@host"]  # only the ends of the text around it
    got = by_id(pii.digest(pii.pii_spans(docs(spark, texts))))
    assert [got[i]["spans"] for i in (6, 7, 17)] == [""] * 3


def test_long_values_with_one_start_are_told_apart(spark):
    twins = ["x" * 90 + end + "@host" for end in "ab"]
    texts = [f"write w{i}@mail.org soon" for i in range(12)] + [f"write {twins[0]} soon", f"path {twins[1]} here"]
    got = by_id(pii.digest(pii.pii_spans(docs(spark, texts))))
    assert [got[i]["spans"] for i in (12, 13)] == ["email:6:102", ""]


def test_odd_rows_and_digest(spark):
    texts = odd_texts() + ["mail a@b.co, 1.2.3.4", "mail a@b.co, 1.2.3.4"]
    got = by_id(pii.digest(pii.pii_spans(docs(spark, texts))))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
    assert got[11]["spans"] == got[12]["spans"] == "email:5:11,ip:13:20"
    assert pii.digest(pii.pii_spans(empty(spark))).count() == 0


def test_redact(spark):
    got = by_id(pii.redact(docs(spark, ["mail a@b.co now", None, "clean", "1.2.3.4 +1 (974) 555-3436"])))
    assert [got[i]["text"] for i in range(4)] == ["mail [EMAIL] now", None, "clean", "[IP] [PHONE]"]
    assert got[0]["score"] == 9.5
