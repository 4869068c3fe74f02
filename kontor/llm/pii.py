"""Personal data: fixed patterns, then bootstrapped contextual extraction.

The fixed patterns give the base spans (and the seeds). Every identifier-like
token of the corpus, seed or not, is an instance that occurs in lexical
patterns: the word before it or the word after it, with the token's coarse class
(address, digits or mixed), so that a format which no base rule knows is found.
Rounds of scoring run over the pattern-instance graph in Spark: a pattern's
confidence for a kind is the share of its distinct instances that belong to
the kind; an instance whose confident patterns agree to a noisy-or score of at
least ``min_score`` joins the kind and counts in the next round. Rounds go on
until one accepts nothing. Occurrences accepted that way are added spans;
base spans stay, and an added span never overlaps one.

Defined results
---------------
* null text counts as empty: no spans, the hash of the empty string.
* repeated rows: each row gets its own result, equal for equal rows; repeated
  rows count once as instances, because confidences count distinct values.
* ties between kinds of a pattern: the kind listed first.
* empty table: empty result. Further columns are not read.
* ``n_*`` count base spans; ``spans`` holds base and added spans.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import map_rows, saved

KINDS = ["email", "ip", "card", "phone"]

# Fixed patterns. Possessive runs and anchors keep them linear in the text:
# a match that starts inside a run of digits would also start at the run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_TOKEN = re.compile(r"[^\s|\"'<>=,;:!?#$%&*]+")
_NUMERIC = re.compile(r"[+(]?[0-9][0-9().-]*|\([0-9][0-9().-]*")
_LETTER = re.compile(r"[^\W\d_]")
_EDGE = ".-()+_"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text):
    """Leftmost matches: the local part is the whole run before an @, up to the previous match."""
    free = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        if at < free:
            continue
        start = at
        while start > free:
            # step back in blocks; a block that is all local characters may continue
            low = max(free, start - 64)
            block = text[low:start]
            tail = 0
            for run in _LOCAL_BACK.finditer(block):
                if run.end() == len(block):
                    tail = len(run[0])
            start -= tail
            if tail < len(block):
                break
        if start < at:
            free = m.end()
            yield start, free


def base_spans(text: str | None):
    """[(kind, start, end)] by kind as listed, then start."""
    out = []
    if not text:
        return out
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 13 or m.end() - m.start() > 37:
                continue
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def span_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def class_of(value: str) -> str:
    """Coarse class of a token, whatever its grouping and length."""
    if "@" in value:
        return "address"
    return "mixed" if _LETTER.search(value) else "digits"


def key_of(token: str) -> str:
    """The token, or a 128-bit hash of the whole of a long one, apart from any token by its line feed."""
    return token if len(token) <= 40 else "\n" + hashlib.blake2b(token.encode(), digest_size=16).hexdigest()


def instances(text: str | None, base):
    """Identifier-like tokens with their context: (start, end, value, class, left, right, kind of the base span or None)."""
    if not text or not ("@" in text or _DIGIT.search(text)):
        return []
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    out, i = [], 0
    by_start = sorted((s, e, k) for k, s, e in base)
    at = 0
    while i < len(tokens):
        first = i
        start, end, value = tokens[i]
        i += 1
        if not ("@" in value or _DIGIT.search(value)):
            continue
        if _NUMERIC.fullmatch(value):  # number groups set apart by one blank are one token
            while i < len(tokens) and tokens[i][0] == end + 1 and text[end] == " " and _NUMERIC.fullmatch(tokens[i][2]):
                end = tokens[i][1]
                i += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while start < end and text[start] in ".-)_":
            start += 1
        value = text[start:end]
        if len(value) < 5:
            continue
        while at < len(by_start) and by_start[at][1] <= start:
            at += 1
        kind = next((k for s, e, k in by_start[at:at + 8] if s < end and start < e), None)
        left = key_of(tokens[first - 1][2].lower()) if first else "^"
        right = key_of(tokens[i][2].lower()) if i < len(tokens) else "$"
        out.append((start, end, key_of(value), class_of(value), left, right, kind))
    return out


_SCAN = ("doc_id long, mark long, base array<struct<kind:string,start:long,end:long>>, "
         "found array<struct<start:long,end:long,value:string,class:string,left:string,right:string,kind:string>>")


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and instances of every row, in one pass over the texts."""
    names = ("start", "end", "value", "class", "left", "right", "kind")

    def judge(batch):
        texts = batch["text"].to_pylist()
        base = [base_spans(t) for t in texts]
        return (batch["doc_id"], batch["mark"], [[dict(zip(("kind", "start", "end"), x)) for x in b] for b in base],
                [[dict(zip(names, x)) for x in instances(t, b)] for t, b in zip(texts, base)])

    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), _SCAN, judge)


def bootstrap(occurrences: DataFrame, max_rounds: int = 200, min_seeds: int = 4, min_confidence: float = 0.75,
              min_score: float = 0.9) -> DataFrame:
    """Kinds of unseen values: rows (value, class, kind) accepted by confident patterns.

    ``occurrences`` holds (value, class, left, right, kind), kind null where unseen.
    Rounds end when one accepts no further value; ``max_rounds`` guards against
    endless runs and raises, it never truncates.
    """
    edges = saved(
        occurrences.select("value", "class", "kind", F.explode(F.array(
            F.concat(F.lit("< "), "left"), F.concat(F.lit("> "), "right"))).alias("word"))
        .where(~F.col("word").isin("< ^", "> $"))  # the ends of a text are no words
        .groupBy("word", "class", "value").agg(F.min("kind").alias("kind")), "pii-edges")
    joined = None
    order = F.when(F.col("kind") == KINDS[0], 0)
    for i, k in enumerate(KINDS[1:], 1):
        order = order.when(F.col("kind") == k, i)
    for turn in range(max_rounds):
        known = edges if joined is None else edges.join(
            joined.withColumnRenamed("kind", "won"), ["value", "class"], "left").select(
            "word", "class", "value", F.coalesce("kind", "won").alias("kind"))
        patterns = (known.groupBy("word", "class")
                    .agg(F.count("*").alias("n"),
                         *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
                    .select("word", "class", "n", F.explode(F.array(*[
                        F.struct(F.lit(k).alias("kind"), F.col(k).alias("seeds")) for k in KINDS])).alias("s"))
                    .select("word", "class", F.col("s.kind").alias("kind"), F.col("s.seeds").alias("seeds"),
                            (F.col("s.seeds") / F.col("n")).alias("confidence"))
                    .where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence)))
        unseen = known.where("kind IS NULL").select("word", "class", "value")
        # noisy-or over the patterns that hold the value
        scored = (unseen.join(patterns, ["word", "class"]).groupBy("value", "class", "kind")
                  .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
                  .where(F.col("score") >= min_score).withColumn("place", order)
                  .groupBy("value", "class")
                  .agg(F.max_by("kind", F.struct(F.col("score"), (-F.col("place")).alias("place"))).alias("kind")))
        scored = saved(scored, f"pii-round{turn}")
        if scored.isEmpty():
            return scored if joined is None else joined
        joined = scored if joined is None else saved(joined.unionByName(scored), f"pii-joined{turn}")
    raise RuntimeError(f"contextual extraction did not settle in {max_rounds} rounds")


_DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def pii_spans(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, mark, base, added): base and added spans of every row; mark is xxhash64 of its text."""
    seen = saved(scan(docs), "pii-scan")
    occurrences = seen.where(F.size("found") > 0).select("doc_id", "mark", F.explode("found").alias("f")).select(
        "doc_id", "mark", "f.*")
    accepted = bootstrap(occurrences, **options)
    added = (occurrences.where("kind IS NULL").drop("kind").join(accepted, ["value", "class"])
             .groupBy("doc_id", "mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added")))
    return seen.select("doc_id", "mark", "base").join(
        added.withColumnRenamed("doc_id", "added_id").withColumnRenamed("mark", "added_mark"),
        F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("mark") == F.col("added_mark")), "left").select(
        "doc_id", "mark", "base", F.coalesce("added", F.expr("array()").cast("array<struct<kind:string,start:long,end:long>>")).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and all spans as text."""
    place = {k: i for i, k in enumerate(KINDS)}

    def judge(batch):
        counts, hashes, spans = [[] for _ in KINDS], [], []
        for base, added in zip(batch["base"].to_pylist(), batch["added"].to_pylist()):
            base = [(s["kind"], s["start"], s["end"]) for s in base]
            every = sorted(base + [(s["kind"], s["start"], s["end"]) for s in added], key=lambda s: (place[s[0]], s[1]))
            for column, kind in zip(counts, KINDS):
                column.append(sum(k == kind for k, _, _ in base))
            hashes.append(hashlib.sha256(span_text(base).encode()).hexdigest())
            spans.append(span_text(every))
        return batch["doc_id"], *counts, hashes, spans

    return map_rows(found.select("doc_id", "base", "added"), _DIGEST, judge)


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[KIND]``; rows without a span stay as they are."""
    added = pii_spans(docs, **options).where(F.size("added") > 0).select(
        F.col("doc_id").alias("added_id_"), F.col("mark").alias("added_mark_"),
        F.array_join(F.transform("added", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("added_")
    ).distinct()

    @F.pandas_udf("string")
    def masked(texts: pd.Series, extra: pd.Series) -> pd.Series:
        return pd.Series([mask(t, x) for t, x in zip(texts, extra)], dtype=object)

    joined = docs.join(added, F.col("doc_id").eqNullSafe(F.col("added_id_"))
                       & (F.xxhash64("text") == F.col("added_mark_")), "left")
    return joined.withColumn("text", masked("text", "added_")).select(*docs.columns)


def mask(text: str | None, extra: str | None) -> str | None:
    """Replace base and extra spans; overlapping ones become one mark of the first one's kind."""
    spans = base_spans(text)
    if extra:
        spans += [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in extra.split(","))]
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
