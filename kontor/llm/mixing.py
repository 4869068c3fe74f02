"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed to cells (source, language, topic) of token counts. Each
sweep rakes the cells to the source, language and topic marginals in turn;
sweeps end when every marginal is within ``tolerance`` of its target. Between
sweeps the log weights are extrapolated from the last few sweeps (Anderson's
mixing; the blend stays a product of level factors, so the raked table is the
same), and a blend that lowers the dual objective is taken back. A cell's
raked weight over its tokens is its sampling rate; divided by the largest rate
it is a probability, so the expected tokens of the sample are in the exact
proportions of the raked table. A document is kept if its uniform number, from
the md5 of its id, is below its cell's probability.

With ``share`` the sample has a stated size instead: it expects that share of
the tokens of all cells with a rate. Rates are scaled to it, cells that reach
probability 1 stay whole, and the others keep the proportions of the raked
table among themselves.

Targets default to tempered shares: a level's share of the tokens to the power
``alpha``, renormalised, which lowers crowded levels and raises rare ones.

Defined results
---------------
* null source, language or text: a level of its own (``null``); null text has
  no token and the topic ``prose``.
* a document without tokens has weight 0 in every marginal; it takes its
  cell's probability, or the smallest one where the whole cell has no token.
* levels without tokens are left out of the targets, the rest is renormalised.
* repeated rows share an id and so a uniform number: all stay or all go.
* empty table: empty result. Further columns are not read.
* targets that no weights of the present cells can meet: a sweep proves it when
  its gain, the targets' sum of its log factors, is above its largest move of a
  cell's log weight. Plain sweeps then go on until the shares settle, a warning
  names the gap, and the topic marginal, raked last, is exact.
* neither within ``max_sweeps``: an error, never a silent partial fit.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import saved

MARGINS = {"source": 0.5, "lang": 0.7, "topic": 1.0}  # margin: alpha of its default targets
TOLERANCE = 1e-9
MAX_SWEEPS = 40  # sweeps written out in the SQL
GUARD = 5000  # sweeps after which the fit raises
DEPTH = 6  # sweeps an extrapolation looks back on
NOISE = 1e-10  # fall of the dual objective that rounding explains
SETTLED = 1e-6  # summed change of the shares in a sweep towards targets that cannot be met
SPACE = r"[ \t\n\x0B\f\r]+"


def topic_of(text):
    """A coarse form of the text, by fixed rules, first that holds."""
    return (F.when(F.instr(text, "@") > 0, "contact")
            .when(F.instr(text, " | ") > 0, "table")
            .when(F.instr(text, "License") > 0, "licensed")
            .when(F.length(text) > 4000, "long")
            .otherwise("prose"))


def tokens_of(text):
    """Number of words that white space sets apart."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    bare = F.trim(bare)
    return F.when(bare == "", F.lit(0)).otherwise(
        F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def uniform(doc_id):
    """A number in [0, 1) from the md5 of the id."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def level(column):
    """Levels as text; null is a level of its own, apart from any value."""
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(column)))


def tempered(cells: DataFrame, margin: str, alpha: float) -> DataFrame:
    """Default targets of one margin: (level, target), shares to the power ``alpha``."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    powers = sums.select(margin, F.pow(F.col("tokens").cast("double"), F.lit(alpha)).alias("power"))
    total = powers.agg(F.sum("power")).first()[0] or 1.0
    return powers.select(margin, (F.col("power") / F.lit(total)).alias("target"))


def swept(cells: DataFrame, margins: list, start) -> DataFrame:
    """One sweep from the log weights ``start``: its result and its move lead the arrays ``ends`` and ``moves``."""
    frame = (cells.withColumn("start", start).withColumn("end", F.col("start"))
             .drop(*[f"sum_{m}" for m in margins]))
    for m in margins:
        sums = frame.groupBy(m).agg(F.sum(F.exp("end")).alias(f"sum_{m}"))
        frame = frame.join(sums, m).withColumn("end", F.col("end") + F.log(f"target_{m}") - F.coalesce(
            F.log(f"sum_{m}"), F.lit(float("-inf"))))
    newest = lambda column, old: F.slice(F.concat(F.array(column), old), 1, DEPTH).alias(old)
    return frame.select(*margins, "tokens", *[f"target_{m}" for m in margins], *[f"sum_{m}" for m in margins],
                        newest(F.col("end"), "ends"), newest(F.col("end") - F.col("start"), "moves"),
                        F.abs(F.exp("end") - F.exp("start")).alias("change"))


def judged(frame: DataFrame, margins: list) -> tuple:
    """(largest relative gap of a marginal, gain of the dual objective) of a sweep."""
    levels = reduce(DataFrame.unionByName, [frame.groupBy(m).agg(
        F.sum(F.exp(F.col("ends")[0])).alias("sum"), F.first(f"target_{m}").alias("target"),
        F.first(f"sum_{m}").alias("before")).select("sum", "target", "before") for m in margins])
    far = F.lit(float("inf"))
    return levels.agg(
        F.max(F.coalesce(F.abs(F.col("sum") / F.col("target") - 1), far)),
        F.sum(F.coalesce(F.col("target") * (F.log("target") - F.log("before")), far))).first()


def blend(frame: DataFrame, depth: int) -> tuple:
    """(largest and summed change of a cell, coefficients of the last ``depth`` sweeps that cancel most of their moves)."""
    pairs = [(i, j) for i in range(depth) for j in range(i, depth)]
    top, change, *sums = frame.agg(F.max(F.col("moves")[0]), F.sum("change"), *[
        F.sum(F.col("moves")[i] * F.col("moves")[j]) for i, j in pairs]).first()
    gram = np.zeros((depth, depth))
    for (i, j), x in zip(pairs, sums):
        gram[i, j] = gram[j, i] = x
    if depth == 1 or not np.isfinite(gram).all():
        return top, change, [1.0] + [0.0] * (depth - 1)
    left = gram[0, 0] - gram[0, 1:, None] - gram[None, 0, 1:] + gram[1:, 1:]
    older = np.linalg.lstsq(left, gram[0, 0] - gram[0, 1:], rcond=1e-14)[0]
    return top, change, [float(1 - older.sum()), *map(float, older)]


def rake(cells: DataFrame, targets: dict, tolerance: float = TOLERANCE, max_sweeps: int = GUARD) -> DataFrame:
    """``cells`` (margins, tokens) with ``weight``: raked shares that sum to 1."""
    margins = list(targets)
    full = cells.where("tokens > 0")
    live = full
    for m in margins:  # cells of a level without target have weight 0
        live = live.join(targets[m].where("target > 0").select(m, F.col("target").alias(f"target_{m}")), m)
    live = saved(live, "cells")
    total = live.agg(F.sum("tokens")).first()[0]
    if total is None:
        return full.withColumn("weight", F.lit(0.0))
    for m in margins:  # targets only for levels with tokens, summing to 1
        present = live.select(m, f"target_{m}").distinct().agg(F.sum(f"target_{m}")).first()[0]
        live = live.withColumn(f"target_{m}", F.col(f"target_{m}") / F.lit(present))
    none = F.array().cast("array<double>")
    state, start = live.withColumns({"ends": none, "moves": none}), F.log(F.col("tokens") / F.lit(float(total)))
    last, duals, dual, proved = None, [], 0.0, False
    for _ in range(max_sweeps):
        frame = saved(swept(state, margins, start), "raked")
        gap, gain = judged(frame, margins)
        if duals and not dual + gain >= duals[0] - NOISE:  # the extrapolation went too far: back to the last sweep
            state = last.withColumn("kept", F.col("ends")[0]).withColumns({"ends": none, "moves": none})
            start, dual, duals = F.col("kept"), duals[0], []
            continue
        duals = [dual + gain, *duals][:DEPTH]
        top, change, share = blend(frame, len(duals))
        if gap <= tolerance or proved and change <= SETTLED:
            break
        # for weights p that meet the targets, gain = sum(p * move) <= top
        proved = proved or gain - top > 1e-12
        if proved:
            share = [1.0] + [0.0] * (len(duals) - 1)
        last = state = frame
        start = reduce(lambda a, b: a + b, [F.col("ends")[i] * F.lit(c) for i, c in enumerate(share)])
        dual = sum(c * d for c, d in zip(share, duals))
    else:
        raise RuntimeError(f"marginals still differ by {gap} after {max_sweeps} sweeps")
    if gap > tolerance:
        warnings.warn(f"no weights of the present cells meet the targets: marginals differ by up to {gap:.3g}", stacklevel=2)
    fitted = frame.select(*margins, F.exp(F.col("ends")[0]).alias("weight"))
    return full.join(fitted, margins, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) with levels as text."""
    return docs.select("doc_id", level("source").alias("source"), level("lang").alias("lang"),
                       topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("tokens"))


def scale(rated: DataFrame, share: float) -> float:
    """Factor of the rates at which a sample with probabilities of at most 1 expects ``share`` of the tokens.

    Cells that reach 1 stay there and the rest is solved again, until no
    further cell reaches 1; so a rare cell takes no share from the others.
    """
    rated = rated.where("rate > 0")
    total = rated.agg(F.sum("tokens")).first()[0]
    factor, full = 0.0, F.lit(False)
    while total is not None:
        capped, count, rest = rated.agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.count_if(full),
            F.sum(F.when(~full, F.col("tokens") * F.col("rate")))).first()
        if rest is None:  # every cell stays whole
            break
        factor = max(factor, (share * total - capped) / rest)
        full = F.col("rate") * F.lit(factor) >= 1
        if rated.agg(F.count_if(full)).first()[0] == count:
            break
    return factor


def probabilities(rows: DataFrame, targets: dict | None = None, share: float | None = None) -> DataFrame:
    """(source, lang, topic, probability) of every cell of ``measured`` rows."""
    cells = saved(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    targets = targets or {m: tempered(cells, m, a) for m, a in MARGINS.items()}
    raked = rake(cells, targets).select(*MARGINS, "tokens", (F.col("weight") / F.col("tokens")).alias("rate"))
    raked = raked if share is None else saved(raked, "rates")
    top, least = raked.agg(F.max("rate"), F.min("rate")).first()
    if share is not None and top:
        top = 1 / scale(raked, share)
    raked = raked.drop("tokens")
    rate = F.coalesce("rate", F.lit(least).cast("double"))
    return (cells.join(raked, list(MARGINS), "left")
            .select(*MARGINS, F.least(F.coalesce(rate / F.lit(top).cast("double"), F.lit(1.0)), F.lit(1.0)).alias("probability")))


def mix(docs: DataFrame, targets: dict | None = None, share: float | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) of every document."""
    rows = saved(measured(docs), "measured")
    return rows.join(probabilities(rows, targets, share), list(MARGINS)).select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"),
        (uniform("doc_id") < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, targets: dict | None = None, share: float | None = None) -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = saved(measured(docs), "measured").drop("doc_id")
    own = docs.columns
    found = probabilities(rows, targets, share).select(*[F.col(m).alias(f"mix_{m}_") for m in MARGINS], "probability")
    marked = docs.withColumns({"mix_source_": level("source"), "mix_lang_": level("lang"),
                               "mix_topic_": topic_of(F.col("text"))})
    joined = marked.join(found.withColumnRenamed("probability", "mix_p_"), [f"mix_{m}_" for m in MARGINS])
    return joined.where(uniform("doc_id") < F.col("mix_p_")).select(*own)


def oracle(sweeps: int = MAX_SWEEPS) -> str:
    """The same fit in SQL, with ``sweeps`` sweeps written out."""
    ctes = [f"""rows AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS lang,
         CASE WHEN strpos(text, '@') > 0 THEN 'contact' WHEN strpos(text, ' | ') > 0 THEN 'table'
              WHEN strpos(text, 'License') > 0 THEN 'licensed' WHEN length(text) > 4000 THEN 'long' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS tokens FROM documents)""",
            "cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL)"]
    for m, a in MARGINS.items():
        ctes.append(f"t_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, {a}) / sum(pow(sum(tokens)::DOUBLE, {a})) OVER () "
                    f"AS target FROM cells GROUP BY {m} HAVING sum(tokens) > 0)")
    ctes.append("w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS weight FROM cells WHERE tokens > 0)")
    last, n = "w0", 0
    for _ in range(sweeps):
        for m in MARGINS:
            n += 1
            ctes.append(f"w{n} AS MATERIALIZED (SELECT w.* REPLACE (weight * t.target / sum(weight) OVER (PARTITION BY w.{m}) "
                        f"AS weight) FROM {last} w JOIN t_{m} t USING ({m}))")
            last = f"w{n}"
    ctes.append(f"rates AS (SELECT source, lang, topic, weight / tokens AS rate FROM {last})")
    ctes.append("""probs AS (
  SELECT c.source, c.lang, c.topic,
         coalesce(coalesce(r.rate, (SELECT min(rate) FROM rates)) / (SELECT max(rate) FROM rates), 1.0) AS p
  FROM cells c LEFT JOIN rates r USING (source, lang, topic))""")
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability,
       (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < p AS kept
FROM rows JOIN probs USING (source, lang, topic)"""
