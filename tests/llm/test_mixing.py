import numpy as np
import pytest
from cases import docs, empty, odd_texts
from compare import compare, duck_connect
from pyspark.sql import functions as F

import corpus_pipeline as cp
from kontor.llm import mixing


def sample_docs(spark):
    rng = np.random.default_rng(0)
    texts, langs, sources = [], {}, {}
    for i in range(1500):
        texts.append(" ".join(["word"] * int(rng.integers(1, 80))) + rng.choice(["", " a@b.c", " | x", " License"]))
        langs[i] = [None, "en", "de"][rng.integers(0, 3)]
        sources[i] = "big" if rng.random() < 0.6 else f"s{rng.integers(0, 4)}"
    return docs(spark, texts, langs, sources)


def test_raked_table_meets_its_marginals(spark):
    rows = mixing.measured(sample_docs(spark))
    cells = rows.groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens"))
    targets = {m: mixing.tempered(cells, m, a) for m, a in mixing.MARGINS.items()}
    raked = mixing.rake(cells, targets).toPandas()
    assert raked["weight"].sum() == pytest.approx(1)
    for m, target in targets.items():
        want = {r[m]: r["target"] for r in target.collect()}
        assert raked.groupby(m)["weight"].sum().to_dict() == pytest.approx(want, rel=1e-8)


def bound_cells(spark, own, sources=3):
    """Cells of sources that hold ``own`` of their tokens in one language each."""
    rows = []
    for i in range(sources):
        for j in range(3):
            share = own if j == i % 3 else (1 - own) / 2
            rows += [(f"s{i}", f"l{j}", t, round(10_000_000 * (i + 1) ** 2 * share * part)) for t, part in (("a", 0.7), ("b", 0.3))]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


@pytest.mark.parametrize("own", [0.97, 0.999])
def test_sources_mostly_in_one_language_meet_their_marginals(spark, own):
    cells = bound_cells(spark, own)
    targets = {m: mixing.tempered(cells, m, a) for m, a in mixing.MARGINS.items()}
    raked = mixing.rake(cells, targets).toPandas()
    for m, target in targets.items():
        want = {r[m]: r["target"] for r in target.collect()}
        assert raked.groupby(m)["weight"].sum().to_dict() == pytest.approx(want, rel=2e-9)
    # still the start times one factor a level: the odds ratios are those of the tokens
    rate = (raked.assign(rate=raked["weight"] / raked["tokens"]).set_index(["source", "lang", "topic"])["rate"])
    for t in ("a", "b"):
        assert rate["s0", "l0", t] * rate["s1", "l1", t] == pytest.approx(rate["s0", "l1", t] * rate["s1", "l0", t], rel=1e-9)


def test_targets_that_cannot_be_met_are_named(spark):
    cells = bound_cells(spark, 1.0).where("tokens > 0")
    targets = {m: mixing.tempered(cells, m, a) for m, a in mixing.MARGINS.items()}
    with pytest.warns(UserWarning, match="no weights of the present cells"):
        raked = mixing.rake(cells, targets).toPandas()
    assert raked.groupby("topic")["weight"].sum().to_dict() == pytest.approx({"a": 0.7, "b": 0.3})
    with pytest.raises(RuntimeError, match="after 2 sweeps"):
        mixing.rake(bound_cells(spark, 0.97), targets, max_sweeps=2)


def test_expected_sample_is_in_proportion(spark):
    frame = mixing.mix(sample_docs(spark)).toPandas()
    assert frame["probability"].max() == 1.0
    expected = (frame["tokens"] * frame["probability"]).groupby(frame["source"]).sum()
    tokens = frame["tokens"].groupby(frame["source"]).sum() ** 0.5
    assert (expected / expected.sum()).to_dict() == pytest.approx((tokens / tokens.sum()).to_dict(), rel=1e-3)
    drawn = frame[frame["kept"]]["tokens"].sum()
    assert drawn == pytest.approx(expected.sum(), rel=0.1)


def test_a_tiny_source_does_not_shrink_the_others(spark):
    texts, sources = ["word " * 100] * 400 + ["one two three"], {i: f"s{i % 20}" for i in range(400)} | {400: "tiny"}
    frame = mixing.mix(docs(spark, texts, sources=sources), share=0.65).toPandas().set_index("doc_id")
    assert frame["probability"][400] == 1.0
    assert (frame["tokens"] * frame["probability"]).sum() == pytest.approx(0.65 * frame["tokens"].sum(), rel=1e-5)
    assert frame["probability"].drop(400).nunique() == 1
    staged = cp.mixture(spark, docs(spark, texts, sources=sources), None).count()
    assert staged == frame["kept"].sum() > 200
    whole = mixing.mix(docs(spark, texts, sources=sources), share=1.0)
    assert whole.where("probability < 1").count() == 0


def test_sample_keeps_rows_and_columns(spark):
    frame = sample_docs(spark)
    kept = {r["doc_id"] for r in mixing.mix(frame).where("kept").collect()}
    rows = mixing.sample(frame).collect()
    assert rows[0].asDict().keys() == set(frame.columns)
    assert {r["doc_id"] for r in rows} == kept


def test_given_targets_leave_out_absent_levels(spark):
    frame = docs(spark, ["a b", "c d e f", "g"], sources={0: "x", 1: "y", 2: None})
    target = lambda rows: spark.createDataFrame(rows, "level string, target double")
    got = mixing.mix(frame, {
        "source": target([("=x", 0.5), ("=y", 0.25), ("null", 0.25), ("=gone", 7.0)]).withColumnRenamed("level", "source"),
        "lang": target([("=en", 1.0)]).withColumnRenamed("level", "lang"),
        "topic": target([("prose", 1.0)]).withColumnRenamed("level", "topic")}).collect()
    assert {r["doc_id"]: r["probability"] for r in got} == {0: 1.0, 1: 0.25, 2: 1.0}


def test_odd_rows(spark):
    rows = mixing.mix(docs(spark, odd_texts(), {3: None}, {4: None})).collect()
    assert len(rows) == 11 and all(0 <= r["probability"] <= 1 for r in rows)
    assert [r["tokens"] for r in sorted(rows, key=lambda r: r["doc_id"])][:5] == [0, 0, 0, 1, 4]
    assert mixing.mix(empty(spark)).count() == 0


def test_query_matches_sql(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    assert compare(E.queries()["op10_mixing"](spark, sf), duck_connect(sf), E.oracle_sql()["op10_mixing"])["match"]
