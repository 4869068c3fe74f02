import pytest
from cases import docs, empty, odd_texts

import corpus_pipeline as cp
from kontor.llm import mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_sweeps(monkeypatch):
    """The raking has tests of its own; a few sweeps show that the stages fit together."""
    monkeypatch.setattr(mixing, "MAX_SWEEPS", 3)


def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "personal_data", "mixture", "packing"]
    frame = docs(spark, odd_texts() + ["plain words of one document here"] * 2, {3: None})
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, frame, SF).columns == cp.COLUMNS
        assert stage(spark, empty(spark), SF).count() == 0
    assert cp.STAGES[-1][1](spark, empty(spark), SF).count() == 0


def test_stage_decisions(spark):
    text = "the dog and the cat sat on a mat " * 4
    frame = docs(spark, [text, text + "x", None, "12 34", text + " mail a@b.co"])
    assert {r["doc_id"] for r in cp.language(spark, frame, SF).collect()} == {0, 1, 4}
    kept = {r["doc_id"] for r in cp.near_duplicates(spark, docs(spark, [text, text, "other words entirely", None]), SF).collect()}
    assert kept == {0, 2, 3}
    masked = {r["doc_id"]: r for r in cp.personal_data(spark, frame, SF).collect()}
    assert masked[4]["text"].endswith("mail [EMAIL]") and masked[4]["n_chars"] == len(masked[4]["text"])
    assert masked[0]["text"] == text


def test_texts_that_share_an_id_are_told_apart(spark):
    a, *rest = [" ".join(f"{w}{i * j}" for i in range(1, 60)) for j, w in enumerate(["tree", "stone", "cloud", "river"], 1)]
    rows = [(3, a), (7, a), (7, rest[0]), (9, rest[1]), (9, rest[2]), (9, rest[2])]
    frame = None
    for i, t in rows:
        one = docs(spark, [t], first=i)
        frame = one if frame is None else frame.unionByName(one)
    got = sorted((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, frame, SF).collect())
    assert got == sorted([(3, a), (7, rest[0]), (9, rest[1]), (9, rest[2])])


def test_run_equals_its_stages(spark):
    """run() is the stages one after another; each has a brute-force test of its own."""
    whole = cp.run(spark, SF).collect()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        frame = stage(spark, frame, SF)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, frame.collect()))


def test_registered():
    import __spark_entry__ as E

    names = [n for n in E.queries() if n.startswith("op") and n[2:].split("_")[0].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in E.queries()
