from cases import by_id, docs, empty, odd_texts

from kontor.llm import language_id as lid

EN = "the cat sat on the mat and the dog ran over the hill with this thing "
DE = "der hund und die katze sind nicht auf dem dach sondern unter einer decke "


def test_predicts_and_mixes(spark):
    texts = [EN * 5, DE * 5] * 8 + [EN * 4 + DE * 2, "the dog ran", "der hund und"]
    frame = docs(spark, texts, {i: "de" for i in range(1, 16, 2)} | {16: None, 17: None, 18: None})
    got = by_id(lid.language_id(frame))
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(16))
    assert {m["lang"] for m in got[16]["mixture"]} == {"en", "de"}
    assert 0.55 < got[16]["score"] < 0.8 and got[16]["lang_pred"] == "en"
    assert (got[17]["lang_pred"], got[18]["lang_pred"]) == ("en", "de")


def test_odd_rows(spark):
    frame = docs(spark, odd_texts() + [EN, DE], {12: "de", 0: None})
    got = by_id(lid.language_id(frame))
    assert len(got) == 13
    for i in (0, 1, 2):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["mixture"]) == ("und", 0.0, [])
    assert got[4]["lang_pred"] == got[5]["lang_pred"] and got[4]["score"] == got[5]["score"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_empty_and_unlabelled(spark):
    assert lid.language_id(empty(spark)).count() == 0
    got = by_id(lid.language_id(docs(spark, [EN, DE], {0: None, 1: None})))
    assert {r["lang_pred"] for r in got.values()} == {"und"}


def test_two_thousand_languages(spark):
    def words(i):
        letters = "".join(chr(97 + i // 26**k % 26) for k in range(3))
        return f"{letters}{letters[::-1]} q{letters} {letters[1:]}z " * 6

    texts = [words(i) for i in range(2000)]
    frame = docs(spark, texts + texts[:40], {i: f"l{i:04d}" for i in range(2000)} | {2000 + i: None for i in range(40)})
    langs, matrix = lid.learn(frame.where("lang IS NOT NULL"))
    assert len(langs) == 2000 and matrix.shape[0] == 1024
    got = by_id(lid.identify(frame.where("lang IS NULL").drop("lang"), (langs, matrix)))
    assert sum(got[2000 + i]["lang_pred"] == f"l{i:04d}" for i in range(40)) >= 36


def test_held_out_accuracy_on_documents(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = E.queries()["op1_language_id"](spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
