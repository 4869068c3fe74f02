"""Sinks, view registration and scalar helpers."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from kontor.functions import money as M
from kontor.operators import reports as R
from kontor.sources import fixture as FX
from kontor.sources import readers as RD

from conftest import SF_SMALL


def test_update_by_key_stamps_changed_rows_only(spark):
    prod = spark.createDataFrame([(1, D("1.0000")), (2, D("2.0000"))], "id BIGINT, average_cost DECIMAL(20,4)")
    ch = spark.createDataFrame([(2, D("2.5000"))], "id BIGINT, average_cost DECIMAL(20,4)")
    out = {r["id"]: r for r in RD.update_by_key(prod, ch, "id", ["average_cost"], stamp=True).collect()}
    assert out[1]["average_cost"] == D("1.0000") and out[1]["updated_at"] is None
    assert out[2]["average_cost"] == D("2.5000") and out[2]["updated_at"] is not None


def test_upsert_accumulate_and_cascade(spark):
    state = spark.createDataFrame([(1, 1, D(5))], "p INT, l INT, quantity DECIMAL(20,6)")
    deltas = spark.createDataFrame([(1, 1, D(-2)), (1, 2, D(3)), (1, 2, D(1))], "p INT, l INT, quantity DECIMAL(20,6)")
    got = {(r["p"], r["l"]): r["quantity"] for r in RD.upsert_accumulate(state, deltas, ["p", "l"], "quantity").collect()}
    assert got == {(1, 1): 3, (1, 2): 4}
    lines = spark.createDataFrame([(1, 10), (2, 11)], "id INT, hdr INT")
    gone = spark.createDataFrame([(10,)], "id INT")
    assert [r["id"] for r in RD.cascade_delete(lines, gone, "hdr").collect()] == [2]


def test_required_fields_and_append(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, " ", "y"), (3, None, "z")], "id INT, code STRING, name STRING")
    ok, bad = RD.required_fields(df, ["code", "name"])
    assert [r["id"] for r in ok.collect()] == [1] and sorted(r["id"] for r in bad.collect()) == [2, 3]
    new = spark.createDataFrame([(4, "B", "w")], "id INT, code STRING, name STRING")
    assert [r["id"] for r in RD.append_rows(ok, new, newest_first=True).collect()] == [4, 1]


def test_conform_and_load_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "X", 2.5)], "id INT, code STRING, rate DOUBLE")
    c = RD.conform(df.withColumnRenamed("code", "name"), "currencies")
    assert c.schema["decimal_places"].dataType.simpleString() == "smallint"
    path = str(tmp_path)
    lg = FX.ledger(spark, SF_SMALL)
    lg.accounts.write.mode("overwrite").parquet(f"{path}/accounts")
    t = RD.load_table(spark, path, "accounts", partial=True)
    assert t.columns == lg.accounts.columns
    with pytest.raises(ValueError, match="created_at"):
        RD.load_table(spark, path, "accounts")
    lg.declared(["accounts"])["accounts"].write.parquet(f"{path}/full/accounts")
    assert RD.load_table(spark, f"{path}/full", "accounts").columns == [c for c, _ in RD.table_columns("accounts")]
    assert t.count() == lg.accounts.count()
    assert t.schema["opening_balance"].dataType.simpleString() == "decimal(20,4)"


def test_register_views(spark):
    lg = FX.ledger(spark, SF_SMALL)
    names = R.register_views(spark, lg, FX.AS_OF)
    assert "v_trial_balance" in names
    assert spark.sql("SELECT COUNT(*) FROM v_trial_balance").first()[0] == lg.accounts.count()


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("12.5",), ("",), ("abc",), (None,)], "x STRING")
    assert [r[0] for r in df.select(M.parse_amount("x")).collect()] == [D("12.5"), 0, 0, 0]
    n = spark.createDataFrame([(2024, 7), (2024, 12345)], "y INT, n INT")
    assert [r[0] for r in n.select(M.doc_number("GJ", "y", "n", 4)).collect()] == ["GJ-2024-0007", "GJ-2024-12345"]
    q = spark.createDataFrame([(D("2.500000"), D("3.3333"))], "q DECIMAL(20,6), c DECIMAL(20,4)")
    assert q.select(M.qty_times_cost("q", "c")).first()[0] == D("8.3333")
    assert q.select(M.to_base("c", F.lit(D("1.5")))).first()[0] == D("5.0000")


def test_table_diff(spark):
    from kontor.operators.audit import table_diff
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id INT, v STRING")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "v_id INT, v STRING").withColumnRenamed("v_id", "id")
    got = sorted((r["id"], r["side"]) for r in table_diff(a, b).collect())
    assert got == [(1, "expected_only"), (2, "expected_only"), (3, "actual_only")]


def test_audit_precision_and_checks_on_raw_types(spark):
    """A table loaded with money as DOUBLE: values that do not fit DECIMAL(20,4) are reported."""
    from kontor.operators.audit import audit
    pay = spark.createDataFrame([(1, 1, "P1", "inbound", 10.5), (2, 1, "P2", "inbound", 1e17), (3, 1, "P3", "inbound", -1.0)],
                                "id BIGINT, company_id INT, payment_number STRING, direction STRING, amount DOUBLE")
    found = {(r["rule_id"], r["row_key"]) for r in audit({"payments": pay}, ["payments"]).collect()}
    assert ("precision_amount", "2") in found          # 1e17 needs 18 integer digits
    assert ("payment_positive", "3") in found          # CHECK amount > 0
    assert not any(k == "1" for _, k in found)


def test_bucketed_tables_join_without_shuffle(spark):
    lg = FX.ledger(spark, SF_SMALL)
    RD.write_bucketed(lg.journal_entries.select("id", "status"), "kontor_test_entries", "id", 8)
    RD.write_bucketed(lg.journal_entry_lines.select("id", "journal_entry_id", "debit_base")
                      .withColumnRenamed("id", "line_id"), "kontor_test_lines", "journal_entry_id", 8)
    e = spark.table("kontor_test_entries")
    ln = spark.table("kontor_test_lines")
    j = ln.join(e, ln["journal_entry_id"] == e["id"]).groupBy("status").agg(F.sum("debit_base"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the sort-merge path
    try:
        plan = j._jdf.queryExecution().executedPlan().toString()
        join_part = plan[plan.index("SortMergeJoin"):]
        assert "Exchange hashpartitioning(journal_entry_id" not in join_part
        assert "Exchange hashpartitioning(id" not in join_part
        assert j.count() == 3   # draft, posted, voided
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS kontor_test_entries")
        spark.sql("DROP TABLE IF EXISTS kontor_test_lines")


def test_command_line(spark, capsys, tmp_path):
    from kontor.__main__ import main
    assert main(["list"]) == 0
    assert "trial_balance (oracle)" in capsys.readouterr().out
    assert main(["run", "no_such_query"]) == 2
    out = str(tmp_path / "tb")
    assert main(["run", "trial_balance", "--sf-dir", SF_SMALL, "--out", out, "--master", "local[2]"]) == 0
    assert spark.read.parquet(out).count() == 45
