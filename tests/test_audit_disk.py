"""What the audit shuffles and writes."""

from kontor.operators import audit as A
from kontor.sources import fixture as FX

SF = "/root/testdata/sf0.001"


def test_row_wise_tables_are_mapped_in_scans(spark):
    """a table whose rows come one by one from another written table is not written again."""
    from pyspark.sql import functions as F
    lg = FX.ledger(spark, SF)
    t = lg.materialize(["sales_order_lines", "payment_allocations", "stock_quantities", "invoice_lines"])
    files = {n: {r["f"].split("/")[-2] for r in df.select(F.input_file_name().alias("f")).distinct().collect()} for n, df in t.items()}
    assert files == {"sales_order_lines": {"line_src"}, "payment_allocations": {"order_head"},
                     "stock_quantities": {"stock_quantities"}, "invoice_lines": {"invoice_lines"}}
    plain = FX.ledger(spark, SF)
    for n, df in t.items():
        assert df.exceptAll(plain[n]).isEmpty() and plain[n].exceptAll(df).isEmpty()


def test_hashes_travel_in_packs(spark, monkeypatch):
    """one row a pack and task is shuffled, not one a key; hashes of few bits only make more suspects."""
    rows = spark.range(0, 5000, 1, 4).selectExpr("CAST(id AS INT) AS id", "1 AS company_id", "IF(id % 1000 = 7, 'twice', concat('c', id)) AS code")
    rows = rows.unionByName(rows.where("id = 3")).unionByName(rows.where("id = 5").selectExpr("id", "company_id", "CAST(NULL AS STRING) AS code"))
    plans, stored = [], A.stored
    monkeypatch.setattr(A, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    want = {("pk_duplicate", "3", "rows=2"), ("pk_duplicate", "5", "rows=2"), ("unique_company_id_code", "1|c3", "rows=2"),
            ("unique_company_id_code", "1|twice", "rows=5")}
    for packs in (A.PACKS, 1):
        monkeypatch.setattr(A, "PACKS", packs)
        got = [(r["rule_id"], r["row_key"], r["detail"]) for r in A.key_findings({"cost_centers": rows}, ["cost_centers"]).collect()]
        assert len(got) == len(want) and set(got) == want
    assert len(plans) == 2 and all("collect_list" in p for p in plans)


def test_manual_entries_are_written_for_their_rule(spark, monkeypatch):
    """lines are not shuffled to meet the few manual entries."""
    names, stored = [], A.stored
    monkeypatch.setattr(A, "stored", lambda df, name: names.append(name) or stored(df, name))
    lines = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 10, 6), (4, 12, 5)], "id BIGINT, journal_entry_id BIGINT, account_id INT")
    lines = lines.selectExpr("*", "CAST(0 AS DECIMAL(20,4)) AS debit_amount", "CAST(0 AS DECIMAL(20,4)) AS credit_amount")
    tables = {"journal_entry_lines": lines,
              "accounts": spark.createDataFrame([(5, True, "asset", "debit"), (6, False, "asset", "debit")],
                                                "id INT, is_control BOOLEAN, category STRING, normal_balance STRING"),
              "journal_entries": spark.createDataFrame([(10, "manual"), (11, "invoice"), (12, None), (10, "manual")], "id BIGINT, source_type STRING")}
    found = A.audit(tables).where("rule_id = 'no_manual_posting_to_control'").collect()
    assert [(r["row_key"], r["detail"]) for r in found] == [("1", "5")]
    assert "manual_entries" in names
