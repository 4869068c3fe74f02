"""Roll-ups without the closure, the layer store, names of any script, declared rules, order amounts and budgets."""

import datetime as dt
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from kontor.operators import hierarchy as H
from kontor.operators import inventory as I
from kontor.operators import search as SE
from kontor.session import stored
from kontor.sources import fixture as FX

SF = "/root/testdata/sf0.001"
ORDER = ["move_date", "id"]


def test_a_chain_of_many_nodes_rolls_up(spark):
    n = 100_000
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    values = spark.range(n).where("id % 10 = 9").select("id", F.lit(D("2")).alias("v"))
    got = H.tree_rollup(nodes, values, "id", ["v"])
    assert got.count() == n and got.where("v <> 2 * (cast((99999 - id) div 10 AS int) + 1)").count() == 0


def test_rollup_equals_the_closure(spark):
    rng = random.Random(2)
    parents = [(i, rng.choice([None, rng.randrange(i)]) if i else None) for i in range(300)]
    parents += [(301, 302), (302, 301), (303, 302), (304, 304), (305, 999)]  # cycles, a node below one, a lost parent
    nodes = spark.createDataFrame(parents, "id INT, parent_id INT")
    values = spark.createDataFrame([(rng.randrange(310), D(rng.randint(-50, 50)), D(1)) for _ in range(200)]
                                   + [(301, D(7), D(1)), (303, D(8), D(1))], "node INT, a DECIMAL(20,4), b DECIMAL(20,4)")
    closed = (H.tree_closure(nodes).join(values, F.col("descendant_id") == F.col("node"))
              .groupBy(F.col("ancestor_id").alias("id")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    assert sorted(map(tuple, H.tree_rollup(nodes, values, "node", ["a", "b"]).collect())) == sorted(map(tuple, closed.collect()))
    assert H.tree_rollup(nodes.limit(0), values, "node", ["a"]).count() == 0


def test_layers_carried_from_run_to_run_equal_the_full_fifo(spark):
    moves = FX.ledger(spark, SF).stock_moves
    alloc, layers = I.fifo_layers_and_cogs(moves, ORDER)
    rng = random.Random(4)
    days = sorted(r[0] for r in moves.select("move_date").distinct().collect())
    cuts = sorted(rng.sample(days, 4))
    active, parts = I.empty_layers(spark), []
    for lo, hi in zip([dt.date(1900, 1, 1), *cuts], [*cuts, dt.date(2900, 1, 1)]):
        got, active = I.consume_layers(active, moves.where(F.col("move_date").between(lo, hi) & (F.col("move_date") < hi)), ORDER)
        parts, active = parts + got.collect(), stored(active, "active")
    assert sorted(map(str, parts)) == sorted(map(str, alloc.collect()))
    want = sorted(map(tuple, layers.where("remaining_qty > 0").collect()))
    assert want and sorted(map(tuple, active.select(*layers.columns).collect())) == want


def test_names_of_any_script(spark):
    names = ["Müller & Söhne", "M. Ller", "MÜLLER AG", "株式会社東京商事", "東京", "京都商会", "Ελλάς Α.Ε.", "ООО Ромашка 7",
             "Zürich-東京 Bank", "", None, "the of"]
    contacts = spark.createDataFrame(list(enumerate(names)), "id INT, name STRING")

    def found(query):
        return sorted(r["id"] for r in SE.search_contacts(contacts, query).collect())

    assert found("müller") == [0, 2]
    assert found("ller") == [1] and found("m ller") == [1]
    assert found("東京") == [3, 4, 8] and found("京") == [3, 4, 5, 8] and found("商事") == [3]
    assert found("東京 bank") == [8]
    assert found("ελλάς") == [6] and found("ромашка") == [7]
    assert found("nothing") == [] and found("the") == [] and found("") == []
    index = stored(SE.name_tokens(contacts).sortWithinPartitions("token"), "postings")
    assert SE.search_contacts(contacts, "東京 bank", index).count() == 1


def test_key_audit_of_dense_sparse_and_null_keys(spark):
    from kontor.operators import audit as AU

    schema = "id INT, company_id INT, code STRING, name STRING"
    dense = [(i, 1, f"c{i}", "x") for i in range(500)]
    sparse = [(i * i * 4001, 1, f"c{i}", "x") for i in range(500)]
    for rows in (dense, sparse):
        extra = [(rows[7][0], 1, "other", "x"), (rows[9][0] + 1, 1, "c9", "x"), (rows[3][0], 2, None, "x")]
        tables = {"cost_centers": spark.createDataFrame(rows + extra, schema)}
        got = {(r["rule_id"], r["row_key"], r["detail"]) for r in AU.key_findings(tables, ["cost_centers"]).collect()}
        want = {("pk_duplicate", str(rows[7][0]), "rows=2"), ("pk_duplicate", str(rows[3][0]), "rows=2"),
                ("unique_company_id_code", "1|c9", "rows=2")}
        if (rows[9][0] + 1) in {r[0] for r in rows}:
            want.add(("pk_duplicate", str(rows[9][0] + 1), "rows=2"))
        assert got == want
    nulls = {"cost_centers": spark.createDataFrame([(None, 1, "a", "x"), (None, 1, "b", "x"), (3, None, "a", "x")], schema)}
    got = {(r["rule_id"], r["row_key"], r["detail"]) for r in AU.key_findings(nulls, ["cost_centers"]).collect()}
    assert got == {("pk_duplicate", "NULL", "rows=2"), ("pk_null", "id", "rows=2")}
    assert AU.key_findings({"cost_centers": nulls["cost_centers"].limit(0)}, ["cost_centers"]).count() == 0


def test_declared_rules_name_declared_columns():
    from kontor.sources import schemas as S

    names = {t: [c.name for c in cols] for t, cols in S.COLUMNS.items()}
    assert len(names) == 33 and all(len(set(c)) == len(c) for c in names.values())
    assert len(S.FOREIGN_KEYS) == len(set(S.FOREIGN_KEYS)) == 111
    assert all(c in names[t] and p in names[parent] for t, c, parent, p in S.FOREIGN_KEYS)
    assert all(set(u) <= set(names[t]) for t, keys in S.UNIQUE_KEYS.items() for u in keys)
    assert ("companies", "country", 2) in S.LENGTH_LIMITS and ("products", "sku", 100) in S.LENGTH_LIMITS
    assert "created_at" in S.NOT_NULL["currencies"] and "id" not in S.NOT_NULL["currencies"]
    assert "due_date" not in S.NOT_NULL["invoices"]


def test_row_rules_of_wide_and_of_keyless_rows(spark):
    """Every broken rule of a row is a finding of its own; a table without its id is named by a unique key."""
    from kontor.operators import audit as AU

    companies = spark.createDataFrame(
        [(1, "a", "USD", "DEU", None), (2, None, "EURO", None, None), (3, "c", "USD", "DE", None)],
        "id INT, name STRING, base_currency STRING, country STRING, extra STRING")
    stock = spark.createDataFrame([(7, 1, None, 0.0), (8, 1, 5.0, None)],
                                  "product_id BIGINT, location_id INT, quantity DOUBLE, reserved_qty DOUBLE")
    got = {(r["rule_id"], r["row_key"], r["detail"])
           for r in AU.audit({"companies": companies, "stock_quantities": stock}).collect()}
    assert got == {("length_country", "1", "length=3"), ("not_null_name", "2", "name"),
                   ("length_base_currency", "2", "length=4"), ("not_null_quantity", "7|1", "quantity"),
                   ("not_null_reserved_qty", "8|1", "reserved_qty")}


def test_order_amounts_over_several_documents(spark):
    from kontor.operators import orders as O

    po = spark.createDataFrame([(1, 9, dt.date(2024, 1, 1), D(100), D(0)), (2, 9, dt.date(2024, 1, 5), D(50), D(7)),
                                (3, 8, dt.date(2024, 1, 5), D(0), D(0))],
                               "id LONG, vendor_id LONG, order_date DATE, total_amount DECIMAL(20,4), amount_billed DECIMAL(20,4)")
    lines = spark.createDataFrame([(11, 1, 5, D(10)), (21, 2, 5, D(5)), (31, 3, 5, D(1))],
                                  "id LONG, po_id LONG, product_id LONG, quantity DECIMAL(20,6)")
    bills = spark.createDataFrame([(100, "purchase", "sent", 9, dt.date(2024, 2, 1)), (101, "purchase", "paid", 9, dt.date(2024, 2, 2)),
                                   (102, "purchase", "draft", 9, dt.date(2024, 2, 3)), (103, "sale", "paid", 9, dt.date(2024, 2, 3))],
                                  "id LONG, type STRING, status STRING, contact_id LONG, invoice_date DATE")
    rows = [(1000, 100, 5, D(8), D("10.0000"), D(0)), (1001, 101, 5, D(4), D("9.3333"), D(50)),
            (1002, 102, 5, D(99), D(1), D(0)), (1003, 103, 5, D(99), D(1), D(0)), (1004, 101, 6, D(3), D(1), D(0))]
    bl = spark.createDataFrame(rows, "id LONG, invoice_id LONG, product_id LONG, quantity DECIMAL(20,6), "
                                     "unit_price DECIMAL(20,4), discount_pct DECIMAL(6,4)")
    for range_rows in (None, 2):
        got = {r["id"]: (r["quantity"], r["amount_billed"], r["stored_amount"], r["billed_pct"], r["to_come"])
               for r in O.purchase_order_amounts(lines, po, bl, bills, range_rows).collect()}
        # 8 at 10 and 2 at half of 9.3333; then 2 more of the second bill; the third order has no bill and no total
        assert got == {1: (D(10), D("89.3333"), D(0), D("89.33"), D("10.6667")),
                       2: (D(2), D("9.3333"), D(7), D("18.67"), D("40.6667")),
                       3: (D(0), D(0), D(0), D(0), D(0))}


def test_project_budget_states(spark):
    from kontor.operators import reports as R

    projects = spark.createDataFrame([(i, 1, f"P{i}", b) for i, b in
                                      enumerate([D(100), D(100), D(100), None, D(0), D(100)])],
                                     "id INT, company_id INT, code STRING, budget DECIMAL(20,4)")
    accounts = spark.createDataFrame([(1, "expense"), (2, "revenue"), (3, "asset")], "id INT, category STRING")
    entries = spark.createDataFrame([(1, "posted"), (2, "draft")], "id LONG, status STRING")
    lines = [(1, 1, 0, 89, 0), (2, 1, 0, 500, 0), (1, 3, 0, 500, 0), (1, 1, 1, 95, 5), (1, 1, 2, 101, 0),
             (1, 2, 2, 0, 30), (1, 1, 3, 5, 0), (1, 1, 4, 1, 0), (1, 1, None, 77, 0)]
    ln = spark.createDataFrame([(e, a, p, D(d), D(c)) for e, a, p, d, c in lines],
                               "journal_entry_id LONG, account_id INT, project_id INT, debit_base DECIMAL(20,4), "
                               "credit_base DECIMAL(20,4)")
    got = {r["id"]: (r["actual"], r["revenue"], r["remaining"], r["used_pct"], r["status"])
           for r in R.project_budget(ln, accounts, entries, projects).collect()}
    assert got == {0: (D(89), D(0), D(11), D(89), "within"), 1: (D(90), D(0), D(10), D(90), "near"),
                   2: (D(101), D(30), D(-1), D(101), "over"), 3: (D(5), D(0), None, None, "no_budget"),
                   4: (D(1), D(0), D(-1), D(0), "over"), 5: (D(0), D(0), D(100), D(0), "within")}
