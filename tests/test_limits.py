"""Values at the declared limits, deep trees, repeated and inverted rows."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from kontor.functions import money as M
from kontor.operators import banking as B
from kontor.operators import fx as X
from kontor.operators import hierarchy as H
from kontor.operators import posting as P
from kontor.operators import reports as R
from kontor.operators import sequences as SQ

d = dt.date


def test_deep_chain_and_wide_tree(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)], "id INT, parent_id INT")
    pairs = H.tree_closure(chain)
    assert pairs.count() == 1275
    assert pairs.agg(F.max("depth")).first()[0] == 49
    wide = spark.range(40_000).select(F.col("id"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 3)).alias("parent_id"))
    leaf = H.tree_closure(wide).where("descendant_id = 39999").orderBy("depth").select("ancestor_id").collect()
    want, x = [], 39_999
    while True:
        want.append(x)
        if not x:
            break
        x = (x - 1) // 3
    assert [r[0] for r in leaf] == want


def test_cycles_are_reported_and_closed_off(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, None), (6, 5), (7, 7), (8, 99)],
                                  "id INT, parent_id INT")
    assert {r["id"] for r in H.tree_cycles(nodes).collect()} == {1, 2, 3, 4, 7}
    got = {(r["ancestor_id"], r["descendant_id"], r["depth"]) for r in H.tree_closure(nodes).collect()}
    assert got == {(i, i, 0) for i in range(1, 9)} | {(5, 6, 1)}


def test_products_over_the_full_declared_types(spark):
    f = spark.createDataFrame([
        (1, D("99999999999999.999999"), D("0.0100"), D("12.5000")), (2, D("100000000"), D("1000.0000"), D("0")),
        (3, D("-0.000005"), D("10.0000"), D("0")), (4, D("0.333333"), D("0.0001"), D("100")),
        (5, D("12345678.654321"), D("98765.4321"), D("99.9999"))],
        "id INT, quantity DECIMAL(20,6), unit_price DECIMAL(20,4), discount_pct DECIMAL(7,4)")
    rows = {r["id"]: r for r in R.line_amount(f).select("*", M.qty_times_cost("quantity", "unit_price").alias("c")).collect()}

    def half_up(x):
        return x.quantize(D("0.0001"), rounding="ROUND_HALF_UP")

    for r in rows.values():
        gross = r["quantity"] * r["unit_price"]
        assert r["c"] == half_up(gross)
        assert r["line_amount"] == half_up(gross * (100 - r["discount_pct"]) / 100)
    a = spark.createDataFrame([(D("100000000000000.0000"), D("1.23456789")), (D("-2.5"), D("0.00003"))],
                              "a DECIMAL(20,4), r DECIMAL(20,8)")
    assert [x[0] for x in a.select(M.to_base("a", "r")).collect()] == [D("123456789000000.0000"), D("-0.0001")]


def test_flat_totals_round_once(spark):
    lines = spark.createDataFrame([(1, D("0.333333"), D("0.0001"))] * 3,
                                  "invoice_id INT, quantity DECIMAL(20,6), unit_price DECIMAL(20,4)")
    assert R.invoice_totals(lines, tax_mode="flat").first()["subtotal"] == D("0.0001")


def test_equal_bank_rows_are_all_matched(spark):
    tx = spark.createDataFrame([(i, 1, d(2024, 5, 1 + i // 2), D("5"), None) for i in range(4)] + [(9, 1, d(2024, 5, 9), D("5"), None)],
                               "id INT, bank_account_id INT, transaction_date DATE, amount DECIMAL(20,4), payment_id INT")
    pay = spark.createDataFrame([(i, 1, "inbound", D("5"), d(2024, 5, 3)) for i in (11, 12, 13, 14)],
                                "id INT, bank_account_id INT, direction STRING, amount DECIMAL(20,4), payment_date DATE")
    got = {r["id"]: r["matched_payment_id"] for r in B.bank_match(tx, pay, 3).collect()}
    assert got == {2: 11, 3: 12, 0: 13, 1: 14, 9: None}


def test_repeated_rates_and_odd_periods(spark):
    rates = spark.createDataFrame([("A", "B", D("1.1"), d(2024, 1, 1)), ("A", "B", D("1.1"), d(2024, 1, 1)),
                                   ("A", "B", D("1.2"), d(2024, 2, 1))],
                                  "from_currency STRING, to_currency STRING, rate DECIMAL(20,8), effective_date DATE")
    facts = spark.createDataFrame([(1, "A", "B", d(2024, 1, 20)), (2, "A", "B", d(2024, 2, 1))], "id INT, f STRING, t STRING, day DATE")
    assert {r["id"]: r["rate"] for r in X.asof_rate(facts, rates, "day", "f", "t").collect()} == {1: D("1.1"), 2: D("1.2")}
    periods = spark.createDataFrame([(1, 7, d(2024, 1, 1), d(2024, 1, 31)), (1, 8, d(2024, 1, 15), d(2024, 2, 29)),
                                     (1, 9, d(2024, 3, 31), d(2024, 3, 1))],
                                    "company_id INT, id INT, start_date DATE, end_date DATE")
    days = spark.createDataFrame([(1, d(2024, 1, 20)), (1, d(2024, 2, 3)), (1, d(2024, 3, 15))], "company_id INT, day DATE")
    got = X.period_for_date(days, periods, "day").orderBy("day").collect()
    assert [r["derived_period_id"] for r in got] == [7, 8, None]


def test_journal_of_a_long_invoice_and_two_control_accounts(spark):
    inv = spark.createDataFrame([(1, 1, "sale", 5, d(2024, 1, 1), D("1")), (2, 1, "credit_note_sale", 5, d(2024, 1, 2), D("1"))],
                                "id BIGINT, company_id INT, type STRING, contact_id INT, invoice_date DATE, exchange_rate DECIMAL(20,8)")
    lines = spark.range(20_000).select(
        "id", F.when(F.col("id") < 19_999, 1).otherwise(2).cast("bigint").alias("invoice_id"),
        (F.col("id") + 1).cast("int").alias("line_number"), F.lit(40).alias("account_id"),
        F.lit(D("2")).cast("DECIMAL(20,4)").alias("line_amount"), F.lit(D("0.2")).cast("DECIMAL(20,4)").alias("tax_amount"),
        F.lit(3).alias("tax_code_id"))
    accounts = spark.createDataFrame([(10, 1, "asset", True), (11, 1, "asset", True), (20, 1, "liability", True)],
                                     "id INT, company_id INT, category STRING, is_control BOOLEAN")
    contacts = spark.createDataFrame([(5, None, None)], "id INT, ar_account_id INT, ap_account_id INT")
    taxes = spark.createDataFrame([(3, 30)], "id INT, account_id INT")
    _, out = P.invoice_to_journal(inv, lines, accounts, contacts, taxes, 10**9)
    assert out.count() == out.select("id").distinct().count() == 40_002
    sums = {r[0]: (r[1], r[2]) for r in out.groupBy("journal_entry_id").agg(F.sum("debit_amount"), F.sum("credit_amount")).collect()}
    assert all(a == b for a, b in sums.values())
    control = {r["journal_entry_id"] - 10**9: r for r in out.where("line_number = 0").collect()}
    assert control[1]["account_id"] == control[2]["account_id"] == 10
    assert control[1]["debit_amount"] > 0 and control[2]["credit_amount"] == D("2.2")


def test_null_keys_are_ranked(spark):
    f = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, "a", 3)], "id INT, k STRING, o INT")
    got = {r["id"]: (r["dup_rank"], r["dup_count"]) for r in SQ.duplicate_rank(f, ["k"], ["o", "id"]).collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (1, 1)}


def test_fifo_per_location_over_all_move_types(spark):
    """Opening stock, a transfer and an adjustment make layers; each location consumes its own."""
    from kontor.operators import inventory as I

    rows = [(1, "opening", None, 1, D(10), D(2)), (2, "transfer", 1, 2, D(4), D(3)), (3, "sale_delivery", 1, None, D(5), None),
            (4, "adjustment", None, 2, D(1), D(7)), (5, "scrap", 2, None, D(6), None), (6, "transfer", 2, 2, D(9), D(1))]
    moves = spark.createDataFrame([(i, 8, t, d(2024, 1, i), q, c, a, b, True) for i, t, a, b, q, c in rows],
                                  "id BIGINT, product_id BIGINT, move_type STRING, move_date DATE, quantity DECIMAL(20,6), "
                                  "unit_cost DECIMAL(20,4), from_location_id INT, to_location_id INT, is_posted BOOLEAN")
    for options in ({}, {"range_rows": 2}):
        cogs, layers = I.fifo_by_location(moves, ["move_date", "id"], **options)
        got = {(r["location_id"], r["issue_id"]): (r["costed_qty"], r["shortfall_qty"], r["cogs"]) for r in cogs.collect()}
        assert got == {(1, 2): (D(4), None, D(8)), (1, 3): (D(5), None, D(10)), (2, 5): (D(5), D(1), D(19))}
        left = {(r["location_id"], r["id"]): r["remaining_qty"] for r in layers.collect()}
        assert left == {(1, 1): D(1), (2, 2): D(0), (2, 4): D(0)}


def test_audit_of_stock_and_of_odd_keys(spark):
    from kontor.operators import audit as AU

    moves = spark.createDataFrame([(1, 7, None, 1, D(5), True), (2, 7, 1, 2, D(2), True), (3, 7, None, 2, D(9), False)],
                                  "id BIGINT, product_id BIGINT, from_location_id INT, to_location_id INT, quantity DECIMAL(20,6), is_posted BOOLEAN")
    stock = spark.createDataFrame([(7, 1, D(3)), (7, 2, D(4))], "product_id BIGINT, location_id INT, quantity DECIMAL(20,6)")
    found = [r for r in AU.audit({"stock_quantities": stock, "stock_moves": moves}).collect()
             if r["rule_id"] == "stock_equals_posted_moves"]
    assert [(r["row_key"], r["detail"]) for r in found] == [("7|2", "difference=2.000000")]
    keys = spark.createDataFrame([("A|B", "C"), ("A", "B|C")], "a STRING, b STRING").selectExpr(AU._key(["a", "b"])).collect()
    assert keys[0] != keys[1]
    periods = spark.createDataFrame([(1, 1, d(2024, 2, 1), d(2024, 1, 1))], "id INT, company_id INT, start_date DATE, end_date DATE")
    entries = spark.createDataFrame([(5, 1, 1, d(2024, 1, 15))], "id BIGINT, company_id INT, period_id INT, entry_date DATE")
    rules = {r["rule_id"] for r in AU.audit({"accounting_periods": periods, "journal_entries": entries}).collect()}
    assert "entry_date_in_period" in rules
