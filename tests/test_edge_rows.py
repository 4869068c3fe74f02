"""Edge rows of FIXTURES.md section 2 on tiny frames."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from kontor.functions import money as M
from kontor.operators import inventory as I
from kontor.operators import posting as P
from kontor.operators import reports as R

LINES = ("id BIGINT, journal_entry_id BIGINT, account_id INT, debit_amount DECIMAL(20,4), "
         "credit_amount DECIMAL(20,4), debit_base DECIMAL(20,4), credit_base DECIMAL(20,4)")


def test_aging_buckets_and_null_due(spark):
    as_of = "2024-03-31"
    base = dt.date(2024, 3, 31)
    lates = [0, 1, 30, 31, 60, 61, 90, 91]
    rows = [(i, 1, "sale", "sent", 7, base - dt.timedelta(days=d)) for i, d in enumerate(lates)]
    rows.append((99, 1, "sale", "sent", 7, None))
    rows += [(100, 1, "credit_note_sale", "sent", 7, base), (101, 1, "sale", "draft", 7, base),
             (102, 1, "sale", "voided", 7, base), (103, 1, "sale", "paid", 7, base)]
    inv = spark.createDataFrame(rows, "id BIGINT, company_id INT, type STRING, status STRING, contact_id BIGINT, "
                                      "due_date DATE").withColumn("invoice_number", F.col("id").cast("string"))
    for c in ("invoice_date",):
        inv = inv.withColumn(c, F.lit(None).cast("date"))
    for c in ("total_amount", "amount_paid", "amount_due"):
        inv = inv.withColumn(c, F.lit(1).cast("decimal(20,4)"))
    contacts = spark.createDataFrame([(7, "C")], "id BIGINT, name STRING")
    got = {r["invoice_number"]: (r["aging_bucket"], r["days_overdue"])
           for r in R.ar_aging(inv, contacts, as_of).collect()}
    assert [got[str(i)][0] for i in range(8)] == ["current", "1–30 days", "1–30 days", "31–60 days",
                                                   "31–60 days", "61–90 days", "61–90 days", "over 90 days"]
    assert got["99"] == ("over 90 days", None)
    assert not {"100", "101", "102", "103"} & set(got)


def test_trial_balance_counts_draft_lines(spark):
    accounts = spark.createDataFrame([(1, 1, "A", "a", "asset", "debit", D(0)), (2, 1, "B", "b", "revenue", "credit", D(0)),
                                      (3, 1, "C", "c", "asset", "debit", D(0))],
                                     "id INT, company_id INT, code STRING, name STRING, category STRING, "
                                     "normal_balance STRING, opening_balance DECIMAL(20,4)")
    entries = spark.createDataFrame([(10, "draft")], "id BIGINT, status STRING")
    lines = spark.createDataFrame([(1, 10, 1, D(5), D(0), D(5), D(0)), (2, 10, 2, D(0), D(5), D(0), D(5))], LINES)
    tb = {r["account_code"]: r["balance"] for r in R.trial_balance(accounts, lines).collect()}
    assert tb == {"A": 5, "B": 5, "C": 0}
    tbp = {r["account_code"]: r["balance"] for r in R.trial_balance(accounts, lines, entries, posted_only=True).collect()}
    assert tbp == {"A": 0, "B": 0, "C": 0}


def test_unbalanced_skips_entries_without_lines(spark):
    entries = spark.createDataFrame([(1, 1, "E1", dt.date(2024, 1, 1)), (2, 1, "E2", dt.date(2024, 1, 1))],
                                    "id BIGINT, company_id INT, entry_number STRING, entry_date DATE")
    lines = spark.createDataFrame([(1, 1, 1, D(5), D(0), D(5), D(0)), (2, 1, 2, D(0), D(4), D(0), D(4))], LINES)
    out = R.unbalanced_entries(entries, lines).collect()
    assert [(r["id"], r["difference"]) for r in out] == [(1, 1)]


def _posting_inputs(spark):
    periods = spark.createDataFrame([(1, "open"), (2, "closed"), (3, "locked")], "id INT, status STRING")
    lines = spark.createDataFrame([
        (1, 1, 1, D(5), D(0), D(5), D(0)), (2, 1, 2, D(0), D(5), D(0), D(5)),      # 1: balanced
        (3, 2, 1, D(5), D(0), D(5), D(0)), (4, 2, 2, D(0), D(4), D(0), D(4)),      # 2: unbalanced
        (5, 4, 2, D(0), D(5), D(0), D(5)),                                          # 4: credit only
        (6, 5, 1, D(5), D(0), D(5), D(0)),                                          # 5: unbalanced, closed
    ], LINES)
    return periods, lines


def test_posting_reasons_on_update(spark):
    periods, lines = _posting_inputs(spark)
    cand = spark.createDataFrame([(1, 1, "posted"), (2, 1, "posted"), (3, 1, "posted"), (4, 1, "posted"),
                                  (5, 2, "posted"), (6, 3, "voided"), (7, 2, "posted")],
                                 "id BIGINT, period_id INT, status STRING")
    prev = spark.createDataFrame([(i, "posted" if i == 7 else "draft") for i in range(1, 8)], "id BIGINT, status STRING")
    got = {r["id"]: r["reason"] for r in P.post_entries(cand, lines, periods, previous=prev).collect()}
    assert got == {1: None, 2: "unbalanced", 3: "no lines", 4: "no lines", 5: "period closed", 6: None,
                   7: "period closed"}


def test_insert_as_posted_skips_balance_rule(spark):
    periods, lines = _posting_inputs(spark)
    cand = spark.createDataFrame([(2, 1, "posted"), (5, 2, "posted")], "id BIGINT, period_id INT, status STRING")
    got = {r["id"]: r["reason"] for r in P.post_entries(cand, lines, periods, event="insert").collect()}
    assert got == {2: None, 5: "period closed"}


MOVES = ("id BIGINT, product_id BIGINT, move_date DATE, move_type STRING, from_location_id INT, to_location_id INT, "
         "quantity DECIMAL(20,6), unit_cost DECIMAL(20,4), is_posted BOOLEAN")


def test_stock_transfer_and_negative(spark):
    d = dt.date(2024, 1, 1)
    moves = spark.createDataFrame([
        (1, 1, d, "sale_delivery", 1, None, D(3), D(0), True),       # issue before any receipt
        (2, 1, d, "purchase_receipt", None, 1, D(10), D(2), True),
        (3, 1, d, "transfer", 1, 2, D(4), D(0), True),
        (4, 1, d, "purchase_receipt", None, 1, D(99), D(2), False),  # not posted: ignored
    ], MOVES)
    got = {(r["product_id"], r["location_id"]): r["quantity"] for r in I.apply_stock_moves(moves).collect()}
    assert got == {(1, 1): 3, (1, 2): 4}
    total = I.stock_on_hand_total(I.apply_stock_moves(moves)).first()["qty_on_hand"]
    assert total == 7


def test_moving_average_cases(spark):
    d = dt.date(2024, 1, 1)
    products = spark.createDataFrame([(1, D("5.0000")), (2, D("5.0000")), (3, D("5.0000"))],
                                     "id BIGINT, average_cost DECIMAL(20,4)")
    moves = spark.createDataFrame([
        (1, 1, d, "purchase_receipt", None, 1, D(10), D(3), True),    # Q=0 -> c
        (2, 1, d, "purchase_receipt", None, 1, D(10), D(0), True),    # zero cost: stock only
        (3, 1, d, "purchase_receipt", None, 1, D(20), D(6), True),    # Q=20: (20*3+20*6)/40 = 4.5
        (4, 2, d, "sale_delivery", 1, None, D(8), D(0), True),        # Q=-8
        (5, 2, d, "purchase_receipt", None, 1, D(5), D(7), True),     # Q+q=-3 <= 0 -> c = 7
        (6, 3, d, "sale_delivery", 1, None, D(2), D(0), True),        # Q=-2
        (7, 3, d, "purchase_receipt", None, 1, D(3), D(7), True),     # (-2*5 + 3*7)/1 = 11
    ], MOVES)
    got = {r["move_id"]: r["average_cost"] for r in I.moving_average_cost(moves, products, ["id"]).collect()}
    assert got == {1: D("3.0000"), 3: D("4.5000"), 5: D("7.0000"), 7: D("11.0000")}


def test_safe_pct_zero_total(spark):
    df = spark.createDataFrame([(D(0), D(0)), (D(50), D(200))], "billed DECIMAL(20,4), total DECIMAL(20,4)")
    assert [r[0] for r in df.select(M.safe_pct("billed", "total")).collect()] == [0, 25]


def test_missing_period_passes_period_rule(spark):
    """No period row: the period status lookup finds nothing and the rule does not fire."""
    periods = spark.createDataFrame([(1, "closed")], "id INT, status STRING")
    lines = spark.createDataFrame([(1, 1, 1, D(5), D(0), D(5), D(0)), (2, 1, 2, D(0), D(5), D(0), D(5))], LINES)
    cand = spark.createDataFrame([(1, 99, "posted")], "id BIGINT, period_id INT, status STRING")
    got = {r["id"]: r["reason"] for r in P.post_entries(cand, lines, periods).collect()}
    assert got == {1: None}
