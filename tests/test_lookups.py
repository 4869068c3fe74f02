"""As-of rates, period lookup, posting split and bank matching on tiny frames."""

import datetime as dt
from decimal import Decimal as D

from kontor.operators import banking as B
from kontor.operators import fx as X
from kontor.operators import posting as P

d = dt.date


def test_asof_rate_boundaries(spark):
    rates = spark.createDataFrame([("USD", "EUR", D("1.1"), d(2024, 1, 1)), ("USD", "EUR", D("1.2"), d(2024, 3, 15)),
                                   ("USD", "GBP", D("0.8"), d(2024, 2, 1))],
                                  "from_currency STRING, to_currency STRING, rate DECIMAL(20,8), effective_date DATE")
    facts = spark.createDataFrame([(1, "USD", "EUR", d(2023, 12, 31)), (2, "USD", "EUR", d(2024, 1, 1)),
                                   (3, "USD", "EUR", d(2024, 3, 14)), (4, "USD", "EUR", d(2024, 3, 15)),
                                   (5, "USD", "EUR", d(2030, 1, 1)), (6, "USD", "GBP", d(2024, 2, 29)),
                                   (7, "USD", "JPY", d(2024, 2, 29))],
                                  "id INT, f STRING, t STRING, day DATE")
    got = {r["id"]: r["rate"] for r in X.asof_rate(facts, rates, "day", "f", "t").collect()}
    assert got == {1: None, 2: D("1.1"), 3: D("1.1"), 4: D("1.2"), 5: D("1.2"), 6: D("0.8"), 7: None}


def test_period_for_date_edges(spark):
    periods = spark.createDataFrame([(1, 10, d(2024, 1, 1), d(2024, 1, 31)), (1, 11, d(2024, 2, 1), d(2024, 3, 31))],
                                    "company_id INT, id INT, start_date DATE, end_date DATE")
    facts = spark.createDataFrame([(1, d(2024, 1, 31)), (1, d(2024, 2, 1)), (1, d(2024, 3, 31)), (1, d(2024, 4, 1)),
                                   (2, d(2024, 1, 5))], "company_id INT, day DATE")
    got = {(r["company_id"], r["day"]): r["derived_period_id"]
           for r in X.period_for_date(facts, periods, "day").collect()}
    assert got == {(1, d(2024, 1, 31)): 10, (1, d(2024, 2, 1)): 11, (1, d(2024, 3, 31)): 11,
                   (1, d(2024, 4, 1)): None, (2, d(2024, 1, 5)): None}


def test_split_posting_and_stamp(spark):
    periods = spark.createDataFrame([(1, "open")], "id INT, status STRING")
    lines = spark.createDataFrame([(1, D(5), D(5)), (2, D(5), D(4))],
                                  "journal_entry_id BIGINT, debit_amount DECIMAL(20,4), credit_amount DECIMAL(20,4)")
    cand = spark.createDataFrame([(1, 1, "posted"), (2, 1, "posted")], "id BIGINT, period_id INT, status STRING")
    checked = P.post_entries(cand, lines, periods, stamp_time=True)
    ok, bad = P.split_posting(checked)
    assert [r["id"] for r in ok.collect()] == [1] and ok.first()["posted_at"] is not None
    assert [(r["id"], r["reason"]) for r in bad.collect()] == [(2, "unbalanced")]


def test_bank_match_rules(spark):
    tx = spark.createDataFrame([(1, 1, d(2024, 1, 10), D("100.0000"), 77), (2, 1, d(2024, 1, 10), D("50.0000"), None),
                                (3, 1, d(2024, 1, 11), D("50.0000"), None), (4, 1, d(2024, 1, 30), D("50.0000"), None)],
                               "id BIGINT, bank_account_id INT, transaction_date DATE, amount DECIMAL(20,4), "
                               "payment_id BIGINT")
    pay = spark.createDataFrame([(77, 1, d(2024, 1, 9), D("100.0000"), "inbound"),
                                 (88, 1, d(2024, 1, 12), D("50.0000"), "inbound")],
                                "id BIGINT, bank_account_id INT, payment_date DATE, amount DECIMAL(20,4), "
                                "direction STRING")
    got = {r["id"]: (r["matched_payment_id"], r["match_rule"]) for r in B.bank_match(tx, pay, 3).collect()}
    # explicit link; payment 88 is closest to transaction 3 and used once; 30 Jan is out of range
    assert got == {1: (77, "explicit"), 2: (None, None), 3: (88, "amount_date"), 4: (None, None)}
