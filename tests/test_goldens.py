"""Goldens derived by hand from the reference UI's mock data."""

from decimal import Decimal

from pyspark.sql import functions as F

from kontor.operators import inventory as I
from kontor.operators import reports as R

# --- fixed values: the UI's mock accounts (code, name, category, normal side, balance) ---
MOCK_ACCOUNTS = [
    (1, "1000", "Cash & Cash Equivalents", "asset", "debit", 142500),
    (2, "1100", "Accounts Receivable", "asset", "debit", 98320),
    (3, "1200", "Inventory", "asset", "debit", 215000),
    (4, "1500", "Property & Equipment", "asset", "debit", 380000),
    (5, "2000", "Accounts Payable", "liability", "credit", 67400),
    (6, "2100", "Accrued Liabilities", "liability", "credit", 12800),
    (7, "2500", "Long-Term Debt", "liability", "credit", 250000),
    (8, "3000", "Common Stock", "equity", "credit", 500000),
    (9, "3100", "Retained Earnings", "equity", "credit", 5620),
    (10, "4000", "Sales Revenue", "revenue", "credit", 320000),
    (11, "5000", "Cost of Goods Sold", "expense", "debit", 185000),
    (12, "5100", "Salaries & Wages", "expense", "debit", 48000),
    (13, "5200", "Rent Expense", "expense", "debit", 18000),
    (14, "5300", "Office Supplies", "expense", "debit", 2400),
]

# --- fixed values: the UI's mock invoices (id, number, type, total, amount due, status) ---
MOCK_INVOICES = [
    (1, "INV-2024-0088", "sale", 24500, 24500, "sent"),
    (2, "INV-2024-0089", "sale", 9800, 9800, "sent"),
    (3, "BILL-2024-041", "purchase", 8200, 0, "paid"),
    (4, "INV-2024-0087", "sale", 31000, 0, "paid"),
    (5, "BILL-2024-042", "purchase", 3200, 3200, "draft"),
]

# --- fixed values: the UI's mock products (id, sku, qty, average cost, value); the
# service item has no quantity or value ---
MOCK_PRODUCTS = [
    (1, "PRD-001", 42, 1200, 50400), (2, "PRD-002", 18, 480, 8640), (3, "PRD-003", 215, 95, 20425),
    (4, "SVC-001", None, 0, None), (5, "PRD-004", 29, 195, 5655), (6, "PRD-005", 88, 38, 3344),
]


def _balances(spark):
    rows = [(1, code, name, cat, nb, Decimal(b)) for _, code, name, cat, nb, b in MOCK_ACCOUNTS]
    return spark.createDataFrame(rows, "company_id INT, account_code STRING, account_name STRING, category STRING, "
                                       "normal_balance STRING, balance DECIMAL(30,4)")


def test_category_totals(spark):
    got = {r["category"]: r["total_balance"] for r in R.category_totals(_balances(spark)).collect()}
    assert got == {"asset": 835820, "liability": 330200, "equity": 505620, "revenue": 320000, "expense": 253400}


def test_trial_balance_totals_not_balanced(spark):
    r = R.trial_balance_totals(_balances(spark)).first()
    assert (r["total_debit"], r["total_credit"], r["difference"]) == (1089220, 1155820, -66600)
    assert r["is_balanced"] is False


def test_dashboard_kpis(spark):
    inv = spark.createDataFrame([(1, i, n, t, Decimal(a), Decimal(d), s) for i, n, t, a, d, s in MOCK_INVOICES],
                                "company_id INT, id BIGINT, invoice_number STRING, type STRING, "
                                "total_amount DECIMAL(20,4), amount_due DECIMAL(20,4), status STRING")
    r = R.dashboard_kpis(_balances(spark), inv).first()
    assert r["total_assets"] == 835820 and r["total_revenue"] == 320000
    assert r["total_expenses"] == 253400 and r["net_income"] == 66600
    assert r["accounts_receivable"] == 34300 and r["open_invoices"] == 2   # UI literal says 3
    assert r["open_bills"] == 0                                               # the open bill is a draft


def test_inventory_total_value_skips_service_items(spark):
    prod = spark.createDataFrame([(i, s, i != 4) for i, s, *_ in MOCK_PRODUCTS],
                                 "id BIGINT, sku STRING, is_tracked BOOLEAN")
    val = spark.createDataFrame([(i, Decimal(v) if v is not None else Decimal(0)) for i, _, _, _, v in MOCK_PRODUCTS],
                                "product_id BIGINT, inventory_value DECIMAL(38,10)")
    assert I.inventory_total_value(val, prod).first()["total_value"] == 88464


def test_invoice_form_flat_tax(spark):
    lines = spark.createDataFrame([(1, Decimal(2), Decimal(100))],
                                  "invoice_id BIGINT, quantity DECIMAL(20,6), unit_price DECIMAL(20,4)")
    r = R.invoice_totals(lines, tax_mode="flat").first()
    assert (r["subtotal"], r["tax_amount"], r["total_amount"]) == (200, 20, 220)


def test_trial_balance_columns(spark):
    rows = {r["account_code"]: r for r in R.trial_balance_columns(_balances(spark)).collect()}
    assert rows["1000"]["debit_column"] == 142500 and rows["1000"]["credit_column"] is None
    assert rows["4000"]["credit_column"] == 320000 and rows["4000"]["debit_column"] is None


def test_filters(spark):
    inv = spark.createDataFrame([(i, t, s) for i, _, t, _, _, s in MOCK_INVOICES], "id INT, type STRING, status STRING")
    assert R.filter_invoices_by_tab(inv, "paid").count() == 2
    assert R.filter_invoices_by_tab(inv, "overdue").count() == 0     # stored status only
    assert R.filter_invoices_by_tab(inv, "purchase").count() == 2
    assert R.open_items(inv).count() == 3                             # drafts are open items
    acc = spark.createDataFrame([(a[0], a[3]) for a in MOCK_ACCOUNTS], "id INT, category STRING")
    assert R.filter_accounts_by_category(acc, "expense").count() == 4
    assert R.filter_accounts_by_category(acc, "all").count() == 14
