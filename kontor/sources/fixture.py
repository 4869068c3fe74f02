"""Test-data mapping: the driver's TPC-H-style tables -> ledger tables.

The reference ships no data, so the library's tests, queries and bench read
the driver tables and map them onto the accounting data model. Each ledger
table is one SQL text that runs unchanged on Spark and on DuckDB (the
correctness oracle prepends the same texts as CTEs), with ``{name}``
placeholders for its inputs. On Spark the placeholders are bound to
DataFrames through ``spark.sql(text, **frames)``, so Catalyst sees one plan:
filters and column pruning reach the Parquet scans through the mapping.

Where the two dialects differ (row legs), a table carries a ``$LEGS$`` marker
that is replaced per engine. Arithmetic that would round differently on the
two engines (double -> decimal ties, DuckDB's decimal division returning
DOUBLE) is done on integers: money in 1e-4 units, then scaled back.

This module is fixture glue, not an operator: real deployments load their
ledger tables with ``sources.readers.load_table``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kontor.sources import schemas as S

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# --- fixed values: currency of each region of the test data --------------------
CURRENCY_BY_REGION = ["USD", "EUR", "GBP", "JPY", "CHF"]

# --- fixed values: chart-of-accounts template (kind, code, name, category,
# group kind, is_control, is_reconcilable); ids are company * 100 + kind ------
ACCOUNT_TEMPLATE = [
    (1, "1010", "Cash at Bank", "asset", 3, False, True),
    (2, "1200", "Accounts Receivable", "asset", 3, True, True),
    (3, "1300", "Inventory", "asset", 4, False, False),
    (4, "2100", "Accounts Payable", "liability", 6, True, True),
    (5, "2200", "Sales Tax Payable", "liability", 6, False, False),
    (6, "3000", "Owner Equity", "equity", 7, False, False),
    (7, "4000", "Sales Revenue", "revenue", 8, False, False),
    (8, "5000", "Cost of Goods Sold", "expense", 10, False, False),
    (9, "5900", "Suspense", "expense", 9, False, False),
]

# --- fixed values: account-group tree template (kind, code, name, category,
# parent kind, level); ids are company * 100 + kind ---------------------------
GROUP_TEMPLATE = [
    (1, "1000", "Assets", "asset", None, 1),
    (2, "1100", "Current Assets", "asset", 1, 2),
    (3, "1110", "Cash and Receivables", "asset", 2, 3),
    (4, "1120", "Inventories", "asset", 2, 3),
    (5, "2000", "Liabilities", "liability", None, 1),
    (6, "2100", "Current Liabilities", "liability", 5, 2),
    (7, "3000", "Equity", "equity", None, 1),
    (8, "4000", "Revenue", "revenue", None, 1),
    (9, "5000", "Expenses", "expense", None, 1),
    (10, "5100", "Cost of Sales", "expense", 9, 2),
]

# Books of every company in the mapping: one per journal type (kind, code,
# name, type, default account kind). Codes are of this mapping's own making.
JOURNAL_TEMPLATE = [
    (1, "MEMO", "Memorial book", "general", None),
    (2, "OUT", "Outgoing invoices", "sales", 2),
    (3, "IN", "Incoming invoices", "purchase", 4),
    (4, "TILL", "Till book", "cash", 1),
    (5, "GIRO", "Giro book", "bank", 1),
]

# The evaluation date used wherever the data model says CURRENT_DATE.
AS_OF = "2001-08-01"


def _ccy(col: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CURRENCY_BY_REGION[:-1]))
    return f"CASE {col} {whens} ELSE '{CURRENCY_BY_REGION[-1]}' END"


def _normal_side(category: str) -> str:
    return "debit" if category in ("asset", "expense") else "credit"


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def _per_company(rows_sql: list[str]) -> str:
    return "\nUNION ALL\n".join(rows_sql)


def _dec4_from_1e4(expr: str) -> str:
    """Integer count of 1e-4 units -> DECIMAL(20,4), exactly, on both engines."""
    return f"CAST(CAST({expr} AS DECIMAL(20,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(20,4))"


def _unit_price_1e4(s: str) -> str:
    """round(extendedprice / quantity, 4) in 1e-4 units, half away from zero."""
    cents = f"CAST(CAST({s}.l_extendedprice AS DECIMAL(20,2)) * 100 AS BIGINT)"
    qty = f"CAST({s}.l_quantity AS BIGINT)"
    return f"CAST(FLOOR(({cents} * 200 + {qty}) / (2 * {qty})) AS BIGINT)"


def _line_amount_1e4(s: str) -> str:
    """qty * unit_price * (1 - discount_pct / 100), rounded to 1e-4."""
    qty = f"CAST({s}.l_quantity AS BIGINT)"
    dpct = f"CAST(ROUND({s}.l_discount * 100) AS BIGINT)"
    return f"CAST(FLOOR(({qty} * {_unit_price_1e4(s)} * (100 - {dpct}) * 2 + 100) / 200) AS BIGINT)"


def _tax_pct(s: str) -> str:
    return f"CAST(ROUND({s}.l_tax * 100) AS BIGINT)"


# ---------------------------------------------------------------------------
# Ledger table texts. Keys in ``deps`` are the placeholders each text uses.
# ---------------------------------------------------------------------------

_T: dict[str, tuple[str, list[str]]] = {}


def _table(name: str, deps: list[str], sql: str) -> None:
    _T[name] = (sql, deps)


_table("currencies", ["region"], f"""
SELECT CAST(r_regionkey + 1 AS INT) AS id, {_ccy('r_regionkey')} AS code,
       r_name || ' currency' AS name,
       CAST(CASE WHEN r_regionkey = 3 THEN 0 ELSE 2 END AS SMALLINT) AS decimal_places,
       r_regionkey = 0 AS is_base, TRUE AS is_active
FROM {{region}}""")

_table("companies", ["region"], f"""
SELECT CAST(r_regionkey + 1 AS INT) AS id, r_name AS name, {_ccy('r_regionkey')} AS base_currency
FROM {{region}}""")

# internal: order header with its company (customer's region)
_table("order_head", ["orders", "customer", "nation"], """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority, o.o_totalprice,
       CAST(o.o_orderdate AS DATE) AS odate,
       CAST(year(o.o_orderdate) AS INT) AS oyear, CAST(month(o.o_orderdate) AS INT) AS omonth,
       n.n_regionkey, CAST(n.n_regionkey + 1 AS INT) AS company_id
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey""")

# internal: line items numbered 1..k inside each order, in a deterministic
# order ((l_orderkey, l_linenumber) alone is not unique in the test data)
_table("line_src", ["lineitem"], """
SELECT l.*, row_number() OVER (PARTITION BY l.l_orderkey
                               ORDER BY l.l_linenumber, l.l_partkey, l.l_shipdate) AS rn
FROM {lineitem} l""")

_table("exchange_rates", ["order_head"], f"""
SELECT CAST(n_regionkey * 1000000 + oyear * 100 + omonth AS INT) AS id,
       'USD' AS from_currency, {_ccy('n_regionkey')} AS to_currency,
       CAST(1 + 0.25 * n_regionkey + omonth * 0.001 AS DECIMAL(20,8)) AS rate,
       make_date(oyear, omonth, 1) AS effective_date
FROM {{order_head}}
WHERE n_regionkey > 0 AND omonth % 2 = 0
GROUP BY n_regionkey, oyear, omonth""")

_table("fiscal_years", ["order_head"], """
SELECT CAST(company_id * 10000 + oyear AS INT) AS id, company_id,
       'FY' || CAST(oyear AS STRING) AS name,
       make_date(oyear, 1, 1) AS start_date, make_date(oyear, 12, 31) AS end_date,
       oyear = 2001 AS is_current, oyear < 2000 AS is_closed
FROM {order_head}
GROUP BY company_id, oyear""")

_table("accounting_periods", ["order_head"], """
SELECT CAST(company_id * 1000000 + oyear * 100 + omonth AS INT) AS id,
       CAST(company_id * 10000 + oyear AS INT) AS fiscal_year_id, company_id,
       CAST(oyear AS STRING) || '-' || lpad(CAST(omonth AS STRING), 2, '0') AS name,
       make_date(oyear, omonth, 1) AS start_date,
       last_day(make_date(oyear, omonth, 1)) AS end_date,
       CAST(omonth AS SMALLINT) AS period_number,
       CASE omonth % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'locked' END AS status
FROM {order_head}
GROUP BY company_id, oyear, omonth""")

_table("account_groups", ["region"], _per_company([
    f"""SELECT CAST((r_regionkey + 1) * 100 + {k} AS INT) AS id, CAST(r_regionkey + 1 AS INT) AS company_id,
       {_sql_lit(code)} AS code, {_sql_lit(name)} AS name, {_sql_lit(cat)} AS category,
       CAST({'NULL' if parent is None else f'(r_regionkey + 1) * 100 + {parent}'} AS INT) AS parent_id,
       CAST({level} AS SMALLINT) AS level
FROM {{region}}""" for k, code, name, cat, parent, level in GROUP_TEMPLATE]))

_table("accounts", ["region"], _per_company([
    f"""SELECT CAST((r_regionkey + 1) * 100 + {k} AS INT) AS id, CAST(r_regionkey + 1 AS INT) AS company_id,
       {_sql_lit(code)} AS code, {_sql_lit(name)} AS name, {_sql_lit(cat)} AS category,
       {_sql_lit(_normal_side(cat))} AS normal_balance,
       CAST((r_regionkey + 1) * 100 + {grp} AS INT) AS group_id, CAST(NULL AS STRING) AS currency,
       TRUE AS is_active, {_sql_lit(rec)} AS is_reconcilable, {_sql_lit(ctl)} AS is_control,
       CAST({'(r_regionkey + 1) * 10000' if k in (1, 6) else '0'} AS DECIMAL(20,4)) AS opening_balance
FROM {{region}}""" for k, code, name, cat, grp, ctl, rec in ACCOUNT_TEMPLATE]))

_table("journals", ["region"], _per_company([
    f"""SELECT CAST((r_regionkey + 1) * 10 + {k} AS INT) AS id, CAST(r_regionkey + 1 AS INT) AS company_id,
       {_sql_lit(code)} AS code, {_sql_lit(name)} AS name, {_sql_lit(typ)} AS type,
       CAST({'NULL' if acct is None else f'(r_regionkey + 1) * 100 + {acct}'} AS INT) AS default_account,
       {_sql_lit(code + '-')} AS sequence_prefix, TRUE AS is_active
FROM {{region}}""" for k, code, name, typ, acct in JOURNAL_TEMPLATE]))

_table("tax_codes", ["lineitem"], f"""
SELECT CAST({_tax_pct('l')} + 1 AS INT) AS id, 1 AS company_id,
       'VAT' || lpad(CAST({_tax_pct('l')} AS STRING), 2, '0') AS code,
       'Tax ' || CAST({_tax_pct('l')} AS STRING) || ' percent' AS name,
       CAST({_tax_pct('l')} AS DECIMAL(8,4)) AS rate, 'both' AS tax_type,
       105 AS account_id, TRUE AS is_active
FROM {{lineitem}} l
GROUP BY {_tax_pct('l')}""")

_table("cost_centers", ["supplier"], """
SELECT CAST(s_suppkey % 10 AS INT) AS id, 1 AS company_id,
       'CC' || CAST(s_suppkey % 10 AS STRING) AS code,
       'Cost centre ' || CAST(s_suppkey % 10 AS STRING) AS name,
       CAST(CASE WHEN s_suppkey % 10 = 1 THEN NULL ELSE 1 END AS INT) AS parent_id,
       TRUE AS is_active
FROM {supplier}
WHERE s_suppkey % 10 > 0
GROUP BY s_suppkey % 10""")

_table("projects", ["region"], _per_company([
    f"""SELECT CAST((r_regionkey + 1) * 10 + {k} AS INT) AS id, CAST(r_regionkey + 1 AS INT) AS company_id,
       'PRJ{k}' AS code, 'Project {k}' AS name,
       CAST({1000000 * (k + 1)} AS DECIMAL(20,4)) AS budget, TRUE AS is_active
FROM {{region}}""" for k in range(3)]))

_table("journal_entries", ["order_head"], """
SELECT o_orderkey AS id, company_id,
       CAST(company_id * 10 + o_orderkey % 5 + 1 AS INT) AS journal_id,
       CAST(company_id * 1000000 + oyear * 100 + omonth AS INT) AS period_id,
       'JE-' || CAST(o_orderkey AS STRING) AS entry_number,
       odate AS entry_date,
       'ORD-' || CAST(o_orderkey AS STRING) AS reference,
       o_orderpriority AS description,
       'USD' AS currency,
       CAST(1 + 0.25 * n_regionkey AS DECIMAL(20,8)) AS exchange_rate,
       CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'draft' ELSE 'voided' END AS status,
       FALSE AS is_reversal, CAST(NULL AS BIGINT) AS reversed_by,
       'invoice' AS source_type, o_orderkey AS source_id
FROM {order_head}""")

# Two legs per line item: debit receivable, credit revenue. The credit is
# 0.01 short on some lines so that unbalanced entries exist.
_LEG_AMOUNT = ("CAST(CASE WHEN lg.leg = 1 OR NOT (s.l_tax = 0.08 AND s.l_orderkey % 7 = 0) "
               "THEN CAST(s.l_extendedprice AS DECIMAL(20,4)) "
               "ELSE CAST(s.l_extendedprice AS DECIMAL(20,4)) - 0.01 END AS DECIMAL(20,4))")
_LEG_BASE = (f"CAST(ROUND(CAST({_LEG_AMOUNT} AS DECIMAL(18,4)) "
             f"* CAST(1 + 0.25 * h.n_regionkey AS DECIMAL(12,8)), 4) AS DECIMAL(20,4))")
_table("journal_entry_lines", ["line_src", "order_head"], f"""
SELECT (s.l_orderkey * 100 + s.rn) * 2 + lg.leg - 1 AS id,
       s.l_orderkey AS journal_entry_id,
       CAST(s.rn * 2 - 2 + lg.leg AS SMALLINT) AS line_number,
       CAST(h.company_id * 100 + CASE WHEN lg.leg = 1 THEN 2 ELSE 7 END AS INT) AS account_id,
       CASE WHEN lg.leg = 1 THEN 'Receivable ' ELSE 'Revenue ' END || CAST(s.l_partkey AS STRING) AS description,
       CASE WHEN lg.leg = 1 THEN {_LEG_AMOUNT} ELSE CAST(0 AS DECIMAL(20,4)) END AS debit_amount,
       CASE WHEN lg.leg = 2 THEN {_LEG_AMOUNT} ELSE CAST(0 AS DECIMAL(20,4)) END AS credit_amount,
       CASE WHEN lg.leg = 1 THEN {_LEG_BASE} ELSE CAST(0 AS DECIMAL(20,4)) END AS debit_base,
       CASE WHEN lg.leg = 2 THEN {_LEG_BASE} ELSE CAST(0 AS DECIMAL(20,4)) END AS credit_base,
       CAST(CASE WHEN lg.leg = 2 THEN {_tax_pct('s')} + 1 ELSE NULL END AS INT) AS tax_code_id,
       CAST(0 AS DECIMAL(20,4)) AS tax_amount,
       CAST(h.o_custkey * 2 AS BIGINT) AS contact_id,
       CAST(CASE WHEN s.l_suppkey % 10 = 0 THEN NULL ELSE s.l_suppkey % 10 END AS INT) AS cost_center_id,
       CAST(CASE WHEN s.l_returnflag = 'R' THEN h.company_id * 10 + s.l_orderkey % 3
                 ELSE NULL END AS INT) AS project_id
FROM {{line_src}} s
JOIN {{order_head}} h ON h.o_orderkey = s.l_orderkey
$LEGS$""")

# internal: what the projects cost, booked on the entries of journal_entries (6 percent of the price; no other
# line of the mapping is an expense)
_table("project_costs", ["line_src", "order_head"], """
SELECT s.l_orderkey AS journal_entry_id, CAST(h.company_id * 100 + 8 AS INT) AS account_id,
       CAST(CAST(s.l_extendedprice AS DECIMAL(16,2)) * CAST(0.06 AS DECIMAL(2,2)) AS DECIMAL(20,4)) AS debit_base,
       CAST(0 AS DECIMAL(20,4)) AS credit_base,
       CAST(h.company_id * 10 + s.l_orderkey % 3 AS INT) AS project_id
FROM {line_src} s
JOIN {order_head} h ON h.o_orderkey = s.l_orderkey
WHERE s.l_returnflag = 'R'""")

_table("contacts", ["customer", "supplier", "nation"], f"""
SELECT CAST(c.c_custkey * 2 AS BIGINT) AS id, CAST(n.n_regionkey + 1 AS INT) AS company_id,
       c.c_name AS name, 'customer' AS type, {_ccy('n.n_regionkey')} AS currency,
       CAST(30 AS SMALLINT) AS payment_terms,
       CAST(CASE WHEN c.c_custkey % 10 = 0 THEN NULL
                 ELSE 50000 + 1000 * (c.c_custkey % 50) END AS DECIMAL(20,4)) AS credit_limit,
       CAST(CASE WHEN c.c_custkey % 13 = 0 THEN (n.n_regionkey + 1) * 100 + 9 ELSE NULL END AS INT)
           AS ar_account_id,
       CAST(NULL AS INT) AS ap_account_id, TRUE AS is_active
FROM {{customer}} c JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
UNION ALL
SELECT CAST(s.s_suppkey * 2 + 1 AS BIGINT) AS id, CAST(n.n_regionkey + 1 AS INT) AS company_id,
       s.s_name AS name, 'vendor' AS type, {_ccy('n.n_regionkey')} AS currency,
       CAST(45 AS SMALLINT) AS payment_terms, CAST(NULL AS DECIMAL(20,4)) AS credit_limit,
       CAST(NULL AS INT) AS ar_account_id,
       CAST(CASE WHEN s.s_suppkey % 13 = 0 THEN (n.n_regionkey + 1) * 100 + 9 ELSE NULL END AS INT)
           AS ap_account_id,
       TRUE AS is_active
FROM {{supplier}} s JOIN {{nation}} n ON n.n_nationkey = s.s_nationkey""")

_SALE_PAID = ("CAST(CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(20,2)) "
              "WHEN 'P' THEN FLOOR(CAST(o_totalprice AS DECIMAL(20,2)) / 2) ELSE 0 END AS DECIMAL(20,4))")
_DUE = ("CAST(CASE substr(o_orderpriority, 1, 1) "
        "WHEN '1' THEN odate + INTERVAL 15 DAY WHEN '2' THEN odate + INTERVAL 30 DAY "
        "WHEN '3' THEN odate + INTERVAL 45 DAY WHEN '5' THEN odate + INTERVAL 60 DAY "
        "ELSE NULL END AS DATE)")
_BILL_MONTH = "make_date(CAST(year(l.l_shipdate) AS INT), CAST(month(l.l_shipdate) AS INT), 1)"
_table("invoices", ["order_head", "lineitem", "supplier", "nation"], f"""
SELECT o_orderkey AS id, company_id, 'INV-' || CAST(o_orderkey AS STRING) AS invoice_number,
       'sale' AS type,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'sent' ELSE 'partial' END AS status,
       CAST(o_custkey * 2 AS BIGINT) AS contact_id, odate AS invoice_date, {_DUE} AS due_date,
       'USD' AS currency, CAST(1 + 0.25 * n_regionkey AS DECIMAL(20,8)) AS exchange_rate,
       CAST(o_totalprice AS DECIMAL(20,4)) AS subtotal, CAST(0 AS DECIMAL(20,4)) AS tax_amount,
       CAST(o_totalprice AS DECIMAL(20,4)) AS total_amount,
       {_SALE_PAID} AS amount_paid,
       CAST(CAST(o_totalprice AS DECIMAL(20,4)) - {_SALE_PAID} AS DECIMAL(20,4)) AS amount_due,
       o_orderkey AS journal_entry_id
FROM {{order_head}}
UNION ALL
SELECT id, company_id, invoice_number, 'purchase' AS type, status, contact_id, invoice_date,
       CAST(invoice_date + INTERVAL 30 DAY AS DATE) AS due_date, currency,
       CAST(1 AS DECIMAL(20,8)) AS exchange_rate, total AS subtotal, CAST(0 AS DECIMAL(20,4)) AS tax_amount,
       total AS total_amount, paid AS amount_paid, CAST(total - paid AS DECIMAL(20,4)) AS amount_due,
       CAST(NULL AS BIGINT) AS journal_entry_id
FROM (
  SELECT id, company_id, invoice_number, status, contact_id, invoice_date, currency, total,
         CAST(CASE status WHEN 'paid' THEN total WHEN 'partial' THEN FLOOR(total / 2) ELSE 0 END
              AS DECIMAL(20,4)) AS paid
  FROM (
    SELECT CAST(1000000000000000 + l.l_suppkey * 1000000 + year(l.l_shipdate) * 100
                + month(l.l_shipdate) AS BIGINT) AS id,
           CAST(n.n_regionkey + 1 AS INT) AS company_id,
           'BILL-' || CAST(l.l_suppkey AS STRING) || '-' || CAST(year(l.l_shipdate) * 100
                + month(l.l_shipdate) AS STRING) AS invoice_number,
           CASE month(l.l_shipdate) % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'sent' WHEN 2 THEN 'partial'
                ELSE 'draft' END AS status,
           CAST(l.l_suppkey * 2 + 1 AS BIGINT) AS contact_id,
           last_day({_BILL_MONTH}) AS invoice_date,
           'USD' AS currency,
           CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(20,4))) AS DECIMAL(20,4)) AS total
    FROM {{lineitem}} l
    JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey
    JOIN {{nation}} n ON n.n_nationkey = s.s_nationkey
    GROUP BY l.l_suppkey, n.n_regionkey, year(l.l_shipdate), month(l.l_shipdate), {_BILL_MONTH}
  ) b
) p""")

# Bills repeat the ordered lines: some are left out, some billed by half, some by more than ordered.
_BILLED = ("CASE (s.l_orderkey + s.rn) % 7 WHEN 0 THEN 0 WHEN 1 THEN FLOOR(CAST(s.l_quantity AS BIGINT) / 2) "
           "WHEN 2 THEN CAST(s.l_quantity AS BIGINT) + 5 ELSE CAST(s.l_quantity AS BIGINT) END")
_BILL_ID = ("CAST(1000000000000000 + s.l_suppkey * 1000000 + year(s.l_shipdate) * 100 + month(s.l_shipdate) "
            "AS BIGINT)")
_table("invoice_lines", ["line_src", "order_head", "supplier", "nation"], f"""
SELECT s.l_orderkey * 100 + s.rn AS id, s.l_orderkey AS invoice_id, CAST(s.rn AS SMALLINT) AS line_number,
       'Part ' || CAST(s.l_partkey AS STRING) AS description,
       CAST(h.company_id * 100 + 7 AS INT) AS account_id,
       CAST(s.l_quantity AS DECIMAL(20,6)) AS quantity,
       {_dec4_from_1e4(_unit_price_1e4('s'))} AS unit_price,
       CAST(ROUND(s.l_discount * 100) AS DECIMAL(6,4)) AS discount_pct,
       {_dec4_from_1e4(_line_amount_1e4('s'))} AS line_amount,
       CAST({_tax_pct('s')} + 1 AS INT) AS tax_code_id,
       {_dec4_from_1e4(f"FLOOR(({_line_amount_1e4('s')} * {_tax_pct('s')} * 2 + 100) / 200)")} AS tax_amount,
       s.l_partkey AS product_id,
       CAST(CASE WHEN s.l_suppkey % 10 = 0 THEN NULL ELSE s.l_suppkey % 10 END AS INT) AS cost_center_id,
       CAST(CASE WHEN s.l_returnflag = 'R' THEN h.company_id * 10 + s.l_orderkey % 3
                 ELSE NULL END AS INT) AS project_id
FROM {{line_src}} s
JOIN {{order_head}} h ON h.o_orderkey = s.l_orderkey
UNION ALL
SELECT 4000000000000000 + s.l_orderkey * 100 + s.rn AS id, {_BILL_ID} AS invoice_id,
       CAST(row_number() OVER (PARTITION BY {_BILL_ID} ORDER BY s.l_orderkey, s.rn) AS SMALLINT) AS line_number,
       'Part ' || CAST(s.l_partkey AS STRING) AS description,
       CAST(n.n_regionkey * 100 + 103 AS INT) AS account_id,
       CAST({_BILLED} AS DECIMAL(20,6)) AS quantity,
       {_dec4_from_1e4(_unit_price_1e4('s'))} AS unit_price,
       CAST(0 AS DECIMAL(6,4)) AS discount_pct,
       {_dec4_from_1e4(f"CAST({_unit_price_1e4('s')} AS BIGINT) * CAST({_BILLED} AS BIGINT)")} AS line_amount,
       CAST({_tax_pct('s')} + 1 AS INT) AS tax_code_id, CAST(0 AS DECIMAL(20,4)) AS tax_amount,
       s.l_partkey AS product_id, CAST(NULL AS INT) AS cost_center_id, CAST(NULL AS INT) AS project_id
FROM {{line_src}} s
JOIN {{supplier}} sp ON sp.s_suppkey = s.l_suppkey
JOIN {{nation}} n ON n.n_nationkey = sp.s_nationkey
WHERE s.l_returnflag = 'N' AND {_BILLED} > 0""")

_PAY_AMOUNT = ("CAST(CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(20,2)) "
               "ELSE FLOOR(CAST(o_totalprice AS DECIMAL(20,2)) / 2) END AS DECIMAL(20,4))")
_table("payments", ["order_head"], f"""
SELECT o_orderkey AS id, company_id, 'PAY-' || CAST(o_orderkey AS STRING) AS payment_number,
       'inbound' AS direction, CAST(o_custkey * 2 AS BIGINT) AS contact_id,
       CAST(odate + INTERVAL 10 DAY AS DATE) AS payment_date,
       CASE o_orderkey % 3 WHEN 0 THEN 'bank_transfer' WHEN 1 THEN 'check' ELSE 'cash' END AS method,
       'USD' AS currency, CAST(1 + 0.25 * n_regionkey AS DECIMAL(20,8)) AS exchange_rate,
       {_PAY_AMOUNT} AS amount,
       CAST(o_custkey % 10 + 1 AS INT) AS bank_account_id, CAST(NULL AS BIGINT) AS journal_entry_id
FROM {{order_head}}
WHERE o_orderstatus IN ('F', 'P') AND {_PAY_AMOUNT} > 0""")

_table("payment_allocations", ["payments"], """
SELECT id, id AS payment_id, id AS invoice_id, amount AS allocated_amount
FROM {payments}""")

_table("bank_accounts", ["events"], """
SELECT CAST(user_id + 1 AS INT) AS id, 1 AS company_id, 101 AS gl_account_id,
       'Account ' || CAST(user_id AS STRING) AS name, 'USD' AS currency,
       CAST(1000 * (user_id % 10) AS DECIMAL(20,4)) AS opening_balance,
       CAST(1000 * (user_id % 10) AS DECIMAL(20,4)) AS current_balance,
       TRUE AS is_active
FROM {events}
GROUP BY user_id""")

_table("bank_transactions", ["events", "payments"], """
SELECT event_id AS id, CAST(user_id + 1 AS INT) AS bank_account_id,
       CAST(ts AS DATE) AS transaction_date, event_type AS description, props AS reference,
       CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(value AS DECIMAL(20,4))
                 ELSE -CAST(value AS DECIMAL(20,4)) END AS DECIMAL(20,4)) AS amount,
       CAST(NULL AS DECIMAL(20,4)) AS running_balance,
       event_id % 3 = 0 AS is_reconciled,
       CAST(NULL AS BIGINT) AS payment_id, CAST(NULL AS BIGINT) AS journal_entry_id
FROM {events}
UNION ALL
SELECT 1000000000000000 + p.id AS id, p.bank_account_id,
       CAST(CASE p.id % 4 WHEN 0 THEN p.payment_date WHEN 1 THEN p.payment_date + INTERVAL 1 DAY
                 WHEN 2 THEN p.payment_date + INTERVAL 2 DAY ELSE p.payment_date + INTERVAL 5 DAY END AS DATE)
           AS transaction_date,
       'deposit' AS description, p.payment_number AS reference, p.amount,
       CAST(NULL AS DECIMAL(20,4)) AS running_balance, p.id % 5 = 0 AS is_reconciled,
       CASE WHEN p.id % 2 = 0 THEN p.id ELSE CAST(NULL AS BIGINT) END AS payment_id,
       CAST(NULL AS BIGINT) AS journal_entry_id
FROM {payments} p
WHERE p.method = 'bank_transfer'""")

# Statements agree with the reconciled books, but for some that are off by 12.50 and some that hold open items.
_STATEMENT = ("CASE WHEN month(x.period_end_date) % 5 = 0 THEN x.balance + 12.5 WHEN month(x.period_end_date) % 7 = 0 "
              "THEN x.total ELSE x.balance END")
_table("bank_reconciliations", ["bank_transactions", "bank_accounts"], f"""
SELECT CAST(x.bank_account_id * 1000 + (year(x.period_end_date) - 1990) * 12 + month(x.period_end_date) AS INT) AS id,
       x.bank_account_id, x.period_end_date, CAST({_STATEMENT} AS DECIMAL(20,4)) AS statement_balance,
       CAST(x.balance AS DECIMAL(20,4)) AS book_balance,
       CAST({_STATEMENT} - x.balance AS DECIMAL(20,4)) AS difference,
       {_STATEMENT} = x.balance AS is_completed
FROM (
  SELECT m.bank_account_id, m.period_end_date,
         a.opening_balance + SUM(m.booked) OVER (PARTITION BY m.bank_account_id ORDER BY m.period_end_date) AS balance,
         a.opening_balance + SUM(m.moved) OVER (PARTITION BY m.bank_account_id ORDER BY m.period_end_date) AS total
  FROM (SELECT bank_account_id, last_day(transaction_date) AS period_end_date, SUM(amount) AS moved,
               SUM(CASE WHEN is_reconciled THEN amount ELSE 0 END) AS booked
        FROM {{bank_transactions}} GROUP BY bank_account_id, last_day(transaction_date)) m
  JOIN {{bank_accounts}} a ON a.id = m.bank_account_id
) x""")

_table("units_of_measure", ["region"], """
SELECT CAST(r_regionkey + 1 AS INT) AS id, CAST(r_regionkey + 1 AS INT) AS company_id,
       'EA' AS code, 'Each' AS name, 'quantity' AS category
FROM {region}""")

_BRAND = "CAST(substr(p_brand, 7) AS INT)"
_table("product_categories", ["part"], f"""
SELECT {_BRAND} AS id, 1 AS company_id, 'B' || CAST({_BRAND} AS STRING) AS code, p_brand AS name,
       CAST(CASE WHEN {_BRAND} <= 5 THEN NULL ELSE {_BRAND} % 5 + 1 END AS INT) AS parent_id,
       CAST(CASE WHEN {_BRAND} % 2 = 0 THEN 103 ELSE NULL END AS INT) AS inventory_account_id,
       CAST(CASE WHEN {_BRAND} % 2 = 0 THEN 108 ELSE NULL END AS INT) AS cogs_account_id,
       CAST(CASE WHEN {_BRAND} % 2 = 0 THEN 107 ELSE NULL END AS INT) AS revenue_account_id
FROM {{part}}
GROUP BY p_brand""")

_table("products", ["part"], f"""
SELECT p_partkey AS id, 1 AS company_id, 'SKU-' || lpad(CAST(p_partkey AS STRING), 8, '0') AS sku,
       p_name AS name, {_BRAND} AS category_id, 1 AS uom_id,
       CAST(CASE WHEN p_size % 4 = 0 THEN 12 ELSE 1 END AS DECIMAL(20,6)) AS uom_conversion,
       CASE p_partkey % 3 WHEN 0 THEN 'fifo' WHEN 1 THEN 'average_cost' ELSE 'standard_cost' END
           AS valuation_method,
       CAST(p_retailprice AS DECIMAL(20,4)) AS standard_cost,
       CAST(0 AS DECIMAL(20,4)) AS last_purchase_price,
       CAST(CAST(p_retailprice AS DECIMAL(20,4)) * 0.8 AS DECIMAL(20,4)) AS average_cost,
       CAST(CAST(p_retailprice AS DECIMAL(20,4)) * 1.25 AS DECIMAL(20,4)) AS sale_price,
       CAST(p_size AS DECIMAL(20,4)) AS reorder_point,
       CAST(p_size * 2 AS DECIMAL(20,4)) AS reorder_qty,
       CAST(CAST(p_size AS DECIMAL(20,4)) * 0.5 AS DECIMAL(20,4)) AS min_stock,
       CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 20 ELSE NULL END AS DECIMAL(20,4)) AS max_stock,
       p_partkey % 50 <> 0 AS is_tracked, TRUE AS is_active,
       CAST(CASE WHEN p_partkey % 11 = 0 THEN 109 ELSE NULL END AS INT) AS inventory_account_id,
       CAST(NULL AS INT) AS cogs_account_id, CAST(NULL AS INT) AS revenue_account_id
FROM {{part}}""")

_table("warehouses", ["supplier"], """
SELECT CAST(CASE WHEN s_suppkey % 10 < 5 THEN 1 ELSE 2 END AS INT) AS id, 1 AS company_id,
       'WH' || CAST(CASE WHEN s_suppkey % 10 < 5 THEN 1 ELSE 2 END AS STRING) AS code,
       CASE WHEN s_suppkey % 10 < 5 THEN 'Main Warehouse' ELSE 'Second Warehouse' END AS name,
       TRUE AS is_active
FROM {supplier}
GROUP BY CASE WHEN s_suppkey % 10 < 5 THEN 1 ELSE 2 END,
         CASE WHEN s_suppkey % 10 < 5 THEN 'Main Warehouse' ELSE 'Second Warehouse' END""")

_table("warehouse_locations", ["supplier"], """
SELECT CAST(k + 1 AS INT) AS id, CAST(CASE WHEN k < 5 THEN 1 ELSE 2 END AS INT) AS warehouse_id,
       'L' || CAST(k AS STRING) AS code, 'Bin ' || CAST(k AS STRING) AS name,
       CAST(CASE WHEN k % 5 = 0 THEN NULL ELSE k END AS INT) AS parent_id,
       CASE WHEN k % 5 = 0 THEN 'input' ELSE 'storage' END AS location_type, TRUE AS is_active
FROM (SELECT s_suppkey % 10 AS k FROM {supplier} GROUP BY s_suppkey % 10) t""")

_table("stock_moves", ["line_src"], f"""
SELECT s.l_orderkey * 100 + s.rn AS id, 1 AS company_id,
       'MV-' || CAST(s.l_orderkey * 100 + s.rn AS STRING) AS move_number,
       CASE s.l_returnflag WHEN 'N' THEN 'purchase_receipt' WHEN 'A' THEN 'sale_delivery'
            ELSE 'transfer' END AS move_type,
       CAST(s.l_shipdate AS DATE) AS move_date, s.l_partkey AS product_id, 1 AS uom_id,
       CAST(CASE WHEN s.l_returnflag = 'N' THEN NULL ELSE s.l_suppkey % 10 + 1 END AS INT) AS from_location_id,
       CAST(CASE s.l_returnflag WHEN 'N' THEN s.l_suppkey % 10 + 1
                 WHEN 'R' THEN (s.l_suppkey + 1) % 10 + 1 ELSE NULL END AS INT) AS to_location_id,
       CAST(s.l_quantity AS DECIMAL(20,6)) AS quantity,
       CASE WHEN s.l_discount = 0 THEN CAST(0 AS DECIMAL(20,4))
            ELSE {_dec4_from_1e4(_unit_price_1e4('s'))} END AS unit_cost,
       CASE WHEN s.l_discount = 0 THEN CAST(0 AS DECIMAL(20,4))
            ELSE {_dec4_from_1e4(f"CAST(s.l_quantity AS BIGINT) * {_unit_price_1e4('s')}")} END AS total_cost,
       s.l_orderkey AS invoice_id, CAST(NULL AS BIGINT) AS journal_entry_id,
       CASE WHEN s.l_returnflag = 'A' THEN s.l_orderkey * 100 + s.rn END AS sales_order_line_id,
       CASE WHEN s.l_returnflag = 'N' THEN s.l_orderkey * 100 + s.rn END AS purchase_order_line_id,
       s.l_linestatus = 'F' AS is_posted
FROM {{line_src}} s""")

_table("sales_orders", ["order_head"], """
SELECT o_orderkey AS id, company_id, 'SO-' || CAST(o_orderkey AS STRING) AS so_number,
       CASE o_orderstatus WHEN 'F' THEN 'invoiced' WHEN 'O' THEN 'confirmed' ELSE 'shipped' END AS status,
       CAST(o_custkey * 2 AS BIGINT) AS customer_id, odate AS order_date, 'USD' AS currency, 1 AS warehouse_id,
       CAST(o_totalprice AS DECIMAL(20,4)) AS subtotal, CAST(0 AS DECIMAL(20,4)) AS tax_amount,
       CAST(o_totalprice AS DECIMAL(20,4)) AS total_amount,
       CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS DECIMAL(20,4)) AS amount_invoiced
FROM {order_head}""")

_table("sales_order_lines", ["line_src"], f"""
SELECT s.l_orderkey * 100 + s.rn AS id, s.l_orderkey AS so_id, CAST(s.rn AS SMALLINT) AS line_number,
       s.l_partkey AS product_id, 'Part ' || CAST(s.l_partkey AS STRING) AS description,
       CAST(s.l_quantity AS DECIMAL(20,6)) AS quantity,
       CAST(CASE WHEN s.l_returnflag = 'A' AND s.l_linestatus = 'F' THEN s.l_quantity ELSE 0 END
            AS DECIMAL(20,6)) AS qty_delivered,
       CAST(CASE WHEN s.l_linestatus = 'F' THEN s.l_quantity ELSE 0 END AS DECIMAL(20,6)) AS qty_invoiced,
       {_dec4_from_1e4(_unit_price_1e4('s'))} AS unit_price,
       CAST(ROUND(s.l_discount * 100) AS DECIMAL(6,4)) AS discount_pct,
       {_dec4_from_1e4(_line_amount_1e4('s'))} AS line_amount,
       CAST({_tax_pct('s')} + 1 AS INT) AS tax_code_id
FROM {{line_src}} s""")

_PO_ID = ("CAST(2000000000000000 + s.l_suppkey * 1000000 + year(s.l_shipdate) * 100 + month(s.l_shipdate) "
          "AS BIGINT)")
_table("purchase_orders", ["line_src", "supplier", "nation"], f"""
SELECT {_PO_ID} AS id, CAST(n.n_regionkey + 1 AS INT) AS company_id,
       'PO-' || CAST(s.l_suppkey AS STRING) || '-' || CAST(year(s.l_shipdate) * 100 + month(s.l_shipdate) AS STRING)
           AS po_number,
       CASE month(s.l_shipdate) % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'received' ELSE 'invoiced' END AS status,
       CAST(s.l_suppkey * 2 + 1 AS BIGINT) AS vendor_id,
       make_date(CAST(year(s.l_shipdate) AS INT), CAST(month(s.l_shipdate) AS INT), 1) AS order_date,
       'USD' AS currency, 1 AS warehouse_id,
       CAST(SUM({_dec4_from_1e4(_line_amount_1e4('s'))}) AS DECIMAL(20,4)) AS subtotal,
       CAST(0 AS DECIMAL(20,4)) AS tax_amount,
       CAST(SUM({_dec4_from_1e4(_line_amount_1e4('s'))}) AS DECIMAL(20,4)) AS total_amount,
       CAST(SUM(CASE WHEN s.l_linestatus = 'F' THEN {_dec4_from_1e4(_line_amount_1e4('s'))} ELSE 0 END)
            AS DECIMAL(20,4)) AS amount_billed
FROM {{line_src}} s
JOIN {{supplier}} sp ON sp.s_suppkey = s.l_suppkey
JOIN {{nation}} n ON n.n_nationkey = sp.s_nationkey
WHERE s.l_returnflag = 'N'
GROUP BY {_PO_ID}, n.n_regionkey, s.l_suppkey, year(s.l_shipdate), month(s.l_shipdate)""")

_table("purchase_order_lines", ["line_src"], f"""
SELECT s.l_orderkey * 100 + s.rn AS id, {_PO_ID} AS po_id,
       CAST(row_number() OVER (PARTITION BY {_PO_ID} ORDER BY s.l_orderkey, s.rn) AS SMALLINT) AS line_number,
       s.l_partkey AS product_id, 'Part ' || CAST(s.l_partkey AS STRING) AS description,
       CAST(s.l_quantity AS DECIMAL(20,6)) AS quantity,
       CAST(CASE WHEN s.l_linestatus = 'F' THEN s.l_quantity ELSE 0 END AS DECIMAL(20,6)) AS qty_received,
       CAST(CASE WHEN s.l_linestatus = 'F' AND s.l_tax > 0 THEN s.l_quantity ELSE 0 END AS DECIMAL(20,6))
           AS qty_billed,
       {_dec4_from_1e4(_unit_price_1e4('s'))} AS unit_price,
       CAST(ROUND(s.l_discount * 100) AS DECIMAL(6,4)) AS discount_pct,
       {_dec4_from_1e4(_line_amount_1e4('s'))} AS line_amount,
       CAST({_tax_pct('s')} + 1 AS INT) AS tax_code_id
FROM {{line_src}} s
WHERE s.l_returnflag = 'N'""")

_table("stock_quantities", ["stock_moves"], """
SELECT product_id * 16 + location_id AS id, product_id, location_id,
       CAST(SUM(q) + CASE WHEN product_id % 211 = 0 THEN 1 ELSE 0 END AS DECIMAL(20,6)) AS quantity,
       CAST(CASE WHEN product_id % 5 = 0 THEN 2 ELSE 0 END AS DECIMAL(20,6)) AS reserved_qty,
       CAST(SUM(q) + CASE WHEN product_id % 211 = 0 THEN 1 ELSE 0 END
            - CASE WHEN product_id % 5 = 0 THEN 2 ELSE 0 END AS DECIMAL(20,6)) AS available_qty
FROM (SELECT product_id, to_location_id AS location_id, quantity AS q FROM {stock_moves}
      WHERE is_posted AND to_location_id IS NOT NULL
      UNION ALL
      SELECT product_id, from_location_id, -quantity FROM {stock_moves}
      WHERE is_posted AND from_location_id IS NOT NULL) legs
GROUP BY product_id, location_id""")

# Some layers hold more than they received, less than nothing, or name no move.
_LEFT = "CASE id % 503 WHEN 0 THEN quantity + 1 WHEN 1 THEN -1 ELSE quantity * (id % 2) END"
_table("inventory_cost_layers", ["stock_moves"], f"""
SELECT id, product_id, to_location_id AS location_id,
       CASE WHEN id % 1009 = 0 THEN -id ELSE id END AS stock_move_id, move_date AS received_date,
       quantity AS original_qty, CAST({_LEFT} AS DECIMAL(20,6)) AS remaining_qty, unit_cost,
       CAST(CAST({_LEFT} AS DECIMAL(18,0)) * unit_cost AS DECIMAL(20,4)) AS total_cost
FROM {{stock_moves}}
WHERE is_posted AND move_type = 'purchase_receipt'""")

LEDGER_TABLES = [t for t in _T if t not in ("order_head", "line_src", "project_costs")]

# Declared columns that the texts above leave out. Only the audit reads them;
# their values follow from the row's id and the column's declaration, and one
# row in every ``FAULT_EVERY`` breaks the column's rule.
DECLARED_ONLY = {
    "currencies": "symbol created_at",
    "exchange_rates": "created_at",
    "companies": "tax_id address_line1 address_line2 city state postal_code country phone email "
                 "website logo_url created_at updated_at",
    "fiscal_years": "created_at",
    "accounting_periods": "created_at",
    "account_groups": "sort_order created_at",
    "accounts": "description created_at updated_at",
    "journal_entries": "posted_at posted_by created_by created_at updated_at",
    "journal_entry_lines": "is_reconciled reconciled_at reconciliation_id created_at",
    "projects": "start_date end_date",
    "contacts": "reference tax_id email phone website address_line1 address_line2 city state "
                "postal_code country tax_code_id notes created_at updated_at",
    "invoices": "reference notes created_by created_at updated_at",
    "payments": "reference notes created_at",
    "payment_allocations": "created_at",
    "bank_accounts": "bank_name account_number routing_number swift_code iban created_at",
    "bank_transactions": "reconciliation_id created_at",
    "bank_reconciliations": "completed_at created_at",
    "product_categories": "purchase_price_variance_id",
    "products": "description purchase_uom_id is_purchasable is_sellable tax_code_purchase_id "
                "tax_code_sale_id weight weight_uom barcode created_at updated_at",
    "warehouses": "address_line1 city country",
    "stock_quantities": "updated_at",
    "stock_moves": "reference description purchase_order_id sales_order_id posted_at created_by "
                   "created_at",
    "inventory_cost_layers": "created_at",
    "purchase_orders": "expected_date exchange_rate amount_received_pct notes reference created_by "
                       "created_at updated_at",
    "purchase_order_lines": "uom_id tax_amount account_id",
    "sales_orders": "expected_date exchange_rate notes reference created_by created_at updated_at",
    "sales_order_lines": "uom_id tax_amount account_id",
}
FACTS = {"journal_entries", "journal_entry_lines", "invoices", "invoice_lines", "payments", "payment_allocations",
         "bank_transactions", "stock_quantities", "stock_moves", "inventory_cost_layers", "purchase_orders",
         "purchase_order_lines", "sales_orders", "sales_order_lines", "contacts", "products"}
FAULT_EVERY = {True: 1009, False: 5}  # facts and long lists, short lists
REPEATED = ["cost_centers", "tax_codes", "warehouse_locations", "payments"]  # one row in every FAULT_EVERY is there twice
MISTYPED = {("products", "weight"): "DECIMAL(20,4)", ("purchase_orders", "amount_received_pct"): "DECIMAL(20,4)"}
_PARENT_IDS = {"tax_codes": "id % 5 + 1", "units_of_measure": "1", "accounts": "103",
               "sales_orders": "invoice_id", "purchase_orders": "NULL",
               "bank_reconciliations": "CASE WHEN is_reconciled THEN bank_account_id * 1000 "
                                       "+ (year(transaction_date) - 1990) * 12 + month(transaction_date) END"}


def _declared_value(table: str, i: int, c: S.Column) -> str:
    """The i-th column that ``table`` declares beyond the mapped ones, as an expression over its rows."""
    fault = f"(id + {i}) % {FAULT_EVERY[table in FACTS]} = 0"
    parent = next((p for t, name, p, _ in S.FOREIGN_KEYS if (t, name) == (table, c.name)), None)
    wrong = "NULL"
    if parent:
        value, wrong = _PARENT_IDS[parent], "-1"
    elif c.type == "STRING":
        value = f"'{c.name} ' || CAST(id AS STRING)"
        if c.length:
            value, wrong = f"substr({value}, 1, {c.length})", f"rpad('x', {c.length + 1}, 'x')"
    elif c.type == "TIMESTAMP":
        value = "CAST('2001-01-01 08:00:00' AS TIMESTAMP)"
    elif c.type == "DATE":
        value = "CAST('2001-02-01' AS DATE)"
    elif c.type == "BOOLEAN":
        value = "id % 2 = 0"
    else:
        value = "id % 1000"
        if (table, c.name) in MISTYPED:
            wrong = "100000000"
    return f"CAST(CASE WHEN {fault} THEN {wrong} ELSE {value} END AS {MISTYPED.get((table, c.name), c.type)}) AS {c.name}"


def declared_sql(table: str) -> str:
    """``table`` with every declared column, wrong values of its enum columns and repeated rows, over ``{table}``."""
    every = FAULT_EVERY[table in FACTS]
    wrong = {c: f"CASE WHEN (id + {i}) % {every} = 2 THEN 'unknown' ELSE {c} END AS {c}"
             for i, (t, c, _) in enumerate(S.ENUM_COLUMNS) if t == table}
    extra = DECLARED_ONLY.get(table, "").split()
    cols = [_declared_value(table, extra.index(c.name), c) if c.name in extra else wrong.get(c.name, c.name)
            for c in S.COLUMNS[table]]
    text = f"SELECT {', '.join(cols)} FROM {{{table}}}"
    return f"{text} UNION ALL {text} WHERE id % {every} = 3" if table in REPEATED else text

_LEGS = {
    "spark": "LATERAL VIEW explode(array(1, 2)) lg AS leg",
    "duckdb": "JOIN (SELECT unnest([1, 2]) AS leg) lg ON TRUE",
}


def table_sql(name: str, dialect: str) -> tuple[str, list[str]]:
    sql, deps = _T[name]
    return sql.replace("$LEGS$", _LEGS[dialect]), deps


def _closure(names) -> list[str]:
    """Dependency-ordered list of fixture tables needed by ``names``."""
    out: list[str] = []

    def visit(n):
        if n in RAW_TABLES or n in out:
            return
        for d in _T[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def duckdb_with(names, prefix: str = "") -> str:
    """``WITH`` clause defining the listed ledger tables, their names prefixed, for the DuckDB oracle."""
    parts = []
    for n in _closure(names):
        sql, deps = table_sql(n, "duckdb")
        parts.append(f"{prefix}{n} AS ({sql.format(**{d: d if d in RAW_TABLES else prefix + d for d in deps})})")
    return "WITH " + ",\n".join(parts) + "\n"


def _row_wise(name: str) -> bool:
    """Whether every row of ``name`` comes from one row of one other ledger table."""
    sql, deps = _T[name]
    return len(deps) == 1 and deps[0] not in RAW_TABLES and not re.search(r"\b(JOIN|GROUP BY|OVER|UNION)\b", sql)


#: Bytes of line item files per task that numbers them and joins them with their orders (about 700,000 rows).
TASK_BYTES = 8 << 20


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over a number of tasks that grows with its files.

    Adaptive execution sizes tasks by compressed shuffle bytes, of which the
    line items have so few that a task would sort and join millions of rows.
    A table of a few tasks' size is left to it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = -(-size // TASK_BYTES)
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


#: Internal tables that others join and window by this key; written, they are bucketed by it.
KEYED = {"line_src": "l_orderkey", "order_head": "o_orderkey"}
MAX_BUCKETS = 100_000  # spark.sql.sources.bucketing.maxBuckets


@dataclass
class Ledger:
    """Lazily built ledger tables over one directory of driver tables."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        key = ("raw", name)
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[key]

    def __getitem__(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            return self.raw(name)
        if name not in self._cache:
            sql, deps = table_sql(name, "spark")
            frames = {d: self[d] for d in deps}
            if name == "line_src":
                frames["lineitem"] = _dealt(frames["lineitem"], "l_orderkey")
            self._cache[name] = self.spark.sql(sql, **frames)
        return self._cache[name]

    def _buckets(self) -> int:
        """Buckets of the ``KEYED`` tables: as many as the tasks line items are dealt over."""
        size = int(str(self.raw("lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return min(max(-(-size // TASK_BYTES), self.spark.sparkContext.defaultParallelism), MAX_BUCKETS)

    def _write(self, name: str) -> DataFrame:
        """``name`` written under the shared checkpoint folder and read back, by its key if it has one."""
        from kontor.session import COMPACT, scratch_path, stored_by
        if name not in KEYED:
            path = scratch_path(self.spark, name)
            self[name].write.options(**COMPACT).parquet(path)
            return self.spark.read.parquet(path)
        key, n = KEYED[name], self._buckets()
        sql, deps = table_sql(name, "spark")
        frames = {d: self[d] for d in deps}
        if name == "line_src":  # numbered where it is dealt
            return stored_by(self.spark.sql(sql, lineitem=frames["lineitem"].repartition(n, key)), name, key, n)
        return stored_by(self.spark.sql(sql, **frames).repartition(n, key), name, key, n)

    def materialize(self, names) -> dict:
        """Write the listed tables once as Parquet under the shared checkpoint
        folder and return them read back (lineage cut: consumers scan files
        instead of re-deriving the mapping). Tables whose rows each come from
        one row of another written one are not written again: a scan maps them.

        Tables are written level by level in dependency order and each level
        reads the previous one from disk, so shared intermediates (the numbered
        line items, the order headers) are computed once. Within a level the
        writes are independent jobs and run concurrently.
        """
        from concurrent.futures import ThreadPoolExecutor

        todo = [n for n in _closure(names) if ("mat", n) not in self._cache]
        level: dict[str, int] = {}
        for n in todo:  # _closure is dependency-ordered
            level[n] = 1 + max([level.get(d, 0) for d in _T[n][1] if d not in RAW_TABLES] or [0])

        for lv in sorted(set(level.values())):
            for n in [n for n in todo if level[n] == lv and _row_wise(n)]:
                self._cache[("mat", n)] = self[n]
            batch = [n for n in todo if level[n] == lv and not _row_wise(n)]
            if not batch:
                continue
            with ThreadPoolExecutor(max_workers=8) as pool:  # plans over the previous levels' files
                for n, df in zip(batch, list(pool.map(self._write, batch))):
                    self._cache[("mat", n)] = df
                    self._cache[n] = df           # later levels read the file
        return {n: self._cache[("mat", n)] for n in names}

    def declared(self, names) -> dict:
        """The listed tables, materialised, with every declared column (see ``DECLARED_ONLY``)."""
        return {n: self.spark.sql(declared_sql(n), **{n: df}) for n, df in self.materialize(names).items()}

    def __contains__(self, name: str) -> bool:
        return name in LEDGER_TABLES or name in RAW_TABLES

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "sf_dir"):
            raise AttributeError(name)
        return self[name]


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    return Ledger(spark, sf_dir)
