"""Registered queries: a Spark plan per operator plus an independent SQL oracle.

Each query reads the driver tables of one scale directory through the
fixture mapping (``sources.fixture``) and runs one library operator over the
whole tables. The oracle text is DuckDB SQL over the same mapping (shared as
CTEs) with the operator written independently in SQL, so the comparison
checks the operator, not the mapping. Output columns are aliased and cast
identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kontor.operators import reports as R
from kontor.sources import fixture as FX

AS_OF = FX.AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, tables: list[str] | None = None, sql: str | None = None):
    """Decorator: register a query and, when given, its oracle SQL."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle_text(tables or [], sql)
        return fn
    return deco


def oracle_text(tables: list[str], sql: str) -> str:
    """Prefix the fixture CTEs; a query with its own WITH joins the same list."""
    body = sql.strip()
    if not tables:
        return body
    head = FX.duckdb_with(tables)
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + head[5:].rstrip() + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return head.rstrip() + ",\n" + body[5:]
    return head + body


def L(spark: SparkSession, sf_dir: str) -> FX.Ledger:
    return FX.ledger(spark, sf_dir)


S30 = "DECIMAL(30,4)"

# --- A1 trial balance ---------------------------------------------------------------------

_TB_SQL = f"""
SELECT acc.company_id, acc.code AS account_code, acc.name AS account_name, acc.category, acc.normal_balance,
       CAST(COALESCE(mv.d, 0) AS {S30}) AS total_debit,
       CAST(COALESCE(mv.c, 0) AS {S30}) AS total_credit,
       CAST((CASE WHEN acc.normal_balance = 'debit' THEN COALESCE(mv.d, 0) - COALESCE(mv.c, 0)
                  WHEN acc.normal_balance = 'credit' THEN COALESCE(mv.c, 0) - COALESCE(mv.d, 0) END)
            {{opening}} AS {S30}) AS balance
FROM accounts acc
LEFT JOIN (SELECT account_id, SUM(debit_base) AS d, SUM(credit_base) AS c
           FROM {{lines}} x GROUP BY account_id) mv ON mv.account_id = acc.id
"""


@register("trial_balance", ["accounts", "journal_entry_lines"],
          _TB_SQL.format(opening="", lines="journal_entry_lines"))
def q_trial_balance(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.trial_balance(lg.accounts, lg.journal_entry_lines)


@register("trial_balance_posted", ["accounts", "journal_entry_lines", "journal_entries"],
          _TB_SQL.format(opening="", lines="""(SELECT x.* FROM journal_entry_lines x
                 JOIN journal_entries e ON e.id = x.journal_entry_id WHERE e.status = 'posted')"""))
def q_trial_balance_posted(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.trial_balance(lg.accounts, lg.journal_entry_lines, lg.journal_entries, posted_only=True)


@register("trial_balance_with_opening", ["accounts", "journal_entry_lines"],
          _TB_SQL.format(opening="+ acc.opening_balance", lines="journal_entry_lines"))
def q_trial_balance_with_opening(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.trial_balance(lg.accounts, lg.journal_entry_lines, with_opening=True)


# --- V1 general ledger --------------------------------------------------------------------

@register("general_ledger",
          ["journal_entries", "journals", "accounting_periods", "journal_entry_lines", "accounts",
           "contacts", "cost_centers", "projects"], """
WITH posted AS (
  SELECT e.id, e.company_id, e.entry_date, e.entry_number, e.status, j.name AS journal_name,
         per.name AS period_name
  FROM journal_entries e, journals j, accounting_periods per
  WHERE e.status = 'posted' AND j.id = e.journal_id AND per.id = e.period_id),
ln AS (
  SELECT x.*, acct.code AS account_code, acct.name AS account_name, acct.category AS account_category
  FROM journal_entry_lines x, accounts acct WHERE acct.id = x.account_id)
SELECT posted.company_id, posted.period_name, posted.entry_date, posted.entry_number, posted.journal_name,
       ln.account_code, ln.account_name, ln.account_category, ln.description AS line_description,
       ln.debit_amount, ln.credit_amount, ln.debit_base, ln.credit_base,
       (SELECT name FROM contacts WHERE id = ln.contact_id) AS contact_name,
       (SELECT name FROM cost_centers WHERE id = ln.cost_center_id) AS cost_center,
       (SELECT name FROM projects WHERE id = ln.project_id) AS project,
       posted.status
FROM posted JOIN ln ON ln.journal_entry_id = posted.id
""")
def q_general_ledger(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.general_ledger(lg.journal_entries, lg.journals, lg.accounting_periods, lg.journal_entry_lines,
                            lg.accounts, lg.contacts, lg.cost_centers, lg.projects)


# --- A2 unbalanced entries / A3 entry totals -------------------------------------------------

@register("unbalanced_entries", ["journal_entries", "journal_entry_lines"], f"""
WITH t AS (SELECT journal_entry_id, SUM(debit_amount) AS d, SUM(credit_amount) AS c
           FROM journal_entry_lines GROUP BY journal_entry_id)
SELECT e.id, e.company_id, e.entry_number, e.entry_date, CAST(t.d AS {S30}) AS total_debit,
       CAST(t.c AS {S30}) AS total_credit, CAST(t.d - t.c AS {S30}) AS difference
FROM t JOIN journal_entries e ON e.id = t.journal_entry_id
WHERE t.d <> t.c
""")
def q_unbalanced_entries(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.unbalanced_entries(lg.journal_entries, lg.journal_entry_lines)


@register("entry_totals", ["journal_entry_lines"], f"""
SELECT journal_entry_id, CAST(COALESCE(SUM(debit_amount), 0) AS {S30}) AS total_debit,
       CAST(COALESCE(SUM(credit_amount), 0) AS {S30}) AS total_credit
FROM journal_entry_lines GROUP BY journal_entry_id
""")
def q_entry_totals(spark, sf_dir):
    return R.entry_totals(L(spark, sf_dir).journal_entry_lines)


# --- V2 / V3 aging ----------------------------------------------------------------------------

_AGING_SQL = """
SELECT company_id, {party}_id, {party}_name, invoice_number, invoice_date, due_date, total_amount,
       amount_paid, amount_due, days_overdue,
       CASE WHEN days_overdue <= 0 THEN 'current' WHEN days_overdue <= 30 THEN '1–30 days'
            WHEN days_overdue <= 60 THEN '31–60 days' WHEN days_overdue <= 90 THEN '61–90 days'
            ELSE 'over 90 days' END AS aging_bucket
FROM (SELECT inv.company_id, inv.contact_id AS {party}_id, ct.name AS {party}_name, inv.invoice_number,
             inv.invoice_date, inv.due_date, inv.total_amount, inv.amount_paid, inv.amount_due,
             CAST(DATE '{as_of}' - inv.due_date AS INTEGER) AS days_overdue
      FROM invoices inv, contacts ct
      WHERE ct.id = inv.contact_id AND inv.type = '{itype}' AND inv.status NOT IN ('paid', 'voided', 'draft')) o
"""


@register("ar_aging", ["invoices", "contacts"], _AGING_SQL.format(party="customer", itype="sale", as_of=AS_OF))
def q_ar_aging(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.ar_aging(lg.invoices, lg.contacts, AS_OF)


@register("ap_aging", ["invoices", "contacts"], _AGING_SQL.format(party="vendor", itype="purchase", as_of=AS_OF))
def q_ap_aging(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.ap_aging(lg.invoices, lg.contacts, AS_OF)


_AR_ROWS = "(" + _AGING_SQL.format(party="customer", itype="sale", as_of=AS_OF) + ")"


@register("aging_summary", ["invoices", "contacts"], f"""
SELECT company_id, customer_id,
       CAST(SUM(CASE WHEN aging_bucket = 'current' THEN amount_due ELSE 0 END) AS {S30}) AS current,
       CAST(SUM(CASE WHEN aging_bucket = '1–30 days' THEN amount_due ELSE 0 END) AS {S30}) AS d1_30,
       CAST(SUM(CASE WHEN aging_bucket = '31–60 days' THEN amount_due ELSE 0 END) AS {S30}) AS d31_60,
       CAST(SUM(CASE WHEN aging_bucket = '61–90 days' THEN amount_due ELSE 0 END) AS {S30}) AS d61_90,
       CAST(SUM(CASE WHEN aging_bucket = 'over 90 days' THEN amount_due ELSE 0 END) AS {S30}) AS over_90,
       CAST(SUM(amount_due) AS {S30}) AS total_due
FROM {_AR_ROWS} ar GROUP BY company_id, customer_id
""")
def q_aging_summary(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.aging_summary(R.ar_aging(lg.invoices, lg.contacts, AS_OF))


@register("aging_rollup", ["invoices", "contacts"], f"""
SELECT company_id, customer_id, aging_bucket, CAST(SUM(amount_due) AS {S30}) AS amount_due,
       CAST(COUNT(*) AS BIGINT) AS invoices,
       CAST(GROUPING(company_id, customer_id, aging_bucket) AS BIGINT) AS grouping_level
FROM {_AR_ROWS} ar GROUP BY ROLLUP (company_id, customer_id, aging_bucket)
""")
def q_aging_rollup(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.aging_rollup(R.ar_aging(lg.invoices, lg.contacts, AS_OF))


# --- A5 / A6 / A10 summaries over the trial balance ------------------------------------------

_TB_ROWS = "(" + _TB_SQL.format(opening="", lines="journal_entry_lines") + ")"


@register("category_totals", ["accounts", "journal_entry_lines"], f"""
SELECT d.category, CAST(COALESCE(SUM(tb.balance), 0) AS {S30}) AS total_balance
FROM (SELECT unnest(['asset', 'liability', 'equity', 'revenue', 'expense']) AS category) d
LEFT JOIN {_TB_ROWS} tb ON tb.category = d.category
GROUP BY d.category
""")
def q_category_totals(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.category_totals(R.trial_balance(lg.accounts, lg.journal_entry_lines))


@register("trial_balance_totals", ["accounts", "journal_entry_lines"], f"""
SELECT CAST(SUM(CASE WHEN normal_balance = 'debit' THEN balance ELSE 0 END) AS {S30}) AS total_debit,
       CAST(SUM(CASE WHEN normal_balance = 'credit' THEN balance ELSE 0 END) AS {S30}) AS total_credit,
       CAST(SUM(CASE WHEN normal_balance = 'debit' THEN balance ELSE 0 END)
            - SUM(CASE WHEN normal_balance = 'credit' THEN balance ELSE 0 END) AS {S30}) AS difference,
       abs(SUM(CASE WHEN normal_balance = 'debit' THEN balance ELSE 0 END)
           - SUM(CASE WHEN normal_balance = 'credit' THEN balance ELSE 0 END)) < 0.01 AS is_balanced
FROM {_TB_ROWS} tb
""")
def q_trial_balance_totals(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.trial_balance_totals(R.trial_balance(lg.accounts, lg.journal_entry_lines))


@register("dashboard_kpis", ["accounts", "journal_entry_lines", "invoices"], f"""
WITH b AS (
  SELECT company_id,
         CAST(SUM(CASE WHEN category = 'asset' THEN balance ELSE 0 END) AS {S30}) AS total_assets,
         CAST(SUM(CASE WHEN category = 'revenue' THEN balance ELSE 0 END) AS {S30}) AS total_revenue,
         CAST(SUM(CASE WHEN category = 'expense' THEN balance ELSE 0 END) AS {S30}) AS total_expenses
  FROM {_TB_ROWS} tb GROUP BY company_id),
i AS (
  SELECT company_id,
         CAST(SUM(CASE WHEN type = 'sale' THEN amount_due ELSE 0 END) AS {S30}) AS accounts_receivable,
         CAST(COUNT(CASE WHEN type = 'sale' THEN 1 END) AS BIGINT) AS open_invoices,
         CAST(SUM(CASE WHEN type = 'purchase' THEN amount_due ELSE 0 END) AS {S30}) AS accounts_payable,
         CAST(COUNT(CASE WHEN type = 'purchase' THEN 1 END) AS BIGINT) AS open_bills
  FROM invoices WHERE status NOT IN ('paid', 'voided', 'draft') GROUP BY company_id)
SELECT COALESCE(b.company_id, i.company_id) AS company_id,
       COALESCE(total_assets, 0) AS total_assets, COALESCE(total_revenue, 0) AS total_revenue,
       COALESCE(total_expenses, 0) AS total_expenses,
       CAST(COALESCE(total_revenue, 0) - COALESCE(total_expenses, 0) AS {S30}) AS net_income,
       COALESCE(accounts_receivable, 0) AS accounts_receivable,
       COALESCE(open_invoices, 0) AS open_invoices,
       COALESCE(accounts_payable, 0) AS accounts_payable, COALESCE(open_bills, 0) AS open_bills
FROM b FULL JOIN i ON b.company_id = i.company_id
""")
def q_dashboard_kpis(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.dashboard_kpis(R.trial_balance(lg.accounts, lg.journal_entry_lines), lg.invoices)


# --- A9 invoice totals ------------------------------------------------------------------------

@register("invoice_totals_flat", ["invoice_lines"], f"""
SELECT invoice_id, CAST(ROUND(gross, 4) AS {S30}) AS subtotal, CAST(ROUND(gross * 0.10, 4) AS {S30}) AS tax_amount,
       CAST(ROUND(gross, 4) + ROUND(gross * 0.10, 4) AS {S30}) AS total_amount
FROM (SELECT invoice_id, CAST(SUM(CAST(quantity AS DECIMAL(18,6)) * CAST(unit_price AS DECIMAL(18,4))) AS DECIMAL(34,10))
             AS gross FROM invoice_lines GROUP BY invoice_id) x
""")
def q_invoice_totals_flat(spark, sf_dir):
    return R.invoice_totals(L(spark, sf_dir).invoice_lines, tax_mode="flat")


@register("invoice_totals_by_code", ["invoice_lines", "tax_codes"], f"""
SELECT invoice_id, CAST(SUM(line_amount) AS {S30}) AS subtotal,
       CAST(SUM(round(CAST(line_amount AS DECIMAL(20,4)) * COALESCE(t.rate, 0) * 0.01, 4)) AS {S30})
           AS tax_amount,
       CAST(SUM(line_amount) + SUM(round(CAST(line_amount AS DECIMAL(20,4)) * COALESCE(t.rate, 0) * 0.01, 4))
            AS {S30}) AS total_amount
FROM invoice_lines il LEFT JOIN tax_codes t ON t.id = il.tax_code_id
GROUP BY invoice_id
""")
def q_invoice_totals_by_code(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.invoice_totals(lg.invoice_lines, lg.tax_codes, tax_mode="by_code")


@register("contact_outstanding", ["invoices"], f"""
SELECT contact_id, type, CAST(SUM(amount_due) AS {S30}) AS amount_due, CAST(COUNT(*) AS BIGINT) AS open_count
FROM invoices WHERE status NOT IN ('paid', 'voided', 'draft') GROUP BY contact_id, type
""")
def q_contact_outstanding(spark, sf_dir):
    return R.contact_outstanding(L(spark, sf_dir).invoices)


# --- A14 / A15 / A11 dimensional reports -------------------------------------------------------

@register("dimension_pnl", ["journal_entry_lines", "accounts"], f"""
SELECT a.company_id, COALESCE(l.cost_center_id, -1) AS cost_center_id, COALESCE(l.project_id, -1) AS project_id,
       CAST(SUM(CASE WHEN a.category = 'revenue' THEN l.credit_base - l.debit_base ELSE 0 END) AS {S30}) AS revenue,
       CAST(SUM(CASE WHEN a.category = 'expense' THEN l.debit_base - l.credit_base ELSE 0 END) AS {S30}) AS expense,
       CAST(SUM(CASE WHEN a.category = 'revenue' THEN l.credit_base - l.debit_base ELSE 0 END)
            - SUM(CASE WHEN a.category = 'expense' THEN l.debit_base - l.credit_base ELSE 0 END) AS {S30}) AS profit,
       CAST(GROUPING(a.company_id, COALESCE(l.cost_center_id, -1), COALESCE(l.project_id, -1)) AS BIGINT)
           AS grouping_level
FROM journal_entry_lines l JOIN accounts a ON a.id = l.account_id
WHERE a.category IN ('revenue', 'expense')
GROUP BY CUBE (a.company_id, COALESCE(l.cost_center_id, -1), COALESCE(l.project_id, -1))
""")
def q_dimension_pnl(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.dimension_pnl(lg.journal_entry_lines, lg.accounts)


@register("project_budget", ["journal_entry_lines", "project_costs", "journal_entries", "accounts", "projects"], f"""
SELECT p.id, p.company_id, p.code, CAST(p.budget AS {S30}) AS budget, CAST(COALESCE(x.spent, 0) AS {S30}) AS actual,
       CAST(COALESCE(x.earned, 0) AS {S30}) AS revenue, CAST(p.budget - COALESCE(x.spent, 0) AS {S30}) AS remaining,
       CAST(CASE WHEN p.budget = 0 THEN 0 ELSE round(COALESCE(x.spent, 0) * 100 / p.budget, 2) END AS DECIMAL(30,2))
           AS used_pct,
       CASE WHEN p.budget IS NULL THEN 'no_budget' WHEN COALESCE(x.spent, 0) > p.budget THEN 'over'
            WHEN COALESCE(x.spent, 0) >= 0.9 * p.budget THEN 'near' ELSE 'within' END AS status
FROM projects p
LEFT JOIN (SELECT l.project_id, SUM(CASE WHEN a.category = 'expense' THEN l.debit_base - l.credit_base ELSE 0 END) AS spent,
                  SUM(CASE WHEN a.category = 'revenue' THEN l.credit_base - l.debit_base ELSE 0 END) AS earned
           FROM (SELECT journal_entry_id, account_id, project_id, debit_base, credit_base FROM journal_entry_lines
                 UNION ALL
                 SELECT journal_entry_id, account_id, project_id, debit_base, credit_base FROM project_costs) l
           JOIN journal_entries e ON e.id = l.journal_entry_id AND e.status = 'posted'
           JOIN accounts a ON a.id = l.account_id
           GROUP BY l.project_id) x ON x.project_id = p.id
""")
def q_project_budget(spark, sf_dir):
    lg = L(spark, sf_dir)
    costs = lg["project_costs"]
    return R.project_budget(lg.journal_entry_lines.select(*costs.columns).unionByName(costs), lg.accounts,
                            lg.journal_entries, lg.projects)


@register("contact_pnl", ["journal_entry_lines", "accounts"], f"""
SELECT company_id, contact_id, CAST(SUM(rev) AS {S30}) AS revenue, CAST(SUM(ex) AS {S30}) AS expense,
       CAST(SUM(rev) - SUM(ex) AS {S30}) AS profit, CAST(GROUPING(company_id, contact_id) AS BIGINT) AS grouping_level
FROM (SELECT a.company_id, COALESCE(CAST(l.contact_id AS BIGINT), -1) AS contact_id,
             CASE WHEN a.category = 'revenue' THEN l.credit_base - l.debit_base ELSE 0 END AS rev,
             CASE WHEN a.category = 'expense' THEN l.debit_base - l.credit_base ELSE 0 END AS ex
      FROM journal_entry_lines l JOIN accounts a ON a.id = l.account_id WHERE a.category IN ('revenue', 'expense')) x
GROUP BY ROLLUP (company_id, contact_id)
""")
def q_contact_pnl(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.contact_pnl(lg.journal_entry_lines, lg.accounts)


@register("ledger_by_period", ["journal_entry_lines", "journal_entries", "accounting_periods"], f"""
SELECT ap.company_id, ap.name AS period_name, l.account_id,
       CAST(SUM(l.debit_base) AS {S30}) AS total_debit, CAST(SUM(l.credit_base) AS {S30}) AS total_credit,
       CAST(GROUPING(ap.company_id, ap.name, l.account_id) AS BIGINT) AS grouping_level
FROM journal_entry_lines l JOIN journal_entries je ON je.id = l.journal_entry_id
JOIN accounting_periods ap ON ap.id = je.period_id
WHERE je.status = 'posted'
GROUP BY ROLLUP (ap.company_id, ap.name, l.account_id)
""")
def q_ledger_by_period(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.ledger_by_period(lg.journal_entry_lines, lg.journal_entries, lg.accounting_periods)


@register("period_change_pct", ["journal_entry_lines", "journal_entries", "accounts"], f"""
WITH m AS (
  SELECT a.company_id, CAST(date_trunc('month', je.entry_date) AS DATE) AS month,
         CAST(SUM(l.debit_base) - SUM(l.credit_base) AS {S30}) AS net_movement
  FROM journal_entry_lines l JOIN accounts a ON a.id = l.account_id
  JOIN journal_entries je ON je.id = l.journal_entry_id
  WHERE a.category = 'asset' AND je.status = 'posted'
  GROUP BY a.company_id, CAST(date_trunc('month', je.entry_date) AS DATE))
SELECT company_id, month, net_movement,
       CAST(CASE WHEN lag(net_movement) OVER w IS NULL OR lag(net_movement) OVER w = 0 THEN NULL
            ELSE CAST(sign(net_movement - lag(net_movement) OVER w)
                      * ((2 * abs(CAST((net_movement - lag(net_movement) OVER w) * 10000 AS HUGEINT)) * 10000
                          + abs(CAST(lag(net_movement) OVER w * 10000 AS HUGEINT)))
                         // (2 * abs(CAST(lag(net_movement) OVER w * 10000 AS HUGEINT)))) AS DECIMAL(20,0))
                 * 0.01 END AS DECIMAL(20,2)) AS change_pct
FROM m WINDOW w AS (PARTITION BY company_id ORDER BY month)
""")
def q_period_change_pct(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.period_change_pct(lg.journal_entry_lines, lg.journal_entries, lg.accounts)


# --- top-k and counts ---------------------------------------------------------------------------

@register("recent_entries", ["journal_entries"], """
SELECT * FROM journal_entries ORDER BY entry_date DESC, id DESC LIMIT 5
""")
def q_recent_entries(spark, sf_dir):
    return R.recent_entries(L(spark, sf_dir).journal_entries, 5)


@register("count_accounts_by_category", ["accounts"], """
SELECT category, CAST(COUNT(*) AS BIGINT) AS n FROM accounts GROUP BY category
""")
def q_count_accounts(spark, sf_dir):
    return R.count_rows(L(spark, sf_dir).accounts, ["category"])
