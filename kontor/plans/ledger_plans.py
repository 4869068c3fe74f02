"""Registered queries: posting, reversal, journal generation, FX, banking,
receivables, hierarchies and document sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.operators import banking as B
from kontor.operators import fx as X
from kontor.operators import hierarchy as H
from kontor.operators import inventory as I
from kontor.operators import posting as P
from kontor.operators import receivables as RC
from kontor.operators import sequences as SQ
from kontor.plans.catalog import AS_OF, L, register

REVERSAL_OFFSET = 1_000_000_000_000
JOURNAL_OFFSET = 2_000_000_000_000
BANK_PERIOD_END = "2024-01-15"

# --- T1 + T2 posting --------------------------------------------------------------------

_TOTALS = """(SELECT journal_entry_id, SUM(debit_amount) AS d, SUM(credit_amount) AS c
              FROM journal_entry_lines GROUP BY journal_entry_id)"""


@register("post_entries", ["journal_entries", "journal_entry_lines", "accounting_periods"], f"""
SELECT je.id, je.company_id, je.entry_number, je.status <> 'posted' AS transition,
       CASE WHEN ap.status IN ('closed', 'locked') THEN 'period ' || ap.status
            WHEN je.status <> 'posted' AND COALESCE(t.d, 0) = 0 THEN 'no lines'
            WHEN je.status <> 'posted' AND COALESCE(t.d, 0) <> COALESCE(t.c, 0) THEN 'unbalanced' END AS reason,
       CASE WHEN ap.status IN ('closed', 'locked') THEN 'period ' || ap.status
            WHEN je.status <> 'posted' AND COALESCE(t.d, 0) = 0 THEN 'no lines'
            WHEN je.status <> 'posted' AND COALESCE(t.d, 0) <> COALESCE(t.c, 0) THEN 'unbalanced' END IS NULL
           AS accepted
FROM journal_entries je
LEFT JOIN accounting_periods ap ON ap.id = je.period_id
LEFT JOIN {_TOTALS} t ON t.journal_entry_id = je.id
""")
def q_post_entries(spark, sf_dir):
    """Post every entry: the batch is the entries with status set to 'posted'."""
    lg = L(spark, sf_dir)
    e = lg.journal_entries
    cand = e.select("id", "company_id", "entry_number", "period_id").withColumn("status", F.lit("posted"))
    out = P.post_entries(cand, lg.journal_entry_lines, lg.accounting_periods, previous=e.select("id", "status"))
    return out.select("id", "company_id", "entry_number", "transition", "reason", "accepted")


@register("post_entries_insert", ["journal_entries", "accounting_periods"], """
SELECT je.id, je.status,
       CASE WHEN je.status = 'posted' AND ap.status IN ('closed', 'locked') THEN 'period ' || ap.status END
           AS reason
FROM journal_entries je LEFT JOIN accounting_periods ap ON ap.id = je.period_id
""")
def q_post_entries_insert(spark, sf_dir):
    """The entries as inserted: only the period rule applies on INSERT."""
    lg = L(spark, sf_dir)
    out = P.post_entries(lg.journal_entries.select("id", "status", "period_id"), lg.journal_entry_lines,
                         lg.accounting_periods, event="insert")
    return out.select("id", "status", "reason")


@register("reverse_entries", ["journal_entries", "journal_entry_lines"], f"""
SELECT l.id + {REVERSAL_OFFSET} AS id, l.journal_entry_id + {REVERSAL_OFFSET} AS journal_entry_id,
       l.account_id, l.credit_amount AS debit_amount, l.debit_amount AS credit_amount,
       l.credit_base AS debit_base, l.debit_base AS credit_base
FROM journal_entry_lines l JOIN journal_entries e ON e.id = l.journal_entry_id WHERE e.status = 'posted'
""")
def q_reverse_entries(spark, sf_dir):
    lg = L(spark, sf_dir)
    _, new_lines, _ = P.reverse_entries(lg.journal_entries, lg.journal_entry_lines, REVERSAL_OFFSET)
    return new_lines.select("id", "journal_entry_id", "account_id", "debit_amount", "credit_amount",
                            "debit_base", "credit_base")


_BASE = "CAST(round(CAST(amount AS DECIMAL(24,4)) * CAST(exchange_rate AS DECIMAL(20,8)), 4) AS DECIMAL(20,4))"


@register("invoice_to_journal", ["invoices", "invoice_lines", "accounts", "contacts", "tax_codes"], f"""
WITH ctl AS (
  SELECT company_id, category, min(id) AS id FROM accounts WHERE is_control GROUP BY company_id, category),
il AS (
  SELECT l.id, l.invoice_id, l.line_number, l.account_id, l.line_amount, l.tax_amount,
         t.account_id AS tax_account, i.exchange_rate,
         i.type IN ('sale', 'credit_note_purchase') AS debit_control,
         CASE WHEN i.type LIKE '%sale' THEN coalesce(c.ar_account_id, s.id) ELSE coalesce(c.ap_account_id, p.id) END AS control
  FROM invoice_lines l JOIN invoices i ON i.id = l.invoice_id LEFT JOIN tax_codes t ON t.id = l.tax_code_id
  LEFT JOIN contacts c ON c.id = i.contact_id
  LEFT JOIN ctl s ON s.company_id = i.company_id AND s.category = 'asset'
  LEFT JOIN ctl p ON p.company_id = i.company_id AND p.category = 'liability'),
legs AS (
  SELECT invoice_id, 3 * id AS line_key, line_number * 2 AS ln, account_id, line_amount AS amount,
         NOT debit_control AS is_debit, exchange_rate FROM il
  UNION ALL
  SELECT invoice_id, 3 * id + 1, line_number * 2 + 1, tax_account, tax_amount, NOT debit_control, exchange_rate
  FROM il WHERE tax_amount <> 0
  UNION ALL
  SELECT invoice_id, 3 * invoice_id + 2, 0, any_value(control), SUM(line_amount + tax_amount), any_value(debit_control),
         any_value(exchange_rate)
  FROM il GROUP BY invoice_id)
SELECT line_key + {JOURNAL_OFFSET} AS id, invoice_id + {JOURNAL_OFFSET} AS journal_entry_id,
       CAST(ln AS INTEGER) AS line_number, CAST(account_id AS INTEGER) AS account_id,
       CASE WHEN is_debit THEN CAST(amount AS DECIMAL(20,4)) ELSE CAST(0 AS DECIMAL(20,4)) END AS debit_amount,
       CASE WHEN NOT is_debit THEN CAST(amount AS DECIMAL(20,4)) ELSE CAST(0 AS DECIMAL(20,4)) END AS credit_amount,
       CASE WHEN is_debit THEN {_BASE} ELSE CAST(0 AS DECIMAL(20,4)) END AS debit_base,
       CASE WHEN NOT is_debit THEN {_BASE} ELSE CAST(0 AS DECIMAL(20,4)) END AS credit_base
FROM legs
""")
def q_invoice_to_journal(spark, sf_dir):
    lg = L(spark, sf_dir)
    _, lines = P.invoice_to_journal(lg.invoices, lg.invoice_lines, lg.accounts, lg.contacts, lg.tax_codes,
                                    JOURNAL_OFFSET)
    return lines


# --- FX and calendar ---------------------------------------------------------------------

@register("asof_rate", ["journal_entries", "companies", "exchange_rates"], """
SELECT je.id, je.company_id, je.entry_date, je.currency, c.base_currency,
       CASE WHEN je.currency = c.base_currency THEN CAST(1 AS DECIMAL(20,8))
            ELSE (SELECT r.rate FROM exchange_rates r
                  WHERE r.from_currency = je.currency AND r.to_currency = c.base_currency
                    AND r.effective_date <= je.entry_date
                  ORDER BY r.effective_date DESC LIMIT 1) END AS asof_rate
FROM journal_entries je JOIN companies c ON c.id = je.company_id
""")
def q_asof_rate(spark, sf_dir):
    lg = L(spark, sf_dir)
    return X.entry_rates_asof(lg.journal_entries, lg.companies, lg.exchange_rates).select(
        "id", "company_id", "entry_date", "currency", "base_currency", "asof_rate")


@register("rate_validity", ["exchange_rates"], """
SELECT from_currency, to_currency, effective_date, rate,
       lead(effective_date) OVER (PARTITION BY from_currency, to_currency ORDER BY effective_date) AS valid_to
FROM exchange_rates
""")
def q_rate_validity(spark, sf_dir):
    return X.rate_validity(L(spark, sf_dir).exchange_rates).select(
        "from_currency", "to_currency", "effective_date", "rate", "valid_to")


@register("convert_to_base", ["journal_entries", "journal_entry_lines"], """
SELECT l.id, CAST(round(CAST(l.debit_amount AS DECIMAL(20,4)) * CAST(e.exchange_rate AS DECIMAL(20,8)), 4)
                  AS DECIMAL(20,4)) AS debit_base,
       CAST(round(CAST(l.credit_amount AS DECIMAL(20,4)) * CAST(e.exchange_rate AS DECIMAL(20,8)), 4)
            AS DECIMAL(20,4)) AS credit_base
FROM journal_entry_lines l JOIN journal_entries e ON e.id = l.journal_entry_id
""")
def q_convert_to_base(spark, sf_dir):
    lg = L(spark, sf_dir)
    e = lg.journal_entries.select(F.col("id").alias("journal_entry_id"), "exchange_rate")
    lines = lg.journal_entry_lines.select("id", "journal_entry_id", "debit_amount", "credit_amount").join(
        e, "journal_entry_id")
    return X.convert_to_base(lines).select("id", "debit_base", "credit_base")


@register("payment_periods", ["payments", "accounting_periods"], """
SELECT p.id, p.company_id, p.payment_date, ap.id AS derived_period_id
FROM payments p LEFT JOIN accounting_periods ap
  ON ap.company_id = p.company_id AND p.payment_date BETWEEN ap.start_date AND ap.end_date
""")
def q_payment_periods(spark, sf_dir):
    lg = L(spark, sf_dir)
    return X.period_for_date(lg.payments.select("id", "company_id", "payment_date"), lg.accounting_periods,
                             "payment_date")


@register("entry_period_mismatch", ["journal_entries", "accounting_periods"], """
SELECT je.id, je.company_id, je.entry_date, je.period_id, ap.id AS derived_period_id
FROM journal_entries je LEFT JOIN accounting_periods ap
  ON ap.company_id = je.company_id AND je.entry_date BETWEEN ap.start_date AND ap.end_date
WHERE ap.id IS NULL OR ap.id <> je.period_id
""")
def q_entry_period_mismatch(spark, sf_dir):
    lg = L(spark, sf_dir)
    return X.period_mismatches(lg.journal_entries, lg.accounting_periods)


@register("effective_currency", ["accounts", "companies"], """
SELECT a.id, COALESCE(a.currency, c.base_currency) AS effective_currency
FROM accounts a LEFT JOIN companies c ON c.id = a.company_id
""")
def q_effective_currency(spark, sf_dir):
    lg = L(spark, sf_dir)
    return X.effective_currency(lg.accounts, lg.companies).select("id", "effective_currency")


# --- banking -------------------------------------------------------------------------------

@register("bank_running_balance", ["bank_transactions", "bank_accounts"], """
SELECT t.id, t.bank_account_id, t.transaction_date, t.amount,
       CAST(COALESCE(a.opening_balance, 0)
            + SUM(t.amount) OVER (PARTITION BY t.bank_account_id ORDER BY t.transaction_date, t.id
                                  ROWS UNBOUNDED PRECEDING) AS DECIMAL(30,4)) AS running_balance
FROM bank_transactions t LEFT JOIN bank_accounts a ON a.id = t.bank_account_id
""")
def q_bank_running_balance(spark, sf_dir):
    lg = L(spark, sf_dir)
    return B.bank_running_balance(lg.bank_transactions, lg.bank_accounts).select(
        "id", "bank_account_id", "transaction_date", "amount", "running_balance")


def _bank_match_sql(max_days: int) -> str:
    """The definition written out: distance by distance, what is still open is paired k-th with k-th."""
    ctes = ["""p AS (
  SELECT id AS pay_id, bank_account_id, payment_date,
         CAST(CASE WHEN direction = 'inbound' THEN amount ELSE -amount END AS DECIMAL(20,4)) AS amount
  FROM payments WHERE id NOT IN (SELECT payment_id FROM bank_transactions WHERE payment_id IS NOT NULL))""",
            "f0 AS (SELECT id, payment_id AS pay_id FROM bank_transactions WHERE false)"]
    shifts = [0] + [s for d in range(1, max_days + 1) for s in (-d, d)]
    for n, shift in enumerate(shifts, 1):
        ctes.append(f"""f{n} AS MATERIALIZED (SELECT * FROM f{n - 1} UNION ALL SELECT a.id, b.pay_id FROM (
    SELECT id, bank_account_id, amount, transaction_date + {shift} AS day,
           row_number() OVER (PARTITION BY bank_account_id, amount, transaction_date ORDER BY id) AS k
    FROM bank_transactions WHERE payment_id IS NULL AND id NOT IN (SELECT id FROM f{n - 1})) a
  JOIN (SELECT pay_id, bank_account_id, amount, payment_date AS day,
               row_number() OVER (PARTITION BY bank_account_id, amount, payment_date ORDER BY pay_id) AS k
        FROM p WHERE pay_id NOT IN (SELECT pay_id FROM f{n - 1})) b USING (bank_account_id, amount, day, k))""")
    return ", ".join(ctes) + f"""
SELECT t.id, t.bank_account_id, t.transaction_date, t.amount, COALESCE(t.payment_id, f.pay_id) AS matched_payment_id,
       CASE WHEN t.payment_id IS NOT NULL THEN 'explicit' WHEN f.pay_id IS NOT NULL THEN 'amount_date' END AS match_rule
FROM bank_transactions t LEFT JOIN f{len(shifts)} f ON f.id = t.id
"""


@register("bank_match", ["bank_transactions", "payments"], "WITH " + _bank_match_sql(3))
def q_bank_match(spark, sf_dir):
    lg = L(spark, sf_dir)
    return B.bank_match(lg.bank_transactions, lg.payments, 3)


@register("bank_reconcile", ["bank_transactions", "bank_accounts"], f"""
SELECT a.id AS bank_account_id, DATE '{BANK_PERIOD_END}' AS period_end_date,
       CAST(a.opening_balance + COALESCE(SUM(CASE WHEN t.is_reconciled THEN t.amount ELSE 0 END), 0)
            AS DECIMAL(30,4)) AS statement_balance,
       CAST(a.opening_balance + COALESCE(SUM(t.amount), 0) AS DECIMAL(30,4)) AS book_balance,
       CAST(COALESCE(SUM(CASE WHEN t.is_reconciled THEN t.amount ELSE 0 END), 0) - COALESCE(SUM(t.amount), 0)
            AS DECIMAL(30,4)) AS difference,
       CAST(COUNT(CASE WHEN NOT t.is_reconciled THEN 1 END) AS BIGINT) AS unreconciled_count
FROM bank_accounts a
LEFT JOIN bank_transactions t ON t.bank_account_id = a.id AND t.transaction_date <= DATE '{BANK_PERIOD_END}'
GROUP BY a.id, a.opening_balance
""")
def q_bank_reconcile(spark, sf_dir):
    lg = L(spark, sf_dir)
    return B.bank_reconcile(lg.bank_transactions, lg.bank_accounts, BANK_PERIOD_END)


@register("bank_statement_reconciliation", ["bank_reconciliations", "bank_transactions", "bank_accounts"], """
SELECT *, CASE WHEN difference = 0 THEN 'agrees' WHEN difference = outstanding THEN 'explained' ELSE 'differs' END AS status
FROM (
  SELECT r.id AS reconciliation_id, r.bank_account_id, r.period_end_date,
         CAST(r.statement_balance AS DECIMAL(30,4)) AS statement_balance,
         CAST(a.opening_balance + COALESCE(SUM(CASE WHEN t.is_reconciled THEN t.amount END), 0) AS DECIMAL(30,4))
             AS reconciled_balance,
         CAST(a.opening_balance + COALESCE(SUM(t.amount), 0) AS DECIMAL(30,4)) AS book_balance,
         CAST(COUNT(CASE WHEN NOT t.is_reconciled THEN 1 END) AS BIGINT) AS open_transactions,
         CAST(r.statement_balance - a.opening_balance - COALESCE(SUM(CASE WHEN t.is_reconciled THEN t.amount END), 0)
              AS DECIMAL(30,4)) AS difference,
         CAST(COALESCE(SUM(t.amount), 0) - COALESCE(SUM(CASE WHEN t.is_reconciled THEN t.amount END), 0)
              AS DECIMAL(30,4)) AS outstanding
  FROM bank_reconciliations r JOIN bank_accounts a ON a.id = r.bank_account_id
  LEFT JOIN bank_transactions t ON t.bank_account_id = r.bank_account_id AND t.transaction_date <= r.period_end_date
  GROUP BY r.id, r.bank_account_id, r.period_end_date, r.statement_balance, a.opening_balance) x
""")
def q_bank_statement_reconciliation(spark, sf_dir):
    lg = L(spark, sf_dir)
    return B.statement_reconciliation(lg.bank_transactions, lg.bank_accounts, lg.bank_reconciliations)


# --- receivables ---------------------------------------------------------------------------

@register("settle_invoices", ["invoices", "payment_allocations"], """
SELECT i.id, CAST(COALESCE(a.paid, 0) AS DECIMAL(20,4)) AS amount_paid,
       CAST(i.total_amount - COALESCE(a.paid, 0) AS DECIMAL(20,4)) AS amount_due
FROM invoices i LEFT JOIN (SELECT invoice_id, SUM(allocated_amount) AS paid FROM payment_allocations
                           GROUP BY invoice_id) a ON a.invoice_id = i.id
""")
def q_settle_invoices(spark, sf_dir):
    lg = L(spark, sf_dir)
    return RC.settle_invoices(lg.invoices, lg.payment_allocations).select("id", "amount_paid", "amount_due")


@register("derive_invoice_status", ["invoices"], f"""
SELECT id, CASE WHEN status IN ('draft', 'voided') THEN status
                WHEN amount_due <= 0 THEN 'paid'
                WHEN due_date IS NOT NULL AND due_date < DATE '{AS_OF}' THEN 'overdue'
                WHEN amount_paid > 0 THEN 'partial'
                ELSE 'sent' END AS derived_status
FROM invoices
""")
def q_derive_invoice_status(spark, sf_dir):
    return RC.derive_invoice_status(L(spark, sf_dir).invoices, AS_OF).select("id", "derived_status")


@register("credit_limit_breach", ["invoices", "contacts"], """
SELECT c.id AS contact_id, c.company_id, c.name, c.credit_limit, CAST(d.open_due AS DECIMAL(30,4)) AS open_due,
       CAST(d.open_due - c.credit_limit AS DECIMAL(30,4)) AS excess
FROM contacts c JOIN (SELECT contact_id, SUM(amount_due) AS open_due FROM invoices
                      WHERE type = 'sale' AND status NOT IN ('paid', 'voided', 'draft') GROUP BY contact_id) d
  ON d.contact_id = c.id
WHERE c.credit_limit IS NOT NULL AND d.open_due > c.credit_limit
""")
def q_credit_limit_breach(spark, sf_dir):
    lg = L(spark, sf_dir)
    return RC.credit_limit_breach(lg.invoices, lg.contacts).select(
        "contact_id", "company_id", "name", "credit_limit", "open_due", "excess")


@register("payment_autoallocate", ["payments", "invoices"], """
WITH s AS (
  SELECT contact_id, id AS payment_id,
         SUM(amount) OVER (PARTITION BY contact_id ORDER BY payment_date, id ROWS UNBOUNDED PRECEDING) AS hi,
         SUM(amount) OVER (PARTITION BY contact_id ORDER BY payment_date, id ROWS UNBOUNDED PRECEDING)
             - amount AS lo
  FROM payments WHERE direction = 'inbound'),
d AS (
  SELECT contact_id, id AS invoice_id,
         SUM(total_amount) OVER (PARTITION BY contact_id ORDER BY invoice_date, id ROWS UNBOUNDED PRECEDING) AS hi,
         SUM(total_amount) OVER (PARTITION BY contact_id ORDER BY invoice_date, id ROWS UNBOUNDED PRECEDING)
             - total_amount AS lo
  FROM invoices WHERE type = 'sale' AND status NOT IN ('draft', 'voided')),
tot AS (SELECT contact_id, MAX(hi) AS total FROM s GROUP BY contact_id)
SELECT d.contact_id, s.payment_id, d.invoice_id,
       CAST(least(d.hi, s.hi) - greatest(d.lo, s.lo) AS DECIMAL(20,4)) AS allocated_amount
FROM d JOIN s ON s.contact_id = d.contact_id AND s.lo < d.hi AND d.lo < s.hi
UNION ALL
SELECT d.contact_id, NULL, d.invoice_id, CAST(d.hi - greatest(d.lo, COALESCE(t.total, 0)) AS DECIMAL(20,4))
FROM d LEFT JOIN tot t ON t.contact_id = d.contact_id WHERE d.hi > COALESCE(t.total, 0)
""")
def q_payment_autoallocate(spark, sf_dir):
    lg = L(spark, sf_dir)
    return RC.payment_autoallocate(lg.payments, lg.invoices)


@register("resolve_control_accounts", ["contacts", "accounts"], """
SELECT c.id, c.company_id,
       COALESCE(c.ar_account_id, (SELECT MIN(a.id) FROM accounts a WHERE a.company_id = c.company_id
                                  AND a.is_control AND a.category = 'asset')) AS ar_account_id,
       COALESCE(c.ap_account_id, (SELECT MIN(a.id) FROM accounts a WHERE a.company_id = c.company_id
                                  AND a.is_control AND a.category = 'liability')) AS ap_account_id
FROM contacts c
""")
def q_resolve_control_accounts(spark, sf_dir):
    lg = L(spark, sf_dir)
    return RC.resolve_control_accounts(lg.contacts, lg.accounts)


@register("resolve_gl_accounts", ["products", "product_categories"], """
SELECT p.id AS product_id,
       CAST(COALESCE(p.inventory_account_id, c.inventory_account_id) AS INTEGER) AS inventory_account_id,
       CAST(COALESCE(p.cogs_account_id, c.cogs_account_id) AS INTEGER) AS cogs_account_id,
       CAST(COALESCE(p.revenue_account_id, c.revenue_account_id) AS INTEGER) AS revenue_account_id
FROM products p LEFT JOIN product_categories c ON c.id = p.category_id
""")
def q_resolve_gl_accounts(spark, sf_dir):
    lg = L(spark, sf_dir)
    return I.resolve_gl_accounts(lg.products, lg.product_categories)


# --- hierarchies ---------------------------------------------------------------------------

def _closure_sql(table: str) -> str:
    return f"""WITH RECURSIVE c(ancestor_id, descendant_id, depth) AS (
  SELECT id, id, 0 FROM {table}
  UNION ALL
  SELECT n.parent_id, c.descendant_id, c.depth + 1 FROM c JOIN {table} n ON n.id = c.ancestor_id
  WHERE n.parent_id IS NOT NULL)
SELECT ancestor_id, descendant_id, depth FROM c"""


for _t in ["account_groups", "product_categories", "warehouse_locations", "cost_centers"]:
    def _mk(t):
        def q(spark, sf_dir):
            return H.tree_closure(L(spark, sf_dir)[t])
        return q
    register(f"tree_closure_{_t}", [_t], _closure_sql(_t))(_mk(_t))


@register("account_group_balances", ["account_groups", "accounts", "journal_entry_lines"], """
WITH RECURSIVE c(ancestor_id, descendant_id, depth) AS (
  SELECT id, id, 0 FROM account_groups
  UNION ALL
  SELECT n.parent_id, c.descendant_id, c.depth + 1 FROM c JOIN account_groups n ON n.id = c.ancestor_id
  WHERE n.parent_id IS NOT NULL),
tb AS (
  SELECT a.group_id, COALESCE(SUM(l.debit_base), 0) AS total_debit, COALESCE(SUM(l.credit_base), 0) AS total_credit
  FROM accounts a LEFT JOIN journal_entry_lines l ON l.account_id = a.id
  WHERE a.group_id IS NOT NULL GROUP BY a.id, a.group_id)
SELECT c.ancestor_id AS id, CAST(SUM(tb.total_debit) AS DECIMAL(30,4)) AS total_debit,
       CAST(SUM(tb.total_credit) AS DECIMAL(30,4)) AS total_credit
FROM c JOIN tb ON tb.group_id = c.descendant_id
GROUP BY c.ancestor_id
""")
def q_account_group_balances(spark, sf_dir):
    from kontor.operators import reports as R
    lg = L(spark, sf_dir)
    tb = R.trial_balance(lg.accounts, lg.journal_entry_lines)
    return H.account_group_balances(lg.account_groups, lg.accounts, tb)


# --- sequences -------------------------------------------------------------------------------

@register("entry_numbering", ["journal_entries", "journals"], """
SELECT je.id, je.company_id, je.journal_id,
       j.sequence_prefix || CAST(year(je.entry_date) AS VARCHAR) || '-'
       || lpad(CAST(row_number() OVER (PARTITION BY je.company_id, je.journal_id, year(je.entry_date)
                                       ORDER BY je.entry_date, je.id) AS VARCHAR), 4, '0') AS document_number
FROM journal_entries je JOIN journals j ON j.id = je.journal_id
""")
def q_entry_numbering(spark, sf_dir):
    lg = L(spark, sf_dir)
    j = lg.journals.select(F.col("id").alias("journal_id"), "sequence_prefix")
    e = (lg.journal_entries.select("id", "company_id", "journal_id", "entry_date").join(j, "journal_id")
         .withColumn("_year", F.year("entry_date")))
    return SQ.assign_document_numbers(e, ["company_id", "journal_id"], ["entry_date", "id"], "sequence_prefix",
                                      "_year").select("id", "company_id", "journal_id", "document_number")


@register("invoice_line_duplicates", ["invoice_lines"], """
SELECT * FROM (
  SELECT id, invoice_id, product_id,
         CAST(row_number() OVER (PARTITION BY invoice_id, product_id ORDER BY line_number, id) AS INTEGER) AS dup_rank,
         COUNT(*) OVER (PARTITION BY invoice_id, product_id) AS dup_count
  FROM invoice_lines) x
WHERE dup_count > 1
""")
def q_invoice_line_duplicates(spark, sf_dir):
    il = L(spark, sf_dir).invoice_lines.select("id", "invoice_id", "product_id", "line_number")
    return (SQ.duplicate_rank(il, ["invoice_id", "product_id"], ["line_number", "id"])
            .filter(F.col("dup_count") > 1).select("id", "invoice_id", "product_id", "dup_rank", "dup_count"))


@register("invoice_number_gaps", ["invoices"], """
SELECT company_id, type, previous_number, next_number, next_number - previous_number - 1 AS missing_count
FROM (SELECT company_id, type, n AS next_number, lag(n) OVER (PARTITION BY company_id, type ORDER BY n) AS previous_number
      FROM (SELECT company_id, type, CAST(regexp_extract(invoice_number, '(\\d+)$', 1) AS BIGINT) AS n
            FROM invoices) a) b
WHERE next_number - previous_number > 1
""")
def q_invoice_number_gaps(spark, sf_dir):
    inv = L(spark, sf_dir).invoices.select("company_id", "type", SQ.numeric_suffix("invoice_number").alias("n"))
    return SQ.sequence_gaps(inv, ["company_id", "type"], "n").withColumnRenamed("n", "next_number")


@register("account_running_balance", ["journal_entries", "journal_entry_lines", "accounts"], """
SELECT a.company_id, a.code AS account_code, e.entry_date, e.entry_number, l.id AS line_key,
       l.debit_base, l.credit_base,
       CAST(SUM(CAST(CASE WHEN a.normal_balance = 'debit' THEN l.debit_base - l.credit_base
                     ELSE l.credit_base - l.debit_base END AS DECIMAL(30,4)))
           OVER (PARTITION BY a.company_id, a.code ORDER BY e.entry_date, e.entry_number, l.id
                 ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,4)) AS running_balance
FROM journal_entry_lines l JOIN journal_entries e ON e.id = l.journal_entry_id
JOIN accounts a ON a.id = l.account_id
WHERE e.status = 'posted'
""")
def q_account_running_balance(spark, sf_dir):
    lg = L(spark, sf_dir)
    e = lg.journal_entries.filter(F.col("status") == "posted").select(
        F.col("id").alias("journal_entry_id"), "entry_date", "entry_number")
    a = lg.accounts.select(F.col("id").alias("account_id"), "company_id", F.col("code").alias("account_code"),
                           "normal_balance")
    ledger = (lg.journal_entry_lines.select(F.col("id").alias("line_key"), "journal_entry_id", "account_id",
                                            "debit_base", "credit_base")
              .join(e, "journal_entry_id").join(a, "account_id"))
    return B.account_running_balance(ledger).select(
        "company_id", "account_code", "entry_date", "entry_number", "line_key", "debit_base", "credit_base",
        F.col("running_balance").cast("DECIMAL(38,4)").alias("running_balance"))


@register("category_stock_rollup", ["product_categories", "products", "stock_moves"], """
WITH RECURSIVE c(ancestor_id, descendant_id, depth) AS (
  SELECT id, id, 0 FROM product_categories
  UNION ALL
  SELECT n.parent_id, c.descendant_id, c.depth + 1 FROM c JOIN product_categories n ON n.id = c.ancestor_id
  WHERE n.parent_id IS NOT NULL),
legs AS (
  SELECT product_id, -quantity AS delta FROM stock_moves WHERE is_posted AND from_location_id IS NOT NULL
  UNION ALL
  SELECT product_id, quantity FROM stock_moves WHERE is_posted AND to_location_id IS NOT NULL),
per_cat AS (
  SELECT p.category_id, SUM(l.delta) AS qty FROM legs l JOIN products p ON p.id = l.product_id
  GROUP BY p.category_id)
SELECT c.ancestor_id AS id, CAST(SUM(per_cat.qty) AS DECIMAL(30,4)) AS qty_on_hand
FROM c JOIN per_cat ON per_cat.category_id = c.descendant_id
GROUP BY c.ancestor_id
""")
def q_category_stock_rollup(spark, sf_dir):
    """Stock on hand rolled up the product-category tree (a category includes its subtree)."""
    lg = L(spark, sf_dir)
    stock = I.stock_on_hand_total(I.apply_stock_moves(lg.stock_moves))
    per_product = stock.join(lg.products.select(F.col("id").alias("product_id"), "category_id"), "product_id")
    return H.tree_rollup(lg.product_categories, per_product, "category_id", ["qty_on_hand"])
