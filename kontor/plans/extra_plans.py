"""Registered queries for the remaining projections, filters, sinks and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.operators import inventory as I
from kontor.operators import reports as R
from kontor.operators import search as SE
from kontor.plans.catalog import L, register
from kontor.sources import readers as RD


@register("trial_balance_columns", ["accounts", "journal_entry_lines"], """
SELECT a.company_id, a.code AS account_code, a.name AS account_name, a.category,
       CASE WHEN a.normal_balance = 'debit' THEN CAST(COALESCE(SUM(l.debit_base), 0) - COALESCE(SUM(l.credit_base), 0)
            AS DECIMAL(30,4)) END AS debit_column,
       CASE WHEN a.normal_balance = 'credit' THEN CAST(COALESCE(SUM(l.credit_base), 0) - COALESCE(SUM(l.debit_base), 0)
            AS DECIMAL(30,4)) END AS credit_column
FROM accounts a LEFT JOIN journal_entry_lines l ON l.account_id = a.id
GROUP BY a.id, a.company_id, a.code, a.name, a.category, a.normal_balance
""")
def q_trial_balance_columns(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.trial_balance_columns(R.trial_balance(lg.accounts, lg.journal_entry_lines))


@register("open_items", ["invoices"], """
SELECT id, company_id, type, status, due_date, amount_due FROM invoices WHERE status NOT IN ('paid', 'voided')
""")
def q_open_items(spark, sf_dir):
    return R.open_items(L(spark, sf_dir).invoices).select("id", "company_id", "type", "status", "due_date",
                                                         "amount_due")


@register("invoices_tab_purchase", ["invoices"], """
SELECT id, invoice_number, status FROM invoices WHERE type = 'purchase'
""")
def q_invoices_tab_purchase(spark, sf_dir):
    return R.filter_invoices_by_tab(L(spark, sf_dir).invoices, "purchase").select("id", "invoice_number", "status")


@register("accounts_revenue_filter", ["accounts"], """
SELECT id, code, name FROM accounts WHERE category = 'revenue' AND is_active
""")
def q_accounts_revenue_filter(spark, sf_dir):
    a = R.active_only(R.filter_accounts_by_category(L(spark, sf_dir).accounts, "revenue"))
    return a.select("id", "code", "name")


@register("line_amounts", ["invoice_lines"], """
SELECT id, CAST(round(CAST(CAST(CAST(quantity AS DECIMAL(20,6)) * CAST(unit_price AS DECIMAL(20,4)) AS DECIMAL(30,10))
                           * CAST(100 - discount_pct AS DECIMAL(8,4)) AS DECIMAL(38,14)) * 0.01, 4)
            AS DECIMAL(20,4)) AS line_amount
FROM invoice_lines
""")
def q_line_amounts(spark, sf_dir):
    il = L(spark, sf_dir).invoice_lines.drop("line_amount")
    return R.line_amount(il).select("id", "line_amount")


@register("move_total_cost", ["stock_moves"], """
SELECT id, CAST(round(CAST(quantity AS DECIMAL(20,6)) * CAST(unit_cost AS DECIMAL(20,4)), 4) AS DECIMAL(20,4))
           AS total_cost
FROM stock_moves
""")
def q_move_total_cost(spark, sf_dir):
    m = L(spark, sf_dir).stock_moves.drop("total_cost")
    return I.move_total_cost(m).select("id", "total_cost")


@register("uom_stock_qty", ["invoice_lines", "products"], """
SELECT l.id, CAST(CAST(l.quantity AS DECIMAL(20,6)) * CAST(COALESCE(p.uom_conversion, 1) AS DECIMAL(20,6))
                  AS DECIMAL(30,6)) AS stock_qty
FROM invoice_lines l LEFT JOIN products p ON p.id = l.product_id
""")
def q_uom_stock_qty(spark, sf_dir):
    lg = L(spark, sf_dir)
    return I.uom_to_stock_qty(lg.invoice_lines.select("id", "product_id", "quantity"), lg.products).select(
        "id", "stock_qty")


@register("stock_upsert", ["stock_moves"], """
SELECT product_id, location_id, CAST(SUM(delta) AS DECIMAL(20,6)) AS quantity
FROM (SELECT product_id, from_location_id AS location_id, -quantity AS delta
      FROM stock_moves WHERE is_posted AND from_location_id IS NOT NULL
      UNION ALL
      SELECT product_id, to_location_id AS location_id, quantity AS delta
      FROM stock_moves WHERE is_posted AND to_location_id IS NOT NULL) legs
GROUP BY product_id, location_id
""")
def q_stock_upsert(spark, sf_dir):
    """State from the moves before 1999, then the later moves upserted into it."""
    m = L(spark, sf_dir).stock_moves
    cut = F.lit("1999-01-01").cast("date")
    state = I.apply_stock_moves(m.filter(F.col("move_date") < cut)).select("product_id", "location_id", "quantity")
    later = I.stock_legs(m.filter(F.col("move_date") >= cut)).withColumnRenamed("delta", "quantity")
    return RD.upsert_accumulate(state, later, ["product_id", "location_id"], "quantity")


@register("rows_appended", ["invoices"], """
SELECT id, type FROM invoices WHERE type IN ('sale', 'purchase')
""")
def q_rows_appended(spark, sf_dir):
    inv = L(spark, sf_dir).invoices.select("id", "type")
    return RD.append_rows(inv.where("type = 'sale'"), inv.where("type = 'purchase'"))


@register("products_updated_by_key", ["products", "stock_moves"], """
WITH last AS (SELECT product_id, max(unit_cost) AS cost FROM stock_moves WHERE is_posted GROUP BY product_id)
SELECT p.id, CAST(coalesce(l.cost, p.standard_cost) AS DECIMAL(20,4)) AS standard_cost, l.product_id IS NOT NULL AS stamped
FROM products p LEFT JOIN last l ON l.product_id = p.id
""")
def q_products_updated_by_key(spark, sf_dir):
    """Update by key with the change stamp (T5): the stamp itself is the current time, so only its presence is returned."""
    lg = L(spark, sf_dir)
    new = (lg.stock_moves.where("is_posted").groupBy(F.col("product_id").alias("id"))
           .agg(F.max("unit_cost").alias("standard_cost")))
    out = RD.update_by_key(lg.products.select("id", "standard_cost"), new, "id", ["standard_cost"], stamp=True)
    return out.select("id", F.col("standard_cost").cast("decimal(20,4)").alias("standard_cost"),
                      F.col("updated_at").isNotNull().alias("stamped"))


@register("required_fields_split", ["stock_moves"], """
SELECT id, from_location_id IS NOT NULL AND to_location_id IS NOT NULL AS valid FROM stock_moves
""")
def q_required_fields_split(spark, sf_dir):
    moves = L(spark, sf_dir).stock_moves.select("id", "from_location_id", "to_location_id")
    good, bad = RD.required_fields(moves, ["from_location_id", "to_location_id"])
    return good.select("id", F.lit(True).alias("valid")).unionByName(bad.select("id", F.lit(False).alias("valid")))


@register("entries_diff", ["journal_entries"], """
SELECT id, status, 'expected_only' AS side FROM journal_entries WHERE status <> 'posted'
UNION ALL
SELECT id, 'void', 'actual_only' FROM journal_entries WHERE status <> 'posted'
""")
def q_entries_diff(spark, sf_dir):
    from kontor.operators import audit as AU
    e = L(spark, sf_dir).journal_entries.select("id", "status")
    changed = e.withColumn("status", F.when(F.col("status") == "posted", F.col("status")).otherwise(F.lit("void")))
    return AU.table_diff(e, changed).select("id", "status", "side")


@register("invoice_due_same_day", ["invoices"], """
SELECT id, coalesce(due_date, invoice_date) AS effective_due_date FROM invoices
""")
def q_invoice_due_same_day(spark, sf_dir):
    lg = L(spark, sf_dir)
    from kontor.operators import receivables as RV
    return RV.default_due_date(lg.invoices, lg.contacts, mode="same_day").select("id", "effective_due_date")


@register("invoice_document_numbers", ["invoices"], """
SELECT id, CASE WHEN type = 'sale' THEN 'INV-' ELSE 'BILL-' END || CAST(year(invoice_date) AS VARCHAR) || '-'
       || CASE WHEN id < 10000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END AS document_number
FROM invoices WHERE type IN ('sale', 'purchase')
""")
def q_invoice_document_numbers(spark, sf_dir):
    from kontor.functions import money as M
    inv = L(spark, sf_dir).invoices.where("type IN ('sale', 'purchase')")
    number = F.when(F.col("type") == "sale", M.doc_number("INV", F.year("invoice_date"), F.col("id"), 4)).otherwise(
        M.doc_number("BILL", F.year("invoice_date"), F.col("id"), 4))
    return inv.select("id", number.alias("document_number"))


@register("lines_after_voided_delete", ["journal_entries", "journal_entry_lines"], """
SELECT l.id, l.journal_entry_id FROM journal_entry_lines l
WHERE l.journal_entry_id NOT IN (SELECT id FROM journal_entries WHERE status = 'voided')
""")
def q_lines_after_voided_delete(spark, sf_dir):
    lg = L(spark, sf_dir)
    gone = lg.journal_entries.filter(F.col("status") == "voided")
    return RD.cascade_delete(lg.journal_entry_lines.select("id", "journal_entry_id"), gone, "journal_entry_id")


@register("contact_name_index", ["contacts"], """
SELECT token, CAST(COUNT(*) AS BIGINT) AS contacts
FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{M}\\p{N}]+')) AS token FROM contacts) t
WHERE length(token) > 0 AND token NOT IN (""" + ", ".join(f"'{w}'" for w in SE.STOP_WORDS) + """)
GROUP BY token
""")
def q_contact_name_index(spark, sf_dir):
    return SE.build_name_index(L(spark, sf_dir).contacts)


@register("contact_search", ["contacts"], """
SELECT id, name FROM contacts
WHERE list_has_all(regexp_extract_all(lower(name), '[\\p{L}\\p{M}\\p{N}]+'), ['customer', '000000007'])
""")
def q_contact_search(spark, sf_dir):
    return SE.search_contacts(L(spark, sf_dir).contacts, "Customer#000000007").select("id", "name")


_WORLD_NAME = ("CASE id % 4 WHEN 0 THEN concat('M\u00fcller & S\u00f6hne ', name) WHEN 1 THEN concat(name, ' \u6771\u4eac\u5546\u4e8b') "
               "WHEN 2 THEN concat('M. Ller-', name) ELSE name END")


@register("contact_search_unicode", ["contacts"], f"""
WITH c AS (SELECT id, {_WORLD_NAME} AS name FROM contacts)
SELECT id, name, 'accent' AS kind FROM c
WHERE list_has_all(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), ['m\u00fcller', 's\u00f6hne'])
UNION ALL
SELECT id, name, 'part' FROM c WHERE contains(name, '\u4eac\u5546')
UNION ALL
SELECT id, name, 'plain' FROM c WHERE list_has_all(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), ['m', 'ller'])
""")
def q_contact_search_unicode(spark, sf_dir):
    """Accents stay in their word, and a name without spaces is found by any part of it."""
    c = L(spark, sf_dir).contacts.select("id", F.expr(_WORLD_NAME).alias("name"))
    found = [SE.search_contacts(c, q).withColumn("kind", F.lit(kind)) for q, kind in
             (("S\u00f6hne M\u00fcller", "accent"), ("\u4eac\u5546", "part"), ("M. Ller", "plain"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("sales_order_rollup", ["sales_order_lines", "stock_moves"], """
SELECT l.so_id, CAST(COUNT(*) AS BIGINT) AS lines, CAST(SUM(l.quantity) AS DECIMAL(30,6)) AS qty_ordered,
       CAST(SUM(COALESCE(d.q, 0)) AS DECIMAL(30,6)) AS qty_delivered,
       CAST(SUM(l.qty_invoiced) AS DECIMAL(30,6)) AS qty_invoiced,
       CAST(SUM(l.quantity) - SUM(COALESCE(d.q, 0)) AS DECIMAL(30,6)) AS backlog,
       CAST(SUM(l.line_amount) AS DECIMAL(30,4)) AS amount
FROM sales_order_lines l
LEFT JOIN (SELECT sales_order_line_id, SUM(quantity) AS q FROM stock_moves
           WHERE is_posted AND move_type = 'sale_delivery' AND sales_order_line_id IS NOT NULL
           GROUP BY sales_order_line_id) d ON d.sales_order_line_id = l.id
GROUP BY l.so_id
""")
def q_sales_order_rollup(spark, sf_dir):
    from kontor.operators import orders as O
    lg = L(spark, sf_dir)
    return O.sales_order_rollup(lg.sales_order_lines, lg.stock_moves)


@register("purchase_order_rollup", ["purchase_order_lines", "stock_moves"], """
SELECT po_id, CAST(COUNT(*) AS BIGINT) AS lines, CAST(SUM(quantity) AS DECIMAL(30,6)) AS qty_ordered,
       CAST(SUM(received) AS DECIMAL(30,6)) AS qty_received, CAST(SUM(qty_billed) AS DECIMAL(30,6)) AS qty_billed,
       CAST(SUM(quantity - received) AS DECIMAL(30,6)) AS to_receive, CAST(SUM(line_amount) AS DECIMAL(30,4)) AS amount
FROM (SELECT l.*, COALESCE((SELECT SUM(m.quantity) FROM stock_moves m WHERE m.purchase_order_line_id = l.id
                            AND m.is_posted AND m.move_type = 'purchase_receipt'), 0) AS received
      FROM purchase_order_lines l) x
GROUP BY po_id
""")
def q_purchase_order_rollup(spark, sf_dir):
    from kontor.operators import orders as O
    lg = L(spark, sf_dir)
    return O.purchase_order_rollup(lg.purchase_order_lines, lg.stock_moves)


@register("unreconciled_transactions", ["bank_transactions"], """
SELECT id, bank_account_id, transaction_date, amount FROM bank_transactions
WHERE transaction_date <= DATE '1997-12-31' AND is_reconciled IS NOT TRUE
""")
def q_unreconciled_transactions(spark, sf_dir):
    from kontor.operators import banking as BK
    return BK.unreconciled_transactions(L(spark, sf_dir).bank_transactions, "1997-12-31").select(
        "id", "bank_account_id", "transaction_date", "amount")


@register("three_way_match", ["purchase_order_lines", "stock_moves"], """
SELECT l.id, l.po_id, CAST(l.quantity AS DECIMAL(30,6)) AS qty_ordered,
       CAST(COALESCE(r.q, 0) AS DECIMAL(30,6)) AS qty_received, CAST(l.qty_billed AS DECIMAL(30,6)) AS qty_billed,
       CASE WHEN l.qty_billed > COALESCE(r.q, 0) THEN 'billed_not_received'
            WHEN COALESCE(r.q, 0) < l.quantity THEN 'open_receipt'
            WHEN l.qty_billed < COALESCE(r.q, 0) THEN 'received_not_billed'
            ELSE 'matched' END AS match_status
FROM purchase_order_lines l
LEFT JOIN (SELECT purchase_order_line_id, SUM(quantity) AS q FROM stock_moves
           WHERE is_posted AND move_type = 'purchase_receipt' AND purchase_order_line_id IS NOT NULL
           GROUP BY purchase_order_line_id) r ON r.purchase_order_line_id = l.id
""")
def q_three_way_match(spark, sf_dir):
    from kontor.operators import orders as O
    lg = L(spark, sf_dir)
    return O.three_way_match(lg.purchase_order_lines, lg.stock_moves)


_BILLS_SQL = """
WITH s AS (SELECT i.contact_id AS vendor_id, l.product_id, l.id AS bill_line_id, l.quantity AS q,
                  SUM(l.quantity) OVER (PARTITION BY i.contact_id, l.product_id ORDER BY i.invoice_date, l.id) AS e
           FROM invoice_lines l JOIN invoices i ON i.id = l.invoice_id
           WHERE i.type = 'purchase' AND i.status NOT IN ('draft', 'voided')),
d AS (SELECT o.vendor_id, l.product_id, l.id AS po_line_id, l.quantity AS q,
             SUM(l.quantity) OVER (PARTITION BY o.vendor_id, l.product_id ORDER BY o.order_date, l.id) AS e
      FROM purchase_order_lines l JOIN purchase_orders o ON o.id = l.po_id),
a AS (SELECT d.vendor_id, d.product_id, s.bill_line_id, d.po_line_id,
             LEAST(s.e, d.e) - GREATEST(s.e - s.q, d.e - d.q) AS allocated
      FROM s JOIN d ON s.vendor_id = d.vendor_id AND s.product_id = d.product_id
       AND LEAST(s.e, d.e) > GREATEST(s.e - s.q, d.e - d.q))
"""


@register("bill_allocations", ["invoice_lines", "invoices", "purchase_order_lines", "purchase_orders"], _BILLS_SQL + """
SELECT vendor_id, product_id, bill_line_id, po_line_id, CAST(allocated AS DECIMAL(30,6)) AS allocated FROM a
UNION ALL
SELECT d.vendor_id, d.product_id, NULL, d.po_line_id, CAST(d.q - COALESCE(x.g, 0) AS DECIMAL(30,6))
FROM d LEFT JOIN (SELECT po_line_id, SUM(allocated) AS g FROM a GROUP BY po_line_id) x ON x.po_line_id = d.po_line_id
WHERE d.q > COALESCE(x.g, 0)
""")
def q_bill_allocations(spark, sf_dir):
    from kontor.operators import orders as O
    lg = L(spark, sf_dir)
    return O.allocate_bills(lg.purchase_order_lines, lg.purchase_orders, lg.invoice_lines, lg.invoices).withColumn(
        "allocated", F.col("allocated").cast("DECIMAL(30,6)"))


@register("three_way_match_bills", ["purchase_order_lines", "stock_moves", "invoice_lines", "invoices", "purchase_orders"],
          _BILLS_SQL + """
SELECT l.id, l.po_id, CAST(l.quantity AS DECIMAL(30,6)) AS qty_ordered,
       CAST(COALESCE(r.q, 0) AS DECIMAL(30,6)) AS qty_received, CAST(COALESCE(b.q, 0) AS DECIMAL(30,6)) AS qty_billed,
       CASE WHEN COALESCE(b.q, 0) > COALESCE(r.q, 0) THEN 'billed_not_received'
            WHEN COALESCE(r.q, 0) < l.quantity THEN 'open_receipt'
            WHEN COALESCE(b.q, 0) < COALESCE(r.q, 0) THEN 'received_not_billed'
            ELSE 'matched' END AS match_status
FROM purchase_order_lines l
LEFT JOIN (SELECT purchase_order_line_id, SUM(quantity) AS q FROM stock_moves
           WHERE is_posted AND move_type = 'purchase_receipt' AND purchase_order_line_id IS NOT NULL
           GROUP BY purchase_order_line_id) r ON r.purchase_order_line_id = l.id
LEFT JOIN (SELECT po_line_id, SUM(allocated) AS q FROM a GROUP BY po_line_id) b ON b.po_line_id = l.id
""")
def q_three_way_match_bills(spark, sf_dir):
    from kontor.operators import orders as O
    lg = L(spark, sf_dir)
    return O.three_way_match(lg.purchase_order_lines, lg.stock_moves, lg.purchase_orders, lg.invoice_lines, lg.invoices)


def _amounts_sql(orders: str, lines: str, key: str, party: str, doc_type: str, amount: str, pct: str) -> str:
    """What the documents of an order come to, from interval overlaps of the two queues of each party and product."""
    return f"""
WITH s AS (SELECT l.id AS doc_line_id, i.contact_id AS party, l.product_id, l.unit_price, l.discount_pct,
                  SUM(l.quantity) OVER w - l.quantity AS lo, SUM(l.quantity) OVER w AS hi
           FROM invoice_lines l JOIN invoices i ON i.id = l.invoice_id
           WHERE i.type = '{doc_type}' AND i.status NOT IN ('draft', 'voided') AND l.quantity > 0
           WINDOW w AS (PARTITION BY i.contact_id, l.product_id ORDER BY i.invoice_date, l.id)),
o AS (SELECT l.{key} AS order_id, o.{party} AS party, l.product_id,
             SUM(l.quantity) OVER w - l.quantity AS lo, SUM(l.quantity) OVER w AS hi
      FROM {lines} l JOIN {orders} o ON o.id = l.{key}
      WINDOW w AS (PARTITION BY o.{party}, l.product_id ORDER BY o.order_date, l.id)),
b AS (SELECT o.order_id, s.unit_price, s.discount_pct,
             CAST(least(s.hi, o.hi) - greatest(s.lo, o.lo) AS DECIMAL(20,6)) AS q
      FROM s JOIN o ON o.party = s.party AND o.product_id = s.product_id AND s.lo < o.hi AND o.lo < s.hi),
t AS (SELECT order_id, SUM(q) AS q,
             SUM(CAST(round(CAST(CAST(q * unit_price AS DECIMAL(30,10)) * CAST(100 - discount_pct AS DECIMAL(8,4))
                                 AS DECIMAL(38,14)) * 0.01, 4) AS DECIMAL(20,4))) AS amount
      FROM b GROUP BY order_id)
SELECT x.id, CAST(COALESCE(t.q, 0) AS DECIMAL(30,6)) AS quantity, CAST(COALESCE(t.amount, 0) AS DECIMAL(30,4)) AS {amount},
       CAST(x.{amount} AS DECIMAL(30,4)) AS stored_amount,
       CAST(CASE WHEN x.total_amount = 0 THEN 0
                 ELSE round(CAST(COALESCE(t.amount, 0) AS DECIMAL(28,4)) * 100 / x.total_amount, 2) END AS DECIMAL(30,2)) AS {pct},
       CAST(x.total_amount - COALESCE(t.amount, 0) AS DECIMAL(30,4)) AS to_come
FROM {orders} x LEFT JOIN t ON t.order_id = x.id
"""


@register("purchase_order_amounts", ["invoice_lines", "invoices", "purchase_order_lines", "purchase_orders"],
          _amounts_sql("purchase_orders", "purchase_order_lines", "po_id", "vendor_id", "purchase", "amount_billed", "billed_pct"))
def q_purchase_order_amounts(spark, sf_dir):
    from kontor.operators import orders as O
    lg = L(spark, sf_dir)
    lg.materialize(["line_src", "order_head"])  # lines and orders, documents and their lines read these
    return O.purchase_order_amounts(lg.purchase_order_lines, lg.purchase_orders, lg.invoice_lines, lg.invoices)


@register("sales_order_amounts", ["invoice_lines", "invoices", "sales_order_lines", "sales_orders"],
          _amounts_sql("sales_orders", "sales_order_lines", "so_id", "customer_id", "sale", "amount_invoiced", "invoiced_pct"))
def q_sales_order_amounts(spark, sf_dir):
    from kontor.operators import orders as O
    lg = L(spark, sf_dir)
    lg.materialize(["line_src", "order_head"])  # lines and orders, documents and their lines read these
    return O.sales_order_amounts(lg.sales_order_lines, lg.sales_orders, lg.invoice_lines, lg.invoices)


@register("po_received_pct", ["purchase_orders"], """
SELECT id, CAST(CASE WHEN total_amount = 0 THEN 0
                     ELSE round(CAST(amount_billed AS DECIMAL(38,4)) * 100 / total_amount, 2) END
            AS DECIMAL(6,2)) AS amount_received_pct
FROM purchase_orders
""")
def q_po_received_pct(spark, sf_dir):
    from kontor.operators import orders as O
    return O.po_billed_pct(L(spark, sf_dir).purchase_orders)


@register("due_date_default", ["invoices", "contacts"], """
SELECT i.id, COALESCE(i.due_date, i.invoice_date + CAST(COALESCE(c.payment_terms, 30) AS INTEGER))
           AS effective_due_date
FROM invoices i LEFT JOIN contacts c ON c.id = i.contact_id
""")
def q_due_date_default(spark, sf_dir):
    from kontor.operators import receivables as RC
    lg = L(spark, sf_dir)
    return RC.default_due_date(lg.invoices, lg.contacts).select("id", "effective_due_date")


@register("invoice_contact_names", ["invoices", "contacts"], """
SELECT i.id, i.invoice_number, COALESCE(c.name, 'Unknown') AS contact_name
FROM invoices i LEFT JOIN contacts c ON c.id = i.contact_id
""")
def q_invoice_contact_names(spark, sf_dir):
    from kontor.operators import receivables as RC
    lg = L(spark, sf_dir)
    return RC.invoice_contact_names(lg.invoices, lg.contacts).select("id", "invoice_number", "contact_name")


@register("entry_sources", ["journal_entries", "invoices", "payments", "stock_moves"], """
SELECT e.id, e.source_type, e.source_id,
       COALESCE(i.invoice_number, p.payment_number, m.move_number) AS source_document,
       COALESCE(i.invoice_number, p.payment_number, m.move_number) IS NOT NULL AS source_found
FROM journal_entries e
LEFT JOIN invoices i ON e.source_type = 'invoice' AND i.id = e.source_id
LEFT JOIN payments p ON e.source_type = 'payment' AND p.id = e.source_id
LEFT JOIN stock_moves m ON e.source_type = 'stock_move' AND m.id = e.source_id
""")
def q_entry_sources(spark, sf_dir):
    from kontor.operators import posting as P
    lg = L(spark, sf_dir)
    return P.resolve_sources(lg.journal_entries, lg.invoices, lg.payments, lg.stock_moves)


@register("close_period_balances", ["journal_entry_lines", "journal_entries", "accounting_periods", "accounts"], """
WITH per AS (
  SELECT l.account_id, e.period_id, SUM(l.debit_base) AS d, SUM(l.credit_base) AS c
  FROM journal_entry_lines l JOIN journal_entries e ON e.id = l.journal_entry_id
  WHERE e.status = 'posted' GROUP BY l.account_id, e.period_id),
j AS (
  SELECT per.account_id, per.period_id, p.start_date, a.opening_balance,
         CAST(CASE a.normal_balance WHEN 'debit' THEN per.d - per.c WHEN 'credit' THEN per.c - per.d END
              AS DECIMAL(30,4)) AS movement
  FROM per JOIN accounts a ON a.id = per.account_id JOIN accounting_periods p ON p.id = per.period_id)
SELECT account_id, period_id, movement,
       CAST(opening_balance + SUM(movement) OVER (PARTITION BY account_id ORDER BY start_date, period_id
                                                  ROWS UNBOUNDED PRECEDING) AS DECIMAL(30,4)) AS closing_balance
FROM j
""")
def q_close_period_balances(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.close_period_balances(lg.journal_entry_lines, lg.journal_entries, lg.accounting_periods, lg.accounts)


@register("weekly_movements", ["stock_moves"], """
SELECT CAST(move_date - CAST(((move_date - DATE '1970-01-01') % 7 + 7) % 7 AS INTEGER) AS DATE) AS week_start,
       product_id, move_type, CAST(SUM(quantity) AS DECIMAL(30,6)) AS quantity, COUNT(*) AS moves
FROM stock_moves WHERE is_posted
GROUP BY 1, product_id, move_type
""")
def q_weekly_movements(spark, sf_dir):
    return I.weekly_movements(L(spark, sf_dir).stock_moves)


@register("normal_balance_side", ["accounts"], """
SELECT id, category, normal_balance,
       CASE WHEN category IN ('asset', 'expense') THEN 'debit' ELSE 'credit' END AS derived_side
FROM accounts
""")
def q_normal_balance_side(spark, sf_dir):
    from kontor.functions import money as M
    a = L(spark, sf_dir).accounts
    return a.select("id", "category", "normal_balance", M.normal_side("category").alias("derived_side"))


@register("line_tax_amount", ["invoice_lines", "tax_codes"], """
SELECT l.id, CAST(round(CAST(l.line_amount AS DECIMAL(20,4)) * COALESCE(t.rate, 0) * 0.01, 4) AS DECIMAL(20,4))
           AS computed_tax
FROM invoice_lines l LEFT JOIN tax_codes t ON t.id = l.tax_code_id
""")
def q_line_tax_amount(spark, sf_dir):
    lg = L(spark, sf_dir)
    return R.line_tax_amount(lg.invoice_lines, lg.tax_codes).select("id", "computed_tax")


@register("entry_balance_flags", ["journal_entry_lines"], """
SELECT journal_entry_id, CAST(COALESCE(SUM(debit_amount), 0) AS DECIMAL(30,4)) AS total_debit,
       CAST(COALESCE(SUM(credit_amount), 0) AS DECIMAL(30,4)) AS total_credit,
       COALESCE(SUM(debit_amount), 0) <> 0 AND COALESCE(SUM(debit_amount), 0) = COALESCE(SUM(credit_amount), 0)
           AS balanced_for_posting,
       COALESCE(SUM(debit_amount), 0) > 0
           AND abs(COALESCE(SUM(debit_amount), 0) - COALESCE(SUM(credit_amount), 0)) < 0.001 AS balanced_in_form
FROM journal_entry_lines GROUP BY journal_entry_id
""")
def q_entry_balance_flags(spark, sf_dir):
    return R.entry_balance_flags(L(spark, sf_dir).journal_entry_lines)


@register("recent_invoices", ["invoices"], """
SELECT id, invoice_number, invoice_date FROM invoices ORDER BY invoice_date DESC, id DESC
""")
def q_recent_invoices(spark, sf_dir):
    return R.recent_invoices(L(spark, sf_dir).invoices).select("id", "invoice_number", "invoice_date")


@register("reversal_mirror_check", ["journal_entries", "journal_entry_lines"], """
WITH rev_lines AS (
  SELECT l.journal_entry_id + 1000000000000 AS journal_entry_id, l.account_id,
         l.credit_base AS debit_base, l.debit_base AS credit_base
  FROM journal_entry_lines l JOIN journal_entries e ON e.id = l.journal_entry_id WHERE e.status = 'posted'),
all_lines AS (
  SELECT journal_entry_id, account_id, debit_base, credit_base FROM journal_entry_lines UNION ALL
  SELECT * FROM rev_lines),
pairs AS (SELECT id AS original_id, id + 1000000000000 AS reversal_id FROM journal_entries WHERE status = 'posted'),
member AS (SELECT original_id, original_id AS journal_entry_id FROM pairs
           UNION ALL SELECT original_id, reversal_id FROM pairs)
SELECT m.original_id, l.account_id, CAST(SUM(l.debit_base) - SUM(l.credit_base) AS DECIMAL(30,4)) AS net
FROM all_lines l JOIN member m ON m.journal_entry_id = l.journal_entry_id
GROUP BY m.original_id, l.account_id
HAVING SUM(l.debit_base) - SUM(l.credit_base) <> 0
""")
def q_reversal_mirror_check(spark, sf_dir):
    """Reverse all posted entries, then check that every pair mirrors (expect no rows)."""
    from kontor.operators import posting as P
    lg = L(spark, sf_dir)
    new_e, new_l, marked = P.reverse_entries(lg.journal_entries, lg.journal_entry_lines, 1_000_000_000_000)
    entries = marked.select("id", "reversed_by").unionByName(new_e.select("id", "reversed_by"))
    lines = lg.journal_entry_lines.unionByName(new_l)
    return P.reversal_mirror_check(entries, lines)
