"""Order roll-ups (sales and purchase) and the purchase three-way match.

Document lines are aggregated per line first (moves linked to each order
line), then per order, so each step shuffles on its own key with partial
aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions import money as M
from kontor.operators.reports import line_amount
from kontor.operators.sweep import RANGE_ROWS, interval_allocate
from kontor.session import stored

QTY_SUM = "DECIMAL(30,6)"
AMOUNT_SUM = "DECIMAL(30,4)"


def _moved(moves: DataFrame, link_col: str, move_type: str) -> DataFrame:
    return (moves.filter(F.col("is_posted") & (F.col("move_type") == move_type) & F.col(link_col).isNotNull())
            .groupBy(F.col(link_col).alias("line_id")).agg(F.sum("quantity").alias("_moved")))


def sales_order_rollup(so_lines: DataFrame, moves: DataFrame) -> DataFrame:
    """Per sales order: ordered / delivered (posted deliveries) / invoiced quantities, backlog, amount."""
    d = _moved(moves, "sales_order_line_id", "sale_delivery")
    ln = (so_lines.join(d, so_lines["id"] == d["line_id"], "left")
          .withColumn("_delivered", F.coalesce("_moved", F.lit(0))))
    return ln.groupBy("so_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("lines"),
        F.sum("quantity").cast(QTY_SUM).alias("qty_ordered"),
        F.sum("_delivered").cast(QTY_SUM).alias("qty_delivered"),
        F.sum("qty_invoiced").cast(QTY_SUM).alias("qty_invoiced"),
        (F.sum("quantity") - F.sum("_delivered")).cast(QTY_SUM).alias("backlog"),
        F.sum("line_amount").cast(AMOUNT_SUM).alias("amount"))


def purchase_order_rollup(po_lines: DataFrame, moves: DataFrame) -> DataFrame:
    """Per purchase order: ordered / received (posted receipts) / billed quantities, what is still to come, amount."""
    r = _moved(moves, "purchase_order_line_id", "purchase_receipt")
    ln = (po_lines.join(r, po_lines["id"] == r["line_id"], "left")
          .withColumn("_received", F.coalesce("_moved", F.lit(0))))
    return ln.groupBy("po_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("lines"),
        F.sum("quantity").cast(QTY_SUM).alias("qty_ordered"),
        F.sum("_received").cast(QTY_SUM).alias("qty_received"),
        F.sum("qty_billed").cast(QTY_SUM).alias("qty_billed"),
        (F.sum("quantity") - F.sum("_received")).cast(QTY_SUM).alias("to_receive"),
        F.sum("line_amount").cast(AMOUNT_SUM).alias("amount"))


def _allocate(order_lines: DataFrame, orders: DataFrame, doc_lines: DataFrame, docs: DataFrame, doc_type: str,
              order_id: str, party: str, doc_line_id: str, order_line_id: str, range_rows: int | None,
              amounts: bool = False) -> DataFrame:
    """Quantities of one type of document allocated to order lines, see ``allocate_bills``.

    With ``amounts`` the rows carry what their lines say: the document line's price and discount, the order line's order.
    """
    price, order = (["unit_price", "discount_pct"], [order_id]) if amounts else ([], [])
    supply = (doc_lines.join(docs.where((F.col("type") == doc_type) & ~F.col("status").isin("draft", "voided")).select(
                  F.col("id").alias("invoice_id"), F.col("contact_id").alias(party), "invoice_date"), "invoice_id")
              .where("quantity > 0")
              .select(party, "product_id", "invoice_date", F.col("id").alias(doc_line_id),
                      F.col("quantity").alias("_billed"), *price))
    demand = (order_lines.join(orders.select(F.col("id").alias(order_id), party, "order_date"), order_id)
              .select(party, "product_id", "order_date", F.col("id").alias(order_line_id),
                      F.col("quantity").alias("_ordered"), *order))
    return interval_allocate(supply, demand, [party, "product_id"], ["invoice_date", doc_line_id],
                             ["order_date", order_line_id], "_billed", "_ordered", doc_line_id, order_line_id, range_rows,
                             price, order)


def _said_by(rows: DataFrame, lines: DataFrame, line_id: str, cols: list[str]) -> DataFrame:
    """``rows`` with ``cols`` of the line that ``line_id`` names, which they carry; once for each line if several have that id."""
    repeated = stored(lines.where("id IS NOT NULL").groupBy(F.col("id").alias(line_id)).count().where("count > 1")
                      .select(line_id), "repeated_ids")
    rows = rows.where(F.col(line_id).isNotNull())
    if repeated.isEmpty():
        return rows
    every = (lines.withColumnRenamed("id", line_id).join(repeated, line_id, "left_semi")
             .groupBy(line_id).agg(F.collect_list(F.struct(*cols)).alias("_every")))
    said = F.explode(F.coalesce("_every", F.array(F.struct(*cols)))).alias("_said")
    rest = [c for c in rows.columns if c not in cols]
    return rows.join(every, line_id, "left").select(*rest, said).select(*rest, "_said.*")


def allocate_bills(po_lines: DataFrame, purchase_orders: DataFrame, bill_lines: DataFrame, bills: DataFrame,
                   range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """(bill line, order line, quantity): billed quantities allocated to order lines.

    A bill line does not name its order line. Per vendor and product, bill lines
    in order of (invoice date, id) fill order lines in order of (order date, id),
    so a bill may cover several orders and an order several bills. Drafts and
    voided bills do not count. Order quantity that no bill covers has a NULL
    ``bill_line_id``.
    """
    return _allocate(po_lines, purchase_orders, bill_lines, bills, "purchase", "po_id", "vendor_id", "bill_line_id",
                     "po_line_id", range_rows)


def allocate_invoices(so_lines: DataFrame, sales_orders: DataFrame, invoice_lines: DataFrame, invoices: DataFrame,
                      range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """(invoice line, order line, quantity): as ``allocate_bills``, for sales orders per customer and product."""
    return _allocate(so_lines, sales_orders, invoice_lines, invoices, "sale", "so_id", "customer_id", "invoice_line_id",
                     "so_line_id", range_rows)


def _document_amounts(allocated: DataFrame, order_lines: DataFrame, orders: DataFrame, doc_lines: DataFrame,
                      order_id: str, doc_line_id: str, order_line_id: str, amount: str, pct: str) -> DataFrame:
    """Per order: what its allocated document lines come to, and that as a percentage of the order's total.

    Each allocated quantity is priced as its document line is (price and
    discount) and rounded as a line is. Orders without documents get 0.
    """
    rows = allocated.select(doc_line_id, order_line_id, order_id, "unit_price", "discount_pct", F.col("allocated").alias("quantity"))
    rows = _said_by(rows, doc_lines, doc_line_id, ["unit_price", "discount_pct"])
    rows = _said_by(rows, order_lines, order_line_id, [order_id])
    per = (line_amount(rows).groupBy(F.col(order_id).alias("id"))
           .agg(F.sum("quantity").alias("_q"), F.sum("line_amount").alias("_a")))
    found = F.coalesce("_a", F.lit(0)).cast(AMOUNT_SUM)
    total = F.col("total_amount")
    return orders.join(per, "id", "left").select(
        "id", F.coalesce("_q", F.lit(0)).cast(QTY_SUM).alias("quantity"), found.alias(amount),
        F.col(amount).cast(AMOUNT_SUM).alias("stored_amount"), M.safe_pct(M.money(found), total).cast("DECIMAL(30,2)").alias(pct),
        (total - found).cast(AMOUNT_SUM).alias("to_come"))


def purchase_order_amounts(po_lines: DataFrame, purchase_orders: DataFrame, bill_lines: DataFrame, bills: DataFrame,
                           range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """``amount_billed`` of every purchase order from the bills themselves, beside the stored column, and its percentage."""
    a = _allocate(po_lines, purchase_orders, bill_lines, bills, "purchase", "po_id", "vendor_id", "bill_line_id",
                  "po_line_id", range_rows, amounts=True)
    return _document_amounts(a, po_lines, purchase_orders, bill_lines, "po_id", "bill_line_id", "po_line_id",
                             "amount_billed", "billed_pct")


def sales_order_amounts(so_lines: DataFrame, sales_orders: DataFrame, invoice_lines: DataFrame, invoices: DataFrame,
                        range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """``amount_invoiced`` of every sales order from the invoices themselves, beside the stored column, and its percentage."""
    a = _allocate(so_lines, sales_orders, invoice_lines, invoices, "sale", "so_id", "customer_id", "invoice_line_id",
                  "so_line_id", range_rows, amounts=True)
    return _document_amounts(a, so_lines, sales_orders, invoice_lines, "so_id", "invoice_line_id", "so_line_id",
                             "amount_invoiced", "invoiced_pct")


def three_way_match(po_lines: DataFrame, moves: DataFrame, purchase_orders: DataFrame | None = None,
                    bill_lines: DataFrame | None = None, bills: DataFrame | None = None) -> DataFrame:
    """Per purchase-order line: ordered vs received (posted receipts linked to the
    line) vs billed quantity, with a match status.

    With orders and bills, the billed quantity is what ``allocate_bills`` gives
    the line; otherwise it is the stored column ``qty_billed``.
    """
    r = _moved(moves, "purchase_order_line_id", "purchase_receipt")
    j = po_lines.join(r, po_lines["id"] == r["line_id"], "left")
    billed = F.col("qty_billed")
    if bills is not None:
        billed_by = (allocate_bills(po_lines, purchase_orders, bill_lines, bills).where("bill_line_id IS NOT NULL")
                     .groupBy(F.col("po_line_id").alias("id")).agg(F.sum("allocated").alias("_from_bills")))
        j = j.join(billed_by, "id", "left")
        billed = F.coalesce("_from_bills", F.lit(0))
    ordered = F.col("quantity")
    received = F.coalesce(F.col("_moved"), F.lit(0)).cast(QTY_SUM)
    status = (F.when(billed > received, F.lit("billed_not_received"))
              .when(received < ordered, F.lit("open_receipt"))
              .when(billed < received, F.lit("received_not_billed"))
              .otherwise(F.lit("matched")))
    return j.select("id", "po_id", ordered.cast(QTY_SUM).alias("qty_ordered"), received.alias("qty_received"),
                    billed.cast(QTY_SUM).alias("qty_billed"), status.alias("match_status"))


def po_billed_pct(purchase_orders: DataFrame) -> DataFrame:
    """The stored percentage column: 0 when the total is 0, else round(billed / total * 100, 2).

    (Its name in the data model says "received"; its input is the billed amount.)
    """
    return purchase_orders.select("id", M.safe_pct("amount_billed", "total_amount").cast("DECIMAL(6,2)")
                                  .alias("amount_received_pct"))
