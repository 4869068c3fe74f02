"""Amounts of orders: one shuffle of the queues, prices carried along, derived lines written once."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from kontor.operators import orders as O
from kontor.operators.sweep import interval_allocate
from kontor.sources import fixture as FX

SF = "/root/testdata/sf0.001"
LINES = "id BIGINT, {} BIGINT, product_id BIGINT, quantity DECIMAL(20,6), unit_price DECIMAL(20,4), discount_pct DECIMAL(6,4)"


def _frames(spark, order_id, party, kind):
    """Two parties, an id of a document line and of an order line that is there twice, null keys, zero and null quantities."""
    rng = random.Random(4)
    day = dt.date(2024, 1, 1)
    docs = [(i, kind if i % 5 else "other", "draft" if i == 7 else "sent", None if i == 8 else i % 2, day + dt.timedelta(i % 3))
            for i in range(12)]
    orders = [(100 + i, i % 2, day + dt.timedelta(i % 4), D(100 * i), D(i)) for i in range(6)]
    doc_lines = [(i, i % 12, None if i == 3 else i % 3, D(rng.randint(0, 9)) if i % 11 else None, D(rng.randint(1, 9)), D(0))
                 for i in range(60)]
    doc_lines.append((14, 2, 2, D(0), D(50), D(0)))
    order_lines = [(1000 + i, 100 + i % 6, i % 3, D(rng.randint(0, 15)) if i % 13 else None) for i in range(40)]
    order_lines.append((1004, 105, 7, D(3)))
    return (spark.createDataFrame(order_lines, f"id BIGINT, {order_id} BIGINT, product_id BIGINT, quantity DECIMAL(20,6)"),
            spark.createDataFrame(orders, f"id BIGINT, {party} BIGINT, order_date DATE, total_amount DECIMAL(20,4), amount DECIMAL(20,4)"),
            spark.createDataFrame(doc_lines, LINES.format("invoice_id")),
            spark.createDataFrame(docs, "id BIGINT, type STRING, status STRING, contact_id BIGINT, invoice_date DATE")
            ), (docs, orders, doc_lines, order_lines)


def _expected(kind, docs, orders, doc_lines, order_lines):
    """(quantity, amount) of every order, from queues walked item by item."""
    head = {d[0]: d for d in docs if d[1] == kind and d[2] == "sent"}
    who = {o[0]: o for o in orders}
    supply, demand, found = defaultdict(list), defaultdict(list), defaultdict(D)
    for i, doc, product, q, *_ in doc_lines:
        if doc in head and head[doc][3] is not None and product is not None and q is not None and q > 0:
            supply[head[doc][3], product].append((head[doc][4], i, q))
    for i, order, product, q in order_lines:
        demand[who[order][1], product].append((who[order][2], i, q or D(0)))
    for key, wanted in demand.items():
        left = [list(x) for x in sorted(supply[key])]
        for _, line, q in sorted(wanted):
            while q and left:
                part = min(q, left[0][2])
                found[left[0][1], line] += part
                q -= part
                left[0][2] -= part
                if not left[0][2]:
                    left.pop(0)
    out = defaultdict(lambda: [D(0), D(0)])
    for (doc_line, order_line), q in found.items():
        for price in [x[4] for x in doc_lines if x[0] == doc_line]:
            for order in [x[1] for x in order_lines if x[0] == order_line]:
                out[order][0] += q
                out[order][1] += q * price
    return {o[0]: tuple(out[o[0]]) for o in orders}


@pytest.mark.parametrize("range_rows", [None, 1_000_000, 3])
@pytest.mark.parametrize("side", ["sale", "purchase"])
def test_lines_are_not_read_again_for_their_prices(spark, side, range_rows):
    """allocated rows carry price, discount and order; one join is left, that of the orders."""
    fn, order_id, party, amount = {"sale": (O.sales_order_amounts, "so_id", "customer_id", "amount_invoiced"),
                                   "purchase": (O.purchase_order_amounts, "po_id", "vendor_id", "amount_billed")}[side]
    frames, rows = _frames(spark, order_id, party, side)
    frames = (frames[0], frames[1].withColumnRenamed("amount", amount), *frames[2:])
    got = {r["id"]: (r["quantity"], r[amount]) for r in fn(*frames, range_rows).collect()}
    assert got == _expected(side, *rows)
    once = fn(frames[0].dropDuplicates(["id"]), frames[1], frames[2].dropDuplicates(["id"]), frames[3], None)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("RepartitionByExpression") == 1


def test_allocation_carries_columns_over_ranges(spark):
    """small and hot keys give the same rows, with what was asked to be carried."""
    rng = random.Random(1)
    s = [(k, i, D(rng.randint(0, 6)), f"s{i}") for k in (1, 2, None) for i in range(40 if k == 1 else 2)]
    d = [(k, i, D(rng.randint(0, 6)) if i else None, f"d{i}") for k in (1, 2, None) for i in range(30 if k == 1 else 5)]
    s = spark.createDataFrame(s, "k INT, sid INT, q DECIMAL(20,6), sx STRING")
    d = spark.createDataFrame(d, "k INT, did INT, q DECIMAL(20,6), dx STRING")
    whole, cut = (interval_allocate(s, d, ["k"], ["sid"], ["did"], "q", "q", "sid", "did", n, ["sx"], ["dx"]) for n in (None, 4))
    assert whole.schema == cut.schema and whole.columns == ["k", "sid", "did", "allocated", "sx", "dx"]
    rows = sorted(map(str, whole.collect()))
    assert rows == sorted(map(str, cut.collect())) and any("k=2" in r for r in rows) and not any("k=None" in r for r in rows)
    assert whole.where("sx <> concat('s', sid) OR dx <> concat('d', did) OR (sid IS NULL) <> (sx IS NULL)").isEmpty()


def test_written_line_items_are_joined_without_a_shuffle(spark):
    """lines and order headers are written by their key, in a dense codec, and the catalog keeps no name."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    lg = FX.ledger(spark, SF)
    lg.materialize(["line_src", "order_head"])
    try:
        spark.conf.set(threshold, "-1")
        lines = lg.journal_entry_lines
        assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
        plain = FX.ledger(spark, SF).journal_entry_lines
        assert lines.exceptAll(plain).isEmpty() and plain.exceptAll(lines).isEmpty()
    finally:
        spark.conf.set(threshold, before)
    files = lg["line_src"].select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all(".zstd." in r["f"] for r in files)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("kontor_") and len(t.name) == 39]
