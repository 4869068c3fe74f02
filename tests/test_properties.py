"""Property checks of the ordered-state operators."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kontor.operators import posting as P
from kontor.operators.sweep import interval_allocate, running_sum
from kontor.sources import fixture as FX

from conftest import SF_SMALL

qty = st.integers(min_value=1, max_value=20)


@settings(max_examples=15, deadline=None)
@given(st.lists(qty, min_size=0, max_size=8), st.lists(qty, min_size=1, max_size=8))
def test_allocation_conserves_quantity(spark, supply, demand):
    s = spark.createDataFrame([(1, i, Decimal(q)) for i, q in enumerate(supply)] or [(2, 0, Decimal(1))],
                              "k INT, sid INT, q DECIMAL(20,6)")
    d = spark.createDataFrame([(1, i, Decimal(q)) for i, q in enumerate(demand)], "k INT, did INT, q DECIMAL(20,6)")
    a = interval_allocate(s, d, ["k"], ["sid"], ["did"], "q", "q", "sid", "did").filter("k = 1").collect()
    matched = sum(r["allocated"] for r in a if r["sid"] is not None)
    short = sum(r["allocated"] for r in a if r["sid"] is None)
    assert matched == min(sum(supply), sum(demand))
    assert short == max(0, sum(demand) - sum(supply))
    # FIFO: a later supply item is only used once every earlier one is exhausted
    used = {}
    for r in a:
        if r["sid"] is not None:
            used[r["sid"]] = used.get(r["sid"], 0) + r["allocated"]
    for sid in used:
        for earlier in range(sid):
            assert used.get(earlier, 0) == supply[earlier]


def test_running_sum_bucketed_equals_plain(spark):
    rows = [(k % 3, i, i // 7, Decimal(i % 5 - 2)) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k INT, i INT, b INT, v DECIMAL(20,4)")
    plain = {(r["k"], r["i"]): r["s"] for r in running_sum(df, ["k"], ["i"], "v", "s").collect()}
    split = {(r["k"], r["i"]): r["s"] for r in running_sum(df, ["k"], ["b", "i"], "v", "s", bucket="b").collect()}
    assert plain == split


def test_generated_journals_balance(spark):
    lg = FX.ledger(spark, SF_SMALL)
    _, lines = P.invoice_to_journal(lg.invoices, lg.invoice_lines, lg.accounts, lg.contacts, lg.tax_codes, 10**12)
    bad = (lines.groupBy("journal_entry_id")
           .agg((F.sum("debit_amount") - F.sum("credit_amount")).alias("d")).filter("d != 0").count())
    assert bad == 0


def test_reversal_nets_to_zero(spark):
    lg = FX.ledger(spark, SF_SMALL)
    _, rev, _ = P.reverse_entries(lg.journal_entries, lg.journal_entry_lines, 10**12)
    posted = lg.journal_entry_lines.join(lg.journal_entries.filter("status = 'posted'")
                                         .select(F.col("id").alias("journal_entry_id")), "journal_entry_id", "left_semi")
    both = posted.select("account_id", "debit_base", "credit_base").unionByName(
        rev.select("account_id", "debit_base", "credit_base"))
    net = both.groupBy("account_id").agg((F.sum("debit_base") - F.sum("credit_base")).alias("n"))
    assert net.filter("n != 0").count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(qty, min_size=1, max_size=12), st.lists(qty, min_size=1, max_size=12))
def test_axis_bucketed_sweep_equals_plain(spark, supply, demand):
    s = spark.createDataFrame([(1, i, Decimal(q)) for i, q in enumerate(supply)], "k INT, sid INT, q DECIMAL(20,6)")
    d = spark.createDataFrame([(1, i, Decimal(q)) for i, q in enumerate(demand)], "k INT, did INT, q DECIMAL(20,6)")
    plain = {tuple(r) for r in interval_allocate(s, d, ["k"], ["sid"], ["did"], "q", "q", "sid", "did",
                                                 range_rows=None).collect()}
    split = {tuple(r) for r in interval_allocate(s, d, ["k"], ["sid"], ["did"], "q", "q", "sid", "did",
                                                 range_rows=2).collect()}
    single = {tuple(r) for r in interval_allocate(s, d, ["k"], ["sid"], ["did"], "q", "q", "sid", "did",
                                                  range_rows=1).collect()}
    assert plain == split == single


def test_transfers_conserve_stock(spark):
    """Posted transfers move stock between locations: per product they net to zero."""
    from kontor.operators import inventory as I
    lg = FX.ledger(spark, SF_SMALL)
    transfers = lg.stock_moves.filter(F.col("move_type") == "transfer")
    per_product = I.stock_on_hand_total(I.apply_stock_moves(transfers))
    assert per_product.count() > 0
    assert per_product.filter(F.col("qty_on_hand") != 0).count() == 0
