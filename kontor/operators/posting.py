"""Posting rules as set operations: period check (T1), balance check (T2),
journal generation from invoices, reversal of entries.

The data model enforces its rules with row triggers that abort a statement.
Here a whole batch of candidate rows is checked at once and split: every
row comes back with a ``reason`` (NULL when accepted), so callers can write
the accepted rows and quarantine the rest. Rule precedence follows the
trigger firing order: the period check first, then "no lines", then
"unbalanced".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions import money as M

AMOUNT_SUM = "DECIMAL(30,4)"


def check_period_open(candidates: DataFrame, periods: DataFrame) -> DataFrame:
    """A row whose new status is 'posted' may not sit in a closed or locked period."""
    p = periods.select(F.col("id").alias("period_id"), F.col("status").alias("_period_status"))
    j = candidates.join(p, "period_id", "left")
    bad = (F.col("status") == "posted") & F.col("_period_status").isin("closed", "locked")
    return (j.withColumn("period_reason", F.when(bad, F.concat(F.lit("period "), F.col("_period_status"))))
            .drop("_period_status"))


def post_entries(candidates: DataFrame, lines: DataFrame, periods: DataFrame,
                 previous: DataFrame | None = None, event: str = "update",
                 stamp_time: bool = False) -> DataFrame:
    """T1 + T2 over a batch of entry rows in their new state.

    ``previous`` holds (id, status) before the change; with ``event='update'``
    the balance rule runs only on a transition to 'posted' (no previous row or
    a previous status other than 'posted'). With ``event='insert'`` only the
    period rule runs -- the balance trigger is declared for UPDATE only, so an
    unbalanced entry inserted directly as posted is accepted.

    Balance rule: sum(debit) = 0 -> 'no lines' (also credit-only or zero
    entries), sum(debit) <> sum(credit) -> 'unbalanced'. Line totals are
    aggregated only for the candidate entries (semi-join first).
    """
    c = check_period_open(candidates, periods)
    if event == "insert":
        reason = F.col("period_reason")
        out = c.withColumn("transition", F.lit(False))
    else:
        if previous is not None:
            prev = previous.select(F.col("id"), F.col("status").alias("_old_status"))
            c = c.join(prev, "id", "left")
        else:
            c = c.withColumn("_old_status", F.lit(None).cast("string"))
        transition = (F.col("status") == "posted") & (F.col("_old_status").isNull()
                                                      | (F.col("_old_status") != "posted"))
        ids = candidates.select(F.col("id").alias("journal_entry_id"))
        totals = (lines.join(ids, "journal_entry_id", "left_semi")
                  .groupBy("journal_entry_id")
                  .agg(F.sum("debit_amount").alias("_d"), F.sum("credit_amount").alias("_c")))
        c = c.join(totals, c["id"] == totals["journal_entry_id"], "left").drop("journal_entry_id")
        d = F.coalesce("_d", F.lit(0))
        cr = F.coalesce("_c", F.lit(0))
        reason = (F.when(F.col("period_reason").isNotNull(), F.col("period_reason"))
                  .when(F.col("transition") & (d == 0), F.lit("no lines"))
                  .when(F.col("transition") & (d != cr), F.lit("unbalanced")))
        out = (c.withColumn("transition", transition)
               .withColumn("total_debit", d.cast(AMOUNT_SUM)).withColumn("total_credit", cr.cast(AMOUNT_SUM))
               .withColumn("reason", reason)
               .drop("_d", "_c", "_old_status"))
    if event == "insert":
        out = out.withColumn("reason", reason)
    out = out.withColumn("accepted", F.col("reason").isNull()).drop("period_reason")
    if stamp_time:
        out = out.withColumn("posted_at", F.when(F.col("accepted") & F.col("transition"), F.current_timestamp()))
    return out


def split_posting(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with reason)."""
    return checked.filter(F.col("accepted")), checked.filter(~F.col("accepted"))


def reverse_entries(entries: DataFrame, lines: DataFrame, id_offset: int,
                    reversal_date: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mirror posted entries: new header (is_reversal) with debit/credit swapped lines.

    Returns (new entries, new lines, originals with ``reversed_by`` set). New
    ids are ``id + id_offset`` for headers and lines, so they are stable and
    need no global numbering. Both the original and the reversal together
    net to zero on every account.
    """
    posted = entries.filter(F.col("status") == "posted")
    new_e = (posted.withColumn("id", F.col("id") + F.lit(id_offset))
             .withColumn("entry_number", F.concat(F.lit("REV-"), F.col("entry_number")))
             .withColumn("is_reversal", F.lit(True))
             .withColumn("reversed_by", F.lit(None).cast("bigint"))
             .withColumn("source_type", F.lit("reversal"))
             .withColumn("source_id", F.col("id") - F.lit(id_offset)))
    if reversal_date is not None:
        new_e = new_e.withColumn("entry_date", F.lit(reversal_date).cast("date"))
    ids = posted.select(F.col("id").alias("journal_entry_id"))
    new_l = (lines.join(ids, "journal_entry_id", "left_semi")
             .select(*[F.col(c) for c in lines.columns if c not in (
                 "id", "journal_entry_id", "debit_amount", "credit_amount", "debit_base", "credit_base")],
                     (F.col("id") + F.lit(id_offset)).alias("id"),
                     (F.col("journal_entry_id") + F.lit(id_offset)).alias("journal_entry_id"),
                     F.col("credit_amount").alias("debit_amount"), F.col("debit_amount").alias("credit_amount"),
                     F.col("credit_base").alias("debit_base"), F.col("debit_base").alias("credit_base"))
             .select(*lines.columns))
    marked = entries.withColumn(
        "reversed_by", F.when(F.col("status") == "posted", F.col("id") + F.lit(id_offset))
        .otherwise(F.col("reversed_by")))
    return new_e, new_l, marked


def invoice_to_journal(invoices: DataFrame, invoice_lines: DataFrame, accounts: DataFrame,
                       contacts: DataFrame, tax_codes: DataFrame, id_offset: int) -> tuple[DataFrame, DataFrame]:
    """Journal entry per invoice or credit note: receivable/payable vs revenue/expense and tax lines.

    Sales: debit the customer's receivable (contact override, else the
    company's control account) with line amount + tax; credit each line's
    revenue account with the line amount and the tax code's account with the
    tax. Purchases mirror it (debit expense + tax, credit payable), and credit
    notes reverse the sides of their kind. Of several control accounts of a
    company the one with the lowest id counts. Line ids follow from the ids of
    the invoice lines (3 * line + leg) and of the invoice (3 * invoice + 2), so
    they are distinct for any number of lines. Amounts
    come from the lines (``line_amount`` and ``tax_amount``), so every
    generated entry balances by construction. Lines are generated with one
    ``explode`` per invoice line (2 legs) plus one aggregated control leg per
    invoice.
    """
    kinds = ["sale", "purchase", "credit_note_sale", "credit_note_purchase"]
    inv = invoices.filter(F.col("type").isin(*kinds)).select(
        F.col("id").alias("invoice_id"), "company_id", "type", "contact_id", "invoice_date", "exchange_rate",
        F.when(F.col("type").endswith("sale"), "sale").otherwise("purchase").alias("side"))
    ctl = (accounts.filter(F.col("is_control") & F.col("category").isin("asset", "liability"))
           .groupBy("company_id", F.when(F.col("category") == "asset", "sale").otherwise("purchase").alias("side"))
           .agg(F.min("id").alias("_default_ctl")))
    ct = contacts.select(F.col("id").alias("contact_id"), "ar_account_id", "ap_account_id")
    tx = tax_codes.select(F.col("id").alias("tax_code_id"), F.col("account_id").alias("_tax_account"))
    il = (invoice_lines.join(inv, "invoice_id").join(tx, "tax_code_id", "left")
          .select("invoice_id", "company_id", "contact_id", F.col("id").alias("line_id"), "line_number", "type", "side",
                  "account_id", "line_amount", "tax_amount", "_tax_account", "exchange_rate"))
    sale = F.col("side") == "sale"
    debit_control = F.col("type").isin("sale", "credit_note_purchase")
    legs = F.array(
        F.struct(F.col("account_id").alias("account_id"), F.col("line_amount").alias("amount"),
                 F.lit(0).alias("leg")),
        F.struct(F.col("_tax_account").alias("account_id"), F.col("tax_amount").alias("amount"),
                 F.lit(1).alias("leg")))
    detail = (il.select("invoice_id", "line_id", "line_number", "type", "exchange_rate", F.explode(legs).alias("g"))
              .filter((F.col("g.amount") != 0) | (F.col("g.leg") == 0))
              .select("invoice_id", (F.col("line_id") * 3 + F.col("g.leg")).alias("line_key"),
                      (F.col("line_number").cast("int") * 2 + F.col("g.leg")).alias("line_number"),
                      F.col("g.account_id").alias("account_id"), F.col("g.amount").alias("amount"),
                      (~debit_control).alias("is_debit"), "exchange_rate"))
    control = (il.groupBy("invoice_id", "company_id", "contact_id", "type", "side", "exchange_rate")
               .agg((F.sum("line_amount") + F.sum("tax_amount")).alias("amount"))
               .join(ct, "contact_id", "left")
               .join(ctl, ["company_id", "side"], "left")
               .select("invoice_id", (F.col("invoice_id") * 3 + 2).alias("line_key"), F.lit(0).alias("line_number"),
                       F.coalesce(F.when(sale, F.col("ar_account_id")).otherwise(F.col("ap_account_id")),
                                  F.col("_default_ctl")).alias("account_id"),
                       "amount", debit_control.alias("is_debit"), "exchange_rate"))
    jl = detail.unionByName(control)
    amt = F.col("amount").cast("DECIMAL(20,4)")
    zero = M.zero_money()
    lines_out = jl.select(
        (F.col("line_key") + F.lit(id_offset)).alias("id"),
        (F.col("invoice_id") + F.lit(id_offset)).alias("journal_entry_id"),
        F.col("line_number").cast("int").alias("line_number"), F.col("account_id").cast("int"),
        F.when(F.col("is_debit"), amt).otherwise(zero).alias("debit_amount"),
        F.when(~F.col("is_debit"), amt).otherwise(zero).alias("credit_amount"),
        F.when(F.col("is_debit"), M.to_base(amt, "exchange_rate")).otherwise(zero).alias("debit_base"),
        F.when(~F.col("is_debit"), M.to_base(amt, "exchange_rate")).otherwise(zero).alias("credit_base"))
    entries_out = inv.select(
        (F.col("invoice_id") + F.lit(id_offset)).alias("id"), "company_id",
        F.concat(F.lit("JE-INV-"), F.col("invoice_id").cast("string")).alias("entry_number"),
        F.col("invoice_date").alias("entry_date"), F.lit("draft").alias("status"),
        F.lit("invoice").alias("source_type"), F.col("invoice_id").alias("source_id"))
    return entries_out, lines_out


def resolve_sources(entries: DataFrame, invoices: DataFrame, payments: DataFrame,
                    moves: DataFrame) -> DataFrame:
    """Polymorphic source link (source_type, source_id) -> the source document number.

    One left join per source type on (type, id), combined with ``coalesce``:
    each entry meets only the table its type names, and an unknown type or a
    dangling id yields NULL (``source_found`` = false).
    """
    e = entries.select("id", "source_type", "source_id")
    srcs = [("invoice", invoices.select(F.col("id").alias("_sid"), F.col("invoice_number").alias("_doc"))),
            ("payment", payments.select(F.col("id").alias("_sid"), F.col("payment_number").alias("_doc"))),
            ("stock_move", moves.select(F.col("id").alias("_sid"), F.col("move_number").alias("_doc")))]
    out = e
    docs = []
    for i, (typ, df) in enumerate(srcs):
        d = df.withColumnRenamed("_doc", f"_doc{i}").withColumn("_t", F.lit(typ)).withColumnRenamed("_sid", f"_s{i}")
        out = out.join(d, (out["source_type"] == d["_t"]) & (out["source_id"] == d[f"_s{i}"]), "left").drop(
            "_t", f"_s{i}")
        docs.append(F.col(f"_doc{i}"))
    return (out.withColumn("source_document", F.coalesce(*docs))
            .withColumn("source_found", F.col("source_document").isNotNull())
            .select("id", "source_type", "source_id", "source_document", "source_found"))


def reversal_mirror_check(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Reversal pairs (entry.reversed_by -> its reversal) whose lines do not
    mirror: per account, original + reversal base amounts must net to zero.

    Self equi-join of entries on ``reversed_by``; both entries' lines are
    aggregated to (pair, account) before comparing.
    """
    pairs = (entries.filter(F.col("reversed_by").isNotNull())
             .select(F.col("id").alias("original_id"), F.col("reversed_by").alias("reversal_id")))
    orig = pairs.select("original_id", F.col("original_id").alias("journal_entry_id"))
    rev = pairs.select("original_id", F.col("reversal_id").alias("journal_entry_id"))
    member = orig.unionByName(rev)
    net = (lines.select("journal_entry_id", "account_id", "debit_base", "credit_base")
           .join(member, "journal_entry_id")
           .groupBy("original_id", "account_id")
           .agg((F.sum("debit_base") - F.sum("credit_base")).cast(AMOUNT_SUM).alias("net")))
    return net.filter(F.col("net") != 0)
