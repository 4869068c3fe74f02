"""Receivables and payables: settlement, status, credit limits, payment allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.operators.sweep import interval_allocate

AMOUNT_SUM = "DECIMAL(30,4)"


def settle_invoices(invoices: DataFrame, allocations: DataFrame) -> DataFrame:
    """amount_paid = sum of the invoice's payment allocations; amount_due = total - paid."""
    paid = allocations.groupBy("invoice_id").agg(F.sum("allocated_amount").alias("_paid"))
    return (invoices.join(paid, invoices["id"] == paid["invoice_id"], "left").drop("invoice_id")
            .withColumn("amount_paid", F.coalesce("_paid", F.lit(0)).cast("DECIMAL(20,4)"))
            .withColumn("amount_due", (F.col("total_amount") - F.col("amount_paid")).cast("DECIMAL(20,4)"))
            .drop("_paid"))


def derive_invoice_status(invoices: DataFrame, as_of: str) -> DataFrame:
    """Status from amounts and dates (our rule; the data model stores it only).

    draft and voided are kept; nothing due -> paid; past due date -> overdue;
    something paid -> partial; else sent.
    """
    as_of_c = F.lit(as_of).cast("date")
    st = (F.when(F.col("status").isin("draft", "voided"), F.col("status"))
          .when(F.col("amount_due") <= 0, F.lit("paid"))
          .when(F.col("due_date").isNotNull() & (F.col("due_date") < as_of_c), F.lit("overdue"))
          .when(F.col("amount_paid") > 0, F.lit("partial"))
          .otherwise(F.lit("sent")))
    return invoices.withColumn("derived_status", st)


def credit_limit_breach(invoices: DataFrame, contacts: DataFrame) -> DataFrame:
    """Customers whose open sales amount due exceeds their credit limit (NULL limit = none)."""
    due = (invoices.filter((F.col("type") == "sale") & ~F.col("status").isin("paid", "voided", "draft"))
           .groupBy("contact_id").agg(F.sum("amount_due").cast(AMOUNT_SUM).alias("open_due")))
    c = contacts.filter(F.col("credit_limit").isNotNull()).select(
        F.col("id").alias("contact_id"), "company_id", "name", "credit_limit")
    return (c.join(due, "contact_id")
            .filter(F.col("open_due") > F.col("credit_limit"))
            .withColumn("excess", (F.col("open_due") - F.col("credit_limit")).cast(AMOUNT_SUM)))


def resolve_control_accounts(contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Contact's AR/AP override, else the company's control receivable / payable account."""
    ctl = accounts.filter(F.col("is_control"))
    ar = ctl.filter(F.col("category") == "asset").groupBy("company_id").agg(F.min("id").alias("_ar"))
    ap = ctl.filter(F.col("category") == "liability").groupBy("company_id").agg(F.min("id").alias("_ap"))
    return (contacts.join(ar, "company_id", "left").join(ap, "company_id", "left")
            .select("id", "company_id", F.coalesce("ar_account_id", "_ar").alias("ar_account_id"),
                    F.coalesce("ap_account_id", "_ap").alias("ap_account_id")))


def payment_autoallocate(payments: DataFrame, invoices: DataFrame, invoice_type: str = "sale",
                         direction: str = "inbound") -> DataFrame:
    """Allocate each contact's payments to its oldest invoices (FIFO).

    Payments in (payment_date, id) order fill invoices in (invoice_date, id)
    order; each (payment, invoice) overlap is an allocation row. Invoice
    amounts not covered come back with a NULL payment (still open).
    """
    sup = payments.filter(F.col("direction") == direction).select(
        "contact_id", F.col("id").alias("payment_id"), "payment_date", F.col("amount").alias("_amt"))
    dem = invoices.filter((F.col("type") == invoice_type) & ~F.col("status").isin("draft", "voided")).select(
        "contact_id", F.col("id").alias("invoice_id"), "invoice_date", F.col("total_amount").alias("_tot"))
    a = interval_allocate(sup, dem, ["contact_id"], ["payment_date", "payment_id"], ["invoice_date", "invoice_id"],
                          "_amt", "_tot", "payment_id", "invoice_id")
    return a.select("contact_id", "payment_id", "invoice_id",
                    F.col("allocated").cast("DECIMAL(20,4)").alias("allocated_amount"))


def default_due_date(invoices: DataFrame, contacts: DataFrame, mode: str = "terms") -> DataFrame:
    """Due date when none is stored.

    ``terms``: invoice date + the contact's payment terms in days (30 when
    the contact has none), as the data model's default suggests; ``same_day``:
    the invoice date, as the invoice form does it.
    """
    if mode == "same_day":
        return invoices.withColumn("effective_due_date", F.coalesce("due_date", "invoice_date"))
    c = contacts.select(F.col("id").alias("contact_id"), "payment_terms")
    days = F.coalesce(F.col("payment_terms").cast("int"), F.lit(30))
    return (invoices.join(c, "contact_id", "left")
            .withColumn("effective_due_date", F.coalesce("due_date", F.date_add("invoice_date", days)))
            .drop("payment_terms"))


def invoice_contact_names(invoices: DataFrame, contacts: DataFrame) -> DataFrame:
    """Invoice list with the contact's name, 'Unknown' when the contact is missing."""
    c = contacts.select(F.col("id").alias("contact_id"), F.col("name").alias("_n"))
    return (invoices.join(c, "contact_id", "left")
            .withColumn("contact_name", F.coalesce("_n", F.lit("Unknown"))).drop("_n"))
