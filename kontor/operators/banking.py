"""Bank operators: running balances, transaction-to-payment matching, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators.sweep import RANGE, RANGE_ROWS, ranged, running, running_sum
from kontor.session import cut_lineage

AMOUNT_SUM = "DECIMAL(30,4)"


def bank_running_balance(transactions: DataFrame, bank_accounts: DataFrame) -> DataFrame:
    """Balance after each transaction, per account in (date, id) order, from the opening balance.

    ROWS frame (same-day transactions are ordered by id, not summed together).
    Two-phase running sum bucketed by transaction date: a busy account is
    spread over its days.
    """
    t = running_sum(transactions, ["bank_account_id"], ["transaction_date", "id"], "amount", "_run",
                    bucket="transaction_date")
    a = bank_accounts.select(F.col("id").alias("bank_account_id"), "opening_balance")
    return (t.join(a, "bank_account_id", "left")
            .withColumn("running_balance",
                        (F.coalesce("opening_balance", F.lit(0)) + F.col("_run")).cast(AMOUNT_SUM))
            .drop("_run", "opening_balance"))


def account_running_balance(ledger: DataFrame) -> DataFrame:
    """Running balance per account over general-ledger rows, on the normal side.

    Input: general-ledger rows with account_code, company_id, entry_date,
    entry_number, debit_base, credit_base and the account's normal side.
    """
    signed = F.when(F.col("normal_balance") == "debit", F.col("debit_base") - F.col("credit_base")) \
        .otherwise(F.col("credit_base") - F.col("debit_base"))
    g = ledger.withColumn("_signed", signed.cast(AMOUNT_SUM))
    return running_sum(g, ["company_id", "account_code"], ["entry_date", "entry_number", "line_key"], "_signed",
                       "running_balance", bucket="entry_date").drop("_signed")


def bank_match(transactions: DataFrame, payments: DataFrame, max_days: int = 3) -> DataFrame:
    """Match bank transactions to payments.

    1. explicit link: the transaction's payment_id;
    2. otherwise by (bank account, signed amount) with the dates at most
       ``max_days`` apart. Closer dates first, at equal distance the earlier
       payment date; of equal ones on a date the k-th transaction takes the
       k-th payment, by id. A payment is used once, and no two that could be
       matched both stay open.
    Returns every transaction with ``matched_payment_id`` and ``match_rule``
    (explicit / amount_date / NULL when unmatched). Each distance is one
    equi-join on (account, amount, date, rank), so recurring amounts spread
    over their dates and no pair that is not a match is made.
    """
    t = transactions.select("id", "bank_account_id", "transaction_date", "amount", "payment_id")
    signed = F.when(F.col("direction") == "inbound", F.col("amount")).otherwise(-F.col("amount"))
    p = payments.select(F.col("id").alias("pay_id"), F.col("bank_account_id").alias("_pb"),
                        F.col("payment_date"), signed.cast("DECIMAL(20,4)").alias("_pamt"))
    explicit = t.filter(F.col("payment_id").isNotNull())
    used = explicit.select(F.col("payment_id").alias("pay_id")).distinct()
    open_t = t.filter(F.col("payment_id").isNull()).select("id", "bank_account_id", "amount", "transaction_date")
    open_p = p.join(used, "pay_id", "left_anti")
    found = None
    for shift in sorted(range(-max_days, max_days + 1), key=lambda s: (abs(s), s)):
        left_t = open_t if found is None else open_t.join(found.select("id"), "id", "left_anti")
        left_p = open_p if found is None else open_p.join(found.select("pay_id"), "pay_id", "left_anti")
        ranked_t = left_t.withColumn("_k", F.row_number().over(
            Window.partitionBy("bank_account_id", "amount", "transaction_date").orderBy("id")))
        ranked_p = left_p.withColumn("_k", F.row_number().over(
            Window.partitionBy("_pb", "_pamt", "payment_date").orderBy("pay_id"))).withColumnRenamed("_k", "_pk")
        pairs = ranked_t.join(ranked_p, (F.col("bank_account_id") == F.col("_pb")) & (F.col("amount") == F.col("_pamt"))
                              & (F.date_add("transaction_date", shift) == F.col("payment_date"))
                              & (F.col("_k") == F.col("_pk"))).select("id", "pay_id")
        found = cut_lineage(pairs if found is None else found.unionByName(pairs))
    m2 = found.select("id", F.col("pay_id").alias("_m2"))
    out = t.join(m2, "id", "left")
    return out.select(
        "id", "bank_account_id", "transaction_date", "amount",
        F.coalesce("payment_id", "_m2").alias("matched_payment_id"),
        F.when(F.col("payment_id").isNotNull(), F.lit("explicit"))
        .when(F.col("_m2").isNotNull(), F.lit("amount_date")).alias("match_rule"))


def unreconciled_transactions(transactions: DataFrame, period_end: str) -> DataFrame:
    """The transactions up to ``period_end`` that no statement has confirmed yet."""
    return transactions.filter((F.col("transaction_date") <= F.lit(period_end).cast("date"))
                               & ~F.coalesce("is_reconciled", F.lit(False)))


def bank_reconcile(transactions: DataFrame, bank_accounts: DataFrame, period_end: str) -> DataFrame:
    """Per account at ``period_end``: book balance (opening + all transactions up to
    the date), statement balance (opening + reconciled ones), their difference
    and the number of unreconciled transactions. One pass of conditional sums."""
    end = F.lit(period_end).cast("date")
    t = transactions.filter(F.col("transaction_date") <= end)
    agg = t.groupBy("bank_account_id").agg(
        F.sum("amount").alias("_all"),
        F.sum(F.when(F.col("is_reconciled"), F.col("amount")).otherwise(0)).alias("_rec"),
        F.count(F.when(~F.col("is_reconciled"), F.lit(1))).cast("bigint").alias("unreconciled_count"))
    a = bank_accounts.select(F.col("id").alias("bank_account_id"), "opening_balance")
    j = a.join(agg, "bank_account_id", "left")
    book = (F.col("opening_balance") + F.coalesce("_all", F.lit(0))).cast(AMOUNT_SUM)
    stmt = (F.col("opening_balance") + F.coalesce("_rec", F.lit(0))).cast(AMOUNT_SUM)
    return j.select("bank_account_id", end.alias("period_end_date"), stmt.alias("statement_balance"),
                    book.alias("book_balance"), (stmt - book).cast(AMOUNT_SUM).alias("difference"),
                    F.coalesce("unreconciled_count", F.lit(0).cast("bigint")).alias("unreconciled_count"))


def statement_reconciliation(transactions: DataFrame, bank_accounts: DataFrame, statements: DataFrame,
                             range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """Every stored bank statement against the books as of its own date.

    Statements and transactions share one axis per account, ordered by date with
    a day's transactions before its statement, so one ordered pass gives the
    booked and the reconciled balance and the open transactions as of every
    statement; a busy account is cut into ranges. ``difference`` is statement
    minus reconciled books, ``outstanding`` what the open transactions add to
    them. ``status``: ``agrees`` without a difference, else ``explained`` if the
    open transactions make it up, else ``differs``.
    """
    zero = F.lit(0).cast(AMOUNT_SUM)
    moves = transactions.select(
        "bank_account_id", F.col("transaction_date").alias("day"), F.lit(0).alias("kind"), "id",
        F.col("amount").cast(AMOUNT_SUM).alias("amount"),
        F.when(F.col("is_reconciled"), F.col("amount")).otherwise(0).cast(AMOUNT_SUM).alias("settled"),
        F.when(F.coalesce("is_reconciled", F.lit(False)), 0).otherwise(1).cast("bigint").alias("open"),
        F.lit(None).cast(AMOUNT_SUM).alias("statement_balance"))
    marks = statements.select(
        "bank_account_id", F.col("period_end_date").alias("day"), F.lit(1).alias("kind"), F.col("id").cast("bigint").alias("id"),
        zero.alias("amount"), zero.alias("settled"), F.lit(0).cast("bigint").alias("open"),
        F.col("statement_balance").cast(AMOUNT_SUM).alias("statement_balance"))
    order = ["day", "kind", "id"]
    axis = ranged(moves.unionByName(marks), ["bank_account_id"], order, range_rows)
    seen = running(axis, ["bank_account_id"], order,
                   [("_booked", "amount", "sum"), ("_settled", "settled", "sum"), ("_open", "open", "sum")], RANGE)
    accounts = bank_accounts.select(F.col("id").alias("bank_account_id"), "opening_balance")
    r = seen.where("kind = 1").join(accounts, "bank_account_id", "left").select(
        F.col("id").cast("int").alias("reconciliation_id"), "bank_account_id", F.col("day").alias("period_end_date"),
        "statement_balance",
        (F.coalesce("opening_balance", F.lit(0)) + F.col("_settled")).cast(AMOUNT_SUM).alias("reconciled_balance"),
        (F.coalesce("opening_balance", F.lit(0)) + F.col("_booked")).cast(AMOUNT_SUM).alias("book_balance"),
        F.col("_open").cast("bigint").alias("open_transactions"))
    r = (r.withColumn("difference", (F.col("statement_balance") - F.col("reconciled_balance")).cast(AMOUNT_SUM))
          .withColumn("outstanding", (F.col("book_balance") - F.col("reconciled_balance")).cast(AMOUNT_SUM)))
    return r.withColumn("status", F.when(F.col("difference") == 0, "agrees")
                        .when(F.col("difference") == F.col("outstanding"), "explained").otherwise("differs"))
