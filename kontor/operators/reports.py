"""Reporting relations: the six views (V1-V4, A1, A2) and the aggregate reports.

All functions take ledger DataFrames and return a lazy DataFrame. Joins to
dimension tables are plain equi-joins: Spark broadcasts a side when its size
is known from file statistics, and AQE re-plans at runtime from the actual
shuffle sizes, so no side is forced into memory on a guess. Facts are always
aggregated before they meet a dimension (eager aggregation), so the shuffle
carries one partial row per key and map task rather than every line -- this
is also what keeps a hot account (cash, receivables) from overloading one
reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions import money as M
from kontor.sources.schemas import AGING_BUCKETS, ENUMS

AMOUNT_SUM = "DECIMAL(30,4)"   # sums of money columns (Spark's SUM type for DECIMAL(20,4))
VALUE = "DECIMAL(38,10)"       # exact quantity * cost products


def _sum(c: str, alias: str):
    return F.coalesce(F.sum(c), F.lit(0)).cast(AMOUNT_SUM).alias(alias)


# --- A1 trial balance ---------------------------------------------------------

def trial_balance(accounts: DataFrame, lines: DataFrame, entries: DataFrame | None = None,
                  posted_only: bool = False, with_opening: bool = False) -> DataFrame:
    """Per account: total base debit / credit and balance on the normal side.

    Faithful default: every line counts whatever its entry's status (the
    reference's ``posted`` condition sits in a LEFT JOIN whose columns are never
    used). ``posted_only=True`` semi-joins the lines to posted entries first.
    ``with_opening=True`` adds ``accounts.opening_balance`` to the balance.
    Every account appears, with zeros when it has no lines.
    """
    if posted_only:
        if entries is None:
            raise ValueError("posted_only needs the entries table")
        posted = entries.filter(F.col("status") == "posted").select(F.col("id").alias("journal_entry_id"))
        lines = lines.join(posted, "journal_entry_id", "left_semi")
    per_account = (lines.groupBy("account_id")
                   .agg(F.sum("debit_base").alias("_d"), F.sum("credit_base").alias("_c")))
    a = accounts.alias("a")
    joined = a.join(per_account, F.col("a.id") == per_account["account_id"], "left")
    d = F.coalesce(F.col("_d"), F.lit(0)).cast(AMOUNT_SUM)
    c = F.coalesce(F.col("_c"), F.lit(0)).cast(AMOUNT_SUM)
    bal = M.signed_balance("a.normal_balance", d, c)
    if with_opening:
        bal = bal + F.col("a.opening_balance")
    return joined.select(
        F.col("a.company_id"), F.col("a.code").alias("account_code"), F.col("a.name").alias("account_name"),
        F.col("a.category"), F.col("a.normal_balance"),
        d.alias("total_debit"), c.alias("total_credit"), bal.cast(AMOUNT_SUM).alias("balance"))


# --- V1 general ledger ----------------------------------------------------------

GENERAL_LEDGER_COLUMNS = [
    "company_id", "period_name", "entry_date", "entry_number", "journal_name", "account_code",
    "account_name", "account_category", "line_description", "debit_amount", "credit_amount",
    "debit_base", "credit_base", "contact_name", "cost_center", "project", "status",
]


def general_ledger(entries, journals, periods, lines, accounts, contacts, cost_centers, projects,
                   status: str = "posted") -> DataFrame:
    """Denormalised ledger of posted entries: 4 inner + 3 left joins, 17 columns."""
    je = entries.filter(F.col("status") == status).select(
        F.col("id").alias("je_id"), "company_id", "journal_id", "period_id", "entry_date",
        "entry_number", "status")
    j = journals.select(F.col("id").alias("journal_id"), F.col("name").alias("journal_name"))
    ap = periods.select(F.col("id").alias("period_id"), F.col("name").alias("period_name"))
    jel = lines.select(F.col("journal_entry_id").alias("je_id"), "account_id",
                       F.col("description").alias("line_description"), "debit_amount", "credit_amount",
                       "debit_base", "credit_base", "contact_id", "cost_center_id", "project_id")
    a = accounts.select(F.col("id").alias("account_id"), F.col("code").alias("account_code"),
                        F.col("name").alias("account_name"), F.col("category").alias("account_category"))
    c = contacts.select(F.col("id").alias("contact_id"), F.col("name").alias("contact_name"))
    cc = cost_centers.select(F.col("id").alias("cost_center_id"), F.col("name").alias("cost_center"))
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    out = (je.join(j, "journal_id").join(ap, "period_id").join(jel, "je_id").join(a, "account_id")
           .join(c, "contact_id", "left").join(cc, "cost_center_id", "left").join(p, "project_id", "left"))
    return out.select(*GENERAL_LEDGER_COLUMNS)


# --- V2 / V3 aging ----------------------------------------------------------------

def aging(invoices: DataFrame, contacts: DataFrame, as_of: str, invoice_type: str = "sale",
          party: str = "customer") -> DataFrame:
    """Open invoices of one type with days overdue and the aging bucket.

    ``as_of`` replaces CURRENT_DATE so results are reproducible. Open means
    status not in (paid, voided, draft); credit notes are excluded by type.
    """
    i = invoices.filter((F.col("type") == invoice_type)
                        & ~F.col("status").isin("paid", "voided", "draft"))
    c = contacts.select(F.col("id").alias("contact_id"), F.col("name").alias(f"{party}_name"))
    as_of_c = F.lit(as_of).cast("date")
    return i.join(c, "contact_id").select(
        "company_id", F.col("contact_id").alias(f"{party}_id"), f"{party}_name", "invoice_number",
        "invoice_date", "due_date", "total_amount", "amount_paid", "amount_due",
        F.datediff(as_of_c, F.col("due_date")).alias("days_overdue"),
        M.aging_bucket("due_date", as_of).alias("aging_bucket"))


def ar_aging(invoices, contacts, as_of: str) -> DataFrame:
    return aging(invoices, contacts, as_of, "sale", "customer")


def ap_aging(invoices, contacts, as_of: str) -> DataFrame:
    return aging(invoices, contacts, as_of, "purchase", "vendor")


# --- V4 inventory valuation ----------------------------------------------------------

def inventory_valuation(stock: DataFrame, products: DataFrame, locations: DataFrame,
                        warehouses: DataFrame, categories: DataFrame) -> DataFrame:
    """On-hand quantity x average cost per product and location (non-zero rows).

    Uses ``average_cost`` whatever the product's valuation method, as the
    data model's view does; see inventory.valuation_by_method for the
    method-aware variant. The product is exact (scale 10), as in SQL NUMERIC.
    """
    sq = stock.filter(F.col("quantity") != 0)
    p = products.select(F.col("id").alias("product_id"), "sku", F.col("name").alias("product_name"),
                        "category_id", "average_cost")
    wl = locations.select(F.col("id").alias("location_id"), "warehouse_id",
                          F.col("name").alias("location_name"))
    w = warehouses.select(F.col("id").alias("warehouse_id"), F.col("name").alias("warehouse_name"))
    pc = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    out = (sq.join(p, "product_id").join(wl, "location_id").join(w, "warehouse_id")
           .join(pc, "category_id", "left"))
    whole, rest = M.parts("quantity", 14, 6)
    cost = M.money("average_cost")
    value = ((whole * cost).cast("decimal(37,10)") + (rest * cost).cast("decimal(37,10)")).cast(VALUE)
    return out.select("product_id", "sku", "product_name", "category_name", "warehouse_name",
                      "location_name", F.col("quantity").alias("qty_on_hand"), "reserved_qty",
                      "available_qty", "average_cost", value.alias("inventory_value"))


# --- A2 unbalanced entries ------------------------------------------------------------

def entry_totals(lines: DataFrame) -> DataFrame:
    """A3: per entry, sum of transaction-currency debits and credits (0 if none)."""
    return lines.groupBy("journal_entry_id").agg(_sum("debit_amount", "total_debit"),
                                                 _sum("credit_amount", "total_credit"))


def unbalanced_entries(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries (any status) whose debits differ from credits; no lines -> absent."""
    t = entry_totals(lines).filter(F.col("total_debit") != F.col("total_credit"))
    je = entries.select("id", "company_id", "entry_number", "entry_date")
    return (je.join(t, je["id"] == t["journal_entry_id"])
            .select("id", "company_id", "entry_number", "entry_date", "total_debit", "total_credit",
                    (F.col("total_debit") - F.col("total_credit")).cast(AMOUNT_SUM).alias("difference")))


def is_balanced(total_debit, total_credit, tolerance: float | None = None):
    """A4: posting rule (exact, debit non-zero) or, with a tolerance, the form rule
    (debit > 0 and |debit - credit| < tolerance)."""
    d, c = M.col(total_debit), M.col(total_credit)
    if tolerance is None:
        return (d != 0) & (d == c)
    return (d > 0) & (F.abs(d - c) < F.lit(tolerance))


# --- A5 / A6 / A10 balance summaries ------------------------------------------------------

def category_domain(spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in ENUMS["account_category"]], "category STRING")


def category_totals(balances: DataFrame) -> DataFrame:
    """Sum of balance per account category; all five categories, 0 when empty."""
    per = balances.groupBy("category").agg(F.sum("balance").alias("_b"))
    dom = F.broadcast(category_domain(balances.sparkSession))  # 5 rows by definition
    return (dom.join(per, "category", "left")
            .select("category", F.coalesce(F.col("_b"), F.lit(0)).cast(AMOUNT_SUM).alias("total_balance")))


def trial_balance_totals(tb: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: sum of balances of debit-normal and credit-normal accounts, difference."""
    d = F.sum(F.when(F.col("normal_balance") == "debit", F.col("balance")).otherwise(0))
    c = F.sum(F.when(F.col("normal_balance") == "credit", F.col("balance")).otherwise(0))
    out = tb.agg(d.cast(AMOUNT_SUM).alias("total_debit"), c.cast(AMOUNT_SUM).alias("total_credit"))
    diff = (F.col("total_debit") - F.col("total_credit")).cast(AMOUNT_SUM)
    return out.select("total_debit", "total_credit", diff.alias("difference"),
                      (F.abs(diff) < F.lit(tolerance)).alias("is_balanced"))


def trial_balance_columns(tb: DataFrame) -> DataFrame:
    """Balance shown in the Debit or the Credit column by normal side (NULL otherwise)."""
    return tb.select("company_id", "account_code", "account_name", "category",
                     F.when(F.col("normal_balance") == "debit", F.col("balance")).alias("debit_column"),
                     F.when(F.col("normal_balance") == "credit", F.col("balance")).alias("credit_column"))


def dashboard_kpis(balances: DataFrame, invoices: DataFrame) -> DataFrame:
    """Headline figures in one pass over each input, per company.

    Assets, revenue, expenses from account balances; net income = revenue -
    expenses; receivable / payable = amount due of open sales / purchase
    invoices with their counts.
    """
    def by_cat(cat):
        return F.sum(F.when(F.col("category") == cat, F.col("balance")).otherwise(0)).cast(AMOUNT_SUM)

    b = balances.groupBy("company_id").agg(by_cat("asset").alias("total_assets"),
                                           by_cat("revenue").alias("total_revenue"),
                                           by_cat("expense").alias("total_expenses"))
    open_i = invoices.filter(~F.col("status").isin("paid", "voided", "draft"))

    def due(t):
        return F.sum(F.when(F.col("type") == t, F.col("amount_due")).otherwise(0)).cast(AMOUNT_SUM)

    def cnt(t):
        return F.count(F.when(F.col("type") == t, F.lit(1))).cast("bigint")

    i = open_i.groupBy("company_id").agg(due("sale").alias("accounts_receivable"),
                                         cnt("sale").alias("open_invoices"),
                                         due("purchase").alias("accounts_payable"),
                                         cnt("purchase").alias("open_bills"))
    out = b.join(i, "company_id", "full")
    z = F.lit(0).cast(AMOUNT_SUM)
    return out.select(
        "company_id",
        F.coalesce("total_assets", z).alias("total_assets"),
        F.coalesce("total_revenue", z).alias("total_revenue"),
        F.coalesce("total_expenses", z).alias("total_expenses"),
        (F.coalesce("total_revenue", z) - F.coalesce("total_expenses", z)).cast(AMOUNT_SUM).alias("net_income"),
        F.coalesce("accounts_receivable", z).alias("accounts_receivable"),
        F.coalesce("open_invoices", F.lit(0).cast("bigint")).alias("open_invoices"),
        F.coalesce("accounts_payable", z).alias("accounts_payable"),
        F.coalesce("open_bills", F.lit(0).cast("bigint")).alias("open_bills"))


# --- A9 invoice totals ---------------------------------------------------------------------

def line_amount(lines: DataFrame) -> DataFrame:
    """qty x price x (1 - discount_pct/100), 4 d.p., for invoice / order lines."""
    # The whole and the fractional part of the quantity multiply exactly; the sum
    # of both products, 14 places, is rounded once. round(x / 100, 4) == round(x, 2) / 100.
    whole, rest = M.parts("quantity", 14, 6)
    price = M.money("unit_price")
    share = (F.lit(100) - F.col("discount_pct")).cast("decimal(7,4)")
    x = ((whole * price).cast("decimal(26,4)") * share).cast("decimal(37,14)") + (rest * price * share).cast("decimal(37,14)")
    amount = (F.round(x, 2).cast("decimal(30,2)") / F.lit(100)).cast("DECIMAL(20,4)")
    return lines.withColumn("line_amount", F.when(share == 0, M.zero_money()).otherwise(amount))


def line_tax_amount(lines: DataFrame, tax_codes: DataFrame, rate_is_percent: bool = True,
                    out: str = "computed_tax") -> DataFrame:
    """Tax of each line from its tax code: round(line_amount x rate, 4).

    ``rate_is_percent``: the code's rate is a percentage (8.0000 = 8%) rather
    than a fraction (0.0800); the data model leaves this open, so it is an
    argument. A line without a tax code gets 0.
    """
    rates = tax_codes.select(F.col("id").alias("tax_code_id"), F.col("rate").alias("_rate"))
    r = F.coalesce(F.col("_rate"), F.lit(0)).cast("decimal(8,4)")
    amt = F.col("line_amount").cast("decimal(20,4)") * r
    tax = F.round(amt / F.lit(100) if rate_is_percent else amt, 4).cast("DECIMAL(20,4)")
    return lines.join(rates, "tax_code_id", "left").withColumn(out, tax).drop("_rate")


def recent_invoices(invoices: DataFrame) -> DataFrame:
    """All invoices newest first (display order: a distributed range sort)."""
    return invoices.orderBy(F.col("invoice_date").desc(), F.col("id").desc())


def entry_balance_flags(lines: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """A3 + A4: per entry the totals and both balance rules -- the posting rule
    (exact, debit non-zero) and the entry form's rule (debit > 0, |d - c| < tol)."""
    t = entry_totals(lines)
    return t.select("journal_entry_id", "total_debit", "total_credit",
                    is_balanced("total_debit", "total_credit").alias("balanced_for_posting"),
                    is_balanced("total_debit", "total_credit", tolerance).alias("balanced_in_form"))


def invoice_totals(lines: DataFrame, tax_codes: DataFrame | None = None, tax_mode: str = "flat",
                   flat_rate: str = "0.10") -> DataFrame:
    """Subtotal, tax and total per invoice.

    ``flat``: subtotal = sum(qty x price) and a flat 10% tax, as the invoice
    form computes it (discounts and tax codes ignored). ``by_code``: subtotal =
    sum(line_amount), tax = sum(round(line_amount x rate / 100, 4)) with the
    line's tax code (rates are percentages).
    """
    if tax_mode == "flat":
        # exact products are summed and rounded once, as the form does
        whole, rest = M.parts("quantity", 14, 6)
        price = M.money("unit_price")
        t = lines.groupBy("invoice_id").agg(
            F.sum((whole * price).cast("decimal(28,4)")).cast("decimal(32,4)").alias("_whole"),
            F.sum((rest * price).cast("decimal(27,10)")).cast("decimal(32,10)").alias("_rest"))
        exact = F.col("_whole").cast("decimal(33,10)") + F.col("_rest").cast("decimal(33,10)")
        t = t.select("invoice_id", F.round(exact, 4).cast(AMOUNT_SUM).alias("subtotal"),
                     F.round(exact.cast("decimal(34,10)") * F.lit(flat_rate).cast("decimal(4,2)"), 4)
                     .cast(AMOUNT_SUM).alias("_tax"))
        tax = F.col("_tax")
    elif tax_mode == "by_code":
        if tax_codes is None:
            raise ValueError("by_code needs tax_codes")
        ln = line_tax_amount(lines, tax_codes)
        t = ln.groupBy("invoice_id").agg(F.sum("line_amount").cast(AMOUNT_SUM).alias("subtotal"),
                                         F.sum("computed_tax").cast(AMOUNT_SUM).alias("_tax"))
        tax = F.col("_tax")
    else:
        raise ValueError(tax_mode)
    return t.select("invoice_id", "subtotal", tax.alias("tax_amount"),
                    (F.col("subtotal") + tax).cast(AMOUNT_SUM).alias("total_amount"))


# --- A12 / A13 receivables summaries ------------------------------------------------------

def contact_outstanding(invoices: DataFrame) -> DataFrame:
    """Amount due of open invoices per contact and invoice type."""
    return (invoices.filter(~F.col("status").isin("paid", "voided", "draft"))
            .groupBy("contact_id", "type")
            .agg(F.sum("amount_due").cast(AMOUNT_SUM).alias("amount_due"),
                 F.count(F.lit(1)).cast("bigint").alias("open_count")))


def aging_summary(aging_rows: DataFrame, party: str = "customer") -> DataFrame:
    """Amount due per party pivoted over the five bucket labels (fixed list -> one pass)."""
    names = ["current", "d1_30", "d31_60", "d61_90", "over_90"]
    aggs = [F.sum(F.when(F.col("aging_bucket") == lbl, F.col("amount_due")).otherwise(0))
            .cast(AMOUNT_SUM).alias(n) for lbl, n in zip(AGING_BUCKETS, names)]
    aggs.append(F.sum("amount_due").cast(AMOUNT_SUM).alias("total_due"))
    return aging_rows.groupBy("company_id", f"{party}_id").agg(*aggs)


def aging_rollup(aging_rows: DataFrame, party: str = "customer") -> DataFrame:
    """Amount due by company and party with subtotals (ROLLUP) per bucket."""
    return (aging_rows.rollup("company_id", f"{party}_id", "aging_bucket")
            .agg(F.sum("amount_due").cast(AMOUNT_SUM).alias("amount_due"),
                 F.count(F.lit(1)).cast("bigint").alias("invoices"),
                 F.grouping_id().alias("grouping_level")))


# --- A14 / A15 dimensional reports ---------------------------------------------------------

def contact_pnl(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Revenue and expense per company and contact with subtotals (ROLLUP); -1 stands for lines without a contact."""
    a = accounts.filter(F.col("category").isin("revenue", "expense")).select(
        F.col("id").alias("account_id"), "category", "company_id")
    per = (lines.groupBy("account_id", F.coalesce(F.col("contact_id").cast("bigint"), F.lit(-1)).alias("contact_id"))
           .agg(F.sum("debit_base").alias("_d"), F.sum("credit_base").alias("_c")))
    rev = F.sum(F.when(F.col("category") == "revenue", F.col("_c") - F.col("_d")).otherwise(0))
    exp = F.sum(F.when(F.col("category") == "expense", F.col("_d") - F.col("_c")).otherwise(0))
    return (per.join(a, "account_id").rollup("company_id", "contact_id")
            .agg(rev.cast(AMOUNT_SUM).alias("revenue"), exp.cast(AMOUNT_SUM).alias("expense"),
                 (rev - exp).cast(AMOUNT_SUM).alias("profit"), F.grouping_id().alias("grouping_level")))


NEAR_BUDGET = 90  # percent of a budget from which a project counts as near it


def project_budget(lines: DataFrame, accounts: DataFrame, entries: DataFrame, projects: DataFrame) -> DataFrame:
    """Budget against actual per project, from the lines of posted entries.

    ``actual`` is the expense booked on the project, ``remaining`` the budget
    less that, ``status`` one of no_budget, over (more spent than budgeted), near
    (from ``NEAR_BUDGET`` percent on) and within. Projects without a line are
    kept. Lines are summed per (entry, account, project) before they meet the
    entries and the small tables.
    """
    posted = entries.where("status = 'posted'").select(F.col("id").alias("journal_entry_id"))
    kinds = accounts.where("category IN ('revenue', 'expense')").select(F.col("id").alias("account_id"), "category")
    per = (lines.where("project_id IS NOT NULL").groupBy("journal_entry_id", "account_id", "project_id")
           .agg(F.sum(F.col("debit_base") - F.col("credit_base")).alias("_net"))
           .join(posted, "journal_entry_id", "left_semi").join(kinds, "account_id")
           .groupBy(F.col("project_id").alias("id"))
           .agg(F.sum(F.when(F.col("category") == "expense", F.col("_net"))).alias("_expense"),
                F.sum(F.when(F.col("category") == "revenue", -F.col("_net"))).alias("_revenue")))
    actual = F.coalesce("_expense", F.lit(0)).cast(AMOUNT_SUM)
    budget = F.col("budget").cast(AMOUNT_SUM)
    # narrower than the sums, so that the quotient keeps the digits it is rounded from
    used = M.safe_pct(actual.cast("DECIMAL(24,4)"), F.col("budget")).cast("DECIMAL(30,2)")
    status = (F.when(budget.isNull(), "no_budget").when(actual > budget, "over")
              .when(actual * 100 >= budget * NEAR_BUDGET, "near").otherwise("within"))
    return projects.join(per, "id", "left").select(
        "id", "company_id", "code", budget.alias("budget"), actual.alias("actual"),
        F.coalesce("_revenue", F.lit(0)).cast(AMOUNT_SUM).alias("revenue"),
        (budget - actual).cast(AMOUNT_SUM).alias("remaining"), used.alias("used_pct"), status.alias("status"))


def dimension_pnl(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Revenue and expense by cost centre x project with all subtotals (CUBE).

    NULL dimension values become -1 ("unassigned") before the cube so that
    they are not confused with the subtotal rows; ``grouping_level`` tells
    subtotals apart.
    """
    a = accounts.filter(F.col("category").isin("revenue", "expense")).select(
        F.col("id").alias("account_id"), "category", "company_id")
    ln = lines.select("account_id", F.coalesce("cost_center_id", F.lit(-1)).alias("cost_center_id"),
                      F.coalesce("project_id", F.lit(-1)).alias("project_id"), "debit_base", "credit_base")
    # aggregate the fact to (account, cc, project) before joining the dimension
    per = ln.groupBy("account_id", "cost_center_id", "project_id").agg(
        F.sum("debit_base").alias("_d"), F.sum("credit_base").alias("_c"))
    j = per.join(a, "account_id")
    rev = F.sum(F.when(F.col("category") == "revenue", F.col("_c") - F.col("_d")).otherwise(0))
    exp = F.sum(F.when(F.col("category") == "expense", F.col("_d") - F.col("_c")).otherwise(0))
    return (j.cube("company_id", "cost_center_id", "project_id")
            .agg(rev.cast(AMOUNT_SUM).alias("revenue"), exp.cast(AMOUNT_SUM).alias("expense"),
                 (rev - exp).cast(AMOUNT_SUM).alias("profit"), F.grouping_id().alias("grouping_level")))


def ledger_by_period(lines: DataFrame, entries: DataFrame, periods: DataFrame,
                     posted_only: bool = True) -> DataFrame:
    """Period x account debit / credit matrix with per-period and grand totals (ROLLUP)."""
    je = entries
    if posted_only:
        je = je.filter(F.col("status") == "posted")
    je = je.select(F.col("id").alias("journal_entry_id"), "period_id")
    per = (lines.select("journal_entry_id", "account_id", "debit_base", "credit_base")
           .join(je, "journal_entry_id")
           .groupBy("period_id", "account_id")
           .agg(F.sum("debit_base").alias("_d"), F.sum("credit_base").alias("_c")))
    ap = periods.select(F.col("id").alias("period_id"), F.col("name").alias("period_name"), "company_id")
    j = per.join(ap, "period_id")
    return (j.rollup("company_id", "period_name", "account_id")
            .agg(F.sum("_d").cast(AMOUNT_SUM).alias("total_debit"),
                 F.sum("_c").cast(AMOUNT_SUM).alias("total_credit"),
                 F.grouping_id().alias("grouping_level")))


def period_change_pct(lines: DataFrame, entries: DataFrame, accounts: DataFrame,
                      category: str = "asset") -> DataFrame:
    """Month-over-month change of the net movement of one account category.

    Per company and month: net movement (debit - credit on base amounts of
    posted entries) and its percentage change against the previous month
    with activity (``lag`` over the company's months; NULL for the first or
    when the previous month is 0).
    """
    a = accounts.filter(F.col("category") == category).select(F.col("id").alias("account_id"), "company_id")
    je = entries.filter(F.col("status") == "posted").select(
        F.col("id").alias("journal_entry_id"), F.date_trunc("month", "entry_date").cast("date").alias("month"))
    per = (lines.select("journal_entry_id", "account_id", "debit_base", "credit_base")
           .join(a, "account_id").join(je, "journal_entry_id")
           .groupBy("company_id", "month")
           .agg((F.sum("debit_base") - F.sum("credit_base")).cast(AMOUNT_SUM).alias("net_movement")))
    from pyspark.sql import Window as W
    w = W.partitionBy("company_id").orderBy("month")
    prev = F.lag("net_movement").over(w)
    pct = F.when(prev.isNull() | (prev == 0), F.lit(None)).otherwise(
        F.round((F.col("net_movement") - prev) * 100 / F.abs(prev), 2))
    return per.select("company_id", "month", "net_movement", pct.cast("DECIMAL(20,2)").alias("change_pct"))


# --- top-k / counts / filters --------------------------------------------------------------

def recent_entries(entries: DataFrame, k: int = 5) -> DataFrame:
    """Newest k entries (date, then id, descending) -- a TakeOrdered, no global sort."""
    return entries.orderBy(F.col("entry_date").desc(), F.col("id").desc()).limit(k)


def count_rows(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of rows (accounts, products ...), optionally per group."""
    if by:
        return df.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def filter_accounts_by_category(accounts: DataFrame, category: str = "all") -> DataFrame:
    return accounts if category == "all" else accounts.filter(F.col("category") == category)


def filter_invoices_by_tab(invoices: DataFrame, tab: str = "all") -> DataFrame:
    """Invoice list tabs: all / paid / overdue read the stored status; others filter by type."""
    if tab == "all":
        return invoices
    if tab in ("paid", "overdue"):
        return invoices.filter(F.col("status") == tab)
    return invoices.filter(F.col("type") == tab)


def open_items(invoices: DataFrame) -> DataFrame:
    """Open-item predicate of the due-date index: status not paid / voided (drafts kept)."""
    return invoices.filter(~F.col("status").isin("paid", "voided"))


def active_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_active"))


def close_period_balances(lines: DataFrame, entries: DataFrame, periods: DataFrame,
                          accounts: DataFrame) -> DataFrame:
    """Per account and period: movement and closing balance (opening balance +
    movements of all periods up to this one, on the normal side), posted entries.

    Lines are aggregated to (account, period) first; the cumulative window then
    runs over that small matrix.
    """
    from pyspark.sql import Window as W
    je = entries.filter(F.col("status") == "posted").select(F.col("id").alias("journal_entry_id"), "period_id")
    per = (lines.select("journal_entry_id", "account_id", "debit_base", "credit_base").join(je, "journal_entry_id")
           .groupBy("account_id", "period_id")
           .agg(F.sum("debit_base").alias("_d"), F.sum("credit_base").alias("_c")))
    a = accounts.select(F.col("id").alias("account_id"), "normal_balance", "opening_balance")
    p = periods.select(F.col("id").alias("period_id"), "start_date")
    j = per.join(a, "account_id").join(p, "period_id")
    move = M.signed_balance("normal_balance", "_d", "_c").cast(AMOUNT_SUM)
    w = W.partitionBy("account_id").orderBy("start_date", "period_id").rowsBetween(W.unboundedPreceding, 0)
    return j.select("account_id", "period_id", move.alias("movement"),
                    (F.col("opening_balance") + F.sum(move).over(w)).cast(AMOUNT_SUM).alias("closing_balance"))


def register_views(spark, tables, as_of: str, prefix: str = "v_") -> list[str]:
    """Register the six reporting relations as temporary views (``create_views``)."""
    views = {
        "general_ledger": general_ledger(tables["journal_entries"], tables["journals"],
                                         tables["accounting_periods"], tables["journal_entry_lines"],
                                         tables["accounts"], tables["contacts"], tables["cost_centers"],
                                         tables["projects"]),
        "trial_balance": trial_balance(tables["accounts"], tables["journal_entry_lines"]),
        "ar_aging": ar_aging(tables["invoices"], tables["contacts"], as_of),
        "ap_aging": ap_aging(tables["invoices"], tables["contacts"], as_of),
        "unbalanced_entries": unbalanced_entries(tables["journal_entries"], tables["journal_entry_lines"]),
    }
    if "stock_quantities" in tables:
        views["inventory_valuation"] = inventory_valuation(
            tables["stock_quantities"], tables["products"], tables["warehouse_locations"], tables["warehouses"],
            tables["product_categories"])
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in views]
