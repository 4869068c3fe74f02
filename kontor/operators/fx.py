"""Currency and calendar lookups: as-of exchange rates, base conversion, periods.

As-of and date-range lookups are range joins, which Spark would only run as
nested loops. Both dimension tables here are slowly changing (rates: one
row per currency pair and date; periods: one per company and month), so a
range with a successor is expanded into the calendar months it covers and
the fact side is equi-joined on (key, month) plus a range filter. Every fact
row meets only the ranges of its own month: a hash join in which a hot
currency pair or company is still split by month. The open-ended last rate
of each pair is one row per pair (bounded by the number of currency pairs)
and joins on the pair alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions import money as M


def _month():
    return F.expr("INTERVAL 1 MONTH")


def rate_validity(rates: DataFrame) -> DataFrame:
    """Each rate valid on [effective_date, valid_to); valid_to NULL for the latest."""
    w = Window.partitionBy("from_currency", "to_currency").orderBy("effective_date")
    return rates.withColumn("valid_to", F.lead("effective_date").over(w))


def asof_rate(facts: DataFrame, rates: DataFrame, date_col: str, from_col: str, to_col: str,
              out: str = "rate") -> DataFrame:
    """Add the latest rate with effective_date <= the fact's date (NULL before the first rate)."""
    spans = rate_validity(rates).select(
        F.col("from_currency").alias("_f"), F.col("to_currency").alias("_t"),
        F.col("effective_date").alias("_eff"), "valid_to", F.col("rate").alias("_r"))
    # a repeated date leaves an empty span, which no fact falls into
    closed = (spans.filter(F.col("valid_to") > F.col("_eff"))
              .withColumn("_m", F.explode(F.sequence(F.trunc("_eff", "month"),
                                                     F.trunc(F.date_sub("valid_to", 1), "month"), _month()))))
    last = spans.filter(F.col("valid_to").isNull()).select(
        F.col("_f").alias("_lf"), F.col("_t").alias("_lt"), F.col("_eff").alias("_leff"), F.col("_r").alias("_lr"))
    d = F.col(date_col)
    f = facts.withColumn("_m", F.trunc(d, "month"))
    j1 = f.join(closed, (f[from_col] == closed["_f"]) & (f[to_col] == closed["_t"]) & (f["_m"] == closed["_m"])
                & (d >= closed["_eff"]) & (d < closed["valid_to"]), "left")
    j1 = j1.drop(closed["_m"]).drop("_f", "_t", "_eff", "valid_to")
    j2 = j1.join(last, (j1[from_col] == last["_lf"]) & (j1[to_col] == last["_lt"])
                 & (d >= last["_leff"]), "left")
    return j2.withColumn(out, F.coalesce("_r", "_lr")).drop("_r", "_lf", "_lt", "_leff", "_lr", "_m")


def convert_to_base(lines: DataFrame, rate_col: str = "exchange_rate") -> DataFrame:
    """debit_base / credit_base = transaction amounts x the entry's rate, 4 d.p."""
    return (lines.withColumn("debit_base", M.to_base("debit_amount", rate_col))
            .withColumn("credit_base", M.to_base("credit_amount", rate_col)))


def entry_rates_asof(entries: DataFrame, companies: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate from the entry currency to its company's base currency on the entry date.

    Same currency -> 1. Missing rate -> NULL (reported, never guessed).
    """
    c = companies.select(F.col("id").alias("company_id"), F.col("base_currency"))
    e = entries.select("id", "company_id", "entry_date", "currency", "exchange_rate").join(c, "company_id")
    r = asof_rate(e, rates, "entry_date", "currency", "base_currency", "asof_rate")
    return r.withColumn("asof_rate", F.when(F.col("currency") == F.col("base_currency"), F.lit(1).cast("decimal(20,8)"))
                        .otherwise(F.col("asof_rate")))


def effective_currency(accounts: DataFrame, companies: DataFrame) -> DataFrame:
    """Account currency, NULL meaning the company's base currency."""
    c = companies.select(F.col("id").alias("company_id"), "base_currency")
    return (accounts.join(c, "company_id", "left")
            .withColumn("effective_currency", F.coalesce("currency", "base_currency")).drop("base_currency"))


def period_for_date(facts: DataFrame, periods: DataFrame, date_col: str, company_col: str = "company_id",
                    out: str = "derived_period_id") -> DataFrame:
    """Period whose [start_date, end_date] contains the fact's date, per company.

    Of overlapping periods the one that starts first counts, then the lowest
    id, so a fact is never multiplied; a period that ends before it starts
    contains nothing. The periods that touch a month of a company are one row.
    """
    p = (periods.where("start_date <= end_date")
         .select(F.col("company_id").alias("_pc"),
                 F.struct(F.col("start_date").alias("s"), F.col("id").alias("i"), F.col("end_date").alias("e")).alias("_p"))
         .withColumn("_m", F.explode(F.sequence(F.trunc("_p.s", "month"), F.trunc("_p.e", "month"), _month())))
         .groupBy("_pc", "_m").agg(F.array_sort(F.collect_list("_p")).alias("_ps")))
    d = F.col(date_col)
    f = facts.withColumn("_fm", F.trunc(d, "month"))
    j = f.join(p, (f[company_col] == p["_pc"]) & (f["_fm"] == p["_m"]), "left")
    fits = F.filter("_ps", lambda x: (x["s"] <= d) & (x["e"] >= d))
    return j.withColumn(out, F.get(fits, 0)["i"]).drop("_pc", "_ps", "_m", "_fm")


def period_mismatches(entries: DataFrame, periods: DataFrame) -> DataFrame:
    """Entries whose stored period does not contain their entry date."""
    j = period_for_date(entries.select("id", "company_id", "entry_date", "period_id"), periods, "entry_date")
    return j.filter(F.col("derived_period_id").isNull() | (F.col("derived_period_id") != F.col("period_id")))
