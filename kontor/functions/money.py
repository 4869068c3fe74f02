"""Column expressions shared by the operators (all JVM-side, codegen'd).

Decimal rules: Spark widens decimal products to precision 38 and then cuts
the scale, so ``DECIMAL(20,6) * DECIMAL(20,4)`` would come out as
``DECIMAL(38,7)`` and lose digits. The helpers split one factor into its whole
and its fractional part; both partial products fit exactly, for every value of
the declared types. As the parts have one sign and the first product has no
digit beyond the fourth place, rounding the second alone rounds the sum half
away from zero (PostgreSQL's ROUND).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.sources.schemas import AGING_BUCKETS, AGING_UPPER_DAYS, MONEY, QTY


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Cast to the money type DECIMAL(20,4)."""
    return col(c).cast(MONEY)


def qty(c) -> Column:
    return col(c).cast(QTY)


def zero_money() -> Column:
    return F.lit(0).cast(MONEY)


def parts(c, whole: int, fraction: int):
    """(whole part, fractional part) of a decimal, both cut towards zero."""
    value = col(c).cast(f"decimal({whole + fraction},{fraction})")
    rest = (value % F.lit(1).cast("decimal(1,0)")).cast(f"decimal({fraction},{fraction})")
    return (value - rest).cast(f"decimal({whole},0)"), rest


def rounded_product(x, whole: int, fraction: int, y, places: int = 4) -> Column:
    """x * y for x of DECIMAL(whole + fraction, fraction), y with at most ``places`` decimals, rounded once."""
    units, rest = parts(x, whole, fraction)
    wide = f"decimal(37,{places})"
    return (units * y).cast(wide) + F.round(rest * y, places).cast(wide)


def qty_times_cost(q, c) -> Column:
    """quantity * unit cost, exact, stored at 4 d.p. (total_cost columns)."""
    return rounded_product(q, 14, 6, money(c)).cast(MONEY)


def to_base(amount, rate) -> Column:
    """Transaction amount -> base currency at ``rate``, 4 d.p."""
    return rounded_product(rate, 12, 8, money(amount)).cast(MONEY)


def safe_pct(num, den, scale: int = 2) -> Column:
    """0 when the denominator is 0, else ROUND(num / den * 100, scale)."""
    den_c = col(den)
    return (F.when(den_c == 0, F.lit(0))
            .otherwise(F.round(col(num) * 100 / F.when(den_c == 0, F.lit(None)).otherwise(den_c), scale)))


def normal_side(category) -> Column:
    """Normal balance side of an account category: asset/expense -> debit."""
    return F.when(col(category).isin("asset", "expense"), F.lit("debit")).otherwise(F.lit("credit"))


def signed_balance(normal_balance, debit, credit) -> Column:
    """Balance on the account's normal side (simple CASE; NULL for other values)."""
    nb = col(normal_balance)
    return (F.when(nb == "debit", col(debit) - col(credit))
            .when(nb == "credit", col(credit) - col(debit)))


def aging_bucket(due_date, as_of: str) -> Column:
    """Bucket label from the days overdue at ``as_of``.

    The first bucket whose upper bound is not exceeded wins; a NULL due date
    has no day count and lands in the last bucket.
    """
    days = F.datediff(F.lit(as_of).cast("date"), col(due_date))
    expr = F.lit(AGING_BUCKETS[-1])
    for upper, label in reversed(list(zip(AGING_UPPER_DAYS, AGING_BUCKETS))):
        expr = F.when(days <= upper, F.lit(label)).otherwise(expr)
    return expr


def parse_amount(c) -> Column:
    """Form input -> amount; unparsable or empty -> 0 (the UI's ``parseFloat(x) || 0``).

    Unlike parseFloat, a numeric prefix such as ``12abc`` is not accepted.
    """
    return F.coalesce(F.expr(f"try_cast({c} AS DECIMAL(20,4))") if isinstance(c, str)
                      else c.try_cast(MONEY), zero_money())


def doc_number(prefix: str, year, seq, width: int) -> Column:
    """``PREFIX-YYYY-0001`` numbering; ``format_string`` pads without truncating."""
    return F.format_string(f"{prefix}-%d-%0{width}d", col(year), col(seq))
