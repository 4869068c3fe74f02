"""Document numbering, duplicate ranking and sequence gaps (window operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators.sweep import RANGE, RANGE_ROWS, SPLIT, ranged, running, same_keys


def assign_document_numbers(docs: DataFrame, group_cols: list[str], order_cols: list[str], prefix_col: str,
                            year_col: str, width: int = 4, out: str = "document_number") -> DataFrame:
    """``PREFIX-YYYY-0001`` numbering per (group, year) in document order.

    The window is partitioned by the group *and* the year, so a busy journal
    is split by year. ``format_string`` pads to ``width`` digits and never
    truncates longer numbers (unlike ``lpad``).
    """
    if len(order_cols) > 1:
        # row_number as a two-phase running count bucketed by the leading sort key
        # (e.g. the date), so one busy journal-year is spread over its days
        d = running(docs.withColumn("_one", F.lit(1).cast("bigint")), group_cols + [year_col], order_cols,
                    [("_seq", "_one", "sum")], bucket=order_cols[0])
        seq = F.col("_seq")
    else:
        d = docs.withColumn("_seq", F.row_number().over(
            Window.partitionBy(*group_cols, year_col).orderBy(*order_cols)))
        seq = F.col("_seq")
    return (d.withColumn(out, F.format_string(f"%s%d-%0{width}d", F.col(prefix_col), F.col(year_col), seq))
            .drop("_seq", "_one"))


def duplicate_rank(df: DataFrame, key_cols: list[str], order_cols: list[str],
                   range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """Rank rows sharing a key (1 = keeper) and count the group.

    Rows are dealt once by key and range and both ranked and counted there. A
    key of more than ``range_rows`` rows is cut at its ranges, so one heavily
    duplicated key is not a single task; its count is the sum over its ranges.
    """
    part = key_cols + [RANGE]
    rows = ranged(df.withColumn("_one", F.lit(1)), key_cols, order_cols, range_rows)
    # one row for each key that is cut, null keys are a group like any other
    totals = (rows.where(SPLIT).groupBy(*[F.col(k).alias(f"_c_{k}") for k in key_cols])
              .agg(F.count(F.lit(1)).alias("_total")))
    d = running(rows, key_cols, order_cols, [("dup_rank", "_one", "sum")], RANGE, deal=True)
    d = d.withColumn("_here", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    d = d.join(F.broadcast(totals), same_keys(key_cols, [f"_c_{k}" for k in key_cols]), "left")
    return d.select(*df.columns, F.col("dup_rank").cast("int").alias("dup_rank"),
                    F.coalesce("_total", "_here").alias("dup_count"))


def sequence_gaps(df: DataFrame, group_cols: list[str], number_col: str,
                  range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """Consecutive document numbers per group with a gap (next - previous > 1).

    The previous number is a running maximum over smaller numbers, computed in
    two phases over ranges of about equal numbers of rows, so one large series
    (a company's invoices) is spread over many tasks however sparse its numbers are.
    """
    d = df.select(*group_cols, number_col).filter(F.col(number_col).isNotNull())
    d = ranged(d, group_cols, [number_col], range_rows)
    d = running(d, group_cols, [number_col], [("previous_number", number_col, "max")], bucket=RANGE,
                exclusive=True)
    return (d
            .filter(F.col(number_col) - F.col("previous_number") > 1)
            .select(*group_cols, "previous_number", F.col(number_col).alias("next_number"),
                    (F.col(number_col) - F.col("previous_number") - 1).alias("missing_count")))


def numeric_suffix(c: str):
    """Trailing digits of a document number as BIGINT (NULL when there are none)."""
    return F.regexp_extract(F.col(c), r"(\d+)$", 1).try_cast("bigint")
