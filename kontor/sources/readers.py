"""Loading ledger tables with their declared schema, and the write-side helpers.

``load_table`` reads Parquet with the declared column types: the reader gets
only the declared columns (pruned scan), mismatched physical types are cast
(e.g. money stored as DOUBLE -> DECIMAL(20,4)), and a missing column fails
loudly instead of silently becoming NULL.

The sink helpers re-state the data model's write behaviour as set
operations: insert (append), upsert-accumulate (stock), update by key
(product costs), ``updated_at`` stamping on changed rows, and cascading
deletes of lines with their header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.sources.schemas import COLUMNS


def table_columns(name: str) -> list[tuple[str, str]]:
    return [(c.name, c.type) for c in COLUMNS[name]]


def load_table(spark: SparkSession, base_dir: str, name: str, fmt: str = "parquet", partial: bool = False) -> DataFrame:
    """Read ``base_dir/name`` and return exactly the declared columns and types.

    ``partial=True`` takes a table that holds only some of the declared columns,
    and returns those; the operators need no others than they name.
    """
    df = spark.read.format(fmt).load(f"{base_dir}/{name}")
    missing = [c for c, _ in table_columns(name) if c not in df.columns]
    if missing and not partial:
        raise ValueError(f"{name}: missing columns {missing}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in table_columns(name) if c not in missing])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast an in-memory frame to the declared schema of ``name`` (missing columns NULL)."""
    cols = []
    for c, t in table_columns(name):
        cols.append((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c))
    return df.select(*cols)


# --- sinks ------------------------------------------------------------------------------

def append_rows(existing: DataFrame, new: DataFrame, newest_first: bool = False,
                order_col: str = "id") -> DataFrame:
    """Insert rows. Front vs end insertion is a display order only: applied as a sort."""
    out = existing.unionByName(new, allowMissingColumns=True)
    if newest_first:
        out = out.orderBy(F.col(order_col).desc())
    return out


def upsert_accumulate(state: DataFrame, deltas: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Insert new keys, add to existing ones (INSERT ... ON CONFLICT DO UPDATE value = value + delta)."""
    d = deltas.groupBy(*keys).agg(F.sum(value).alias("_delta"))
    j = state.join(d, keys, "full")
    return j.withColumn(value, (F.coalesce(F.col(value), F.lit(0)) + F.coalesce("_delta", F.lit(0)))
                        .cast(state.schema[value].dataType)).drop("_delta")


def update_by_key(target: DataFrame, changes: DataFrame, key: str, columns: list[str],
                  stamp: bool = False) -> DataFrame:
    """Overwrite ``columns`` of the rows whose key appears in ``changes``.

    With ``stamp=True`` the changed rows get ``updated_at = current_timestamp()``.
    """
    ch = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns],
                        F.lit(True).alias("_hit"))
    j = target.join(ch, target[key] == ch["_k"], "left")
    for c in columns:
        j = j.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
                         .cast(target.schema[c].dataType))
    if stamp:
        j = stamp_updated_at(j, F.coalesce(F.col("_hit"), F.lit(False)))
    return j.drop("_k", "_hit", *[f"_new_{c}" for c in columns])


def stamp_updated_at(df: DataFrame, changed) -> DataFrame:
    """Set ``updated_at`` to now on changed rows only (the data model's BEFORE UPDATE stamp)."""
    prev = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp")
    return df.withColumn("updated_at", F.when(changed, F.current_timestamp()).otherwise(prev))


def cascade_delete(lines: DataFrame, deleted_headers: DataFrame, fk: str, header_key: str = "id") -> DataFrame:
    """Lines that survive when their headers are deleted (ON DELETE CASCADE)."""
    gone = deleted_headers.select(F.col(header_key).alias(fk))
    return lines.join(gone, fk, "left_anti")


def required_fields(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected) where every column in ``cols`` is non-blank."""
    ok = None
    for c in cols:
        cond = F.col(c).isNotNull() & (F.length(F.trim(F.col(c).cast("string"))) > 0)
        ok = cond if ok is None else ok & cond
    return df.filter(ok), df.filter(~ok)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_within: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet sink; optional partition columns (e.g. company) and in-file sort
    (e.g. date) so row-group min/max statistics prune range filters."""
    w = df
    if sort_within:
        w = w.sortWithinPartitions(*sort_within)
    writer = w.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """Save as a catalog table bucketed and sorted by ``key``.

    Two tables bucketed the same way on their join key (entries on ``id``,
    lines on ``journal_entry_id``, same bucket count) join without a shuffle:
    matching buckets are read together. Worth it for the fact-fact join that
    every entry-level report repeats.
    """
    (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table))
