"""Structured Streaming versions of the incremental-maintenance rules.

The data model maintains stock and product cost with row triggers on insert;
the streaming equivalents consume an append-only stream of stock moves or
entries and keep the same state:

* ``stock_quantities_stream`` -- T3 as a streaming aggregation (sum of signed
  legs per product and location). No watermark: a stock balance is never
  final, late moves must still count (unbounded correction semantics), so
  the state holds one row per (product, location) -- bounded by the
  dimension, not by the stream.
* ``moving_average_cost_stream`` -- T4 with ``applyInPandasWithState`` keyed
  by product; the state is (stock Q, cost A, last price). Moves must arrive
  in insertion order across micro-batches; within a batch they are replayed
  in ``order``.
* ``post_entries_stream`` -- T1 + T2 with ``foreachBatch`` running the batch
  operator against the static lines and periods.
* ``weekly_movements_stream`` -- T7, event-time windows with a watermark
  (our report, not the data model's).
* ``stock_state_upsert`` -- T3 into a versioned Parquet state table with an
  idempotent ``foreachBatch`` upsert (exactly-once under retries).

The T4 state function sees one product's rows of one micro-batch at a time,
so its memory is bounded by the trigger size (``maxFilesPerTrigger`` /
``maxBytesPerTrigger``), not by the stream.

Checkpoints go under the session's ``spark.checkpoint.dir`` unless given.
"""

from __future__ import annotations

import os
from decimal import ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from kontor.operators import inventory as I
from kontor.operators import posting as P
from kontor.session import ensure_checkpoint_dir

MOVE_STREAM_SCHEMA = (
    "id BIGINT, company_id INT, move_number STRING, move_type STRING, move_date DATE, product_id BIGINT, "
    "uom_id INT, from_location_id INT, to_location_id INT, quantity DECIMAL(20,6), unit_cost DECIMAL(20,4), "
    "total_cost DECIMAL(20,4), invoice_id BIGINT, journal_entry_id BIGINT, sales_order_line_id BIGINT, "
    "purchase_order_line_id BIGINT, is_posted BOOLEAN")


def read_moves_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """File-source stream of stock moves (Parquet), schema declared, no inference."""
    return (spark.readStream.schema(MOVE_STREAM_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


# --- T3 --------------------------------------------------------------------------------

def stock_quantities_stream(moves: DataFrame) -> DataFrame:
    """Running stock per (product, location); use output mode 'update' or 'complete'."""
    return (I.stock_legs(moves).groupBy("product_id", "location_id")
            .agg(F.sum("delta").cast("DECIMAL(30,6)").alias("quantity")))


# --- T4 --------------------------------------------------------------------------------

_CTX = Context(prec=60)
_Q4 = Decimal("0.0001")
COST_OUT_SCHEMA = "product_id BIGINT, move_id BIGINT, average_cost DECIMAL(20,4), last_purchase_price DECIMAL(20,4)"
COST_STATE_SCHEMA = "qty STRING, cost STRING, last STRING"


def _cost_step(key, batches, state):
    """Replay one product's moves of this micro-batch on top of its state."""
    (pid,) = key
    if state.exists:
        q_s, a_s, last_s = state.get
        qty, cost, last = Decimal(q_s), Decimal(a_s), Decimal(last_s)
    else:
        qty, cost, last = None, None, Decimal(0)
    pdf = pd.concat(list(batches), ignore_index=True)
    pdf = pdf.sort_values(["move_date", "id"], kind="stable")
    out_id, out_cost, out_last = [], [], []
    for row in pdf.itertuples(index=False):
        if qty is None:
            qty = Decimal(0)
            cost = row.start_cost if row.start_cost is not None else Decimal(0)
        q = row.quantity
        if row.move_type == "purchase_receipt" and row.is_posted and row.unit_cost > 0:
            den = _CTX.add(qty, q)
            new = _CTX.divide(_CTX.add(_CTX.multiply(qty, cost), _CTX.multiply(q, row.unit_cost)), den) \
                if den > 0 else row.unit_cost
            cost = new.quantize(_Q4, rounding=ROUND_HALF_UP)
            last = row.unit_cost
            out_id.append(row.id)
            out_cost.append(cost)
            out_last.append(last)
        if row.is_posted:
            delta = (q if row.to_location_id is not None and not pd.isna(row.to_location_id) else 0) \
                - (q if row.from_location_id is not None and not pd.isna(row.from_location_id) else 0)
            qty = _CTX.add(qty, Decimal(delta))
    state.update((str(qty), str(cost), str(last)))
    yield pd.DataFrame({"product_id": [pid] * len(out_id), "move_id": out_id, "average_cost": out_cost,
                        "last_purchase_price": out_last})


def moving_average_cost_stream(moves: DataFrame, products: DataFrame) -> DataFrame:
    """Average cost after every costed receipt, per product, maintained in state.

    The product's starting cost comes from a stream-static join with the
    products table. Output mode 'append' (one row per receipt, emitted once).
    """
    start = products.select(F.col("id").alias("product_id"), F.col("average_cost").alias("start_cost"))
    m = (moves.select("id", "product_id", "move_date", "move_type", "quantity", "unit_cost", "is_posted",
                      "from_location_id", "to_location_id")
         .join(start, "product_id", "left"))
    return m.groupBy("product_id").applyInPandasWithState(
        _cost_step, COST_OUT_SCHEMA, COST_STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


# --- T1 + T2 -----------------------------------------------------------------------------

def post_entries_stream(entries: DataFrame, lines: DataFrame, periods: DataFrame, sink_path: str,
                        checkpoint: str | None = None, event: str = "insert", trigger_available_now: bool = True):
    """Check every micro-batch of entry rows with the batch posting operator and
    write the results (accepted and rejected, with reason) to ``sink_path``.

    Each micro-batch overwrites its own ``epoch_id=`` partition, so a batch
    re-run after a failure replaces its earlier output instead of duplicating
    it (idempotent sink)."""
    def run(batch: DataFrame, epoch_id: int):
        checked = P.post_entries(batch, lines, periods, event=event)
        checked.write.mode("overwrite").parquet(f"{sink_path}/epoch_id={epoch_id}")

    checkpoint = checkpoint or checkpoint_for(entries.sparkSession, "post_entries")
    w = entries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()


# --- T7 ------------------------------------------------------------------------------------

def weekly_movements_stream(moves: DataFrame, watermark: str = "14 days") -> DataFrame:
    """Posted quantity moved per product and calendar week, finalised by the watermark.

    In append mode a week is emitted once the watermark passes its end; moves
    older than the watermark (as of the previous micro-batch -- Spark filters
    late rows with the prior batch's watermark) are dropped, never counted
    into an already emitted week."""
    ts = F.col("move_date").cast("timestamp")
    return (moves.filter(F.col("is_posted")).withColumn("move_ts", ts)
            .withWatermark("move_ts", watermark)
            .groupBy(F.window("move_ts", "7 days"), "product_id", "move_type")
            .agg(F.sum("quantity").cast("DECIMAL(30,6)").alias("quantity"),
                 F.count(F.lit(1)).alias("moves")))


# --- T3 into a versioned state table (exactly-once upsert) --------------------------------------

def stock_state_upsert(state_dir: str):
    """``foreachBatch`` function maintaining stock balances as a versioned Parquet table.

    Micro-batch ``e`` reads version ``e - 1``, upserts the batch's posted legs
    (``upsert_accumulate``: insert new (product, location) keys, add to
    existing ones) and overwrites version ``e``. A batch re-run after a
    failure recomputes the same version from the same inputs, so the sink
    is idempotent and the state exactly-once. Readers take the highest
    complete version.
    """
    from kontor.sources.readers import upsert_accumulate

    def run(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        deltas = I.stock_legs(batch).withColumnRenamed("delta", "quantity")
        if epoch_id == 0:
            state = spark.createDataFrame([], "product_id BIGINT, location_id INT, quantity DECIMAL(30,6)")
        else:
            state = spark.read.parquet(f"{state_dir}/version={epoch_id - 1}")
        new = upsert_accumulate(state, deltas, ["product_id", "location_id"], "quantity")
        new.write.mode("overwrite").parquet(f"{state_dir}/version={epoch_id}")

    return run


def run_stock_state_stream(moves: DataFrame, state_dir: str, checkpoint: str | None = None):
    """Start the versioned stock-state stream (availableNow) and return the query.

    The checkpoint defaults to a folder under the session's ``spark.checkpoint.dir``."""
    checkpoint = checkpoint or checkpoint_for(moves.sparkSession, "stock_state")
    return (moves.writeStream.foreachBatch(stock_state_upsert(state_dir))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
