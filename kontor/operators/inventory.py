"""Inventory operators: stock balances (T3), moving-average cost (T4), FIFO layers,
valuation by method, reorder report.

Insertion order. The data model replays stock moves in insertion order (its
row triggers fire per inserted row). ``order`` names the columns that define
that order -- ``["id"]`` for a table whose ids are assigned on insert; the
test fixture inserts day by day, so it passes ``["move_date", "id"]``.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions import money as M
from kontor.operators.sweep import RANGE, RANGE_ROWS, SPLIT, match_intervals, ranged, running, running_sum, same_keys
from kontor.session import stored
from kontor.sources.schemas import ENUMS, MONEY, QTY

QTY_SUM = "DECIMAL(30,6)"


# --- T3 stock quantities ---------------------------------------------------------

def stock_legs(moves: DataFrame) -> DataFrame:
    """Each posted move as signed legs: -qty at the source, +qty at the destination."""
    legs = F.array(
        F.struct(F.col("from_location_id").alias("location_id"), (-F.col("quantity")).alias("delta")),
        F.struct(F.col("to_location_id").alias("location_id"), F.col("quantity").alias("delta")))
    return (moves.filter(F.col("is_posted"))
            .select("product_id", F.explode(legs).alias("leg"))
            .select("product_id", "leg.location_id", "leg.delta")
            .filter(F.col("location_id").isNotNull()))


def apply_stock_moves(moves: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Stock per (product, location) after applying the posted moves (upsert-accumulate).

    A move counts when it is posted at insert time; every touched pair gets a
    row, even when it nets to zero; stock may go negative; reserved quantity
    is carried over from ``state`` untouched. The sum is a partial (map-side)
    aggregation, so a hot product or location does not skew the shuffle.
    """
    deltas = (stock_legs(moves).groupBy("product_id", "location_id")
              .agg(F.sum("delta").alias("_delta")))
    if state is None:
        out = deltas.select("product_id", "location_id",
                            F.col("_delta").cast(QTY).alias("quantity"),
                            F.lit(0).cast(QTY).alias("reserved_qty"))
    else:
        s = state.select("product_id", "location_id", "quantity", "reserved_qty")
        out = (s.join(deltas, ["product_id", "location_id"], "full")
               .select("product_id", "location_id",
                       (F.coalesce("quantity", F.lit(0)) + F.coalesce("_delta", F.lit(0))).cast(QTY)
                       .alias("quantity"),
                       F.coalesce("reserved_qty", F.lit(0).cast(QTY)).cast(QTY).alias("reserved_qty")))
    return out.withColumn("available_qty", (F.col("quantity") - F.col("reserved_qty")).cast(QTY))


def stock_on_hand_total(stock: DataFrame) -> DataFrame:
    """Total quantity per product over all locations."""
    return stock.groupBy("product_id").agg(F.sum("quantity").cast(QTY_SUM).alias("qty_on_hand"))


def move_type_matrix(moves: DataFrame) -> DataFrame:
    """Quantity per product pivoted over the nine move types (fixed list)."""
    types = ENUMS["stock_move_type"]
    return (moves.groupBy("product_id").pivot("move_type", types)
            .agg(F.sum("quantity").cast(QTY_SUM)).na.fill(0))


def move_total_cost(moves: DataFrame) -> DataFrame:
    """Stored column total_cost = quantity x unit_cost at 4 d.p."""
    return moves.withColumn("total_cost", M.qty_times_cost("quantity", "unit_cost"))


def uom_to_stock_qty(lines: DataFrame, products: DataFrame, qty_col: str = "quantity") -> DataFrame:
    """Purchase quantity x the product's uom_conversion = stock quantity."""
    p = products.select(F.col("id").alias("product_id"), "uom_conversion")
    return (lines.join(p, "product_id", "left")
            .withColumn("stock_qty", M.rounded_product(
                qty_col, 14, 6, F.coalesce("uom_conversion", F.lit(1)).cast(QTY), 6).cast(QTY_SUM))
            .drop("uom_conversion"))


# --- T4 moving-average cost --------------------------------------------------------

def _stock_delta(moves: DataFrame) -> DataFrame:
    q = F.col("quantity")
    delta = (F.when(F.col("to_location_id").isNotNull(), q).otherwise(F.lit(0))
             - F.when(F.col("from_location_id").isNotNull(), q).otherwise(F.lit(0)))
    return moves.withColumn("_delta", F.when(F.col("is_posted"), delta).otherwise(F.lit(0)).cast(QTY_SUM))


def costed_receipts(moves: DataFrame, order: list[str], range_rows: int | None = RANGE_ROWS,
                    keep: bool = False) -> DataFrame:
    """Posted purchase receipts with a cost, each with Q = product stock before it.

    Q sums the signed deltas of all earlier posted moves of the product (all
    locations) -- the stock trigger of this move has not run yet when the cost
    trigger reads it. Q does not depend on the cost, so it is a running sum,
    split into ranges of moves. ``keep`` writes the moves with their ranges, which
    two steps read, once under the checkpoint folder.
    """
    columns = ["id", "product_id", "move_type", "quantity", "unit_cost", "is_posted", "from_location_id",
            "to_location_id"]
    columns += [c for c in order if c not in columns]
    m = ranged(_stock_delta(moves.select(*columns)), ["product_id"], order, range_rows)
    if keep:
        m = stored(m, "move_ranges")
    m = running_sum(m, ["product_id"], order, "_delta", "qty_before", bucket=RANGE, exclusive=True, range_rows=range_rows)
    return m.filter((F.col("move_type") == "purchase_receipt") & F.col("is_posted") & (F.col("unit_cost") > 0))


_FOLD_SCHEMA = ("product_id BIGINT, move_id BIGINT, average_cost DECIMAL(20,4), last_purchase_price DECIMAL(20,4), "
                "seg BIGINT, chunk INT, step BIGINT")
_CTX = Context(prec=60)
_Q4 = Decimal("0.0001")


def _fold_partitions(batches):
    """Streamed weighted-average fold over rows sorted by (product, segment, chunk, order).

    State is one (key, cost) pair carried across Arrow batches, so a segment
    of any length is processed without being collected into memory.
    """
    key, cost, step = None, None, 0
    for pdf in batches:
        out_pid, out_id, out_cost, out_last, out_seg, out_step = [], [], [], [], [], []
        chunks = pdf["chunk"].astype("Int32")
        for pid, seg, chunk, mid, qb, q, c, init in zip(pdf["product_id"], pdf["seg"], chunks, pdf["id"],
                                                        pdf["qty_before"], pdf["quantity"], pdf["unit_cost"],
                                                        pdf["init_cost"]):
            own = (pid, seg, None if chunk is pd.NA else chunk)
            if own != key:
                key, step = own, 0
                cost = init if init is not None and not pd.isna(init) else Decimal(0)
            step += 1
            den = _CTX.add(qb, q)
            if den > 0:
                new = _CTX.divide(_CTX.add(_CTX.multiply(qb, cost), _CTX.multiply(q, c)), den)
            else:
                new = c
            cost = new.quantize(_Q4, rounding=ROUND_HALF_UP)
            out_pid.append(pid)
            out_id.append(mid)
            out_cost.append(cost)
            out_last.append(c)
            out_seg.append(seg)
            out_step.append(step)
        yield pd.DataFrame({"product_id": out_pid, "move_id": out_id, "average_cost": out_cost,
                            "last_purchase_price": out_last, "seg": out_seg, "chunk": chunks, "step": out_step})


def _segment_receipts(moves: DataFrame, products: DataFrame, order: list[str],
                      range_rows: int | None, keep: bool = False) -> DataFrame:
    """Costed receipts with Q, their reset segment and the starting cost of segment 0; ``keep`` as in ``costed_receipts``."""
    r = costed_receipts(moves, order, range_rows, keep)
    den = F.col("qty_before") + F.col("quantity")
    r = r.withColumn("_reset", F.when((F.col("qty_before") == 0) | (den <= 0), 1).otherwise(0))
    if keep:
        r = stored(r, "receipts")
    r = running_sum(r, ["product_id"], order, "_reset", "seg", bucket=RANGE, range_rows=range_rows)
    init = products.select(F.col("id").alias("product_id"), F.col("average_cost").alias("_start"))
    return (r.join(init, "product_id", "left")
            .withColumn("init_cost", F.when(F.col("seg") == 0, F.coalesce("_start", F.lit(0).cast(MONEY))))
            .select("product_id", F.col("seg").cast("bigint").alias("seg"), F.col(RANGE).alias("chunk"), "id",
                    "qty_before", "quantity", "unit_cost", "init_cost", *[c for c in order if c != "id"]))


def moving_average_cost(moves: DataFrame, products: DataFrame, order: list[str] | None = None,
                        keep_position: bool = False, range_rows: int | None = RANGE_ROWS,
                        parallel: bool = False) -> DataFrame:
    """Average cost after every costed receipt (T4), per receipt, in insertion order.

    A' = (Q*A + q*c) / (Q + q) if Q + q > 0 else c, rounded to 4 d.p. at each
    step. A receipt with Q = 0 or Q + q <= 0 resets the cost to c, so the
    sequence splits into independent segments at those receipts; segments
    are numbered by a running count and spread over tasks by (product,
    segment). Only segment 0 depends on the product's starting cost. Within
    a segment the fold is sequential by definition (rounding at each step),
    and runs as a streamed ``mapInPandas`` over sorted rows.

    ``parallel`` also cuts a segment at the ranges of its product's moves and
    folds the chunks side by side from guessed starting costs, which are then
    repaired until they are exact (``chunk_starts``). The result is the same;
    it costs some jobs that run while the plan is built, and spreads a product
    that never resets over all cores.
    """
    order = order or ["id"]
    r = _segment_receipts(moves, products, order, range_rows, parallel)
    chunk = ["product_id", "seg", "chunk"]
    if parallel:
        r = stored(r, "segments")
        starts = chunk_starts(r, order)
        r = (r.join(starts.select(*[F.col(c).alias(f"_s_{c}") for c in chunk], "start"),
                    same_keys(chunk, [f"_s_{c}" for c in chunk]), "left")
             .withColumn("init_cost", F.coalesce("start", "init_cost")))
    else:
        r = r.withColumn("chunk", F.lit(None).cast("int"))
    # no explicit partition count: AQE sizes the shuffle from the data
    steps = (r.repartition(*chunk).sortWithinPartitions(*chunk, *order)
             .select(*chunk, "id", "qty_before", "quantity", "unit_cost", "init_cost")
             .mapInPandas(_fold_partitions, _FOLD_SCHEMA))
    return steps if keep_position else steps.drop("seg", "chunk", "step")


_CHUNK_SCHEMA = ("product_id BIGINT, seg BIGINT, chunk INT, first_cost DECIMAL(20,4), a DOUBLE, b DOUBLE")
_END_SCHEMA = "product_id BIGINT, seg BIGINT, chunk INT, end DECIMAL(20,4)"


def _chunk_maps(batches):
    """Each chunk without its rounding: the cost after it is about a * (cost before it) + b."""
    key, a, b, first = None, 1.0, 0.0, None

    def frame(rows):
        return pd.DataFrame(rows, columns=["product_id", "seg", "chunk", "first_cost", "a", "b"])

    for pdf in batches:
        rows = []
        for pid, seg, chunk, qb, q, c, init in zip(pdf["product_id"], pdf["seg"], pdf["chunk"], pdf["qty_before"],
                                                   pdf["quantity"], pdf["unit_cost"], pdf["init_cost"]):
            own = (pid, seg, chunk)
            if own != key:
                if key is not None:
                    rows.append((*key, first, a, b))
                key, a, b, first = own, 1.0, 0.0, init
            total = float(qb) + float(q)
            keep = float(qb) / total if qb and total > 0 else 0.0
            a, b = a * keep, b * keep + float(c) * (1.0 - keep)
        if rows:
            yield frame(rows)
    if key is not None:
        yield frame([(*key, first, a, b)])


def _next_starts(batches):
    """Starting costs of the chunks of each segment, over rows sorted by (product, segment, chunk), one row a chunk.

    Before the first fold ``start`` is missing and the maps are chained. After
    it the next start is the end that was reached, moved by the slope of the
    chunk where its own start moves. Carried along is one cost, so a segment
    may have any number of chunks.
    """
    key, start = None, None
    for pdf in batches:
        starts = []
        for pid, seg, first, a, b, was, end in zip(pdf["product_id"], pdf["seg"], pdf["first_cost"], pdf["a"], pdf["b"],
                                                   pdf["start"], pdf["end"]):
            if (pid, seg) != key:
                key, start = (pid, seg), Decimal(0) if first is None or pd.isna(first) else first
            starts.append(start)
            if was is None or pd.isna(was):
                start = Decimal(repr(a * float(start) + b)).quantize(_Q4, rounding=ROUND_HALF_UP)
            elif start == was:
                start = end
            else:
                start = (end + Decimal(repr(a)) * (start - was)).quantize(_Q4, rounding=ROUND_HALF_UP)
        yield pdf.assign(due=starts)[["product_id", "seg", "chunk", "first_cost", "a", "b", "start", "end", "due"]]


def _chunk_ends(batches):
    """The exact cost after each chunk, from its starting cost."""
    keys, held = ["product_id", "seg", "chunk"], None
    for pdf in _fold_partitions(batches):
        rows = pdf[[*keys, "average_cost"]].rename(columns={"average_cost": "end"})
        ends = (rows if held is None else pd.concat([held, rows])).drop_duplicates(keys, keep="last")
        held = ends.tail(1)
        if len(ends) > 1:
            yield ends.iloc[:-1]
    if held is not None:
        yield held


def chunk_starts(receipts: DataFrame, order: list[str]) -> DataFrame:
    """(product_id, seg, chunk, start): the exact cost before every chunk of the segments that have several.

    Without rounding a chunk maps the cost before it to a * cost + b, so chaining
    the chunks' maps (one row each) guesses every start to within the rounding.
    Then all chunks are folded exactly from their guesses. Where a chunk's end
    is not the next one's start, the starts are corrected along the chain, with
    the maps' slopes, and only chunks with a new start are folded again. Once
    no start changes, all are exact, because the first one is and each end
    follows from its start. Every round makes at least one more chunk exact.
    ``receipts`` is read in every round, so it is a written table.
    """
    chunk = ["product_id", "seg", "chunk"]
    rows = receipts.where("chunk IS NOT NULL").select(
        *chunk, *[c for c in order if c != "id"], "id", "qty_before", "quantity", "unit_cost", "init_cost")
    given = ["id", "qty_before", "quantity", "unit_cost", "init_cost"]
    known = (rows.repartition(*chunk).sortWithinPartitions(*chunk, *order).select(*chunk, *given)
             .mapInPandas(_chunk_maps, _CHUNK_SCHEMA)
             .withColumn("start", F.lit(None).cast(MONEY)).withColumn("end", F.lit(None).cast(MONEY)))
    while True:
        known = stored(known.repartition("product_id", "seg").sortWithinPartitions(*chunk).select(
            *chunk, "first_cost", "a", "b", "start", "end").mapInPandas(
            _next_starts, _CHUNK_SCHEMA + ", start DECIMAL(20,4), end DECIMAL(20,4), due DECIMAL(20,4)"), "chunks")
        moved = known.where("NOT (due <=> start)")
        if moved.isEmpty():
            return known.select(*chunk, "start")
        folded = (rows.drop("init_cost").join(moved.select(*chunk, F.col("due").alias("init_cost")), chunk)
                  .repartition(*chunk).sortWithinPartitions(*chunk, *order).select(*chunk, *given)
                  .mapInPandas(_chunk_ends, _END_SCHEMA))
        known = (moved.drop("start", "end").withColumnRenamed("due", "start").join(folded, chunk)
                 .unionByName(known.where("due <=> start").drop("due")))


def product_costs(moves: DataFrame, products: DataFrame, order: list[str] | None = None,
                  range_rows: int | None = RANGE_ROWS, parallel: bool = False) -> DataFrame:
    """Products with average_cost / last_purchase_price after replaying the moves."""
    order = order or ["id"]
    steps = moving_average_cost(moves, products, order, True, range_rows, parallel)
    # (segment, chunk, step) is the replay position, so the last step needs no re-join with the moves
    last = (steps.withColumn("_ord", F.struct("seg", "chunk", "step"))
            .groupBy("product_id")
            .agg(F.max_by("average_cost", "_ord").alias("_avg"),
                 F.max_by("last_purchase_price", "_ord").alias("_last")))
    return (products.join(last, products["id"] == last["product_id"], "left")
            .withColumn("average_cost", F.coalesce("_avg", "average_cost").cast(MONEY))
            .withColumn("last_purchase_price", F.coalesce("_last", "last_purchase_price").cast(MONEY))
            .drop("_avg", "_last", "product_id"))


# --- FIFO cost layers (W3) ------------------------------------------------------------

def fifo_positions(moves: DataFrame, order: list[str], range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """Posted receipts and deliveries with their places on the queue axis of their product.

    ``_R`` and ``_Q`` are receipts and issues so far, ``_nr`` and ``_nq`` their
    numbers (insertion order). The consumed position on the receipt axis after
    issue j is C_j = Q_j + min(0, min_{k<=j}(R_k - Q_k)) -- each issue takes what
    is on hand and the rest is a shortfall that later receipts do not backfill.
    Running sums plus a running minimum: window aggregates, no per-row loop.
    ``_end`` is R after a receipt and C after an issue, ``satisfied`` what an
    issue takes.
    """
    extra = [c for c in order if c != "id"]
    own = [c for c in ("to_location_id", "move_date", "unit_cost") if c not in extra]
    issue = F.col("move_type") == "sale_delivery"
    zero = F.lit(0).cast(QTY_SUM)
    m = (moves.filter(F.col("is_posted") & F.col("move_type").isin("purchase_receipt", "sale_delivery"))
         .select("product_id", "id", *extra, *own, issue.alias("issue"), "quantity"))
    m = ranged(m, ["product_id"], order, range_rows)
    m = (m.withColumn("_rq", F.when(F.col("issue"), zero).otherwise(F.col("quantity")).cast(QTY_SUM))
         .withColumn("_iq", F.when(F.col("issue"), F.col("quantity")).otherwise(zero).cast(QTY_SUM))
         .withColumn("_r1", F.when(F.col("issue"), 0).otherwise(1).cast("bigint"))
         .withColumn("_i1", F.when(F.col("issue"), 1).otherwise(0).cast("bigint")))
    m = running(m, ["product_id"], order, [("_R", "_rq", "sum"), ("_Q", "_iq", "sum"), ("_nr", "_r1", "sum"),
                                           ("_nq", "_i1", "sum")], RANGE)
    # receipts raise R - Q, so the minimum over issues is the minimum over all rows after an issue
    m = m.withColumn("_D", F.when(F.col("issue"), F.col("_R") - F.col("_Q")).cast("DECIMAL(31,6)"))
    m = running(m, ["product_id"], order, [("_m_ex", "_D", "min")], RANGE, exclusive=True)
    low, low_ex = (F.least(F.lit(0), F.coalesce(c, F.lit(0))) for c in (F.least("_m_ex", "_D"), F.col("_m_ex")))
    return m.select("product_id", "id", *extra, *own, "issue", "quantity", RANGE, SPLIT,
                    F.when(F.col("issue"), F.col("_Q") + low).otherwise(F.col("_R")).cast(QTY_SUM).alias("_end"),
                    F.when(F.col("issue"), F.col("_nq")).otherwise(F.col("_nr")).alias("_rank"),
                    F.when(F.col("issue"), F.col("quantity") + low - low_ex).cast(QTY_SUM).alias("satisfied"))


def fifo_layers_and_cogs(moves: DataFrame, order: list[str] | None = None,
                         range_rows: int | None = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """FIFO at product level: receipts form layers, deliveries consume the oldest on hand.

    Our semantics (the data model only says layers are consumed FIFO): layers
    are posted purchase receipts (any unit cost, 0 allowed) in insertion order;
    a posted sale delivery consumes the oldest layers received before it; what
    is not on hand is a shortfall (reported, not costed, not backfilled);
    transfers move stock between locations without touching the product's
    queue. Returns ``(allocations, layers)``: one allocation row per
    (issue, layer) overlap with ``allocated`` and ``cost``, plus a row with a
    NULL layer for each shortfall; layers carry ``remaining_qty`` and
    ``total_cost`` = remaining x unit cost. The queue positions, which all parts
    of the result read, are written once under the checkpoint folder.
    """
    order = order or ["id"]
    places = stored(fifo_positions(moves, order, range_rows), "fifo_positions")
    layers, issues = places.where("NOT issue"), places.where("issue")
    alloc = match_intervals(layers.withColumnRenamed("id", "stock_move_id"), issues.withColumnRenamed("id", "issue_id"),
                            ["product_id"], "stock_move_id", "issue_id").filter(F.col("stock_move_id").isNotNull())
    cost = layers.select(F.col("id").alias("stock_move_id"), "unit_cost")
    alloc = (alloc.join(cost, "stock_move_id", "left")
             .withColumn("cost", M.qty_times_cost("allocated", "unit_cost"))
             .select("product_id", "issue_id", "stock_move_id", F.col("allocated").cast(QTY).alias("allocated"),
                     "cost"))
    short = (issues.filter(F.col("quantity") > F.col("satisfied"))
             .select("product_id", F.col("id").alias("issue_id"), F.lit(None).cast("bigint").alias("stock_move_id"),
                     (F.col("quantity") - F.col("satisfied")).cast(QTY).alias("allocated"),
                     F.lit(None).cast(MONEY).alias("cost")))
    # what is left of a layer follows from its place alone: consumption runs up to the last issue's end
    used = issues.groupBy("product_id").agg(F.max("_end").alias("_used"))
    begin = F.col("_end") - F.col("quantity")
    left = F.col("quantity") - F.least(F.greatest(F.coalesce("_used", F.lit(0)) - begin, F.lit(0)), F.col("quantity"))
    rem = (layers.join(used, "product_id", "left")
           .select("id", "product_id", F.col("to_location_id").alias("location_id"), F.col("id").alias("stock_move_id"),
                   F.col("move_date").alias("received_date"), F.col("quantity").alias("original_qty"),
                   left.cast(QTY).alias("remaining_qty"), "unit_cost"))
    return alloc.unionByName(short), rem.withColumn("total_cost", M.qty_times_cost("remaining_qty", "unit_cost"))


def fifo_cogs(moves: DataFrame, order: list[str] | None = None, range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """COGS per issue under FIFO; shortfall quantity reported separately."""
    return issue_costs(fifo_layers_and_cogs(moves, order, range_rows)[0])


def issue_costs(alloc: DataFrame) -> DataFrame:
    """Allocations of ``fifo_layers_and_cogs`` per issue."""
    return alloc.groupBy("product_id", "issue_id").agg(
        F.sum(F.when(F.col("stock_move_id").isNotNull(), F.col("allocated"))).cast(QTY_SUM).alias("costed_qty"),
        F.sum(F.when(F.col("stock_move_id").isNull(), F.col("allocated"))).cast(QTY_SUM).alias("shortfall_qty"),
        F.sum("cost").cast("DECIMAL(30,4)").alias("cogs"))


def consume_layers(active: DataFrame, moves: DataFrame, order: list[str] | None = None,
                   range_rows: int | None = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Carry a store of active cost layers (``remaining_qty`` > 0) over a batch of new moves.

    ``active`` has the columns of the layers of ``fifo_layers_and_cogs``; every
    move comes after all the store has seen. What is left of the stored layers
    stands before the new receipts in each product's queue; layers used up leave
    the store. Only products with new moves are touched. Returns the batch's
    ``(allocations, active layers)``; batch after batch gives the full FIFO.
    """
    order = order or ["id"]
    moves = moves.filter(F.col("is_posted") & F.col("move_type").isin("purchase_receipt", "sale_delivery"))
    touched = moves.select("product_id").distinct()
    columns = ["id", "product_id", "move_type", "move_date", "quantity", "unit_cost", "to_location_id", "is_posted"]
    old = (active.join(touched, "product_id", "left_semi")
           .select("id", "product_id", F.lit("purchase_receipt").alias("move_type"),
                   F.col("received_date").alias("move_date"), F.col("remaining_qty").alias("quantity"), "unit_cost",
                   F.col("location_id").alias("to_location_id"), F.lit(True).alias("is_posted"), F.lit(0).alias("_new")))
    queue = old.unionByName(moves.select(*columns).withColumn("_new", F.lit(1)))
    alloc, layers = fifo_layers_and_cogs(queue, ["_new", *order], range_rows)
    kept = active.select("id", F.col("original_qty").alias("_original"))
    left = (layers.where("remaining_qty > 0").join(kept, "id", "left")
            .withColumn("original_qty", F.coalesce("_original", "original_qty").cast(QTY)).drop("_original"))
    return alloc, left.unionByName(active.join(touched, "product_id", "left_anti").select(*left.columns))


def empty_layers(spark) -> DataFrame:
    """A store of cost layers without rows."""
    return spark.createDataFrame([], "id BIGINT, product_id BIGINT, location_id INT, stock_move_id BIGINT, "
                                     f"received_date DATE, original_qty {QTY}, remaining_qty {QTY}, unit_cost {MONEY}, "
                                     f"total_cost {MONEY}")


def location_queues(moves: DataFrame) -> DataFrame:
    """Every posted move of any type as queue events per (product, location).

    A move into a location adds a layer there at the move's own unit cost, a
    move out of one consumes its oldest layers; a transfer does both. The key
    stands in ``product_id`` as a struct, so the FIFO operators take the rows
    as they take moves. A move that stays at its location changes nothing.
    """
    legs = F.array(
        F.struct(F.col("to_location_id").alias("place"), F.lit("purchase_receipt").alias("kind")),
        F.struct(F.col("from_location_id").alias("place"), F.lit("sale_delivery").alias("kind")))
    return (moves.filter(F.col("is_posted") & ~F.col("from_location_id").eqNullSafe(F.col("to_location_id")))
            .select("*", F.explode(legs).alias("_leg")).filter(F.col("_leg.place").isNotNull())
            .select(F.struct("product_id", F.col("_leg.place").alias("location_id")).alias("product_id"), "id",
                    "move_date", F.col("_leg.place").alias("to_location_id"), F.col("_leg.kind").alias("move_type"),
                    "quantity", "unit_cost", "is_posted"))


def fifo_by_location(moves: DataFrame, order: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """W3 per (product, location) over all move types: (cost per issue, layers), as ``fifo_cogs`` and ``fifo_layers_and_cogs``."""
    queues = location_queues(moves)
    alloc, layers = fifo_layers_and_cogs(queues, order, **options)
    cogs = issue_costs(alloc).select("product_id.*", "issue_id", "costed_qty", "shortfall_qty", "cogs")
    rest = [c for c in layers.columns if c not in ("id", "product_id", "location_id")]
    return cogs, layers.select("id", "product_id.*", *rest)


# --- valuation and reorder ----------------------------------------------------------------

def valuation_by_method(stock: DataFrame, products: DataFrame, layers: DataFrame) -> DataFrame:
    """Per product: on-hand quantity and value under its own valuation method.

    average_cost -> qty x average_cost; standard_cost -> qty x standard_cost;
    fifo -> value of the remaining FIFO layers (quantity from the stock table).
    """
    qty_p = stock.groupBy("product_id").agg(F.sum("quantity").alias("qty_on_hand"))
    fifo_v = (layers.groupBy("product_id")
              .agg(F.sum("total_cost").alias("_fifo_value")))
    p = products.select(F.col("id").alias("product_id"), "valuation_method", "average_cost", "standard_cost")
    j = qty_p.join(p, "product_id").join(fifo_v, "product_id", "left")
    value = (F.when(F.col("valuation_method") == "fifo", F.coalesce("_fifo_value", F.lit(0)).cast("decimal(37,4)"))
             .when(F.col("valuation_method") == "standard_cost",
                   M.rounded_product("qty_on_hand", 24, 6, M.money("standard_cost")))
             .otherwise(M.rounded_product("qty_on_hand", 24, 6, M.money("average_cost"))))
    return j.select("product_id", "valuation_method", F.col("qty_on_hand").cast(QTY_SUM).alias("qty_on_hand"),
                    F.round(value, 4).cast("DECIMAL(30,4)").alias("inventory_value"))


def inventory_total_value(valuation: DataFrame, products: DataFrame) -> DataFrame:
    """Total value over tracked (non-service) products."""
    tracked = products.filter(F.col("is_tracked")).select(F.col("id").alias("product_id"))
    return (valuation.join(tracked, "product_id", "left_semi")
            .agg(F.sum("inventory_value").cast("DECIMAL(38,10)").alias("total_value")))


def reorder_report(stock: DataFrame, products: DataFrame) -> DataFrame:
    """Products whose available stock is at or below the reorder point.

    Also flags stock below ``min_stock`` and above ``max_stock`` (NULL max =
    unlimited). Suggested quantity is the product's reorder_qty; ``shortage``
    ranks products within a company by (available - reorder point).
    """
    avail = stock.groupBy("product_id").agg(F.sum("available_qty").cast(QTY_SUM).alias("available_qty"))
    p = products.filter(F.col("is_tracked") & F.col("is_active")).select(
        F.col("id").alias("product_id"), "company_id", "sku", "reorder_point", "reorder_qty", "min_stock",
        "max_stock")
    j = p.join(avail, "product_id", "left").withColumn(
        "available_qty", F.coalesce("available_qty", F.lit(0).cast(QTY_SUM)))
    gap = (F.col("available_qty") - F.col("reorder_point")).cast("DECIMAL(31,6)")
    flagged = (j.filter(F.col("available_qty") <= F.col("reorder_point"))
               .select("company_id", "product_id", "sku", "available_qty", "reorder_point",
                       F.col("reorder_qty").alias("suggested_qty"),
                       (F.col("available_qty") < F.col("min_stock")).alias("below_min"),
                       (F.col("max_stock").isNotNull() & (F.col("available_qty") > F.col("max_stock")))
                       .alias("above_max"),
                       gap.alias("gap"))
               .withColumn("_one", F.lit(1))
               .withColumn("_gb", F.floor("gap").cast("bigint")))
    # (gap, product_id) is unique, so rank = running count; two-phase, bucketed by
    # the integer part of the gap, so one company's ranking is not a single task
    ranked = running(flagged, ["company_id"], ["gap", "product_id"], [("shortage_rank", "_one", "sum")],
                     bucket="_gb")
    return ranked.withColumn("shortage_rank", F.col("shortage_rank").cast("int")).drop("_one", "_gb")


def resolve_gl_accounts(products: DataFrame, categories: DataFrame, default_inventory: int | None = None,
                        default_cogs: int | None = None, default_revenue: int | None = None) -> DataFrame:
    """Product account override, else the category default, else the given default."""
    c = categories.select(F.col("id").alias("category_id"),
                          F.col("inventory_account_id").alias("_ci"), F.col("cogs_account_id").alias("_cc"),
                          F.col("revenue_account_id").alias("_cr"))
    j = products.join(c, "category_id", "left")

    def pick(own, cat, dflt):
        return F.coalesce(F.col(own), F.col(cat), F.lit(dflt).cast("int"))

    return j.select(F.col("id").alias("product_id"),
                    pick("inventory_account_id", "_ci", default_inventory).alias("inventory_account_id"),
                    pick("cogs_account_id", "_cc", default_cogs).alias("cogs_account_id"),
                    pick("revenue_account_id", "_cr", default_revenue).alias("revenue_account_id"))


def weekly_movements(moves: DataFrame) -> DataFrame:
    """T7 in batch: posted quantity per product, move type and 7-day window.

    Windows are aligned like ``window(ts, '7 days')`` (epoch-based) but computed
    on dates, so the result does not depend on the session time zone.
    """
    d = F.col("move_date")
    week = F.date_sub(d, F.pmod(F.datediff(d, F.lit("1970-01-01").cast("date")), F.lit(7)))
    return (moves.filter(F.col("is_posted"))
            .groupBy(week.alias("week_start"), "product_id", "move_type")
            .agg(F.sum("quantity").cast(QTY_SUM).alias("quantity"), F.count(F.lit(1)).alias("moves")))
