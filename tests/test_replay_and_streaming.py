"""Sequential pure-Python replays (test-only references) and batch == streaming."""

import os
import tempfile
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from kontor.operators import inventory as I
from kontor.sources import fixture as FX
from kontor.streaming import ledger_streams as ST

from conftest import SF_SMALL

ORDER = ["move_date", "id"]


def _moves_and_products(spark):
    lg = FX.ledger(spark, SF_SMALL)
    moves = [r.asDict() for r in lg.stock_moves.collect()]
    products = {r["id"]: r["average_cost"] for r in lg.products.select("id", "average_cost").collect()}
    moves.sort(key=lambda m: (m["move_date"], m["id"]))
    return lg, moves, products


def _replay_average_cost(moves, products):
    """Row by row, as the data model's triggers do it on insert."""
    stock, cost, out = {}, dict(products), {}
    for m in moves:
        p, q = m["product_id"], m["quantity"]
        if m["move_type"] == "purchase_receipt" and m["is_posted"] and m["unit_cost"] > 0:
            qb = stock.get(p, Decimal(0))
            a = cost[p]
            new = (qb * a + q * m["unit_cost"]) / (qb + q) if qb + q > 0 else m["unit_cost"]
            cost[p] = new.quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)
            out[m["id"]] = cost[p]
        if m["is_posted"]:
            stock[p] = stock.get(p, Decimal(0)) + (q if m["to_location_id"] is not None else 0) \
                - (q if m["from_location_id"] is not None else 0)
    return out


def test_moving_average_matches_sequential_replay(spark):
    lg, moves, products = _moves_and_products(spark)
    expected = _replay_average_cost(moves, products)
    got = {r["move_id"]: r["average_cost"]
           for r in I.moving_average_cost(lg.stock_moves, lg.products, ORDER).collect()}
    assert got == expected and len(got) > 100


def test_fifo_matches_sequential_replay(spark):
    lg, moves, _ = _moves_and_products(spark)
    layers, cogs, short = {}, {}, {}
    for m in moves:
        if not m["is_posted"]:
            continue
        p = m["product_id"]
        if m["move_type"] == "purchase_receipt":
            layers.setdefault(p, []).append([m["quantity"], m["unit_cost"]])
        elif m["move_type"] == "sale_delivery":
            need, c = m["quantity"], Decimal(0)
            for layer in layers.get(p, []):
                if need == 0:
                    break
                take = min(need, layer[0])
                if take > 0:
                    c += (take * layer[1]).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)
                    layer[0] -= take
                    need -= take
            cogs[m["id"]] = c
            short[m["id"]] = need
    got = {r["issue_id"]: (r["cogs"] or Decimal(0), r["shortfall_qty"] or Decimal(0))
           for r in I.fifo_cogs(lg.stock_moves, ORDER).collect()}
    assert got == {k: (cogs[k], short[k]) for k in cogs}


def _write_move_files(spark, lg):
    """The moves as one Parquet file per year, written in insertion order."""
    d = tempfile.mkdtemp(prefix="kontor-moves-")
    m = lg.stock_moves.withColumn("_y", F.year("move_date"))
    for y in sorted(r[0] for r in m.select("_y").distinct().collect()):
        (m.filter(F.col("_y") == y).drop("_y").coalesce(1)
         .write.mode("overwrite").parquet(os.path.join(d, f"part_{y}")))
    src = tempfile.mkdtemp(prefix="kontor-stream-src-")
    for i, y in enumerate(sorted(os.listdir(d))):
        f = [x for x in os.listdir(os.path.join(d, y)) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, y, f), os.path.join(src, f"{i:04d}.parquet"))
        os.utime(os.path.join(src, f"{i:04d}.parquet"), (1_000_000 + i, 1_000_000 + i))
    return src


def test_streaming_equals_batch(spark):
    lg = FX.ledger(spark, SF_SMALL)
    src = _write_move_files(spark, lg)
    stream = ST.read_moves_stream(spark, src, max_files_per_trigger=1)

    q1 = (ST.stock_quantities_stream(stream).writeStream.outputMode("complete").format("memory")
          .queryName("stock_stream").option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True)
          .start())
    q1.awaitTermination()
    streamed = {(r["product_id"], r["location_id"]): r["quantity"] for r in spark.table("stock_stream").collect()}
    batch = {(r["product_id"], r["location_id"]): r["quantity"] for r in I.apply_stock_moves(lg.stock_moves).collect()}
    assert streamed == batch

    q2 = (ST.moving_average_cost_stream(stream, lg.products).writeStream.outputMode("append").format("memory")
          .queryName("cost_stream").option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True)
          .start())
    q2.awaitTermination()
    streamed_cost = {r["move_id"]: r["average_cost"] for r in spark.table("cost_stream").collect()}
    batch_cost = {r["move_id"]: r["average_cost"]
                  for r in I.moving_average_cost(lg.stock_moves, lg.products, ORDER).collect()}
    assert streamed_cost == batch_cost


def test_posting_stream_matches_batch(spark):
    from kontor.operators import posting as P
    lg = FX.ledger(spark, SF_SMALL)
    src = tempfile.mkdtemp(prefix="kontor-entries-")
    lg.journal_entries.select("id", "status", "period_id").write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("id BIGINT, status STRING, period_id INT").parquet(src)
    sink = tempfile.mkdtemp(prefix="kontor-posted-")
    q = ST.post_entries_stream(stream, lg.journal_entry_lines, lg.accounting_periods, sink,
                               tempfile.mkdtemp(), event="insert")
    q.awaitTermination()
    got = {r["id"]: r["reason"] for r in spark.read.parquet(sink).collect()}
    exp = {r["id"]: r["reason"] for r in P.post_entries(lg.journal_entries.select("id", "status", "period_id"),
                                                        lg.journal_entry_lines, lg.accounting_periods,
                                                        event="insert").collect()}
    assert got == exp


def test_weekly_movements_stream(spark):
    lg = FX.ledger(spark, SF_SMALL)
    src = _write_move_files(spark, lg)
    stream = ST.read_moves_stream(spark, src, max_files_per_trigger=1)
    q = (ST.weekly_movements_stream(stream).writeStream.outputMode("append").format("memory")
         .queryName("weekly").option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    q.awaitTermination()
    total = spark.table("weekly").agg(F.sum("quantity")).first()[0]
    posted = lg.stock_moves.filter("is_posted").agg(F.sum("quantity")).first()[0]
    # windows still open at the end of the stream are not emitted in append mode
    assert 0 < total <= posted


def test_hot_key_plan_equals_plain_plan(spark):
    """Cutting every product's moves into tiny ranges gives the same results."""
    lg = FX.ledger(spark, SF_SMALL)
    plain = {(r["issue_id"], r["cogs"], r["shortfall_qty"]) for r in I.fifo_cogs(lg.stock_moves, ORDER).collect()}
    hot = {(r["issue_id"], r["cogs"], r["shortfall_qty"])
           for r in I.fifo_cogs(lg.stock_moves, ORDER, 1).collect()}
    assert plain == hot and len(plain) > 100
    split = {(r["issue_id"], r["cogs"], r["shortfall_qty"])
             for r in I.fifo_cogs(lg.stock_moves, ORDER, 3).collect()}
    assert plain == split
    c_plain = {r["move_id"]: r["average_cost"] for r in I.moving_average_cost(lg.stock_moves, lg.products, ORDER).collect()}
    for options in ({"range_rows": 2}, {"range_rows": 2, "parallel": True}):
        c_hot = {r["move_id"]: r["average_cost"]
                 for r in I.moving_average_cost(lg.stock_moves, lg.products, ORDER, **options).collect()}
        assert c_plain == c_hot


def test_stock_state_stream_matches_batch(spark):
    lg = FX.ledger(spark, SF_SMALL)
    src = _write_move_files(spark, lg)
    state_dir = tempfile.mkdtemp(prefix="kontor-stock-state-")
    q = ST.run_stock_state_stream(ST.read_moves_stream(spark, src, 1), state_dir, tempfile.mkdtemp())
    q.awaitTermination()
    last = max(int(d.split("=")[1]) for d in os.listdir(state_dir) if d.startswith("version="))
    assert last >= 2   # several micro-batches
    got = {(r["product_id"], r["location_id"]): r["quantity"]
           for r in spark.read.parquet(f"{state_dir}/version={last}").collect()}
    exp = {(r["product_id"], r["location_id"]): r["quantity"] for r in I.apply_stock_moves(lg.stock_moves).collect()}
    assert got == exp


def test_weekly_stream_drops_rows_behind_the_watermark(spark):
    """A move arriving after the watermark has passed its week is not counted (append mode)."""
    import datetime as dt
    from decimal import Decimal as Dm
    src = tempfile.mkdtemp(prefix="kontor-late-")

    def move(i, day, qty):
        return (i, 1, f"M{i}", "purchase_receipt", day, 7, 1, None, 1, Dm(qty), Dm(0), Dm(0), None, None, None, None,
                True)

    batches = [
        [move(1, dt.date(2024, 1, 1), 5)],
        [move(2, dt.date(2024, 3, 1), 7)],            # advances the watermark far past January
        [move(5, dt.date(2024, 3, 2), 1)],            # late rows are filtered with the previous
                                                      # batch's watermark, so let it propagate
        [move(3, dt.date(2024, 1, 2), 100)],          # late: its week is already closed
        [move(4, dt.date(2024, 6, 1), 1)],            # advances again so March's week is emitted
    ]
    for i, rows in enumerate(batches):
        d = os.path.join(src, f"b{i}")
        spark.createDataFrame(rows, ST.MOVE_STREAM_SCHEMA).coalesce(1).write.parquet(d)
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, f), os.path.join(src, f"{i:04d}.parquet"))
        os.utime(os.path.join(src, f"{i:04d}.parquet"), (2_000_000 + i, 2_000_000 + i))
    stream = spark.readStream.schema(ST.MOVE_STREAM_SCHEMA).option("maxFilesPerTrigger", 1) \
        .parquet(os.path.join(src, "*.parquet"))
    q = (ST.weekly_movements_stream(stream, watermark="7 days").writeStream.outputMode("append")
         .format("memory").queryName("weekly_late").option("checkpointLocation", tempfile.mkdtemp())
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["window"]["start"].date(), r["quantity"]) for r in spark.table("weekly_late").collect()}
    assert all(qty != Dm(100) and qty != Dm(105) for _, qty in got)   # the late move never counted
    assert any(qty == Dm(5) for _, qty in got)                         # January's week closed with 5
