"""Ranges of hot keys and the parallel cost fold."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal as D

import pytest
from pyspark.sql import functions as F

from kontor.operators import inventory as I
from kontor.operators import sequences as SQ
from kontor.operators import sweep

MOVES = ("id BIGINT, product_id BIGINT, move_type STRING, move_date DATE, quantity DECIMAL(20,6), unit_cost DECIMAL(20,4), "
         "from_location_id INT, to_location_id INT, is_posted BOOLEAN")


@pytest.mark.parametrize("ids", ["dense", "sparse", "skewed"])
def test_ranges_hold_about_equal_numbers_of_rows(spark, ids):
    n = 60_000
    value = {"dense": F.col("id"), "sparse": F.shiftrightunsigned(F.xxhash64("id"), 4),
             "skewed": F.when(F.col("id") < n // 2, F.col("id")).otherwise(F.col("id") * 10**12)}[ids]
    rows = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), value.alias("o"))
    got = sweep.ranged(rows, ["k"], ["o"], 2000)
    hot = [r["count"] for r in got.where("k = -1").groupBy("_range").count().collect()]
    assert got.where("k <> -1 AND _range IS NOT NULL").count() == 0
    assert 20 <= len(hot) <= 35 and max(hot) < 2 * 2000 and sum(hot) == n * 9 // 10
    spans = got.where("k = -1").groupBy("_range").agg(F.min("o").alias("a"), F.max("o").alias("b")).orderBy("_range").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_ranges_of_ties_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, d, i) for d in (None, 1, 1, 2) for i in range(50)], "k INT, d INT, i INT")
    rows = rows.withColumn("one", F.lit(1))
    cut = sweep.running(sweep.ranged(rows, ["k"], ["d", "i"], 7), ["k"], ["d", "i"], [("n", "one", "sum")], sweep.RANGE)
    assert sorted(r["n"] for r in cut.collect()) == list(range(1, 201))
    assert sweep.ranged(rows.limit(0), ["k"], ["d"], 7).count() == 0


def test_sparse_ids_in_gaps(spark):
    rows = spark.createDataFrame([(1, 2**59 + i * i) for i in range(300)], "g INT, n BIGINT")
    plain, cut = (sorted(map(tuple, SQ.sequence_gaps(rows, ["g"], "n", r).collect())) for r in (None, 10))
    assert plain == cut and len(plain) == 298


def hot_moves(spark, n, seed, sparse=True):
    rng = random.Random(seed)
    ids = sorted(rng.sample(range(2**59), n)) if sparse else range(n)
    rows = [(i, 1, "purchase_receipt" if rng.random() < 0.7 or j < 5 else "sale_delivery", dt.date(2024, 1, 1),
             D(rng.randint(1, 900)) / 7, D(rng.randint(1, 10**6)) / 1000, None, None, True) for j, i in enumerate(ids)]
    rows = [(*r[:6], None, 1, True) if r[2] == "purchase_receipt" else (*r[:4], r[4] / 30, r[5], 1, None, True) for r in rows]
    q6 = D("0.000001")
    rows = [(*r[:4], r[4].quantize(q6), r[5], *r[6:]) for r in rows]
    products = spark.createDataFrame([(1, D("3.5"), D("0"))], "id BIGINT, average_cost DECIMAL(20,4), last_purchase_price DECIMAL(20,4)")
    return rows, spark.createDataFrame(rows, MOVES), products


def replay(rows, cost):
    qty, out = D(0), {}
    for i, _, kind, _, q, c, a, b, _ in rows:
        if kind == "purchase_receipt":
            cost = ((qty * cost + q * c) / (qty + q) if qty + q > 0 else c).quantize(D("0.0001"), ROUND_HALF_UP)
            out[i] = cost
        qty += q if b is not None else 0
        qty -= q if a is not None else 0
    return out


def test_a_product_that_never_resets_is_folded_in_parallel(spark):
    rows, moves, products = hot_moves(spark, 4000, 1)
    want = replay(rows, D("3.5"))
    steps = I.moving_average_cost(moves, products, keep_position=True, range_rows=100, parallel=True).collect()
    assert {r["move_id"]: r["average_cost"] for r in steps} == want
    assert len({r["chunk"] for r in steps}) > 25 and len({r["seg"] for r in steps}) == 1
    assert max(r["step"] for r in steps) < 300
    last = I.product_costs(moves, products, range_rows=100, parallel=True).first()
    assert last["average_cost"] == want[max(want)]


def test_fifo_of_sparse_ids(spark):
    _, moves, _ = hot_moves(spark, 500, 3)
    plain, cut = (sorted(map(tuple, I.fifo_cogs(moves, None, r).collect())) for r in (None, 20))
    assert plain == cut and len(plain) > 100
