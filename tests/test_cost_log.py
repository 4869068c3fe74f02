"""A stream of moves in any order and any batching equals the batch result."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from kontor.operators import inventory as I
from kontor.sources import fixture as FX
from kontor.streaming import cost_log as CL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def moves(spark):
    lg = FX.ledger(spark, SF)
    some = lg.stock_moves.where("product_id % 20 = 3").select(*CL.MOVE_COLUMNS)
    rows = sorted(map(tuple, some.collect()))
    products = lg.products.where("id % 20 = 3").select("id", "average_cost")
    want = sorted(map(tuple, I.moving_average_cost(spark.createDataFrame(rows, CL.MOVE_SCHEMA), products).collect()))
    return rows, products, want


@pytest.mark.parametrize("delay,batches", [(0, 3), (10**15, 3), (20_000, 4)])
def test_shuffled_stream_equals_batch(spark, moves, delay, batches):
    rows, products, want = moves
    rng = random.Random(batches)
    shuffled = rng.sample(rows, len(rows))
    log = CL.CostLog(spark, tempfile.mkdtemp(prefix="kontor-log-") + "/log", products, delay)
    size = -(-len(rows) // batches)
    for e in range(batches):
        part = spark.createDataFrame(shuffled[e * size:(e + 1) * size], CL.MOVE_SCHEMA)
        log.apply(part, e)
        if e == 1:
            log.apply(part, e)  # a batch that runs again replaces itself
    log.flush()
    assert sorted(map(tuple, log.latest().collect())) == want
    kinds = {r["kind"]: r["count"] for r in log.emitted().groupBy("kind").count().collect()}
    assert kinds["cost"] == len(want)
    assert ("correction" in kinds) == (delay < 10**15)


def test_state_follows_the_moves(spark, moves):
    rows, products, want = moves
    log = CL.CostLog(spark, tempfile.mkdtemp(prefix="kontor-log-") + "/log", products)
    log.apply(spark.createDataFrame(rows, CL.MOVE_SCHEMA), 0)
    stock = {r[0]: r[1] for r in I._stock_delta(spark.createDataFrame(rows, CL.MOVE_SCHEMA)).groupBy("product_id")
             .agg(F.sum("_delta")).collect()}
    state = log._state(1).collect()
    assert {r["product_id"]: r["qty"] for r in state} == stock
    last = {p: c for p, _, c, _ in want}
    assert all(r["cost"] == last[r["product_id"]] for r in state if r["product_id"] in last)
