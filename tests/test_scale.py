"""Steps that must not grow into one task, one driver or one frame per row."""

from decimal import Decimal as D

import pandas as pd
from pyspark.sql import DataFrame

from kontor.operators import inventory as I
from kontor.operators import sweep
from kontor.plans import registry

SF = "/root/testdata/sf0.001"


def _chunks(n):
    return pd.DataFrame({"product_id": [1] * 2 * n, "seg": [0] * 2 * n, "chunk": [i // 2 for i in range(2 * n)],
                         "id": range(2 * n), "qty_before": [D(i) for i in range(2 * n)], "quantity": [D(1)] * 2 * n,
                         "unit_cost": [D(i + 1) for i in range(2 * n)], "init_cost": [D(3)] * 2 * n})


def test_a_batch_of_chunks_is_one_frame():
    """one frame a batch, not one a chunk; a chunk over two batches is one row."""
    pdf = _chunks(50)
    for step in (I._chunk_maps, I._chunk_ends):
        whole = list(step([pdf]))
        cut = pd.concat(step([pdf.iloc[:31], pdf.iloc[31:]]))
        assert len(whole) <= 2
        whole = pd.concat(whole)
        assert list(whole["chunk"]) == list(range(50)) == list(cut["chunk"])
        assert whole.iloc[:, -1].tolist() == cut.iloc[:, -1].tolist()


def test_starts_carry_over_batches():
    """a segment's chunks may come in any number of batches."""
    rows = pd.DataFrame({"product_id": [1, 1, 1, 2], "seg": [0, 0, 0, 0], "chunk": [0, 1, 2, 0],
                         "first_cost": [D(4), None, None, None], "a": [0.5] * 4, "b": [1.0] * 4,
                         "start": [None] * 4, "end": [None] * 4})
    due = pd.concat(I._next_starts([rows.iloc[:1], rows.iloc[1:]]))["due"].tolist()
    assert due == [D(4), D(3), D("2.5"), D(0)]


def test_many_cuts_are_not_broadcast(spark):
    """with ranges of a few rows, cuts and totals grow with the rows."""
    rows = spark.range(100).selectExpr("id % 3 AS k", "id AS i", "1L AS v")
    for range_rows, hinted in ((4, False), (sweep.RANGE_ROWS, True)):
        df = sweep.running(sweep.ranged(rows, ["k"], ["i"], range_rows), ["k"], ["i"], [("n", "v", "sum")], sweep.RANGE,
                           range_rows=range_rows)
        assert ("strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()) == hinted
        assert sorted(r["n"] for r in df.where("k = 0").collect()) == list(range(1, 35))


def test_stream_of_moves_is_written_by_many_tasks(spark, monkeypatch):
    """F2: the moves of a micro-batch are not numbered, sorted and written in one task."""
    plans, coalesce = [], DataFrame.coalesce
    monkeypatch.setattr(DataFrame, "coalesce", lambda self, n: plans.append(
        self._jdf.queryExecution().analyzed().toString()) or coalesce(self, n))
    got = registry.queries()["moving_average_cost_replayed"](spark, SF)
    assert not any("l_orderkey" in p for p in plans)
    want = registry.queries()["moving_average_cost_by_insertion"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_line_items_are_dealt_by_size(spark, monkeypatch):
    """The tasks that join lines with their orders grow in number with the files."""
    from kontor.sources import fixture as FX
    few = FX.ledger(spark, SF).journal_entry_lines
    monkeypatch.setattr(FX, "TASK_BYTES", 1 << 10)
    many = FX.ledger(spark, SF).journal_entry_lines
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert "RepartitionByExpression" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()


def test_queues_are_read_from_written_rows(spark, monkeypatch):
    """Cuts, totals and places read each queue's rows, not the joins they come from."""
    from kontor.operators import orders as O
    from kontor.sources import fixture as FX
    written, ranged = [], sweep.ranged
    monkeypatch.setattr(sweep, "ranged", lambda df, *a: written.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or ranged(df, *a))
    lg = FX.ledger(spark, SF)
    O.allocate_bills(lg.purchase_order_lines, lg.purchase_orders, lg.invoice_lines, lg.invoices)
    assert len(written) == 2 and not any("Join" in p or "Window" in p for p in written)


def test_moves_are_numbered_once(spark, monkeypatch):
    """every step reads the written moves."""
    from kontor.plans import inventory_plans as IP
    seen = []
    for name in ("consume_layers", "fifo_by_location", "product_costs"):
        monkeypatch.setattr(I, name, lambda *a, f=getattr(I, name), n=name: seen.append(
            (a[1] if n == "consume_layers" else a[0])._jdf.queryExecution().optimizedPlan().toString()) or f(*a))
    IP.q_active_layers(spark, SF)
    IP.q_valuation_by_method(spark, SF)
    assert len(seen) == 5 and not any("Window" in p or "lineitem" in p for p in seen)


def _tasks(df):
    """Numbers of the tasks that rows are dealt over by number in the plan of ``df``."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [int(line.rsplit(",", 1)[1]) for line in plan.splitlines() if "RepartitionByExpression" in line]


def test_windows_of_buckets_are_dealt_by_size(spark, monkeypatch, tmp_path):
    """the rows one task of the ledger's running balance sorts do not grow with the files."""
    from kontor.operators import banking as B
    rows = spark.range(3000).selectExpr(
        "1 AS company_id", "IF(id % 7 = 0, NULL, concat('a', id % 2)) AS account_code", "IF(id % 2 = 0, 'debit', 'credit') AS normal_balance",
        "IF(id % 11 = 0, NULL, date_add(DATE'2024-01-01', CAST(id % 13 AS INT))) AS entry_date", "CAST(id % 5 AS STRING) AS entry_number",
        "id AS line_key", "CAST(id % 17 AS DECIMAL(20,4)) AS debit_base", "CAST(id % 3 AS DECIMAL(20,4)) AS credit_base")
    for n in (1, 2):
        rows.limit(1500 * n).repartition(4).write.parquet(str(tmp_path / str(n)))
    few = B.account_running_balance(spark.read.parquet(str(tmp_path / "2")))
    monkeypatch.setattr(sweep, "TASK_BYTES", 1 << 10)
    half, many = (B.account_running_balance(spark.read.parquet(str(tmp_path / n))) for n in "12")
    assert not _tasks(few) and spark.sparkContext.defaultParallelism < _tasks(half)[0] < _tasks(many)[0]
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()


def test_duplicates_are_dealt_once_by_size(spark, monkeypatch, tmp_path):
    """one deal by key and range, its tasks grow with the files; a key of many rows is cut at ranges."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from kontor.operators import sequences as SQ
    spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 < 5 THEN 7 ELSE id END AS k", "IF(id % 3 = 0, NULL, id % 4) AS g",
        "IF(id % 13 = 0, NULL, id % 50) AS line_number").repartition(4).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    w = Window.partitionBy("k", "g")
    plain = rows.withColumn("dup_rank", F.row_number().over(w.orderBy("line_number", "id"))).withColumn("dup_count", F.count("*").over(w))
    monkeypatch.setattr(sweep, "TASK_BYTES", 1 << 10)
    for range_rows in (None, 40, 1_000_000):
        got = SQ.duplicate_rank(rows, ["k", "g"], ["line_number", "id"], range_rows)
        assert len(_tasks(got)) == 1 and _tasks(got)[0] > spark.sparkContext.defaultParallelism
        assert got.schema["dup_rank"].dataType.simpleString() == "int" and got.schema["dup_count"].dataType.simpleString() == "bigint"
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
