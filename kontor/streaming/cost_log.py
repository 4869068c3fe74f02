"""Moving-average cost over a stream of moves that arrive out of order.

The cost rule follows insertion order, the order of ids. The id is the clock: a
move is held until no smaller id is expected, that is until the largest id seen
is ``delay`` beyond it (the watermark), and then applied in order of ids. A
move that comes later still is applied at its place, and the rows it changes
are emitted again as corrections, so nothing is dropped and the last row of
every move equals the batch result however the stream is cut into batches.

Every micro-batch is a few Spark jobs over tables in ``folder``, each with one
partition per micro-batch (``epoch=``) that a repeated batch overwrites:

* ``moves``: the moves as they arrived;
* ``state``: per product the last applied id, the stock and the cost after it;
* ``costs``: the emitted rows, ``kind`` is 'cost' or 'correction'.

Products without late moves start from their state, so a micro-batch reads the
held moves and the state but no history. Only products with late moves are
replayed from the log, from the first late id on. Products are independent and
the batch operator does the fold, so a micro-batch is as parallel as a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.operators import inventory as I
from kontor.streaming.ledger_streams import checkpoint_for

MOVE_COLUMNS = ["id", "product_id", "move_type", "quantity", "unit_cost", "is_posted", "from_location_id",
                "to_location_id"]
MOVE_SCHEMA = ("id BIGINT, product_id BIGINT, move_type STRING, quantity DECIMAL(20,6), unit_cost DECIMAL(20,4), "
               "is_posted BOOLEAN, from_location_id INT, to_location_id INT")
STATE_SCHEMA = "product_id BIGINT, last_id BIGINT, qty DECIMAL(30,6), cost DECIMAL(20,4)"
COST_SCHEMA = ("product_id BIGINT, move_id BIGINT, average_cost DECIMAL(20,4), last_purchase_price DECIMAL(20,4), "
               "kind STRING")
CLOCK_SCHEMA = "largest BIGINT, watermark BIGINT"
BEGIN, END = -(1 << 62), 1 << 62


class CostLog:
    """Costs of a stream of moves, kept in ``folder``; ``products`` has their starting costs."""

    def __init__(self, spark: SparkSession, folder: str, products: DataFrame, delay: int = 0):
        self.spark, self.folder, self.delay = spark, folder.rstrip("/"), delay
        self.products = products.select(F.col("id").alias("product_id"), F.col("average_cost").alias("start_cost"))

    # ------------------------------------------------------------ tables

    def _path(self, name: str, epoch: int | None = None) -> str:
        return f"{self.folder}/{name}" + ("" if epoch is None else f"/epoch={epoch}")

    def _epochs(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(name))
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        # a partition counts once its job has committed
        return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(path)
                      if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def _table(self, name: str, schema: str, before: int) -> DataFrame:
        """The rows of all epochs before ``before``, with their epoch."""
        epochs = [e for e in self._epochs(name) if e < before]
        if not epochs:
            return self.spark.createDataFrame([], schema + ", epoch INT")
        return (self.spark.read.schema(schema + ", epoch INT").option("basePath", self._path(name))
                .parquet(*[self._path(name, e) for e in epochs]))

    def _write(self, frame: DataFrame, name: str, epoch: int) -> None:
        frame.write.mode("overwrite").parquet(self._path(name, epoch))

    def _clock(self, before: int) -> tuple[int, int]:
        """(largest id seen, watermark) after the last epoch before ``before``."""
        epochs = [e for e in self._epochs("clock") if e < before]
        if not epochs:
            return BEGIN, BEGIN
        row = self.spark.read.schema(CLOCK_SCHEMA).parquet(self._path("clock", epochs[-1])).first()
        return row["largest"], row["watermark"]

    # ------------------------------------------------------------ micro-batches

    def apply(self, batch: DataFrame, epoch: int, flush: bool = False) -> None:
        """One micro-batch; the function for ``foreachBatch``. Running it again replaces what it wrote."""
        self._write(batch.select(*MOVE_COLUMNS), "moves", epoch)
        largest, passed = self._clock(epoch)
        seen = self.spark.read.schema(MOVE_SCHEMA).parquet(self._path("moves", epoch)).agg(F.max("id")).first()[0]
        largest = max(largest, BEGIN if seen is None else seen)
        watermark = END if flush else max(passed, largest - self.delay)
        moves = self._table("moves", MOVE_SCHEMA, epoch + 1).where(F.col("id") <= watermark)
        # applied now: what was held until the watermark passed it, and what came after that
        due = moves.where((F.col("id") > passed) | (F.col("epoch") == epoch))
        state = self._state(epoch)
        first = (due.groupBy("product_id").agg(F.min("id").alias("first_id"))
                 .join(state, "product_id", "left").join(self.products, "product_id", "left")
                 .withColumn("late", F.coalesce(F.col("first_id") <= F.col("last_id"), F.lit(False))))
        first = self._kept(first, "first", epoch)
        starts = self._kept(self._starts(first, moves, epoch), "starts", epoch)
        # products without late moves take the due moves only, the others all from the first late one on
        late = first.where("late").select("product_id", "first_id")
        replay = (due.join(late, "product_id", "left_anti").select(*MOVE_COLUMNS)
                  .unionByName(moves.join(late, "product_id").where("id >= first_id").select(*MOVE_COLUMNS)))
        opening = starts.select(F.lit(None).cast("bigint").alias("id"), "product_id", F.lit("opening").alias("move_type"),
                                F.col("qty").alias("quantity"), F.lit(0).cast("DECIMAL(20,4)").alias("unit_cost"),
                                F.lit(True).alias("is_posted"), F.lit(None).cast("int").alias("from_location_id"),
                                F.lit(1).alias("to_location_id"), F.lit(0).alias("_after"))
        queue = self._kept(replay.withColumn("_after", F.lit(1)).unionByName(opening), "queue", epoch)
        steps = self._kept(I.moving_average_cost(
            queue, starts.select(F.col("product_id").alias("id"), F.col("cost").alias("average_cost")),
            ["_after", "id"]), "steps", epoch)
        self._write(self._news(steps, late, epoch), "costs", epoch)
        self._write(self._next_state(state, starts, queue, steps), "state", epoch)
        self._write(self.spark.createDataFrame([(largest, watermark)], CLOCK_SCHEMA).coalesce(1), "clock", epoch)

    def _kept(self, frame: DataFrame, name: str, epoch: int) -> DataFrame:
        """An intermediate table of a micro-batch, written so that later steps do not derive it again."""
        self._write(frame, f"work_{name}", epoch)
        return self.spark.read.schema(frame.schema).parquet(self._path(f"work_{name}", epoch))

    def _state(self, epoch: int) -> DataFrame:
        epochs = [e for e in self._epochs("state") if e < epoch]
        if not epochs:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(self._path("state", epochs[-1]))

    def _starts(self, first: DataFrame, moves: DataFrame, epoch: int) -> DataFrame:
        """(product_id, qty, cost) before the first move that is applied now."""
        zero = F.lit(0).cast("DECIMAL(30,6)")
        start = F.coalesce("start_cost", F.lit(0).cast("DECIMAL(20,4)"))
        ahead = first.where("NOT late").select("product_id", F.coalesce("qty", zero).alias("qty"),
                                               F.coalesce(F.col("cost"), start).alias("cost"))
        late = first.where("late").select("product_id", "first_id", start.alias("start"))
        stock = (I._stock_delta(moves.join(late, "product_id").where("id < first_id"))
                 .groupBy("product_id").agg(F.sum("_delta").alias("qty")))
        costs = (self._table("costs", COST_SCHEMA, epoch).join(late, "product_id").where("move_id < first_id")
                 .groupBy("product_id").agg(F.max_by("average_cost", F.struct("move_id", "epoch")).alias("cost")))
        back = late.join(stock, "product_id", "left").join(costs, "product_id", "left").select(
            "product_id", F.coalesce("qty", zero).cast("DECIMAL(30,6)").alias("qty"),
            F.coalesce("cost", "start").alias("cost"))
        return ahead.unionByName(back)

    def _news(self, steps: DataFrame, late: DataFrame, epoch: int) -> DataFrame:
        """Rows to emit: costs of moves not seen before, and corrections where a replayed cost has changed."""
        known = (self._table("costs", COST_SCHEMA, epoch).join(late.select("product_id"), "product_id", "left_semi")
                 .groupBy("product_id", "move_id").agg(F.max_by("average_cost", "epoch").alias("_known")))
        return (steps.join(known, ["product_id", "move_id"], "left")
                .where("_known IS NULL OR _known <> average_cost")
                .select("product_id", "move_id", "average_cost", "last_purchase_price",
                        F.when(F.col("_known").isNull(), "cost").otherwise("correction").alias("kind")))

    def _next_state(self, state: DataFrame, starts: DataFrame, queue: DataFrame, steps: DataFrame) -> DataFrame:
        stock = I._stock_delta(queue).groupBy("product_id").agg(
            F.sum("_delta").cast("DECIMAL(30,6)").alias("qty"), F.max("id").alias("last_id"))
        cost = steps.groupBy("product_id").agg(F.max_by("average_cost", "move_id").alias("_last"))
        now = (starts.drop("qty").join(stock, "product_id").join(cost, "product_id", "left")
               .select("product_id", "last_id", "qty", F.coalesce("_last", "cost").alias("cost")))
        return now.unionByName(state.join(now.select("product_id"), "product_id", "left_anti").select(*now.columns))

    # ------------------------------------------------------------ use

    def run(self, moves: DataFrame, checkpoint: str | None = None) -> None:
        """Apply all that a stream of moves has now, micro-batch by micro-batch."""
        checkpoint = checkpoint or checkpoint_for(self.spark, "cost_log_" + self.folder.split("/")[-2])
        query = (moves.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    def flush(self) -> None:
        """Apply the moves still held, as an epoch of its own; the stream has ended."""
        epochs = self._epochs("moves")
        self.apply(self.spark.createDataFrame([], MOVE_SCHEMA), epochs[-1] + 1 if epochs else 0, flush=True)

    def emitted(self) -> DataFrame:
        return self._table("costs", COST_SCHEMA, END)

    def latest(self) -> DataFrame:
        """The last row of every receipt."""
        return (self.emitted().groupBy("product_id", "move_id")
                .agg(F.max_by(F.struct("average_cost", "last_purchase_price"), "epoch").alias("r"))
                .select("product_id", "move_id", "r.*"))
