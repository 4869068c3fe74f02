"""SparkSession construction and shared-storage helpers.

The library never creates a session behind the caller's back; ``build_session``
is a convenience for tests, the bench and command-line use. On a cluster the
caller passes its own session, and every helper here reads the settings that
session already carries (``spark.checkpoint.dir`` above all).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. ANSI stays on (overflow and divide-by-zero
# raise, as PostgreSQL does); the session zone is pinned so DATE casts of
# timestamps are stable; AQE coalesces small shuffles and splits skewed joins.
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # A union of children with equal hash partitioning must not claim that
    # partitioning: it holds the partitions of all children.
    "spark.sql.unionOutputPartitioning": "false",
}

COMPACT = {"compression": "zstd"}  # of intermediate files


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "kontor", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder (HDFS / object store) there and we use it
    as is. Without the setting a local session gets a scratch folder of its
    own; a cluster raises, as its executors would write to their own disks.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="kontor-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a plan would otherwise re-run a long lineage after an executor
    loss (iterative jobs). Never a local checkpoint: those die with executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for an intermediate table under the shared checkpoint folder; deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kontor-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder.getParent())
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage as ``cut_lineage`` does, and size estimates with it: a
    checkpointed frame keeps the estimate of its plan, which joins multiply, so
    loops of joins use this. Such files are written with ``COMPACT``, which
    takes about 0.6 of the default codec's bytes on ledger rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**COMPACT).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``stored``, in ``buckets`` by ``key``: tables with as many buckets are joined, grouped and windowed by their
    keys without a shuffle. ``df`` is best dealt by ``key`` over as many tasks, for one file a bucket."""
    spark, table = df.sparkSession, f"kontor_{uuid.uuid4().hex}"
    (df.write.options(**COMPACT, path=scratch_path(spark, name)).format("parquet")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external one: only the name goes, the files stay
    return out


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that they need no installation of it."""
    folder = tempfile.mkdtemp(prefix="kontor-pkg-")
    here = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(os.path.join(folder, "kontor.zip"), "w") as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("kontor", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(os.path.join(folder, "kontor.zip"))
