"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kontor.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: text '')."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")),
                  F.lit(modulus))


def hash_fraction(col, fraction: float):
    """True for about ``fraction`` of the distinct values of ``col``, the same ones on every run."""
    if fraction >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(col), 2) < F.lit(int(fraction * 2**62))


def map_rows(df: DataFrame, schema: str, judge) -> DataFrame:
    """``judge(batch)`` gives the columns of ``schema`` for one Arrow batch of ``df``.

    Ids pass through as Arrow arrays, so null and large ids survive.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def rows(batches):
        for batch in batches:
            columns = judge(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type, from_pandas=False)
                 for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(rows, schema)


def saved(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a folder of its own under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage like ``checkpoint()``, but as Parquet: a lost executor costs a
    re-read, not a recomputation, and the files are compressed. The folder is
    deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kontor-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (public splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_roots(n: int, left, right) -> np.ndarray:
    """Component label of each of ``n`` local nodes under the links ``left[i]``--``right[i]``.

    Labels are the smallest index of the component. Vectorised hooking with
    pointer jumping: each pass hooks the larger root of a link to the smaller.
    """
    root = np.arange(n)
    left, right = np.asarray(left, dtype=np.int64), np.asarray(right, dtype=np.int64)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(links: DataFrame, name: str, max_rounds: int = 200) -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(node, component)``, component = smallest node.

    Alternating large-star and small-star passes; every pass is a partially
    aggregated min per node and a join, so no node's neighbours are gathered
    in one place. Each pass is saved, and passes end when the set of links no
    longer changes. Nodes without links do not appear. ``max_rounds`` guards
    against endless runs and raises, it never truncates.
    """
    edges = (links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .distinct())
    edges = saved(edges, f"{name}-edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # every link now points from a larger node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        edges = saved(small, f"{name}-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
