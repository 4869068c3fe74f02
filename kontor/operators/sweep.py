"""Ordered-state building blocks: skew-safe running aggregates and interval allocation.

Running balances, the stock level before each move and FIFO queues are all
prefix aggregates over an ordered key. A plain window partitioned by the key
puts a hot key (one product, one bank account holding a third of the rows)
into a single task. ``running`` splits the work in two phases: totals per
(key, bucket) come from a partial aggregation, their prefix per key is a
small window over bucket totals, and the in-bucket prefix runs partitioned
by (key, bucket). A hot key is spread over as many tasks as it has buckets;
the bucket must be monotone in the ordering (the leading sort key, e.g. a
date).

Without a natural bucket the rows of a key are cut at sampled quantiles of
their own order (``ranged``): a hashed sample of the rows, so every range
holds about the same number of rows whatever the values look like (dense
ids, 60-bit hashes, one busy day), and the same cuts come out of every
evaluation of the plan. A key of fewer rows than a range has no cut, and its
range is NULL. Cuts are at most rows / range_rows, a proven bound, so they are
broadcast, and so are the totals of the ranges, unless the ranges are small
(``SMALL_RANGE``) and the cuts therefore many. It is one plan for all keys:
without a cut the broadcast is empty and adaptive execution drops the second
phase.

``interval_allocate`` matches two ordered queues per key (receipt layers
against issues, payments against invoices) without a range join and without
a per-key global window. Both queues become cumulative intervals on one
quantity axis; the distinct end points cut the axis into segments. The
supply item covering a segment is ``1 + (number of supply ends before the
segment end)`` in queue order, likewise for demand, so every segment is
assigned by running counts, over ranges of the axis, and an equi-join on
(key, rank). No pair that does not overlap is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.session import stored

RANGE = "_range"         # number of the row's range among its key's rows, NULL where the key has one
SPLIT = "_split"         # whether the key has several ranges
RANGE_ROWS = 1_000_000   # rows per range: what one task sorts of a hot key
SAMPLED = 64             # sampled rows per range
SMALL_RANGE = 10_000     # ranges of fewer rows have too many cuts to broadcast them
TASK_BYTES = 8 << 20     # bytes of input files per task of a window (about 500,000 line items)

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def same_keys(left: list[str], right: list[str]):
    """Equal keys; null keys are a group like any other."""
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def dealt(df: DataFrame, cols: list[str], parts: int = 1) -> DataFrame:
    """``df`` dealt by ``cols`` over a number of tasks that grows with the files it is made of, ``parts`` for ``TASK_BYTES``.

    Adaptive execution sizes tasks by compressed shuffle bytes, which say
    little of the rows a window sorts. Files read more than once count once.
    Files of a few tasks' size, and frames whose size is not known, are left to it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = {leaf.semanticHash(): int(str(leaf.stats().sizeInBytes()))
             for leaf in (leaves.apply(i) for i in range(leaves.size()))}
    tasks = -(-parts * sum(sizes.values()) // TASK_BYTES)
    few = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *cols) if few < tasks < 1 << 20 else df


def range_cuts(df: DataFrame, keys: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """(_c_<key>..., _cuts): for each key of more than about ``range_rows`` rows, the sorted first rows of its
    ranges but the first one.

    Rows are sampled by a hash of key and order, ``SAMPLED`` for each range, so
    the cuts are quantiles weighted by rows and the same on every evaluation.
    """
    per = max(min(SAMPLED, range_rows), 1)
    rate = max(range_rows // per, 1)
    sample = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(rate)) == 0)
    cuts = F.filter(F.sort_array(F.collect_list(F.struct(*order))), lambda _, i: (i > 0) & (i % per == 0))
    return (sample.groupBy(*[F.col(k).alias(f"_c_{k}") for k in keys]).agg(cuts.alias("_cuts"))
            .where(F.size("_cuts") > 0))


def _range_of(order: list[str]):
    """Number of cuts at or before the row, by binary search; NULL without cuts."""
    me = f"struct({', '.join(order)})"
    return F.expr(f"""CASE WHEN _cuts IS NOT NULL THEN aggregate(
        sequence(1, cast(ceil(log2(size(_cuts) + 1)) AS int)), named_struct('lo', 0, 'hi', size(_cuts)),
        (s, i) -> IF(s.lo >= s.hi, s, IF(_cuts[cast((s.lo + s.hi) div 2 AS int)] <= {me},
            named_struct('lo', cast((s.lo + s.hi) div 2 AS int) + 1, 'hi', s.hi),
            named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 AS int)))), s -> s.lo) END""")


def ranged(df: DataFrame, keys: list[str], order: list[str], range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """``df`` with the columns ``_range`` and ``_split``, see module doc; the range is monotone in ``order``.

    ``range_rows`` None gives every key one range.
    """
    if range_rows is None:
        return df.select("*", F.lit(None).cast("int").alias(RANGE), F.lit(False).alias(SPLIT))
    return _cut(df, keys, order, range_cuts(df, keys, order, range_rows), range_rows)


def _per_range(df: DataFrame, range_rows: int | None) -> DataFrame:
    """``df``, rows / range_rows rows in all, to be broadcast unless the ranges are small."""
    return df if range_rows is not None and range_rows < SMALL_RANGE else F.broadcast(df)


def _cut(df: DataFrame, keys: list[str], order: list[str], cuts: DataFrame, range_rows: int | None = None) -> DataFrame:
    """``df`` with ``_range`` by the sorted ``cuts`` of each key."""
    return (df.join(_per_range(cuts, range_rows), same_keys(keys, [f"_c_{k}" for k in keys]), "left")
            .select(*df.columns, _range_of(order).alias(RANGE), F.col("_cuts").isNotNull().alias(SPLIT)))


def _offsets(df: DataFrame, keys: list[str], specs: list[tuple[str, str, str]], bucket: str) -> DataFrame:
    """(_k_<key>..., _k_<bucket>, _o_<out>...): the aggregates of all earlier buckets of the key."""
    part = keys + [bucket]
    # the test of the joined column makes it an inner join, which an empty table of cuts empties
    split = df.where(SPLIT) if bucket == RANGE else df
    totals = split.groupBy(*part).agg(*[_AGG[fn](F.col(v)).alias(f"_t_{out}") for out, v, fn in specs])
    wb = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*[F.col(k).alias(f"_k_{k}") for k in part],
                         *[_AGG[fn](F.col(f"_t_{out}")).over(wb).alias(f"_o_{out}") for out, _, fn in specs])


def running(df: DataFrame, keys: list[str], order: list[str], specs: list[tuple[str, str, str]],
            bucket: str | None = None, exclusive: bool = False, range_rows: int | None = None,
            deal: bool = False) -> DataFrame:
    """Add running aggregates: ``specs`` = [(out, value column, 'sum'|'min'|'max')].

    Inclusive (rows up to this one) or ``exclusive`` (rows before it; NULL
    when there are none). With ``bucket``: two phases, see module doc; ``RANGE``
    takes the ranges that ``ranged`` gave to ``df``, whose totals are broadcast
    unless ``range_rows`` says that the ranges are small. Rows of other buckets
    are dealt over tasks by the size of their files (``dealt``), those of
    ranges with ``deal``.
    """
    end = -1 if exclusive else Window.currentRow
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[_AGG[fn](F.col(v)).over(w).alias(out) for out, v, fn in specs])
    part = keys + [bucket]
    offsets = _offsets(df, keys, specs, bucket)
    if bucket == RANGE:
        offsets = _per_range(offsets, range_rows)  # one row a range
    joined = df.join(offsets, same_keys(part, [f"_k_{k}" for k in part]), "left")
    if deal or bucket != RANGE:
        joined = dealt(joined, part)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    cols = []
    for out, v, fn in specs:
        inb, off = _AGG[fn](F.col(v)).over(w), F.col(f"_o_{out}")
        if fn == "sum":
            val = F.when(inb.isNull() & off.isNull(), F.lit(None)).otherwise(
                F.coalesce(inb, F.lit(0)) + F.coalesce(off, F.lit(0)))
        elif fn == "min":
            val = F.least(inb, off)
        else:
            val = F.greatest(inb, off)
        cols.append(val.alias(out) if fn == "sum" else val.cast(df.schema[v].dataType).alias(out))
    return joined.select(*df.columns, *cols)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                bucket: str | None = None, exclusive: bool = False, range_rows: int | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over rows up to this one (ROWS frame); exclusive
    gives the sum over earlier rows (0 for the first)."""
    if not exclusive:
        return running(df, keys, order, [(out, value, "sum")], bucket, range_rows=range_rows)
    r = running(df, keys, order, [(out, value, "sum")], bucket, range_rows=range_rows)
    return r.withColumn(out, F.col(out) - F.col(value))


def interval_allocate(supply: DataFrame, demand: DataFrame, keys: list[str],
                      supply_order: list[str], demand_order: list[str],
                      supply_qty: str, demand_qty: str,
                      supply_id: str, demand_id: str, range_rows: int | None = RANGE_ROWS,
                      supply_with: list[str] = (), demand_with: list[str] = ()) -> DataFrame:
    """Allocate ordered demand to ordered supply per key (FIFO matching).

    Returns one row per overlapping (supply_id, demand_id) with ``allocated``
    and the columns ``supply_with`` and ``demand_with``, which must follow from
    the ids; demand beyond the total supply comes back with a NULL ``supply_id``
    (shortfall); supply never consumed does not appear. Quantities must be
    non-negative. Both queues, which several steps read, are written once under
    the checkpoint folder, unless they have the column ``_range`` already. Keys
    of a queue of more than ``range_rows`` rows are matched over ranges
    (``match_intervals``), all others where their rows meet.
    """
    s, d = supply, demand
    if RANGE not in s.columns:
        s = stored(s.select(*dict.fromkeys([*keys, *supply_order, supply_qty, supply_id, *supply_with])), "supply_rows")
        s = ranged(s, keys, supply_order, range_rows)
    if RANGE not in d.columns:
        d = stored(d.select(*dict.fromkeys([*keys, *demand_order, demand_qty, demand_id, *demand_with])), "demand_rows")
        d = ranged(d, keys, demand_order, range_rows)
    one = F.lit(1).cast("bigint")

    def places(s, d):
        return (running(s.withColumn("_one", one), keys, supply_order,
                        [("_end", supply_qty, "sum"), ("_rank", "_one", "sum")], RANGE),
                running(d.withColumn("_one", one), keys, demand_order,
                        [("_end", demand_qty, "sum"), ("_rank", "_one", "sum")], RANGE))

    qtype = places(s, d)[0].schema["_end"].dataType
    known = [F.col(k).isNotNull() for k in keys]  # a null key matches nothing
    for c in known:
        s, d = s.where(c), d.where(c)
    queues = (supply_order, demand_order, supply_qty, demand_qty, supply_id, demand_id, list(supply_with), list(demand_with))
    hot = s.where(SPLIT).select(*keys).unionByName(d.where(SPLIT).select(*keys)).distinct()
    hot = stored(hot, "hot_keys")
    if hot.isEmpty():
        return _match_whole(s, d, keys, *queues, qtype)
    hot = _per_range(hot, range_rows)
    cold = _match_whole(s.join(hot, keys, "left_anti"), d.join(hot, keys, "left_anti"), keys, *queues, qtype)
    s, d = places(s.join(hot, keys, "left_semi"), d.join(hot, keys, "left_semi"))
    own = [*keys, "_end", "_rank", RANGE, SPLIT]
    s = stored(s.select(*dict.fromkeys([*own, supply_id, *supply_with])), "supply")
    d = stored(d.select(*dict.fromkeys([*own, demand_id, *demand_with])), "demand")
    return cold.unionByName(match_intervals(s, d, keys, supply_id, demand_id, supply_with, demand_with))


def _match_whole(s: DataFrame, d: DataFrame, keys: list[str], supply_order: list[str], demand_order: list[str],
                 supply_qty: str, demand_qty: str, supply_id: str, demand_id: str,
                 supply_with: list[str], demand_with: list[str], qtype) -> DataFrame:
    """Overlaps of two queues whose rows of a key are few enough for one task; their rows are shuffled once.

    The segment that ends at an item's end is covered by the next item of
    either queue at or after it: the last one seen from the far end.
    """
    sides = [(s, supply_order, supply_qty, supply_id, supply_with), (d, demand_order, demand_qty, demand_id, demand_with)]
    named = [{c: f"_{j}_{k}" for k, c in enumerate(dict.fromkeys([*order, item, *extra]))}
             for j, (_, order, _, item, extra) in enumerate(sides)]
    both = [q.select(*keys, F.lit(i == 0).alias("_is_s"), F.col(qty).alias("_qty"),
                     *[(F.col(c) if i == j else F.lit(None).cast(sides[j][0].schema[c].dataType)).alias(name)
                       for j in (0, 1) for c, name in named[j].items()])
            for i, (q, _, qty, _, _) in enumerate(sides)]
    both = both[0].unionByName(both[1])
    rows = dealt(both, keys, 2)  # written rows are dense, and sorted twice
    rows = both.repartition(*keys) if rows is both else rows
    places = [named[j][c] for j in (0, 1) for c in sides[j][1]]
    w = Window.partitionBy(*keys, "_is_s").orderBy(*places).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.sum("_qty").over(w).cast(qtype).alias("_end"), F.count(F.lit(1)).over(w).alias("_rank"))
    items = [F.struct(*[F.col(named[j][c]).alias(c) for c in dict.fromkeys([sides[j][3], *sides[j][4]])]) for j in (0, 1)]
    back = Window.partitionBy(*keys).orderBy(F.col("_end").desc(), F.col("_rank").desc())
    seen = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seg = rows.select(
        *keys, (F.col("_end") - F.coalesce(F.lead("_end").over(back), F.lit(0).cast(qtype))).alias("_len"),
        F.last(F.when(F.col("_is_s"), items[0]), ignorenulls=True).over(seen).alias("_s"),
        F.last(F.when(~F.col("_is_s"), items[1]), ignorenulls=True).over(seen).alias("_d"))
    return _overlaps(seg.where((F.col("_len") > 0) & F.col("_d").isNotNull())
                     .select(*keys, "_len", "_s.*", "_d.*"), keys, supply_id, demand_id, supply_with, demand_with)


def _overlaps(seg: DataFrame, keys: list[str], supply_id: str, demand_id: str, supply_with, demand_with) -> DataFrame:
    """What the segments of every pair of items come to."""
    own = [c for c in dict.fromkeys([*supply_with, *demand_with]) if c not in (*keys, supply_id, demand_id)]
    return seg.groupBy(*keys, supply_id, demand_id).agg(F.sum("_len").alias("allocated"), *[F.first(c).alias(c) for c in own])


def match_intervals(s: DataFrame, d: DataFrame, keys: list[str], supply_id: str, demand_id: str,
                    supply_with: list[str] = (), demand_with: list[str] = ()) -> DataFrame:
    """Overlaps of two queues whose items end at ``_end`` on the axis of their key and are numbered by ``_rank``.

    Both have the columns of ``ranged``. The axis is cut where the ranges of
    either queue end, so no piece holds more points than two ranges.
    """
    qtype = s.schema["_end"].dataType
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    pts = (s.select(*keys, F.col("_end").alias("_pt"), one.alias("_is_s"), none.alias("_is_d"))
           .unionByName(d.select(*keys, F.col("_end").cast(qtype).alias("_pt"), none.alias("_is_s"), one.alias("_is_d"))))
    # Explicit shuffle on (key, point): the union's children are both hash-partitioned
    # by key, and with spark.sql.unionOutputPartitioning the union would claim that
    # partitioning while holding the partitions of both children.
    per_pt = (pts.repartition(*keys, "_pt")
              .groupBy(*keys, "_pt").agg(F.sum("_is_s").alias("_ns"), F.sum("_is_d").alias("_nd")))
    ends = [q.where(SPLIT).groupBy(*keys, RANGE).agg(F.max(F.col("_end").cast(qtype)).alias("_pt")).drop(RANGE)
            for q in (s, d)]
    cuts = (ends[0].unionByName(ends[1]).groupBy(*[F.col(k).alias(f"_c_{k}") for k in keys])
            .agg(F.array_sort(F.collect_set(F.struct("_pt"))).alias("_cuts")))
    per_pt = _cut(per_pt, keys, ["_pt"], cuts)
    per_pt = running(per_pt, keys, ["_pt"], [("_s_before", "_ns", "sum"), ("_d_before", "_nd", "sum"),
                                             ("_prev", "_pt", "max")], RANGE, exclusive=True)
    seg = (per_pt.withColumn("_len", F.col("_pt") - F.coalesce(F.col("_prev"), F.lit(0).cast(qtype)))
           .filter(F.col("_len") > 0)
           .select(*keys, "_len", (F.coalesce("_s_before", F.lit(0)) + 1).alias("_srank"),
                   (F.coalesce("_d_before", F.lit(0)) + 1).alias("_drank")))
    s_ids = s.select(*keys, F.col("_rank").alias("_srank"), supply_id, *supply_with)
    d_ids = d.select(*keys, F.col("_rank").alias("_drank"), demand_id, *demand_with)
    j = seg.join(d_ids, keys + ["_drank"]).join(s_ids, keys + ["_srank"], "left")
    return _overlaps(j, keys, supply_id, demand_id, supply_with, demand_with)
