"""Registered inventory queries: stock balances, moving-average cost, FIFO, valuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.operators import inventory as I
from kontor.operators import reports as R
from kontor.plans.catalog import L, register
from kontor.session import scratch_path, stored

# The fixture inserts moves day by day; within a day by id.
MOVE_ORDER = ["move_date", "id"]

_STOCK_SQL = """
SELECT product_id, location_id, CAST(SUM(delta) AS DECIMAL(20,6)) AS quantity,
       CAST(0 AS DECIMAL(20,6)) AS reserved_qty, CAST(SUM(delta) AS DECIMAL(20,6)) AS available_qty
FROM (SELECT product_id, from_location_id AS location_id, -quantity AS delta
      FROM stock_moves WHERE is_posted AND from_location_id IS NOT NULL
      UNION ALL
      SELECT product_id, to_location_id AS location_id, quantity AS delta
      FROM stock_moves WHERE is_posted AND to_location_id IS NOT NULL) legs
GROUP BY product_id, location_id
"""

# Moving-average replay as a recursive CTE stepping receipt k -> k+1 per
# product; cost held in integer 1e-4 units and rounded half away from zero.
_STEPS_SQL = """
mv AS (
  SELECT id, product_id, move_date, move_type, quantity, unit_cost, is_posted,
         CASE WHEN is_posted THEN (CASE WHEN to_location_id IS NOT NULL THEN quantity ELSE 0 END)
                                - (CASE WHEN from_location_id IS NOT NULL THEN quantity ELSE 0 END)
              ELSE 0 END AS delta
  FROM stock_moves),
qb AS (
  SELECT *, COALESCE(SUM(delta) OVER (PARTITION BY product_id ORDER BY move_date, id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qty_before
  FROM mv),
rc AS (
  SELECT product_id, id, unit_cost,
         row_number() OVER (PARTITION BY product_id ORDER BY move_date, id) AS k,
         CAST(CAST(qty_before AS DECIMAL(20,6)) * 1000000 AS HUGEINT) AS q_b,
         CAST(quantity * 1000000 AS HUGEINT) AS q_n,
         CAST(unit_cost * 10000 AS HUGEINT) AS c4
  FROM qb WHERE move_type = 'purchase_receipt' AND is_posted AND unit_cost > 0),
steps AS (
  SELECT p.id AS product_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS move_id,
         CAST(p.average_cost * 10000 AS HUGEINT) AS a4, CAST(NULL AS DECIMAL(20,4)) AS last_price
  FROM products p WHERE p.id IN (SELECT product_id FROM rc)
  UNION ALL
  SELECT s.product_id, s.k + 1, x.id,
         CASE WHEN x.q_b + x.q_n > 0 THEN
              sign(x.q_b * s.a4 + x.q_n * x.c4)
              * ((2 * abs(x.q_b * s.a4 + x.q_n * x.c4) + (x.q_b + x.q_n)) // (2 * (x.q_b + x.q_n)))
         ELSE x.c4 END,
         x.unit_cost
  FROM steps s JOIN rc x ON x.product_id = s.product_id AND x.k = s.k + 1),
costs AS (
  SELECT p.id AS product_id, p.sku, p.name, p.category_id,
         COALESCE(CAST(CAST(l.a4 AS DECIMAL(38,0)) * 0.0001 AS DECIMAL(20,4)), p.average_cost) AS average_cost,
         COALESCE(l.lp, p.last_purchase_price) AS last_purchase_price
  FROM products p
  LEFT JOIN (SELECT product_id, arg_max(a4, k) AS a4, arg_max(last_price, k) AS lp
             FROM steps WHERE k > 0 GROUP BY product_id) l ON l.product_id = p.id)
"""


@register("stock_quantities", ["stock_moves"], _STOCK_SQL)
def q_stock_quantities(spark, sf_dir):
    return I.apply_stock_moves(L(spark, sf_dir).stock_moves)


@register("stock_on_hand_total", ["stock_moves"], f"""
SELECT product_id, CAST(SUM(quantity) AS DECIMAL(30,6)) AS qty_on_hand FROM ({_STOCK_SQL}) sq GROUP BY product_id
""")
def q_stock_on_hand_total(spark, sf_dir):
    return I.stock_on_hand_total(I.apply_stock_moves(L(spark, sf_dir).stock_moves))


@register("moving_average_cost", ["stock_moves", "products"], "WITH RECURSIVE " + _STEPS_SQL + """
SELECT product_id, move_id, CAST(CAST(a4 AS DECIMAL(38,0)) * 0.0001 AS DECIMAL(20,4)) AS average_cost,
       last_price AS last_purchase_price
FROM steps WHERE k > 0
""")
def q_moving_average_cost(spark, sf_dir):
    lg = L(spark, sf_dir)
    return I.moving_average_cost(lg.stock_moves, lg.products, MOVE_ORDER)


@register("moving_average_cost_by_insertion", ["stock_moves", "products"],
          "WITH RECURSIVE " + _STEPS_SQL.replace("move_date, id", "id") + """
SELECT product_id, move_id, CAST(CAST(a4 AS DECIMAL(38,0)) * 0.0001 AS DECIMAL(20,4)) AS average_cost,
       last_price AS last_purchase_price
FROM steps WHERE k > 0
""")
def q_moving_average_cost_by_insertion(spark, sf_dir):
    """The cost trigger fires as rows are inserted: order of ids, whatever the move date."""
    lg = L(spark, sf_dir)
    return I.moving_average_cost(lg.stock_moves, lg.products)


@register("moving_average_cost_parallel", ["stock_moves", "products"],
          "WITH RECURSIVE " + _STEPS_SQL.replace("move_date, id", "id") + """
SELECT product_id, move_id, CAST(CAST(a4 AS DECIMAL(38,0)) * 0.0001 AS DECIMAL(20,4)) AS average_cost,
       last_price AS last_purchase_price
FROM steps WHERE k > 0
""")
def q_moving_average_cost_parallel(spark, sf_dir):
    """Segments cut at ranges of about four moves, folded side by side from starts that are repaired until exact."""
    lg = L(spark, sf_dir)
    return I.moving_average_cost(lg.stock_moves, lg.products, range_rows=4, parallel=True)


@register("moving_average_cost_replayed", ["stock_moves", "products"],
          "WITH RECURSIVE " + _STEPS_SQL.replace("move_date, id", "id") + """
SELECT product_id, move_id, CAST(CAST(a4 AS DECIMAL(38,0)) * 0.0001 AS DECIMAL(20,4)) AS average_cost,
       last_price AS last_purchase_price
FROM steps WHERE k > 0
""")
def q_moving_average_cost_replayed(spark, sf_dir):
    """The moves as a stream out of order, held for a while, corrected where they come too late."""
    from kontor.streaming import cost_log as CL
    lg = L(spark, sf_dir)
    files = scratch_path(spark, "move_files")
    shuffled = stored(lg.stock_moves.select(*CL.MOVE_COLUMNS).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3))), "moves")
    log = CL.CostLog(spark, scratch_path(spark, "cost_log"), lg.products, delay=1000)
    for i in range(3):  # a micro-batch takes all files that came since the one before
        shuffled.where(f"part = {i}").drop("part").write.mode("append").parquet(files)
        log.run(spark.readStream.schema(CL.MOVE_SCHEMA).parquet(files))
    log.flush()
    return log.latest()


@register("product_costs", ["stock_moves", "products"], "WITH RECURSIVE " + _STEPS_SQL + """
SELECT product_id AS id, average_cost, last_purchase_price FROM costs
""")
def q_product_costs(spark, sf_dir):
    lg = L(spark, sf_dir)
    return I.product_costs(lg.stock_moves, lg.products, MOVE_ORDER).select(
        "id", "average_cost", "last_purchase_price")


@register("inventory_valuation",
          ["stock_moves", "products", "warehouse_locations", "warehouses", "product_categories"],
          "WITH RECURSIVE " + _STEPS_SQL + """,
legs AS (
  SELECT product_id, unnest([from_location_id, to_location_id]) AS place, unnest([-quantity, quantity]) AS delta
  FROM stock_moves WHERE is_posted),
held AS (
  SELECT product_id, place, CAST(SUM(delta) AS DECIMAL(24,6)) AS qty FROM legs WHERE place IS NOT NULL
  GROUP BY product_id, place HAVING SUM(delta) <> 0)
SELECT held.product_id, costs.sku, costs.name AS product_name,
       (SELECT name FROM product_categories k WHERE k.id = costs.category_id) AS category_name,
       (SELECT h.name FROM warehouses h JOIN warehouse_locations x ON x.warehouse_id = h.id WHERE x.id = held.place)
           AS warehouse_name,
       (SELECT name FROM warehouse_locations x WHERE x.id = held.place) AS location_name,
       CAST(held.qty AS DECIMAL(20,6)) AS qty_on_hand, CAST(0 AS DECIMAL(20,6)) AS reserved_qty,
       CAST(held.qty AS DECIMAL(20,6)) AS available_qty, costs.average_cost,
       CAST(held.qty * CAST(costs.average_cost AS DECIMAL(14,4)) AS DECIMAL(38,10)) AS inventory_value
FROM held JOIN costs ON costs.product_id = held.product_id
""")
def q_inventory_valuation(spark, sf_dir):
    lg = L(spark, sf_dir)
    stock = I.apply_stock_moves(lg.stock_moves)
    products = I.product_costs(lg.stock_moves, lg.products, MOVE_ORDER)
    return R.inventory_valuation(stock, products, lg.warehouse_locations, lg.warehouses, lg.product_categories)


_FIFO_SQL = """
l2 AS (
  SELECT product_id, id AS stock_move_id, to_location_id AS location_id, move_date AS received_date,
         quantity AS original_qty, unit_cost,
         SUM(quantity) OVER (PARTITION BY product_id ORDER BY move_date, id ROWS UNBOUNDED PRECEDING) AS hi,
         SUM(quantity) OVER (PARTITION BY product_id ORDER BY move_date, id ROWS UNBOUNDED PRECEDING)
             - quantity AS lo
  FROM stock_moves WHERE is_posted AND move_type = 'purchase_receipt'),
ev AS (
  SELECT product_id, id, move_date, move_type, quantity,
         SUM(CASE WHEN move_type = 'purchase_receipt' THEN quantity ELSE 0 END)
             OVER (PARTITION BY product_id ORDER BY move_date, id ROWS UNBOUNDED PRECEDING) AS r_cum,
         SUM(CASE WHEN move_type = 'sale_delivery' THEN quantity ELSE 0 END)
             OVER (PARTITION BY product_id ORDER BY move_date, id ROWS UNBOUNDED PRECEDING) AS q_cum
  FROM stock_moves WHERE is_posted AND move_type IN ('purchase_receipt', 'sale_delivery')),
c1 AS (
  SELECT product_id, id AS issue_id, move_date, quantity,
         q_cum + least(MIN(r_cum - q_cum) OVER (PARTITION BY product_id ORDER BY move_date, id
                                               ROWS UNBOUNDED PRECEDING), 0) AS c_pos
  FROM ev WHERE move_type = 'sale_delivery'),
i2 AS (
  SELECT product_id, issue_id, quantity, c_pos AS hi,
         COALESCE(lag(c_pos) OVER (PARTITION BY product_id ORDER BY move_date, issue_id), 0) AS lo
  FROM c1),
alloc AS (
  SELECT i.product_id, i.issue_id, l.stock_move_id, least(i.hi, l.hi) - greatest(i.lo, l.lo) AS allocated,
         l.unit_cost
  FROM i2 i JOIN l2 l ON l.product_id = i.product_id AND l.lo < i.hi AND i.lo < l.hi
  UNION ALL
  SELECT product_id, issue_id, NULL, quantity - (hi - lo), NULL FROM i2 WHERE quantity > hi - lo)
"""


@register("fifo_cogs", ["stock_moves"], "WITH " + _FIFO_SQL + """
SELECT product_id, issue_id,
       CAST(SUM(CASE WHEN stock_move_id IS NOT NULL THEN allocated END) AS DECIMAL(30,6)) AS costed_qty,
       CAST(SUM(CASE WHEN stock_move_id IS NULL THEN allocated END) AS DECIMAL(30,6)) AS shortfall_qty,
       CAST(SUM(round(CAST(allocated AS DECIMAL(20,6)) * CAST(unit_cost AS DECIMAL(20,4)), 4))
            AS DECIMAL(30,4)) AS cogs
FROM alloc GROUP BY product_id, issue_id
""")
def q_fifo_cogs(spark, sf_dir):
    return I.fifo_cogs(L(spark, sf_dir).stock_moves, MOVE_ORDER)


@register("fifo_layers", ["stock_moves"], "WITH " + _FIFO_SQL + """
SELECT l.stock_move_id AS id, l.product_id, l.location_id, l.stock_move_id, l.received_date, l.original_qty,
       CAST(l.original_qty - COALESCE(u.used, 0) AS DECIMAL(20,6)) AS remaining_qty, l.unit_cost,
       CAST(round(CAST(l.original_qty - COALESCE(u.used, 0) AS DECIMAL(20,6)) * CAST(l.unit_cost AS DECIMAL(20,4)), 4)
            AS DECIMAL(20,4)) AS total_cost
FROM l2 l LEFT JOIN (SELECT stock_move_id, SUM(allocated) AS used FROM alloc
                     WHERE stock_move_id IS NOT NULL GROUP BY stock_move_id) u
  ON u.stock_move_id = l.stock_move_id
""")
def q_fifo_layers(spark, sf_dir):
    _, layers = I.fifo_layers_and_cogs(L(spark, sf_dir).stock_moves, MOVE_ORDER)
    return layers


@register("active_layers", ["stock_moves"], "WITH " + _FIFO_SQL + """
SELECT * FROM (
  SELECT l.stock_move_id AS id, l.product_id, l.location_id, l.stock_move_id, l.received_date, l.original_qty,
         CAST(l.original_qty - COALESCE(u.used, 0) AS DECIMAL(20,6)) AS remaining_qty, l.unit_cost,
         CAST(round(CAST(l.original_qty - COALESCE(u.used, 0) AS DECIMAL(20,6)) * CAST(l.unit_cost AS DECIMAL(20,4)), 4)
              AS DECIMAL(20,4)) AS total_cost
  FROM l2 l LEFT JOIN (SELECT stock_move_id, SUM(allocated) AS used FROM alloc
                       WHERE stock_move_id IS NOT NULL GROUP BY stock_move_id) u
    ON u.stock_move_id = l.stock_move_id) x
WHERE remaining_qty > 0
""")
def q_active_layers(spark, sf_dir):
    """The store of active layers carried over three batches of moves."""
    moves = stored(L(spark, sf_dir).stock_moves.select(
        "id", "product_id", "move_type", "move_date", "quantity", "unit_cost", "to_location_id", "is_posted"), "moves")
    first, last = moves.agg(F.min("move_date"), F.max("move_date")).first()
    third = (last - first) / 3
    active = I.empty_layers(spark)
    for lo, hi in ((first, first + third), (first + third, first + 2 * third), (first + 2 * third, None)):
        batch = moves.where(F.col("move_date") >= F.lit(lo)) if hi is None else moves.where(
            (F.col("move_date") >= F.lit(lo)) & (F.col("move_date") < F.lit(hi)))
        active = stored(I.consume_layers(active, batch, MOVE_ORDER)[1], "active_layers")
    return active


# Queue events per (product, location): the struct key takes the place of the product.
_PLACES_SQL = """
places AS (
  SELECT id, move_date, {'product_id': product_id, 'location_id': place} AS product_id, place AS to_location_id,
         kind AS move_type, quantity, unit_cost, is_posted
  FROM (SELECT *, to_location_id AS place, 'purchase_receipt' AS kind FROM stock_moves
        UNION ALL SELECT *, from_location_id, 'sale_delivery' FROM stock_moves) x
  WHERE place IS NOT NULL AND from_location_id IS DISTINCT FROM to_location_id),
"""
_FIFO_PLACES_SQL = "WITH " + _PLACES_SQL + _FIFO_SQL.replace("FROM stock_moves", "FROM places")


@register("fifo_cogs_by_location", ["stock_moves"], _FIFO_PLACES_SQL + """
SELECT product_id.product_id AS product_id, product_id.location_id AS location_id, issue_id,
       CAST(SUM(CASE WHEN stock_move_id IS NOT NULL THEN allocated END) AS DECIMAL(30,6)) AS costed_qty,
       CAST(SUM(CASE WHEN stock_move_id IS NULL THEN allocated END) AS DECIMAL(30,6)) AS shortfall_qty,
       CAST(SUM(round(CAST(allocated AS DECIMAL(20,6)) * CAST(unit_cost AS DECIMAL(20,4)), 4))
            AS DECIMAL(30,4)) AS cogs
FROM alloc GROUP BY ALL
""")
def q_fifo_cogs_by_location(spark, sf_dir):
    return I.fifo_by_location(L(spark, sf_dir).stock_moves, MOVE_ORDER)[0]


@register("fifo_layers_by_location", ["stock_moves"], _FIFO_PLACES_SQL + """
SELECT l.stock_move_id AS id, l.product_id.product_id AS product_id, l.product_id.location_id AS location_id,
       l.stock_move_id, l.received_date, l.original_qty,
       CAST(l.original_qty - COALESCE(u.used, 0) AS DECIMAL(20,6)) AS remaining_qty, l.unit_cost,
       CAST(round(CAST(l.original_qty - COALESCE(u.used, 0) AS DECIMAL(20,6)) * CAST(l.unit_cost AS DECIMAL(20,4)), 4)
            AS DECIMAL(20,4)) AS total_cost
FROM l2 l LEFT JOIN (SELECT stock_move_id, SUM(allocated) AS used FROM alloc
                     WHERE stock_move_id IS NOT NULL GROUP BY stock_move_id) u
  ON u.stock_move_id = l.stock_move_id
""")
def q_fifo_layers_by_location(spark, sf_dir):
    return I.fifo_by_location(L(spark, sf_dir).stock_moves, MOVE_ORDER)[1]


@register("move_type_matrix", ["stock_moves"], "SELECT product_id, " + ", ".join(
    f"CAST(COALESCE(SUM(CASE WHEN move_type = '{t}' THEN quantity END), 0) AS DECIMAL(30,6)) AS {t}"
    for t in ["purchase_receipt", "sale_delivery", "transfer", "adjustment", "return", "opening", "scrap",
              "production_in", "production_out"]) + " FROM stock_moves GROUP BY product_id")
def q_move_type_matrix(spark, sf_dir):
    return I.move_type_matrix(L(spark, sf_dir).stock_moves)


@register("reorder_report", ["stock_moves", "products"], f"""
WITH sq AS ({_STOCK_SQL}),
av AS (SELECT product_id, CAST(SUM(available_qty) AS DECIMAL(30,6)) AS available_qty FROM sq GROUP BY product_id),
j AS (
  SELECT p.company_id, p.id AS product_id, p.sku, COALESCE(av.available_qty, 0) AS available_qty,
         p.reorder_point, p.reorder_qty, p.min_stock, p.max_stock
  FROM products p LEFT JOIN av ON av.product_id = p.id
  WHERE p.is_tracked AND p.is_active)
SELECT company_id, product_id, sku, CAST(available_qty AS DECIMAL(30,6)) AS available_qty, reorder_point,
       reorder_qty AS suggested_qty, available_qty < min_stock AS below_min,
       max_stock IS NOT NULL AND available_qty > max_stock AS above_max,
       CAST(available_qty - reorder_point AS DECIMAL(31,6)) AS gap,
       CAST(rank() OVER (PARTITION BY company_id ORDER BY available_qty - reorder_point, product_id) AS INTEGER)
           AS shortage_rank
FROM j WHERE available_qty <= reorder_point
""")
def q_reorder_report(spark, sf_dir):
    lg = L(spark, sf_dir)
    return I.reorder_report(I.apply_stock_moves(lg.stock_moves), lg.products)


@register("inventory_total_value",
          ["stock_moves", "products", "warehouse_locations", "warehouses", "product_categories"],
          "WITH RECURSIVE " + _STEPS_SQL + ", " + """
val AS (SELECT sq.product_id, CAST(CAST(sq.quantity AS DECIMAL(24,6)) * CAST(c.average_cost AS DECIMAL(14,4))
                                AS DECIMAL(38,10)) AS inventory_value
        FROM (""" + _STOCK_SQL + """) sq
        JOIN costs c ON c.product_id = sq.product_id
        JOIN warehouse_locations wl ON wl.id = sq.location_id
        JOIN warehouses w ON w.id = wl.warehouse_id
        WHERE sq.quantity != 0)
SELECT CAST(SUM(val.inventory_value) AS DECIMAL(38,10)) AS total_value
FROM val WHERE val.product_id IN (SELECT id FROM products WHERE is_tracked)
""")
def q_inventory_total_value(spark, sf_dir):
    lg = L(spark, sf_dir)
    stock = I.apply_stock_moves(lg.stock_moves)
    products = I.product_costs(lg.stock_moves, lg.products, MOVE_ORDER)
    val = R.inventory_valuation(stock, products, lg.warehouse_locations, lg.warehouses, lg.product_categories)
    return I.inventory_total_value(val, lg.products)


@register("valuation_by_method", ["stock_moves", "products"], "WITH RECURSIVE " + _STEPS_SQL + ", " + _PLACES_SQL.strip()
          + _FIFO_SQL.replace("FROM stock_moves", "FROM places")
          + ", sq AS (" + _STOCK_SQL + """),
qp AS (SELECT product_id, SUM(quantity) AS q FROM sq GROUP BY product_id),
used AS (SELECT stock_move_id, SUM(allocated) AS used FROM alloc WHERE stock_move_id IS NOT NULL
         GROUP BY stock_move_id),
fv AS (SELECT l.product_id.product_id AS product_id,
              SUM(round(CAST(l.original_qty - COALESCE(u.used, 0) AS DECIMAL(20,6))
                        * CAST(l.unit_cost AS DECIMAL(20,4)), 4)) AS v
       FROM l2 l LEFT JOIN used u ON u.stock_move_id = l.stock_move_id GROUP BY ALL)
SELECT qp.product_id, p.valuation_method, CAST(qp.q AS DECIMAL(30,6)) AS qty_on_hand,
       CAST(round(CASE WHEN p.valuation_method = 'fifo' THEN CAST(COALESCE(fv.v, 0) AS DECIMAL(38,10))
                       WHEN p.valuation_method = 'standard_cost'
                            THEN CAST(qp.q AS DECIMAL(24,6)) * CAST(p.standard_cost AS DECIMAL(14,4))
                       ELSE CAST(qp.q AS DECIMAL(24,6)) * CAST(c.average_cost AS DECIMAL(14,4)) END, 4)
            AS DECIMAL(30,4)) AS inventory_value
FROM qp JOIN products p ON p.id = qp.product_id JOIN costs c ON c.product_id = qp.product_id
LEFT JOIN fv ON fv.product_id = qp.product_id
""")
def q_valuation_by_method(spark, sf_dir):
    lg = L(spark, sf_dir)
    moves = stored(lg.stock_moves.select(  # read by all three operators, several times by each
        "id", "product_id", "move_type", "move_date", "quantity", "unit_cost", "from_location_id", "to_location_id",
        "is_posted"), "moves")
    stock = I.apply_stock_moves(moves)
    products = I.product_costs(moves, lg.products, MOVE_ORDER)
    _, layers = I.fifo_by_location(moves, MOVE_ORDER)
    return I.valuation_by_method(stock, products, layers)
