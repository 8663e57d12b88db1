"""Registered queries for inventory and costing (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import costing
from .registry import query

_SALES_SQL = """sales AS (SELECT management_id AS sale_id, product_id, movement_date AS sale_date, quantity,
                  unit_cost_cents AS unit_price_cents FROM movements WHERE action_type = 'Sale')"""


def _sales(b):
    return b.movements.where(F.col("action_type") == "Sale").select(
        F.col("management_id").alias("sale_id"), "product_id", F.col("movement_date").alias("sale_date"),
        "quantity", F.col("unit_cost_cents").alias("unit_price_cents"))


def _alloc_sql(order: str) -> str:
    return f"""WITH {_SALES_SQL},
s AS (SELECT sale_id, product_id, quantity,
             SUM(quantity) OVER (PARTITION BY product_id ORDER BY sale_date, sale_id ROWS UNBOUNDED PRECEDING) AS d_hi
      FROM sales WHERE quantity > 0),
l AS (SELECT operation_id, product_id, unit_cost_cents, quantity,
             SUM(quantity) OVER (PARTITION BY product_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS s_hi
      FROM layers WHERE quantity > 0),
alloc AS (SELECT s.sale_id, s.product_id, l.operation_id,
                 CAST(LEAST(s.d_hi, l.s_hi) - GREATEST(s.d_hi - s.quantity, l.s_hi - l.quantity) AS BIGINT) AS units,
                 l.unit_cost_cents
          FROM s JOIN l ON s.product_id = l.product_id AND l.s_hi - l.quantity < s.d_hi AND s.d_hi - s.quantity < l.s_hi)"""


_FIFO = "purchase_date, operation_id"
_LIFO = "purchase_date DESC, operation_id DESC"


@query("allocate_layers_fifo", "I1", views=["movements", "layers"], oracle=_alloc_sql(_FIFO) + "\nSELECT * FROM alloc")
def _alloc_fifo(b):
    return costing.allocate_layers(_sales(b), b.layers, "fifo").drop("sale_units")


@query("allocate_layers_lifo", "I1", views=["movements", "layers"], oracle=_alloc_sql(_LIFO) + "\nSELECT * FROM alloc")
def _alloc_lifo(b):
    return costing.allocate_layers(_sales(b), b.layers, "lifo").drop("sale_units")


_AVG_SQL = """SELECT product_id, CAST(SUM(quantity * unit_cost_cents) AS BIGINT) AS total_cost_cents,
       CAST(SUM(quantity) AS BIGINT) AS total_quantity,
       CAST(SUM(quantity * unit_cost_cents) AS DOUBLE) / CAST(NULLIF(SUM(quantity), 0) AS DOUBLE) AS avg_cost_cents
FROM layers WHERE quantity > 0 GROUP BY product_id"""


@query("average_cost", "I2", views=["layers"], oracle=_AVG_SQL)
def _average_cost(b):
    return costing.average_cost(b.layers)


def _cos_sql(order: str, method: str) -> str:
    if method == "avco":
        cogs = ("CASE WHEN COALESCE(a.units, 0) = 0 THEN 0.0 ELSE CAST(COALESCE(a.units, 0) * v.total_cost_cents AS DOUBLE) "
                "/ CAST(v.total_quantity * 100 AS DOUBLE) END")
        margin = f"CAST(CAST(COALESCE(a.units, 0) * s.unit_price_cents / 100.0 AS DECIMAL(18,2)) AS DOUBLE) - ({cogs})"
        join = f"LEFT JOIN ({_AVG_SQL}) v ON s.product_id = v.product_id"
    else:
        cogs = "CAST(COALESCE(a.layer_cost_cents, 0) / 100.0 AS DECIMAL(18,2))"
        margin = f"CAST((COALESCE(a.units, 0) * s.unit_price_cents - COALESCE(a.layer_cost_cents, 0)) / 100.0 AS DECIMAL(18,2))"
        join = ""
    return _alloc_sql(order) + f"""
SELECT s.sale_id, s.product_id, s.quantity AS demanded, CAST(COALESCE(a.units, 0) AS BIGINT) AS allocated,
       s.quantity - CAST(COALESCE(a.units, 0) AS BIGINT) AS shortage,
       {cogs} AS cogs,
       CAST(COALESCE(a.units, 0) * s.unit_price_cents / 100.0 AS DECIMAL(18,2)) AS revenue,
       {margin} AS margin
FROM sales s LEFT JOIN (SELECT sale_id, SUM(units) AS units, SUM(units * unit_cost_cents) AS layer_cost_cents
                        FROM alloc GROUP BY sale_id) a ON s.sale_id = a.sale_id
{join}"""


_COS_MONEY = ["cogs", "revenue", "margin"]


@query("cost_of_sales_fifo", "I3", views=["movements", "layers"], money=_COS_MONEY, oracle=_cos_sql(_FIFO, "fifo"))
def _cos_fifo(b):
    return costing.cost_of_sales(_sales(b), b.layers, "fifo")


@query("cost_of_sales_lifo", "I3", views=["movements", "layers"], money=_COS_MONEY, oracle=_cos_sql(_LIFO, "lifo"))
def _cos_lifo(b):
    return costing.cost_of_sales(_sales(b), b.layers, "lifo")


@query("cost_of_sales_avco", "I3", views=["movements", "layers"], money=["revenue"], oracle=_cos_sql(_FIFO, "avco"))
def _cos_avco(b):
    return costing.cost_of_sales(_sales(b), b.layers, "avco")


@query("remaining_layers_fifo", "I4", views=["movements", "layers"], oracle=_alloc_sql(_FIFO) + """
SELECT l.operation_id, l.product_id, l.unit_cost_cents, l.quantity AS original_quantity,
       CAST(l.quantity - COALESCE(u.used, 0) AS BIGINT) AS remaining_quantity
FROM layers l LEFT JOIN (SELECT operation_id, SUM(units) AS used FROM alloc GROUP BY operation_id) u
  ON l.operation_id = u.operation_id""")
def _remaining_fifo(b):
    return costing.remaining_layers(_sales(b), b.layers, "fifo")


@query("remaining_layers_lifo", "I4", views=["movements", "layers"], oracle=_alloc_sql(_LIFO) + """
SELECT l.operation_id, l.product_id, l.unit_cost_cents, l.quantity AS original_quantity,
       CAST(l.quantity - COALESCE(u.used, 0) AS BIGINT) AS remaining_quantity
FROM layers l LEFT JOIN (SELECT operation_id, SUM(units) AS used FROM alloc GROUP BY operation_id) u
  ON l.operation_id = u.operation_id""")
def _remaining_lifo(b):
    return costing.remaining_layers(_sales(b), b.layers, "lifo")


@query("record_movements", "I5", views=["movements"], oracle="""
SELECT *, CASE WHEN COALESCE(quantity > 0, FALSE) THEN 'RECORDED' ELSE 'REJECTED' END AS status,
       CASE WHEN COALESCE(quantity > 0, FALSE) THEN NULL ELSE 'Invalid quantity' END AS message
FROM movements""")
def _record_movements(b):
    return costing.record_movements(b.movements)


@query("record_cost_layers", "I6", views=["movements"], oracle="""
SELECT management_id AS operation_id, product_id, quantity, unit_cost_cents AS product_cost_cents,
       movement_date AS purchase_date FROM movements WHERE action_type = 'Purchase'""")
def _record_cost_layers(b):
    return costing.record_cost_layers(b.movements)


_STOCK_SQL = """SELECT product_id, warehouse_id,
       CAST(SUM(CASE WHEN action_type IN ('Purchase','Sale Return') THEN quantity
                     WHEN action_type IN ('Sale','Purchase Return') THEN -quantity ELSE 0 END) AS BIGINT) AS on_hand
FROM movements GROUP BY product_id, warehouse_id"""


@query("stock_by_warehouse", "I7", views=["movements"], oracle=_STOCK_SQL)
def _stock_by_warehouse(b):
    return costing.stock_by_warehouse(b.movements)


@query("validate_inventory_sufficient", "I8", views=["movements"], oracle=f"""
SELECT r.management_id AS request_id, r.product_id, r.warehouse_id,
       COALESCE(s.on_hand, 0) >= r.quantity AS has_sufficient_inventory,
       CAST(COALESCE(s.on_hand, 0) AS BIGINT) AS current_quantity, CAST(r.quantity AS BIGINT) AS requested_quantity,
       CASE WHEN COALESCE(s.on_hand, 0) >= r.quantity THEN 'Sufficient inventory available'
            ELSE 'Insufficient inventory: need ' || CAST(r.quantity - COALESCE(s.on_hand, 0) AS VARCHAR) END AS message
FROM movements r LEFT JOIN ({_STOCK_SQL}) s ON r.product_id = s.product_id AND r.warehouse_id = s.warehouse_id
WHERE r.action_type = 'Sale'""")
def _validate_inventory_sufficient(b):
    req = b.movements.where(F.col("action_type") == "Sale").select(
        F.col("management_id").alias("request_id"), "product_id", "warehouse_id", "quantity")
    return costing.validate_inventory_sufficient(req, b.movements)


def _transfers(b):
    m = b.movements.where(F.col("action_type") == "Sale Return")
    to = F.when(F.col("transaction_id") % 13 == 0, F.col("warehouse_id")).otherwise(F.col("warehouse_id") % 3 + 1)
    return m.select(F.col("management_id").alias("transfer_id"), "product_id",
                    F.col("warehouse_id").alias("from_warehouse_id"), to.cast("int").alias("to_warehouse_id"), "quantity")


@query("apply_transfers", "I9", views=["movements"], oracle=f"""
WITH tr AS (SELECT product_id, warehouse_id AS from_w,
                   CAST(CASE WHEN transaction_id % 13 = 0 THEN warehouse_id ELSE warehouse_id % 3 + 1 END AS INT) AS to_w, quantity
            FROM movements WHERE action_type = 'Sale Return'),
d AS (SELECT product_id, warehouse_id, on_hand AS delta FROM ({_STOCK_SQL}) s
      UNION ALL SELECT product_id, from_w, -quantity FROM tr WHERE from_w <> to_w
      UNION ALL SELECT product_id, to_w, quantity FROM tr WHERE from_w <> to_w)
SELECT product_id, warehouse_id, CAST(SUM(delta) AS BIGINT) AS on_hand FROM d GROUP BY product_id, warehouse_id""")
def _apply_transfers(b):
    new, _rejected = costing.apply_transfers(costing.stock_by_warehouse(b.movements), _transfers(b))
    return new
