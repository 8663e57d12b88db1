"""I — inventory movements, stock and FIFO / LIFO / average costing.

Layer consumption is expressed as interval overlap, not as a loop: per product,
the cumulative sale quantities (sales in date order) and the cumulative layer
quantities (oldest first for FIFO, newest first for LIFO) cut the unit line
into half-open intervals that follow each other without gaps.  So every slice
(units that one sale takes from one layer) starts where a sale or a layer
starts: the starts of both are put on one line, each is filled forward with the
sale and the layer in force there, and the slice ends where the first of the two
ends.  No interval is exploded and no pair is tried.  Most products have few rows:
theirs are shuffled once, by product, for both the sums and the filling.  Products
are counted in ``GROUPS`` groups by hash; where a group has more than ``WHOLE`` rows,
the lines of its products are cut into stretches of ``STRETCH`` units, each with at
most twice as many starts; what is in force where a stretch begins comes from a table
of one row per stretch, so neither here nor in the cumulative sums do more than
``WHOLE`` rows of a product meet in one task.  Money stays in integer cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import TOTAL, cents_to_money
from ..functions.windows import running_sum, sort_columns

IN_TYPES = ("Purchase", "Sale Return")
OUT_TYPES = ("Sale", "Purchase Return")
STRETCH = 1 << 20
GROUPS = 1 << 16
WHOLE = 1 << 17


def _method(method: str) -> str:
    m = method.lower()
    if m not in ("fifo", "lifo", "avco"):
        raise ValueError(f"unknown cost method {method!r}")
    return m


def allocate_layers(sales: DataFrame, layers: DataFrame, method: str = "fifo", stretch: int = STRETCH) -> DataFrame:
    """One row per (sale, layer) slice: sale_id, product_id, operation_id, units, unit_cost_cents, sale_units.

    ``sales``: sale_id, product_id, sale_date, quantity.
    ``layers``: operation_id, product_id, purchase_date, quantity, unit_cost_cents.
    ``sale_units`` is what the sale gets from all layers.  Ties are broken by id; AVCO allocates
    units in FIFO order (only the cost differs).  Products of groups with more than ``WHOLE``
    (or ``stretch``) rows are cut into stretches of ``stretch`` units.
    """
    asc = _method(method) != "lifo"
    s = sales.select("sale_id", "product_id", "sale_date", "quantity").where(F.col("quantity") > 0)
    l = (layers.select("operation_id", "product_id", "purchase_date", "quantity", "unit_cost_cents")
         .where(F.col("quantity") > 0))
    group = F.pmod(F.hash("product_id"), F.lit(GROUPS)).alias("_group")
    # at most rows / WHOLE groups are crowded
    crowded = F.broadcast(s.select(group).unionByName(l.select(group)).groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
                          .where(F.col("_n") > min(WHOLE, stretch)).select("_group"))
    few, many = ([df.withColumn("_group", group).join(crowded, "_group", how).drop("_group") for df in (s, l)]
                 for how in ("left_anti", "left_semi"))
    return _allocate_whole(*few, asc).unionByName(_allocate_stretches(*many, asc, stretch))


def _allocate_whole(s: DataFrame, l: DataFrame, asc: bool) -> DataFrame:
    """The slices of products whose rows may meet in one task: one shuffle by product."""
    rows = (s.withColumn("_is_layer", F.lit(False)).unionByName(l.withColumn("_is_layer", F.lit(True)), allowMissingColumns=True)
            .where(F.col("product_id").isNotNull()).repartition("product_id"))
    # the columns of the other side are null, so each side has its own order
    order = [("sale_date", True), ("sale_id", True), ("purchase_date", asc), ("operation_id", asc)]
    so_far = (Window.unboundedPreceding, Window.currentRow)
    sums = Window.partitionBy("product_id", "_is_layer").orderBy(*sort_columns(order)).rowsBetween(*so_far)
    # a row without date or id uses up its units, but gets and gives no slice
    is_sale = ~F.col("_is_layer") & F.col("sale_date").isNotNull() & F.col("sale_id").isNotNull()
    is_layer = F.col("_is_layer") & F.col("purchase_date").isNotNull() & F.col("operation_id").isNotNull()
    rows = rows.withColumn("hi", F.sum("quantity").over(sums)).where(is_sale | is_layer)
    lo = (F.col("hi") - F.col("quantity")).cast("long")
    starts = rows.select("product_id", "_is_layer", lo.alias("_at"), F.col("hi").cast("long").alias("hi"), "sale_id", "operation_id", "unit_cost_cents")
    sale = F.when(~F.col("_is_layer"), F.struct(F.col("_at").alias("lo"), "hi", "sale_id"))
    layer = F.when(F.col("_is_layer"), F.struct("hi", "operation_id", "unit_cost_cents"))
    # of a layer and a sale that start at one point the layer comes first: the sale's start stands for the slice
    line = Window.partitionBy("product_id").orderBy("_at", F.col("_is_layer").desc()).rowsBetween(*so_far)
    filled = starts.select(
        "product_id", "_at", F.last(sale, ignorenulls=True).over(line).alias("_s"), F.last(layer, ignorenulls=True).over(line).alias("_l"),
        F.max(F.when(F.col("_is_layer"), F.col("hi"))).over(Window.partitionBy("product_id")).alias("_supply"))
    return _slices(filled)


def _slices(filled: DataFrame) -> DataFrame:
    """The slices that begin at the starts of a line, given the sale and the layer in force there."""
    ends_at = F.least("_s.hi", "_l.hi")
    got = F.least("_s.hi", "_supply") - F.col("_s.lo")
    # a product without layers (or without sales) has no slice; least() would pass over the missing side
    both = F.col("_s").isNotNull() & F.col("_l").isNotNull()
    return (filled.where(both & (F.col("_at") < ends_at))
            .select("_s.sale_id", "product_id", "_l.operation_id", (ends_at - F.col("_at")).alias("units"), "_l.unit_cost_cents",
                    got.alias("sale_units")))


def _allocate_stretches(s: DataFrame, l: DataFrame, asc: bool, stretch: int) -> DataFrame:
    """The slices of products of any size: lines are cut into stretches."""
    s = running_sum(s, ["product_id"], [("sale_date", True), ("sale_id", True)], "quantity", "hi")
    l = running_sum(l, ["product_id"], [("purchase_date", asc), ("operation_id", asc)], "quantity", "hi")
    lo = (F.col("hi") - F.col("quantity")).cast("long")
    sale = F.struct(lo.alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("sale_id"))
    layer = F.struct(lo.alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("operation_id"), F.col("unit_cost_cents"))
    starts = s.select("product_id", lo.alias("_at"), sale.alias("_sale")).unionByName(
        l.select("product_id", lo.alias("_at"), layer.alias("_layer")), allowMissingColumns=True)
    keys = ["product_id", "_stretch"]
    starts = starts.withColumn("_stretch", F.floor(F.col("_at") / stretch)).repartition(*keys)
    # starts grow along the line, so the latest sale (layer) of a stretch is its largest
    ends = starts.groupBy(*keys).agg(F.max("_sale").alias("_s"), F.max("_layer").alias("_l"))
    before = Window.partitionBy("product_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, F.max("_s").over(before).alias("_s0"), F.max("_l").over(before).alias("_l0"),
                          F.max("_l.hi").over(Window.partitionBy("product_id")).alias("_supply"))
    so_far = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # struct order compares lo first: the maximum is the one in force
    filled = (starts.withColumns({"_s": F.max("_sale").over(so_far), "_l": F.max("_layer").over(so_far)}).join(carried, keys)
              .select("product_id", "_at", "_supply", F.col("_sale").isNull().alias("_from_layer"),
                      F.coalesce("_s", "_s0").alias("_s"), F.coalesce("_l", "_l0").alias("_l")))
    # where both start at one point, the sale's start stands for the slice
    return _slices(filled.where(~F.coalesce(F.col("_from_layer") & (F.col("_s.lo") == F.col("_at")), F.lit(False))))


def average_cost(layers: DataFrame) -> DataFrame:
    """AVCO per product in cents: Σ(q·cost)/Σq over layers with q > 0 (NULL when Σq = 0)."""
    l = layers.where(F.col("quantity") > 0)
    return l.groupBy("product_id").agg(
        F.sum(F.col("quantity") * F.col("unit_cost_cents")).cast("long").alias("total_cost_cents"),
        F.sum("quantity").cast("long").alias("total_quantity"),
    ).withColumn("avg_cost_cents",
                 F.col("total_cost_cents").cast("double") / F.nullif(F.col("total_quantity"), F.lit(0)).cast("double"))


def cost_of_sales(sales: DataFrame, layers: DataFrame, method: str = "fifo") -> DataFrame:
    """Per sale: demanded and allocated units, COGS, revenue, margin, unmet units.

    ``sales`` also carries unit_price_cents.  FIFO/LIFO cost each slice at its layer
    cost; AVCO costs the allocated units at the product's average (exact ratio).
    """
    m = _method(method)
    slices = allocate_layers(sales, layers, m)
    per_sale = slices.groupBy("sale_id").agg(
        F.sum("units").cast("long").alias("units"),
        F.sum(F.col("units") * F.col("unit_cost_cents")).cast("long").alias("layer_cost_cents"))
    s = sales.select("sale_id", "product_id", "quantity", "unit_price_cents").join(per_sale, "sale_id", "left")
    units = F.coalesce(F.col("units"), F.lit(0)).cast("long")
    revenue = cents_to_money(units * F.col("unit_price_cents"))
    if m == "avco":
        avg = average_cost(layers).select("product_id", "total_cost_cents", "total_quantity")
        s = s.join(avg, "product_id", "left")
        cogs = ((units * F.col("total_cost_cents")).cast("double")
                / (F.col("total_quantity") * 100).cast("double"))
        cogs = F.when(units == 0, F.lit(0.0)).otherwise(cogs)
    else:
        cogs = cents_to_money(F.coalesce(F.col("layer_cost_cents"), F.lit(0)))
    return s.select(
        "sale_id", "product_id", F.col("quantity").alias("demanded"), units.alias("allocated"),
        (F.col("quantity") - units).alias("shortage"),
        cogs.alias("cogs"), revenue.alias("revenue"),
        (revenue.cast("double") - cogs.cast("double")).alias("margin") if m == "avco"
        else (revenue - cogs).cast(TOTAL).alias("margin"))


def remaining_layers(sales: DataFrame, layers: DataFrame, method: str = "fifo") -> DataFrame:
    """Layer quantity left after the sales are allocated."""
    used = allocate_layers(sales, layers, method).groupBy("operation_id").agg(F.sum("units").alias("_used"))
    return (layers.select("operation_id", "product_id", "quantity", "unit_cost_cents")
            .join(used, "operation_id", "left")
            .select("operation_id", "product_id", "unit_cost_cents", F.col("quantity").alias("original_quantity"),
                    (F.col("quantity") - F.coalesce(F.col("_used"), F.lit(0))).cast("long").alias("remaining_quantity")))


def record_movements(requests: DataFrame) -> DataFrame:
    """Movement rows with a status: quantity ≤ 0 (or missing) is rejected as 'Invalid quantity'."""
    ok = F.coalesce(F.col("quantity") > 0, F.lit(False))
    return requests.withColumn("status", F.when(ok, "RECORDED").otherwise("REJECTED")) \
                   .withColumn("message", F.when(ok, F.lit(None).cast("string")).otherwise("Invalid quantity"))


def record_cost_layers(purchases: DataFrame) -> DataFrame:
    """Cost-layer rows from purchase movements (cost and price in their own columns)."""
    return purchases.where(F.col("action_type") == "Purchase").select(
        F.col("management_id").alias("operation_id"), "product_id", "quantity",
        F.col("unit_cost_cents").alias("product_cost_cents"),
        F.col("movement_date").alias("purchase_date"))


def _sign() -> F.Column:
    a = F.initcap(F.regexp_replace(F.trim(F.col("action_type")), "_", " "))
    return F.when(a.isin(*IN_TYPES), 1).when(a.isin(*OUT_TYPES), -1).otherwise(0)


def stock_by_warehouse(movements: DataFrame) -> DataFrame:
    """On-hand units per (product, warehouse); action labels are case-normalised."""
    return movements.groupBy("product_id", "warehouse_id").agg(
        F.sum(_sign() * F.col("quantity")).cast("long").alias("on_hand"))


def validate_inventory_sufficient(requests: DataFrame, movements: DataFrame) -> DataFrame:
    """Per request (request_id, product_id, warehouse_id, quantity): enough stock or not."""
    stock = stock_by_warehouse(movements)
    r = requests.select("request_id", "product_id", "warehouse_id", "quantity") \
                .join(stock, ["product_id", "warehouse_id"], "left")
    cur = F.coalesce(F.col("on_hand"), F.lit(0)).cast("long")
    ok = cur >= F.col("quantity")
    return r.select(
        "request_id", "product_id", "warehouse_id", ok.alias("has_sufficient_inventory"),
        cur.alias("current_quantity"), F.col("quantity").cast("long").alias("requested_quantity"),
        F.when(ok, F.lit("Sufficient inventory available"))
         .otherwise(F.concat(F.lit("Insufficient inventory: need "), (F.col("quantity") - cur).cast("string")))
         .alias("message"))


def apply_transfers(stock: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new stock per product and warehouse, rejected transfers with from = to)."""
    valid = transfers.where(F.col("from_warehouse_id") != F.col("to_warehouse_id"))
    rejected = transfers.where(~(F.col("from_warehouse_id") != F.col("to_warehouse_id")) |
                               F.col("from_warehouse_id").isNull() | F.col("to_warehouse_id").isNull())
    deltas = valid.select("product_id", F.col("from_warehouse_id").alias("warehouse_id"),
                          (-F.col("quantity")).alias("delta")).unionByName(
        valid.select("product_id", F.col("to_warehouse_id").alias("warehouse_id"), F.col("quantity").alias("delta")))
    base = stock.select("product_id", "warehouse_id", F.col("on_hand").alias("delta"))
    new = base.unionByName(deltas).groupBy("product_id", "warehouse_id").agg(
        F.sum("delta").cast("long").alias("on_hand"))
    return new, rejected
