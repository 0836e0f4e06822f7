"""L1–L10, U3, T4–T6 — listing queries.  Every listing carries ``company_id`` (the
tenant path), so the tenant form is the global frame filtered by :func:`scope`.

Joins are plain equi-joins along foreign keys; AQE chooses broadcast (runtime size
below the threshold) or sort-merge.  Ordering is applied last, as the sink contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.predicates import ALL, scope


def _tenant_of_product(t) -> DataFrame:
    return t.product.select("product_id", "supplier_id").join(
        t.supplier.select("supplier_id", "company_id"), "supplier_id").select("product_id", "company_id")


def list_companies(t, cid=ALL) -> DataFrame:
    """L1."""
    return scope(t.company, cid).orderBy("company_id")


def list_suppliers(t, cid=ALL) -> DataFrame:
    """L2: supplier.* + company_name."""
    c = t.company.select("company_id", "company_name")
    return scope(t.supplier, cid).join(c, "company_id").select(t.supplier.columns + ["company_name"]) \
        .orderBy("supplier_id")


def list_products(t, cid=ALL) -> DataFrame:
    """L3: product.* + supplier_name (+ the tenant)."""
    s = scope(t.supplier, cid).select("supplier_id", "supplier_name", "company_id")
    return t.product.join(s, "supplier_id").select(t.product.columns + ["supplier_name", "company_id"]) \
        .orderBy("product_id")


def list_warehouses(t) -> DataFrame:
    """L4: warehouses are global (never tenant-scoped)."""
    return t.warehouse.orderBy("warehouse_id")


def list_inventory(t, cid=ALL) -> DataFrame:
    """Inventory.* + product_name, warehouse_name (+ tenant via product → supplier)."""
    p = t.product.select("product_id", "product_name", "supplier_id")
    s = scope(t.supplier, cid).select("supplier_id", "company_id")
    w = t.warehouse.select("warehouse_id", "warehouse_name")
    return (t.inventory.join(p, "product_id").join(s, "supplier_id").join(w, "warehouse_id")
            .select(t.inventory.columns + ["product_name", "warehouse_name", "company_id"])
            .orderBy("inventory_id"))


def list_shipments(t, cid=ALL) -> DataFrame:
    """Shipment.* + product_name, supplier_name; tenant = the shipment's own supplier."""
    p = t.product.select("product_id", "product_name")
    s = scope(t.supplier, cid).select("supplier_id", "supplier_name", "company_id")
    return (t.shipment.join(p, "product_id").join(s, "supplier_id")
            .select(t.shipment.columns + ["product_name", "supplier_name", "company_id"])
            .orderBy("shipment_id"))


def list_orders(t, cid=ALL, ordered: bool = True) -> DataFrame:
    """Orders.* + company_name, product_name, newest first (id breaks ties) unless ``ordered``
    is off, for callers that order, count or write the rows themselves."""
    c = t.company.select("company_id", "company_name")
    p = t.product.select("product_id", "product_name")
    o = (scope(t.orders, cid).join(c, "company_id").join(p, "product_id")
         .select(t.orders.columns + ["company_name", "product_name"]))
    return o.orderBy(F.col("order_date").desc_nulls_first(), F.col("order_id").desc()) if ordered else o


def list_risks(t) -> DataFrame:
    """L8 (global form): newest detected first, then id descending."""
    return t.risk_event.orderBy(F.col("detected_date").desc_nulls_first(), F.col("risk_id").desc())


def dropdown_companies(t) -> DataFrame:
    """L9."""
    return t.company.select("company_id", "company_name").orderBy("company_name", "company_id")


def dropdown_products(t) -> DataFrame:
    """Products with their supplier's name, by product name."""
    s = t.supplier.select("supplier_id", "supplier_name")
    return (t.product.select("product_id", "product_name", "supplier_id").join(s, "supplier_id")
            .select("product_id", "product_name", "supplier_name").orderBy("product_name", "product_id"))


def filter_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column, dropping NULL and ''."""
    return (df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull() & (F.col("value") != ""))
            .distinct().orderBy("value"))


def top_n(df: DataFrame, n: int, order_cols, partition_by=None) -> DataFrame:
    """T4/T5: global top-n (TakeOrderedAndProject) or per-key top-n (row_number ≤ n,
    planned with a WindowGroupLimit so each partition keeps at most n rows per key
    before the shuffle-free window)."""
    if partition_by is None:
        return df.orderBy(*order_cols).limit(n)
    w = Window.partitionBy(*partition_by).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def recent_orders(t, n: int = 15, cid=ALL, per_company: bool = False) -> DataFrame:
    """T4: the n newest orders (order date, then id), globally or per tenant."""
    o = list_orders(t, cid, ordered=False)
    order = [F.col("order_date").desc_nulls_first(), F.col("order_id").desc()]
    return top_n(o, n, order, ["company_id"] if per_company else None)
