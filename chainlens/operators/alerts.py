"""R1, R2, R8 — low-stock and overdue-shipment alerts and their bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions import scalars as X
from chainlens.functions.predicates import ALL, as_of_lit, is_low_stock, is_overdue, scope

LOW_INVENTORY_COLS = ["inventory_id", "product_name", "category", "supplier_name", "company_id",
                      "warehouse_name", "quantity_available", "minimum_threshold", "inventory_status",
                      "last_updated"]


def low_inventory(t, cid=ALL, ordered: bool = True) -> DataFrame:
    """Stock rows below their threshold with product, supplier, tenant and warehouse.

    The filter is applied to inventory before any join, so only low rows enter the
    product / supplier / warehouse joins.  Order: shortage gap descending (NULL first,
    as PostgreSQL does on DESC), then inventory_id."""
    inv = t.inventory.filter(is_low_stock())
    p = t.product.select("product_id", "product_name", "category", "supplier_id")
    s = scope(t.supplier, cid).select("supplier_id", "supplier_name", "company_id")
    w = t.warehouse.select("warehouse_id", "warehouse_name")
    out = (inv.join(p, "product_id").join(s, "supplier_id").join(w, "warehouse_id")
           .select(*LOW_INVENTORY_COLS))
    if ordered:
        out = out.orderBy((F.col("minimum_threshold") - F.col("quantity_available")).desc_nulls_first(),
                          "inventory_id")
    return out


DELAYED_COLS = ["shipment_id", "product_name", "supplier_name", "company_id", "quantity_shipped",
                "expected_delivery_date", "shipment_status", "transport_mode", "days_overdue"]


def delayed_shipments(t, as_of=None, cid=ALL, ordered: bool = True) -> DataFrame:
    """R2: undelivered shipments expected before ``as_of`` (any status), with days overdue."""
    as_of = as_of if as_of is not None else t.as_of
    sh = t.shipment.filter(is_overdue(as_of))
    p = t.product.select("product_id", "product_name")
    s = scope(t.supplier, cid).select("supplier_id", "supplier_name", "company_id")
    out = (sh.join(p, "product_id").join(s, "supplier_id")
           .withColumn("days_overdue", X.days_between(as_of_lit(as_of), F.col("expected_delivery_date")))
           .select(*DELAYED_COLS))
    if ordered:
        out = out.orderBy("expected_delivery_date", "shipment_id")
    return out


def stock_bands(t, cid=ALL) -> DataFrame:
    """Low-stock rows counted per band variant (legacy bar, chart colour, gauge)."""
    low = low_inventory(t, cid, ordered=False)
    q, th = F.col("quantity_available"), F.col("minimum_threshold")
    return (low.select(X.stock_band(q, th).alias("bar_band"), X.stock_ratio_band(q, th).alias("chart_band"),
                       X.stock_danger(q, th).alias("gauge_band"))
            .groupBy("bar_band", "chart_band", "gauge_band").agg(F.count(F.lit(1)).alias("n_rows")))


def reliability_bands(t, cid=ALL) -> DataFrame:
    """Suppliers counted per reliability band variant."""
    s = scope(t.supplier, cid)
    r = F.col("reliability_score")
    return (s.select(X.reliability_band_legacy(r).alias("legacy_band"), X.reliability_band(r).alias("band"),
                     F.when(r >= 0.8, "safe").otherwise("warning").alias("pipeline_band"))
            .groupBy("legacy_band", "band", "pipeline_band").agg(F.count(F.lit(1)).alias("n_suppliers")))


def overdue_bands(t, as_of=None, cid=ALL) -> DataFrame:
    """Overdue shipments counted per days-overdue band."""
    d = delayed_shipments(t, as_of, cid, ordered=False)
    return (d.select(X.overdue_band(F.col("days_overdue")).alias("overdue_band"))
            .groupBy("overdue_band").agg(F.count(F.lit(1)).alias("n_shipments")))
