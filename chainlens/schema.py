"""Domain schemas and the fixed enumerations the computations depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the monitored system's for identical results).
# ---------------------------------------------------------------------------
COMPANY_STATUSES = ("Active", "Inactive", "Suspended")
ENTITY_TYPES = ("Supplier", "Product", "Shipment", "Inventory", "Warehouse", "Order")
SEVERITIES = ("Low", "Medium", "High", "Critical")          # ascending rank
RESOLUTION_STATUSES = ("Open", "Investigating", "Resolved", "Dismissed")
OPEN_STATUSES = ("Open", "Investigating")
INVENTORY_STATUSES = ("In Stock", "Low Stock", "Out of Stock")
SHIPMENT_STATUSES = ("In Transit", "Delivered", "Delayed", "Cancelled")
TRANSPORT_MODES = ("Air", "Sea", "Road", "Rail")
ORDER_STATUSES = ("Pending", "Processing", "Shipped", "Delivered", "Cancelled")
PRIORITIES = ("Low", "Medium", "High", "Critical")
USER_ROLES = ("admin", "company")
SUBSCRIPTION_STATUSES = ("active", "expired", "cancelled", "pending")
RISK_LOW_STOCK = "Low Stock"
RISK_DELAYED = "Delayed Delivery"
# Messages of the risks that a scan creates.
SCAN_LOW_STOCK = "Scan-detected: Stock at {quantity}/{threshold} units"
SCAN_OVERDUE = "Scan-detected: Shipment #{shipment} is {days} days overdue"
DEFAULT_PRIORITY = "Medium"
ORDER_FULFIL_DAYS = 7
SUBSCRIPTION_DAYS = 30
STARTER_PLAN = "Starter"

# Column defaults applied when a column is absent from the input (DEFAULT clauses).
DEFAULTS = {
    "company": {"status": "Active"},
    "supplier": {"active_status": True},
    "product": {"reorder_level": 10, "active_status": True},
    "warehouse": {"active_status": True},
    "inventory": {"quantity_available": 0, "reserved_quantity": 0, "minimum_threshold": 10,
                  "inventory_status": "In Stock"},
    "shipment": {"shipment_status": "In Transit"},
    "orders": {"order_status": "Pending", "priority_level": "Medium"},
    "risk_event": {"risk_severity": "Medium", "resolution_status": "Open"},
}

# ---------------------------------------------------------------------------
# Domain table schemas (explicit; never inferred).
# ---------------------------------------------------------------------------
L, I, S, D, B, TS = (T.LongType(), T.IntegerType(), T.StringType(), T.DateType(),
                     T.BooleanType(), T.TimestampNTZType())


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "company": _st(("company_id", L, False), ("company_name", S, False), ("industry", S, True),
                   ("country", S, True), ("contact_email", S, True), ("contact_phone", S, True),
                   ("created_at", D, True), ("status", S, True)),
    "supplier": _st(("supplier_id", L, False), ("supplier_name", S, False), ("company_id", L, False),
                    ("country", S, True), ("lead_time_days", I, True),
                    ("reliability_score", T.DecimalType(3, 2), True), ("contact_email", S, True),
                    ("active_status", B, True)),
    "product": _st(("product_id", L, False), ("product_name", S, False), ("supplier_id", L, False),
                   ("category", S, True), ("unit_price", T.DecimalType(12, 2), True),
                   ("reorder_level", I, True), ("weight_kg", T.DecimalType(8, 2), True),
                   ("active_status", B, True)),
    "warehouse": _st(("warehouse_id", L, False), ("warehouse_name", S, False),
                     ("location_city", S, True), ("location_country", S, True),
                     ("capacity_units", I, True), ("manager_name", S, True),
                     ("contact_number", S, True), ("active_status", B, True)),
    "inventory": _st(("inventory_id", L, False), ("product_id", L, False), ("warehouse_id", L, False),
                     ("quantity_available", I, True), ("reserved_quantity", I, True),
                     ("last_updated", D, True), ("minimum_threshold", I, True),
                     ("inventory_status", S, True)),
    "shipment": _st(("shipment_id", L, False), ("product_id", L, False), ("supplier_id", L, False),
                    ("quantity_shipped", I, True), ("expected_delivery_date", D, False),
                    ("actual_delivery_date", D, True), ("shipment_status", S, True),
                    ("transport_mode", S, True)),
    "orders": _st(("order_id", L, False), ("company_id", L, False), ("product_id", L, False),
                  ("order_quantity", I, True), ("order_date", D, True),
                  ("expected_fulfill_date", D, True), ("order_status", S, True),
                  ("priority_level", S, True)),
    "risk_event": _st(("risk_id", L, False), ("entity_type", S, False), ("entity_id", L, False),
                      ("risk_type", S, False), ("risk_severity", S, True), ("detected_date", D, True),
                      ("description", S, True), ("resolution_status", S, True)),
    "app_user": _st(("user_id", L, False), ("email", S, False), ("full_name", S, False),
                    ("role", S, False), ("company_id", L, True), ("created_at", TS, True),
                    ("last_login", TS, True)),
    "subscription_plan": _st(("plan_id", L, False), ("plan_name", S, False),
                             ("price_monthly", T.DecimalType(10, 2), False), ("max_suppliers", I, True),
                             ("max_products", I, True), ("has_pipeline", B, True), ("has_map", B, True),
                             ("has_ai_chat", B, True), ("ai_chat_limit", I, True), ("has_export", B, True),
                             ("is_active", B, True), ("created_at", TS, True)),
    "user_subscription": _st(("subscription_id", L, False), ("user_id", L, False), ("plan_id", L, False),
                             ("status", S, True), ("payment_order_id", S, True),
                             ("amount_paid", T.DecimalType(10, 2), True), ("started_at", TS, True),
                             ("expires_at", TS, True), ("created_at", TS, True)),
    # request / change logs
    "order_request": _st(("seq", L, False), ("company_id", L, True), ("product_id", L, True),
                         ("quantity", I, True), ("priority", S, True)),
    "inventory_change": _st(("seq", L, False), ("inventory_id", L, False), ("old_quantity", I, True),
                            ("new_quantity", I, True), ("old_threshold", I, True),
                            ("new_threshold", I, True)),
    "shipment_change": _st(("seq", L, False), ("shipment_id", L, False), ("old_status", S, True),
                           ("new_status", S, True)),
    "risk_resolution": _st(("seq", L, False), ("risk_id", L, False), ("action", S, False)),
    "payment": _st(("seq", L, False), ("user_id", L, False), ("payment_order_id", S, False),
                   ("paid_at", TS, True)),
    "conversations": _st(("conv_id", L, False), ("turn", L, False), ("role", S, True), ("text", S, True)),
}

PRIMARY_KEYS = {
    "company": ["company_id"], "supplier": ["supplier_id"], "product": ["product_id"],
    "warehouse": ["warehouse_id"], "inventory": ["inventory_id"], "shipment": ["shipment_id"],
    "orders": ["order_id"], "risk_event": ["risk_id"], "app_user": ["user_id"],
    "subscription_plan": ["plan_id"], "user_subscription": ["subscription_id"],
}

# (child table, fk column, parent table, parent key, on delete)
FOREIGN_KEYS = [
    ("supplier", "company_id", "company", "company_id", "cascade"),
    ("product", "supplier_id", "supplier", "supplier_id", "cascade"),
    ("inventory", "product_id", "product", "product_id", "cascade"),
    ("inventory", "warehouse_id", "warehouse", "warehouse_id", "cascade"),
    ("shipment", "product_id", "product", "product_id", "cascade"),
    ("shipment", "supplier_id", "supplier", "supplier_id", "cascade"),
    ("orders", "company_id", "company", "company_id", "cascade"),
    ("orders", "product_id", "product", "product_id", "cascade"),
    ("app_user", "company_id", "company", "company_id", "set_null"),
    ("user_subscription", "user_id", "app_user", "user_id", "cascade"),
    ("user_subscription", "plan_id", "subscription_plan", "plan_id", "no_action"),
]

# Raw driver tables (observed Parquet types).
RAW_SCHEMAS: dict[str, T.StructType] = {
    "region": _st(("r_regionkey", I, True), ("r_name", S, True)),
    "nation": _st(("n_nationkey", I, True), ("n_name", S, True), ("n_regionkey", I, True)),
    "customer": _st(("c_custkey", L, True), ("c_name", S, True), ("c_nationkey", I, True),
                    ("c_acctbal", T.DoubleType(), True), ("c_mktsegment", S, True)),
    "supplier": _st(("s_suppkey", L, True), ("s_name", S, True), ("s_nationkey", I, True),
                    ("s_acctbal", T.DoubleType(), True)),
    "part": _st(("p_partkey", L, True), ("p_name", S, True), ("p_brand", S, True), ("p_type", S, True),
                ("p_size", I, True), ("p_retailprice", T.DoubleType(), True)),
    "orders": _st(("o_orderkey", L, True), ("o_custkey", L, True), ("o_orderstatus", S, True),
                  ("o_totalprice", T.DoubleType(), True), ("o_orderdate", TS, True),
                  ("o_orderpriority", S, True)),
    "lineitem": _st(("l_orderkey", L, True), ("l_partkey", L, True), ("l_suppkey", L, True),
                    ("l_linenumber", I, True), ("l_quantity", T.DoubleType(), True),
                    ("l_extendedprice", T.DoubleType(), True), ("l_discount", T.DoubleType(), True),
                    ("l_tax", T.DoubleType(), True), ("l_returnflag", S, True),
                    ("l_linestatus", S, True), ("l_shipdate", TS, True)),
    "events": _st(("event_id", L, True), ("ts", TS, True), ("user_id", L, True),
                  ("event_type", S, True), ("value", T.DoubleType(), True), ("props", S, True)),
    "conversations": _st(("conv_id", L, True), ("turn", L, True), ("role", S, True), ("text", S, True)),
}
