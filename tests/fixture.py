"""A small hand-made domain fixture with the edge cases the semantics hinge on.

Expected values in the tests were derived by hand from these rows."""

import datetime as dt
from decimal import Decimal

from chainlens.operators.subscriptions import plan_catalog
from chainlens.schema import SCHEMAS
from chainlens.sources.tables import tables_from_frames

AS_OF = dt.date(2026, 2, 15)
D = dt.date

ROWS = {
    "company": [
        (1, "Acme", "Retail", "India", None, None, None, "Active"),
        (2, "Beta", "Energy", "Chile", None, None, None, "Active"),
        (3, "Gamma", "Food", "Kenya", None, None, None, "Inactive"),   # no suppliers
    ],
    "supplier": [
        (10, "North Parts", 1, "India", 4, Decimal("0.90"), None, True),
        (11, "Null Score Co", 1, "India", 7, None, None, True),          # NULL score, no shipments
        (12, "South Metal", 2, "Chile", 12, Decimal("0.50"), None, True),
    ],
    "product": [
        (100, "Widget_%", 10, "Parts", Decimal("9.99"), 10, None, True),  # % and _ in the name
        (101, "Gadget", 11, "Parts", Decimal("5.00"), 10, None, True),
        (102, "Bolt", 12, "Metal", Decimal("0.10"), 10, None, True),
    ],
    "warehouse": [
        (1, "North", "Pune", "India", 1000, None, None, True),
        (2, "South", "Lima", "Peru", 1000, None, None, True),
        (3, "East", "Oslo", "Norway", 1000, None, None, True),
    ],
    "inventory": [
        (1000, 100, 1, None, 0, D(2026, 1, 1), 10, "In Stock"),    # NULL quantity: not low, not allocatable
        (1001, 100, 2, 3, 0, D(2026, 1, 1), 10, "Low Stock"),      # exactly 30 % of threshold → Medium
        (1002, 101, 1, 0, 0, D(2026, 1, 1), 0, "Out of Stock"),    # threshold 0: not low
        (1003, 101, 2, 2, 0, D(2026, 1, 1), 10, "Low Stock"),      # High, but an open risk exists
        (1004, 102, 1, 0, 0, D(2026, 1, 1), 5, "Out of Stock"),    # Critical
        (1005, 102, 2, 7, 0, D(2026, 1, 1), 5, "In Stock"),
        (1007, 100, 3, 3, 0, D(2026, 1, 1), 1, "In Stock"),        # ties with 1001 on quantity
        (1008, 300, 3, 9, 0, D(2026, 1, 1), 1, "In Stock"),        # its product does not exist
    ],
    "shipment": [
        (5000, 100, 10, 5, D(2026, 2, 10), None, "In Transit", "Air"),    # 5 days overdue → Medium
        (5001, 100, 10, 5, D(2026, 2, 5), None, "Delayed", "Sea"),        # 10 days → High
        (5002, 102, 12, 5, D(2026, 2, 4), None, "Cancelled", "Road"),     # 11 days, Cancelled still overdue
        (5003, 102, 12, 5, D(2026, 2, 1), D(2026, 2, 2), "Delivered", "Rail"),
        (5004, 101, 10, 5, D(2026, 3, 1), None, "In Transit", "Air"),     # not yet due
    ],
    "orders": [
        (1, 1, 100, 2, D(2026, 2, 1), D(2026, 2, 8), "Pending", "High"),
        (2, 2, 102, 1, D(2026, 2, 3), D(2026, 2, 10), "Delivered", "Low"),
    ],
    "risk_event": [
        (1, "Inventory", 1003, "Low Stock", "High", D(2026, 2, 1), "low", "Open"),
        (2, "Shipment", 5000, "Delayed Delivery", "Critical", D(2026, 2, 2), "late", "Resolved"),
        (3, "Shipment", 9999, "Delayed Delivery", "Low", D(2026, 2, 3), "dangling", "Open"),
        (4, "Inventory", 1004, "Out of Stock", "Medium", D(2026, 2, 4), "oos", "Open"),
        (5, "Supplier", 10, "Low Reliability", "Low", D(2026, 2, 5), "rel", "Investigating"),
        (6, "Shipment", 5002, "Delayed Delivery", "Critical", D(2026, 2, 6), "late", "Investigating"),
    ],
    "order_request": [
        (1, 1, 100, 2, None),          # ties 1001/1007 at 3 → 1001; priority defaults to Medium
        (2, 1, 100, 3, "High"),        # 1001 has 1 left, 1007 has 3 → 1007
        (3, 1, 100, 2, "Low"),         # best row has 1 → insufficient
        (4, 9, 102, 1, "Low"),         # unknown company → invalid
        (5, 2, 102, 0, "Low"),         # quantity 0 → invalid
        (6, 2, 102, 1, "Urgent"),      # unknown priority → invalid
        (7, 2, 555, 1, "Low"),         # no stock rows
        (8, 2, 102, 7, "Critical"),    # 1005: 7 → 0, crosses its threshold
        (9, 2, None, 1, "Low"),        # no product → rejected, not lost
        (10, 2, 102, 8, "Low"),        # more than any row ever held
        (11, 1, 300, 1, "Low"),        # stock of a product that does not exist
    ],
    "inventory_change": [
        (1, 1001, 12, 8, 10, 10),      # crosses → fires
        (2, 1001, 8, 15, 10, 10),      # back above
        (3, 1001, 15, 4, 10, 10),      # crosses again → suppressed (risk still open)
        (1, 1003, 12, 1, 10, 10),      # crosses, open risk 1 suppresses
        (1, 1004, None, 2, 5, 5),      # old quantity NULL → fires
        (1, 1002, 5, 1, None, 3),      # old threshold NULL → no fire
    ],
    "shipment_change": [
        (1, 5000, "In Transit", "Delayed"),    # fires (its risk is resolved)
        (1, 5002, "Cancelled", "Delayed"),     # suppressed by open risk 6
        (1, 5001, None, "Delayed"),            # old NULL → no fire
        (1, 5004, "In Transit", "Delayed"),    # fires
        (2, 5004, "Delayed", "In Transit"),
        (3, 5004, "In Transit", "Delayed"),    # suppressed: own risk still open
    ],
    "app_user": [
        (1, "a@x.test", "A", "company", 1, None, None),
        (2, "b@x.test", "B", "company", 2, None, None),
        (3, "c@x.test", "C", "admin", None, None, None),
    ],
    "conversations": [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "stock?"),
        (1, 3, "system", "note"), (1, 4, "user", "again"), (1, 5, "user", "new question"),
        (2, 0, "user", "only message"),
    ],
}


def make_tables(spark):
    frames = {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in ROWS.items()}
    frames["subscription_plan"] = plan_catalog(spark)
    return tables_from_frames(spark, frames, AS_OF)
