"""Registered queries, part 3: order allocation (M1, E4) and the trigger streams.

The allocation oracle is a recursive CTE: per product the state is the list of stock
rows (quantity, −inventory_id, threshold), so ``list_max`` is the fullest row with the
lowest id on ties; step i applies the product's i-th request.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlens.operators import allocation, shipments
from chainlens.plans.catalog import AS_OF
from chainlens.plans.registry import register
from chainlens.schema import PRIORITIES, SHIPMENT_STATUSES
from chainlens.streaming import risk_state, triggers

_PRIOS = ", ".join(f"'{p}'" for p in PRIORITIES)

ALLOC_CTES = {
    "req": f"""
SELECT r.seq, r.company_id, r.product_id, r.quantity, COALESCE(r.priority, 'Medium') AS priority,
       COALESCE(r.quantity > 0, FALSE) AND COALESCE(r.priority, 'Medium') IN ({_PRIOS})
         AND COALESCE(r.company_id IN (SELECT company_id FROM d_company), FALSE) AS valid,
       row_number() OVER (PARTITION BY r.product_id ORDER BY r.seq) AS i
FROM d_order_request r""",
    "st0": """
SELECT product_id, list({'q': quantity_available, 'nid': -inventory_id, 't': minimum_threshold}) AS st
FROM d_inventory JOIN (SELECT product_id FROM d_product) USING (product_id)
WHERE quantity_available IS NOT NULL GROUP BY product_id""",
    "walk": """
SELECT p.product_id, CAST(0 AS BIGINT) AS i, COALESCE(s.st, []) AS st, CAST(NULL AS BIGINT) AS seq,
       CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS inventory_id,
       CAST(NULL AS INTEGER) AS stock_before, CAST(NULL AS INTEGER) AS stock_after,
       CAST(NULL AS INTEGER) AS minimum_threshold
FROM (SELECT DISTINCT product_id FROM req WHERE product_id IS NOT NULL) p LEFT JOIN st0 s ON p.product_id = s.product_id
UNION ALL
SELECT product_id, i,
       CASE WHEN acc THEN list_transform(st, lambda x: CASE WHEN x.nid = b.nid
                                                         THEN {'q': x.q - quantity, 'nid': x.nid, 't': x.t}
                                                         ELSE x END)
            ELSE st END,
       seq, CASE WHEN acc THEN 'accepted' ELSE 'rejected' END,
       CASE WHEN acc THEN NULL WHEN b IS NULL THEN 'no inventory'
            WHEN b.q < quantity THEN 'insufficient stock' ELSE 'invalid request' END,
       CASE WHEN acc THEN -b.nid END, CASE WHEN acc THEN b.q END,
       CASE WHEN acc THEN b.q - quantity END, CASE WHEN acc THEN b.t END
FROM (SELECT w.product_id, w.i + 1 AS i, w.st, r.seq, r.quantity, list_max(w.st) AS b,
             r.valid AND list_max(w.st) IS NOT NULL AND list_max(w.st).q >= r.quantity AS acc
      FROM walk w JOIN req r ON r.product_id = w.product_id AND r.i = w.i + 1) z""",
    "decisions": """
SELECT w.seq, r.company_id, w.product_id, r.quantity, r.priority, w.status, w.reason, w.inventory_id,
       w.stock_before, w.stock_after, w.minimum_threshold
FROM walk w JOIN req r ON r.product_id = w.product_id AND r.i = w.i WHERE w.i > 0
UNION ALL
SELECT seq, company_id, product_id, quantity, priority, 'rejected', 'no inventory', NULL, NULL, NULL, NULL
FROM req WHERE product_id IS NULL""",
}

ALLOCATION_SQL = """
SELECT seq, company_id, product_id, quantity, priority, status, reason, inventory_id, stock_before, stock_after
FROM decisions"""


def _recursive(sql: str, extra: dict | None = None):
    """Mark the query as recursive: the oracle text must start with WITH RECURSIVE."""
    return sql, {**ALLOC_CTES, **(extra or {})}


_sql, _ctes = _recursive(ALLOCATION_SQL)
register("order_allocation", _sql, ctes=_ctes)(lambda t: allocation.allocate_orders(t)[0])

_sql, _ctes = _recursive("""
SELECT status, reason, COUNT(*) AS requests, CAST(SUM(quantity) AS BIGINT) AS units
FROM decisions GROUP BY status, reason""")
register("allocation_summary", _sql, ctes=_ctes)(lambda t: allocation.allocation_summary(t))

_sql, _ctes = _recursive(f"""
SELECT i.inventory_id, i.product_id, i.warehouse_id,
       COALESCE(f.stock_after, i.quantity_available) AS quantity_available, i.reserved_quantity,
       CASE WHEN f.stock_after IS NOT NULL THEN {AS_OF} ELSE i.last_updated END AS last_updated,
       i.minimum_threshold,
       CASE WHEN f.stock_after IS NULL THEN i.inventory_status WHEN f.stock_after = 0 THEN 'Out of Stock'
            WHEN f.stock_after < i.minimum_threshold THEN 'Low Stock' ELSE 'In Stock' END AS inventory_status
FROM d_inventory i LEFT JOIN final_stock f ON i.inventory_id = f.inventory_id""", {
    "final_stock": """
SELECT inventory_id, arg_max(stock_after, seq) AS stock_after FROM decisions
WHERE status = 'accepted' GROUP BY inventory_id"""})
register("inventory_after_allocation", _sql, ctes=_ctes)(lambda t: allocation.allocate_orders(t)[2])

_sql, _ctes = _recursive("""
SELECT a.product_id, a.units AS accepted_units, b.before_units, b.after_units,
       b.before_units - b.after_units = a.units AND b.least >= 0 AS holds
FROM (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS units FROM decisions WHERE status = 'accepted'
      GROUP BY product_id) a
JOIN (SELECT i.product_id, CAST(SUM(i.quantity_available) AS BIGINT) AS before_units,
             CAST(SUM(COALESCE(f.stock_after, i.quantity_available)) AS BIGINT) AS after_units,
             MIN(COALESCE(f.stock_after, i.quantity_available)) AS least
      FROM d_inventory i LEFT JOIN (SELECT inventory_id, arg_max(stock_after, seq) AS stock_after FROM decisions
                                    WHERE status = 'accepted' GROUP BY inventory_id) f USING (inventory_id)
      GROUP BY i.product_id) b ON a.product_id = b.product_id""")
register("order_allocation_invariants", _sql, ctes=_ctes)(lambda t: allocation.allocation_invariants(t))

register("best_stock_row", """
SELECT product_id, inventory_id, quantity_available FROM (
  SELECT i.*, row_number() OVER (PARTITION BY i.product_id ORDER BY i.quantity_available DESC, i.inventory_id) AS place
  FROM d_inventory i WHERE i.quantity_available IS NOT NULL
    AND EXISTS (SELECT 1 FROM d_product p WHERE p.product_id = i.product_id)) x WHERE place = 1""")(
    lambda t: allocation.best_stock_row(t.inventory, t.product))

# ---------------------------------------------------------------------------------
# E1 / E2 / E4 — trigger batch twins; E3 — the stateful stream
# ---------------------------------------------------------------------------------
_SEV = ("CASE WHEN new_quantity = 0 THEN 'Critical' WHEN CAST(new_quantity AS BIGINT) * 10 "
        "< CAST(new_threshold AS BIGINT) * 3 THEN 'High' ELSE 'Medium' END")


def _inventory_events_sql(changes: str) -> str:
    return f"""
SELECT seq, 'Inventory' AS entity_type, inventory_id AS entity_id, 'Low Stock' AS risk_type,
       {_SEV} AS risk_severity, {AS_OF} AS detected_date,
       'Auto-detected: Stock at ' || CAST(new_quantity AS VARCHAR) || ' units, below threshold of '
         || CAST(new_threshold AS VARCHAR) || ' units' AS description,
       'Open' AS resolution_status
FROM (SELECT * FROM {changes}
      WHERE COALESCE(new_quantity < new_threshold AND (old_quantity >= old_threshold OR old_quantity IS NULL), FALSE)
      QUALIFY row_number() OVER (PARTITION BY inventory_id ORDER BY seq) = 1) c
WHERE NOT EXISTS (SELECT 1 FROM d_risk_event r WHERE r.entity_type = 'Inventory' AND r.entity_id = c.inventory_id
                    AND r.risk_type = 'Low Stock' AND r.resolution_status IN ('Open', 'Investigating'))"""


SHIPMENT_EVENTS_SQL = f"""
SELECT seq, 'Shipment' AS entity_type, shipment_id AS entity_id, 'Delayed Delivery' AS risk_type,
       'High' AS risk_severity, {AS_OF} AS detected_date,
       'Auto-detected: Shipment #' || CAST(shipment_id AS VARCHAR) || ' status changed to Delayed' AS description,
       'Open' AS resolution_status
FROM (SELECT * FROM d_shipment_change
      WHERE COALESCE(new_status = 'Delayed' AND old_status <> 'Delayed', FALSE)
      QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY seq) = 1) c
WHERE NOT EXISTS (SELECT 1 FROM d_risk_event r WHERE r.entity_type = 'Shipment' AND r.entity_id = c.shipment_id
                    AND r.risk_type = 'Delayed Delivery' AND r.resolution_status IN ('Open', 'Investigating'))"""

register("inventory_risk_events", _inventory_events_sql("d_inventory_change"))(
    lambda t: triggers.inventory_risk_events(t.inventory_change, t.risk_event, t.as_of))
register("shipment_delay_events", SHIPMENT_EVENTS_SQL)(
    lambda t: triggers.shipment_delay_events(t.shipment_change, t.risk_event, t.as_of))
_VALID = ", ".join(f"'{s}'" for s in SHIPMENT_STATUSES)
register("shipment_update_delay_events", SHIPMENT_EVENTS_SQL.replace("d_shipment_change", "status_change"), ctes={
    "status_change": f"""
SELECT c.seq, c.shipment_id, c.new_status,
       CASE WHEN row_number() OVER w = 1 THEN s.shipment_status ELSE lag(c.new_status) OVER w END AS old_status
FROM d_shipment_change c JOIN d_shipment s ON s.shipment_id = c.shipment_id
WHERE c.new_status IN ({_VALID}) WINDOW w AS (PARTITION BY c.shipment_id ORDER BY c.seq)"""})(
    lambda t: triggers.shipment_delay_events(shipments.status_changes(t.shipment, t.shipment_change), t.risk_event, t.as_of))

# The stream with its closes: a key creates its first risk at the first crossing after all of its
# open risks were closed, and none while one stays open.
_OPEN = "resolution_status IN ('Open', 'Investigating')"


def _stream_sql(entity: str, risk: str, changes: str, key: str, fires: str, severity: str, text: str) -> str:
    return f"""
SELECT c.seq, '{entity}' AS entity_type, c.{key} AS entity_id, '{risk}' AS risk_type, {severity} AS risk_severity,
       {AS_OF} AS detected_date, {text} AS description, 'Open' AS resolution_status
FROM (SELECT x.* FROM {changes} x
      LEFT JOIN (SELECT r.entity_id, COUNT(*) AS n, COUNT(q.seq) AS closed, MAX(q.seq) AS last_close
                 FROM d_risk_event r
                 LEFT JOIN (SELECT risk_id, MIN(seq) AS seq FROM d_risk_resolution GROUP BY risk_id) q USING (risk_id)
                 WHERE r.entity_type = '{entity}' AND r.risk_type = '{risk}' AND r.{_OPEN} GROUP BY r.entity_id) k
        ON k.entity_id = x.{key}
      WHERE COALESCE({fires}, FALSE) AND (k.n IS NULL OR (k.closed = k.n AND x.seq >= k.last_close))
      QUALIFY row_number() OVER (PARTITION BY x.{key} ORDER BY x.seq) = 1) c"""


RISK_STREAM_SQL = _stream_sql(
    "Inventory", "Low Stock", "d_inventory_change", "inventory_id",
    "new_quantity < new_threshold AND (old_quantity >= old_threshold OR old_quantity IS NULL)", _SEV,
    "'Auto-detected: Stock at ' || CAST(new_quantity AS VARCHAR) || ' units, below threshold of ' "
    "|| CAST(new_threshold AS VARCHAR) || ' units'") + "\nUNION ALL" + _stream_sql(
    "Shipment", "Delayed Delivery", "d_shipment_change", "shipment_id",
    "new_status = 'Delayed' AND old_status <> 'Delayed'", "'High'",
    "'Auto-detected: Shipment #' || CAST(shipment_id AS VARCHAR) || ' status changed to Delayed'")
register("risk_state_stream", RISK_STREAM_SQL, needs_spark=True)(lambda spark, t: risk_state.risk_state_stream(spark, t))

_sql, _ctes = _recursive(_inventory_events_sql("alloc_changes"), {
    "alloc_changes": """
SELECT seq, inventory_id, stock_before AS old_quantity, stock_after AS new_quantity,
       minimum_threshold AS old_threshold, minimum_threshold AS new_threshold
FROM decisions WHERE status = 'accepted'"""})
register("allocation_risk_events", _sql, ctes=_ctes)(lambda t: allocation.allocation_risk_events(t))
