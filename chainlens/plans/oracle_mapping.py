"""The FIXTURES.md §2 mapping as DuckDB SQL common table expressions.

Each oracle query names the domain tables it reads as ``d_<table>``; :func:`with_mapping`
prepends only the CTEs it (transitively) needs.  The raw driver tables are visible to
DuckDB under their own names, which is why the domain CTEs carry a prefix.
"""

from __future__ import annotations

import re

AS_OF_SQL = "DATE '1998-06-15'"

PRIORITY_SQL = ("CASE WHEN {c} LIKE '1-%' THEN 'Critical' WHEN {c} LIKE '2-%' THEN 'High' "
                "WHEN {c} LIKE '3-%' THEN 'Medium' ELSE 'Low' END")

MAPPING: dict[str, str] = {
    "d_company": """
SELECT CAST(n.n_nationkey AS BIGINT) AS company_id, n.n_name AS company_name, r.r_name AS industry,
       r.r_name AS country, CAST(NULL AS VARCHAR) AS contact_email, CAST(NULL AS VARCHAR) AS contact_phone,
       CAST(NULL AS DATE) AS created_at, 'Active' AS status
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "d_supplier": """
SELECT s.s_suppkey AS supplier_id, s.s_name AS supplier_name, CAST(s.s_nationkey AS BIGINT) AS company_id,
       n.n_name AS country, CAST(5 + s.s_suppkey % 21 AS INTEGER) AS lead_time_days,
       CAST((60 + (s.s_suppkey * 37) % 40) / 100.0 AS DECIMAL(3,2)) AS reliability_score,
       CAST(NULL AS VARCHAR) AS contact_email, s.s_acctbal >= 0 AS active_status
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "d_product": """
SELECT p.p_partkey AS product_id, p.p_name AS product_name,
       p.p_partkey % (SELECT COUNT(*) FROM supplier) AS supplier_id, p.p_type AS category,
       CAST(p.p_retailprice AS DECIMAL(12,2)) AS unit_price, p.p_size AS reorder_level,
       CAST(NULL AS DECIMAL(8,2)) AS weight_kg, TRUE AS active_status
FROM part p""",
    "d_warehouse": """
SELECT CAST(r.r_regionkey AS BIGINT) AS warehouse_id, r.r_name AS warehouse_name, r.r_name AS location_city,
       r.r_name AS location_country, CAST(10000 * (r.r_regionkey + 1) AS INTEGER) AS capacity_units,
       CAST(NULL AS VARCHAR) AS manager_name, CAST(NULL AS VARCHAR) AS contact_number, TRUE AS active_status
FROM region r""",
    "d_inventory": """
SELECT inventory_id, product_id, warehouse_id, quantity_available, reserved_quantity, last_updated,
       minimum_threshold,
       CASE WHEN quantity_available = 0 THEN 'Out of Stock'
            WHEN quantity_available < minimum_threshold THEN 'Low Stock' ELSE 'In Stock' END AS inventory_status
FROM (
  SELECT l.l_partkey * 5 + n.n_regionkey AS inventory_id, l.l_partkey AS product_id,
         CAST(n.n_regionkey AS BIGINT) AS warehouse_id,
         CAST(CAST(SUM(l.l_quantity) AS BIGINT) % 97 AS INTEGER) AS quantity_available,
         0 AS reserved_quantity, CAST(MAX(l.l_shipdate) AS DATE) AS last_updated,
         CAST(2 * p.p_size AS INTEGER) AS minimum_threshold
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_partkey, n.n_regionkey, p.p_size) x""",
    "d_shipment": """
SELECT l_orderkey * 8 + l_linenumber AS shipment_id, l_partkey AS product_id, l_suppkey AS supplier_id,
       CAST(l_quantity AS INTEGER) AS quantity_shipped, CAST(l_shipdate AS DATE) AS expected_delivery_date,
       CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 11 - 5 AS INTEGER) END
         AS actual_delivery_date,
       CASE WHEN l_linestatus = 'F' THEN 'Delivered' WHEN l_returnflag = 'R' THEN 'Cancelled'
            WHEN l_returnflag = 'A' THEN 'Delayed' WHEN l_returnflag = 'N' THEN 'In Transit' END
         AS shipment_status,
       CASE l_linenumber % 4 WHEN 0 THEN 'Air' WHEN 1 THEN 'Sea' WHEN 2 THEN 'Road' WHEN 3 THEN 'Rail' END
         AS transport_mode
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn
      FROM lineitem) WHERE rn = 1""",
    "d_orders": f"""
SELECT o.o_orderkey AS order_id, CAST(c.c_nationkey AS BIGINT) AS company_id,
       o.o_orderkey % (SELECT COUNT(*) FROM part) AS product_id,
       CAST(1 + o.o_orderkey % 50 AS INTEGER) AS order_quantity, CAST(o.o_orderdate AS DATE) AS order_date,
       CAST(o.o_orderdate AS DATE) + 14 AS expected_fulfill_date,
       CASE o.o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Processing' END
         AS order_status,
       {PRIORITY_SQL.format(c="o.o_orderpriority")} AS priority_level
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "d_risk_event": """
SELECT risk_id, entity_type, entity_id, risk_type,
       CASE WHEN value >= 150 THEN 'Critical' WHEN value >= 80 THEN 'High' WHEN value >= 20 THEN 'Medium'
            ELSE 'Low' END AS risk_severity,
       CAST(ts AS DATE) AS detected_date,
       risk_type || ' on ' || entity_type || ' #' || CAST(entity_id AS VARCHAR) AS description,
       CASE k % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Investigating' WHEN 2 THEN 'Resolved' WHEN 3 THEN 'Dismissed' END
         AS resolution_status
FROM (
  SELECT event_id AS risk_id, ts, value, k, entity_type,
         CASE entity_type
           WHEN 'Shipment' THEN (event_id % (SELECT COUNT(*) FROM orders)) * 8 + 1
           WHEN 'Inventory' THEN (event_id % (SELECT COUNT(*) FROM part)) * 5 + event_id % 5
           WHEN 'Order' THEN event_id % (SELECT COUNT(*) FROM orders)
           WHEN 'Supplier' THEN event_id % (SELECT COUNT(*) FROM supplier)
           WHEN 'Product' THEN event_id % (SELECT COUNT(*) FROM part) END AS entity_id,
         CASE WHEN entity_type = 'Shipment' THEN 'Delayed Delivery'
              WHEN entity_type = 'Inventory' THEN CASE WHEN k >= 90 THEN 'Out of Stock' ELSE 'Low Stock' END
              WHEN entity_type = 'Supplier' THEN 'Low Reliability' ELSE 'Other' END AS risk_type
  FROM (
    SELECT event_id, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CASE event_type WHEN 'view' THEN 'Shipment' WHEN 'click' THEN 'Inventory' WHEN 'purchase' THEN 'Order'
                           WHEN 'signup' THEN 'Supplier' WHEN 'error' THEN 'Product' END AS entity_type
    FROM events) e1) e2""",
    "d_app_user": """
SELECT c_custkey AS user_id, 'user_' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
       c_name AS full_name, 'company' AS role, CAST(c_nationkey AS BIGINT) AS company_id,
       CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS last_login
FROM customer""",
    "d_subscription_plan": """
SELECT * FROM (VALUES
  (CAST(1 AS BIGINT), 'Starter', CAST(0 AS DECIMAL(10,2)), 3, 10, FALSE, FALSE, FALSE, 0, FALSE, TRUE,
   CAST(NULL AS TIMESTAMP)),
  (CAST(2 AS BIGINT), 'Professional', CAST(999 AS DECIMAL(10,2)), 25, 100, TRUE, TRUE, TRUE, 50, FALSE, TRUE,
   CAST(NULL AS TIMESTAMP)),
  (CAST(3 AS BIGINT), 'Enterprise', CAST(2999 AS DECIMAL(10,2)), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER),
   TRUE, TRUE, TRUE, -1, TRUE, TRUE, CAST(NULL AS TIMESTAMP)))
  AS v(plan_id, plan_name, price_monthly, max_suppliers, max_products, has_pipeline, has_map, has_ai_chat,
       ai_chat_limit, has_export, is_active, created_at)""",
    "d_user_subscription": """
SELECT o_orderkey AS subscription_id, o_custkey AS user_id, 1 + o_orderkey % 3 AS plan_id,
       CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'O' THEN 'active' WHEN 'P' THEN 'pending' END AS status,
       'ord_' || CAST(o_orderkey AS VARCHAR) AS payment_order_id, CAST(NULL AS DECIMAL(10,2)) AS amount_paid,
       o_orderdate AS started_at, CAST(NULL AS TIMESTAMP) AS expires_at, o_orderdate AS created_at
FROM orders""",
    "d_order_request": f"""
SELECT o.o_orderkey AS seq, CAST(c.c_nationkey AS BIGINT) AS company_id,
       o.o_orderkey % (SELECT COUNT(*) FROM part) AS product_id,
       CAST(1 + o.o_orderkey % 37 AS INTEGER) AS quantity,
       {PRIORITY_SQL.format(c="o.o_orderpriority")} AS priority
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "d_inventory_change": """
SELECT CAST(seq AS BIGINT) AS seq, inventory_id,
       LAG(new_quantity) OVER (PARTITION BY inventory_id ORDER BY seq) AS old_quantity, new_quantity,
       LAG(thr) OVER (PARTITION BY inventory_id ORDER BY seq) AS old_threshold, thr AS new_threshold
FROM (
  SELECT inventory_id, thr,
         row_number() OVER w AS seq,
         CAST(CAST(SUM(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) % 97
              AS INTEGER) AS new_quantity
  FROM (SELECT l.l_partkey * 5 + n.n_regionkey AS inventory_id, l.l_quantity, l.l_shipdate, l.l_orderkey,
               l.l_linenumber, l.l_suppkey, l.l_extendedprice, CAST(2 * p.p_size AS INTEGER) AS thr
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
             JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey) x
  WINDOW w AS (PARTITION BY inventory_id
               ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) y
QUALIFY seq > 1""",
    "d_shipment_change": """
SELECT seq, shipment_id, old_status, new_status FROM (
  SELECT event_id AS seq, user_id AS shipment_id,
         LAG(new_status) OVER (PARTITION BY user_id ORDER BY event_id) AS old_status, new_status,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM (SELECT event_id, user_id,
               CASE event_type WHEN 'view' THEN 'In Transit' WHEN 'click' THEN 'In Transit'
                               WHEN 'purchase' THEN 'Delivered' WHEN 'error' THEN 'Delayed'
                               WHEN 'signup' THEN 'Cancelled' END AS new_status
        FROM events) e) x
WHERE rn > 1""",
    "d_risk_resolution": """
SELECT event_id AS seq,
       (event_id * 37 + 11) % ((SELECT COUNT(*) FROM events) + (SELECT COUNT(*) FROM events) // 10) AS risk_id,
       CASE WHEN event_type = 'signup' THEN 'delete' ELSE 'resolve' END AS action
FROM events""",
    "d_payment": """
SELECT o_orderkey AS seq, o_custkey AS user_id, 'ord_' || CAST(o_orderkey AS VARCHAR) AS payment_order_id,
       o_orderdate + INTERVAL 1 DAY AS paid_at
FROM orders WHERE o_orderstatus = 'P'""",
    "d_conversations": "SELECT * FROM conversations",
}

_NAME = re.compile(r"\bd_[a-z_]+\b")


def _deps(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in MAPPING]


def with_mapping(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the mapping CTEs it references (dependencies first).

    ``extra`` adds query-local CTEs (name → body) that may themselves reference the
    mapping; they are emitted after the mapping CTEs, in the given order."""
    extra = extra or {}
    order: list[str] = []

    def visit(name: str):
        if name in order:
            return
        for d in _deps(MAPPING[name]):
            if d != name:
                visit(d)
        order.append(name)

    for body in list(extra.values()) + [sql]:
        for d in _deps(body):
            visit(d)
    ctes = [f"{n} AS ({MAPPING[n].strip()})" for n in order]
    ctes += [f"{n} AS ({b.strip()})" for n, b in extra.items()]
    recursive = any(re.search(rf"\b{re.escape(n)}\b", b) for n, b in extra.items())
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" + sql.strip()) if ctes else sql.strip()
