"""Registered queries, part 2: risk jobs, state changes, integrity, subscriptions,
labels/reports, context documents and conversations."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from chainlens.functions import scalars as X
from chainlens.operators import alerts, context, kpis, listings, quality, risks, shipments, subscriptions
from chainlens.plans.catalog import (AS_OF, CID, COMPANY_ROLLUP_SQL, LOW_INV_SQL, ORDERS_SQL,  # noqa: F401
                                     RISKS_BY_COMPANY_SQL)
from chainlens.plans.registry import register
from chainlens.schema import (FOREIGN_KEYS, PRIMARY_KEYS, RISK_DELAYED, RISK_LOW_STOCK, SCAN_LOW_STOCK, SCAN_OVERDUE,
                              SHIPMENT_STATUSES)

# The severity ladders as SQL; the Spark form is in ``functions/scalars.py``.
STOCK_SEVERITY_SQL = """CASE WHEN quantity_available = 0 THEN 'Critical'
                  WHEN CAST(quantity_available AS BIGINT) * 10 < CAST(minimum_threshold AS BIGINT) * 3 THEN 'High'
                  ELSE 'Medium' END"""
OVERDUE_SEVERITY_SQL = "CASE WHEN days > 10 THEN 'Critical' WHEN days > 5 THEN 'High' ELSE 'Medium' END"


def message_sql(template: str, **columns: str) -> str:
    """A fixed message with its {placeholders} taken from columns."""
    sql = f"'{template}'"
    for name, column in columns.items():
        sql = f"replace({sql}, '{{{name}}}', CAST({column} AS VARCHAR))"
    return sql


# ---------------------------------------------------------------------------------
# M2 — bulk risk detection
# ---------------------------------------------------------------------------------
# One kind of risk per branch, each from its definition: the condition (F2, F3), the severity ladder
# (R3, R4), the message, and no open risk of that kind on the row.
_NO_OPEN_RISK = """NOT EXISTS (SELECT 1 FROM d_risk_event r WHERE r.entity_type = n.entity_type AND r.entity_id = n.entity_id
      AND r.risk_type = n.risk_type AND r.resolution_status IN ('Open', 'Investigating'))"""
DETECT_SQL = f"""
SELECT n.entity_type, n.entity_id, n.risk_type, n.risk_severity, {AS_OF} AS detected_date, n.description, 'Open' AS resolution_status
FROM (SELECT 'Inventory' AS entity_type, inventory_id AS entity_id, '{RISK_LOW_STOCK}' AS risk_type,
             {STOCK_SEVERITY_SQL} AS risk_severity,
             {message_sql(SCAN_LOW_STOCK, quantity='quantity_available', threshold='minimum_threshold')} AS description
      FROM d_inventory WHERE quantity_available < minimum_threshold) n
WHERE {_NO_OPEN_RISK}
UNION ALL
SELECT n.entity_type, n.entity_id, n.risk_type, n.risk_severity, {AS_OF} AS detected_date, n.description, 'Open' AS resolution_status
FROM (SELECT 'Shipment' AS entity_type, shipment_id AS entity_id, '{RISK_DELAYED}' AS risk_type,
             {OVERDUE_SEVERITY_SQL} AS risk_severity,
             {message_sql(SCAN_OVERDUE, shipment='shipment_id', days='days')} AS description
      FROM (SELECT *, {AS_OF} - expected_delivery_date AS days FROM d_shipment) d
      WHERE actual_delivery_date IS NULL AND expected_delivery_date < {AS_OF}) n
WHERE {_NO_OPEN_RISK}"""

register("detect_risks", DETECT_SQL)(lambda t: risks.detect_risks(t))
register("detect_risks_count", """
SELECT risk_type, risk_severity, COUNT(*) AS new_risks FROM new_risks GROUP BY risk_type, risk_severity""",
         ctes={"new_risks": DETECT_SQL})(lambda t: risks.detect_risks_count(t))

register("append_if_absent", f"""
SELECT * FROM d_risk_event
UNION ALL
SELECT CAST(NULL AS BIGINT) AS risk_id, n.* FROM new_risks n
WHERE NOT EXISTS (SELECT 1 FROM d_risk_event r WHERE r.entity_type = n.entity_type AND r.entity_id = n.entity_id
                    AND r.risk_type = n.risk_type AND r.detected_date = n.detected_date)""",
         ctes={"new_risks": DETECT_SQL})(
    lambda t: quality.append_if_absent(t.risk_event, risks.detect_risks(t),
                                       ["entity_type", "entity_id", "risk_type", "detected_date"]))

# ---------------------------------------------------------------------------------
# M3 / M4 — resolve and dismiss
# ---------------------------------------------------------------------------------
register("resolve_risks", """
SELECT r.risk_id, r.entity_type, r.entity_id, r.risk_type, r.risk_severity, r.detected_date, r.description,
       CASE WHEN q.risk_id IS NOT NULL AND r.resolution_status IN ('Open', 'Investigating') THEN 'Resolved'
            ELSE r.resolution_status END AS resolution_status
FROM d_risk_event r
     LEFT JOIN (SELECT DISTINCT risk_id FROM d_risk_resolution WHERE action = 'resolve') q ON r.risk_id = q.risk_id""")(
    lambda t: risks.resolve_risks(t.risk_event, t.risk_resolution.filter(F.col("action") == "resolve"))[0])

register("resolve_risks_not_found", """
SELECT DISTINCT q.risk_id FROM d_risk_resolution q
WHERE q.action = 'resolve'
  AND NOT EXISTS (SELECT 1 FROM d_risk_event r
                  WHERE r.risk_id = q.risk_id AND r.resolution_status IN ('Open', 'Investigating'))""")(
    lambda t: risks.resolve_risks(t.risk_event, t.risk_resolution.filter(F.col("action") == "resolve"))[1])

register("dismiss_risks", """
SELECT r.* FROM d_risk_event r
WHERE NOT EXISTS (SELECT 1 FROM d_risk_resolution q WHERE q.action = 'delete' AND q.risk_id = r.risk_id)""")(
    lambda t: risks.dismiss_risks(t.risk_event, t.risk_resolution.filter(F.col("action") == "delete"))[0])

register("dismiss_risks_missing", """
SELECT DISTINCT q.risk_id FROM d_risk_resolution q
WHERE q.action = 'delete' AND NOT EXISTS (SELECT 1 FROM d_risk_event r WHERE r.risk_id = q.risk_id)""")(
    lambda t: risks.dismiss_risks(t.risk_event, t.risk_resolution.filter(F.col("action") == "delete"))[1])

# ---------------------------------------------------------------------------------
# M5 — shipment status updates; R5 stock status
# ---------------------------------------------------------------------------------
_VALID = ", ".join(f"'{s}'" for s in SHIPMENT_STATUSES)
register("update_shipments", f"""
SELECT s.shipment_id, s.product_id, s.supplier_id, s.quantity_shipped, s.expected_delivery_date,
       CASE WHEN COALESCE(u.delivered, FALSE) THEN {AS_OF} ELSE s.actual_delivery_date END AS actual_delivery_date,
       COALESCE(u.last_status, s.shipment_status) AS shipment_status, s.transport_mode
FROM d_shipment s
     LEFT JOIN (SELECT shipment_id, arg_max(new_status, seq) AS last_status,
                       bool_or(new_status = 'Delivered') AS delivered
                FROM d_shipment_change WHERE new_status IN ({_VALID}) GROUP BY shipment_id) u
       ON s.shipment_id = u.shipment_id""")(
    lambda t: shipments.update_shipments(t.shipment, t.shipment_change, t.as_of)[0])

register("update_shipments_rejected", f"""
SELECT c.*, 'not found' AS reason FROM d_shipment_change c
WHERE NOT EXISTS (SELECT 1 FROM d_shipment s WHERE s.shipment_id = c.shipment_id)
UNION ALL
SELECT c.*, 'invalid status' FROM d_shipment_change c
WHERE EXISTS (SELECT 1 FROM d_shipment s WHERE s.shipment_id = c.shipment_id)
  AND NOT COALESCE(c.new_status IN ({_VALID}), FALSE)""")(
    lambda t: shipments.update_shipments(t.shipment, t.shipment_change, t.as_of)[1])

register("stock_status_recomputed", """
SELECT inventory_id, quantity_available, minimum_threshold, inventory_status,
       CASE WHEN quantity_available = 0 THEN 'Out of Stock' WHEN quantity_available < minimum_threshold
            THEN 'Low Stock' ELSE 'In Stock' END AS recomputed_status,
       COALESCE(inventory_status, CASE WHEN COALESCE(quantity_available, 0) < COALESCE(minimum_threshold, 0)
                                       THEN 'Low Stock' ELSE 'In Stock' END) AS display_status
FROM d_inventory""")(
    lambda t: t.inventory.select(
        "inventory_id", "quantity_available", "minimum_threshold", "inventory_status",
        X.stock_status("quantity_available", "minimum_threshold").alias("recomputed_status"),
        F.coalesce(F.col("inventory_status"),
                   F.when(F.coalesce(F.col("quantity_available"), F.lit(0))
                          < F.coalesce(F.col("minimum_threshold"), F.lit(0)), "Low Stock")
                   .otherwise("In Stock")).alias("display_status")))

# ---------------------------------------------------------------------------------
# R9 — insight banners
# ---------------------------------------------------------------------------------
KPI_BY_COMPANY_SQL = f"""
SELECT c.company_id,
  (SELECT COUNT(*) FROM d_inventory i JOIN d_product p ON i.product_id = p.product_id
    JOIN d_supplier s ON p.supplier_id = s.supplier_id
    WHERE s.company_id = c.company_id AND i.quantity_available < i.minimum_threshold) AS low_inventory_alerts,
  (SELECT COUNT(*) FROM d_shipment sh JOIN d_supplier s ON sh.supplier_id = s.supplier_id
    WHERE s.company_id = c.company_id AND sh.actual_delivery_date IS NULL
      AND sh.expected_delivery_date < {AS_OF}) AS delayed_shipment_alerts,
  (SELECT COUNT(*) FROM d_risk_event WHERE resolution_status IN ('Open', 'Investigating')) AS open_risks
FROM d_company c"""


def _sql_fmt(template: str) -> str:
    s = "'" + template.replace("'", "''") + "'"
    for k, col in (("{d}", "delayed_shipment_alerts"), ("{l}", "low_inventory_alerts"), ("{r}", "open_risks")):
        s = s.replace(k, f"' || CAST({col} AS VARCHAR) || '")
    return s


_L = kpis.LEGACY_INSIGHT
register("insight_by_company", f"""
SELECT company_id, insight_level,
       CASE insight_level WHEN 'critical' THEN {_sql_fmt(_L['critical'])} WHEN 'delays' THEN {_sql_fmt(_L['delays'])}
            WHEN 'low_stock' THEN {_sql_fmt(_L['low_stock'])} WHEN 'risks' THEN {_sql_fmt(_L['risks'])}
            ELSE {_sql_fmt(_L['normal'])} END AS insight_text,
       CASE WHEN open_risks > 0 THEN {_sql_fmt(kpis.REACT_INSIGHT_WARN)}
            ELSE {_sql_fmt(kpis.REACT_INSIGHT_OK)} END AS banner_text,
       CASE WHEN low_inventory_alerts > 3 THEN 'up' WHEN low_inventory_alerts = 0 THEN 'neutral' ELSE 'down' END
         AS trend_low,
       CASE WHEN delayed_shipment_alerts > 3 THEN 'up' WHEN delayed_shipment_alerts = 0 THEN 'neutral'
            ELSE 'down' END AS trend_delayed,
       CASE WHEN open_risks > 3 THEN 'up' WHEN open_risks = 0 THEN 'neutral' ELSE 'down' END AS trend_risks
FROM (SELECT *, CASE WHEN delayed_shipment_alerts > 5 AND low_inventory_alerts > 5 THEN 'critical'
                     WHEN delayed_shipment_alerts > 3 THEN 'delays' WHEN low_inventory_alerts > 3 THEN 'low_stock'
                     WHEN open_risks > 3 THEN 'risks' ELSE 'normal' END AS insight_level
      FROM kpi) k""", ctes={"kpi": KPI_BY_COMPANY_SQL})(lambda t: kpis.insight_by_company(t))

# ---------------------------------------------------------------------------------
# X9–X11 — labels, display dates, class lookups
# ---------------------------------------------------------------------------------


def _sql_lookup(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE '{default}' END"


def _sql_trunc(col: str, n: int) -> str:
    return f"CASE WHEN length({col}) > {n} THEN substring({col}, 1, {n}) || '…' ELSE {col} END"


register("order_report", f"""
SELECT order_id, company_id, company_name, product_name, order_status, priority_level,
       COALESCE(strftime(order_date, '%d %b %Y'), '—') AS order_date_display,
       COALESCE(strftime(expected_fulfill_date, '%d %b %Y'), '—') AS fulfil_date_display,
       {_sql_lookup('order_status', X.LEGACY_STATUS_CLASS, 'muted')} AS status_class,
       {_sql_lookup('priority_level', X.LEGACY_PRIORITY_CLASS, 'muted')} AS priority_class,
       {_sql_lookup('order_status', X.STATUS_BADGE, 'info')} AS status_badge,
       {_sql_trunc('product_name', 18)} AS product_label
FROM ({ORDERS_SQL}) o""")(
    lambda t: listings.list_orders(t).select(
        "order_id", "company_id", "company_name", "product_name", "order_status", "priority_level",
        X.display_date("order_date").alias("order_date_display"),
        X.display_date("expected_fulfill_date").alias("fulfil_date_display"),
        X.lookup("order_status", X.LEGACY_STATUS_CLASS, "muted").alias("status_class"),
        X.lookup("priority_level", X.LEGACY_PRIORITY_CLASS, "muted").alias("priority_class"),
        X.lookup("order_status", X.STATUS_BADGE, "info").alias("status_badge"),
        X.truncate_label("product_name", 18).alias("product_label")))

register("short_labels", f"""
SELECT supplier_id, {_sql_trunc('supplier_name', 14)} AS supplier_label,
       CAST(ROUND(COALESCE(reliability_score, 0) * 100, 0) AS INTEGER) AS reliability_pct
FROM d_supplier""")(
    lambda t: t.supplier.select("supplier_id", X.truncate_label("supplier_name", 14).alias("supplier_label"),
                                X.reliability_pct("reliability_score").alias("reliability_pct")))

# ---------------------------------------------------------------------------------
# Q1–Q5 — integrity jobs
# ---------------------------------------------------------------------------------
register("orders_with_defaults", f"""
SELECT seq AS order_id, company_id, product_id, quantity AS order_quantity, {AS_OF} AS order_date,
       CAST(NULL AS DATE) AS expected_fulfill_date, 'Pending' AS order_status, priority AS priority_level
FROM d_order_request""")(
    lambda t: quality.apply_defaults(
        t.order_request.select(F.col("seq").alias("order_id"), "company_id", "product_id",
                               F.col("quantity").alias("order_quantity"),
                               F.col("priority").alias("priority_level")), "orders", t.as_of))


def _violation_count_sql() -> str:
    parts = []
    for table, rules in quality.constraint_rules().items():
        for name, cond in rules:
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS rule, "
                         f"COUNT(*) FILTER (WHERE {quality.violated_sql(cond)}) AS violations FROM d_{table}")
    return "\nUNION ALL\n".join(parts)


register("check_violations", _violation_count_sql())(lambda t: quality.check_violation_counts(t))

def _violation_rows_sql() -> str:
    parts = []
    for table, rules in quality.constraint_rules().items():
        pk = PRIMARY_KEYS[table][0]
        for name, cond in rules:
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS rule, {pk} AS row_key FROM d_{table} "
                         f"WHERE {quality.violated_sql(cond)}")
    return "\nUNION ALL\n".join(parts)


register("violation_rows", _violation_rows_sql())(lambda t: quality.check_violations(t))


def _domain_keys_sql() -> str:
    keys = [*PRIMARY_KEYS.items(), *((n, k) for n, ks in quality.UNIQUE_KEYS.items() for k in ks)]
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{','.join(key)}' AS key_columns, CAST({key[0]} AS VARCHAR) AS key_value, "
        f"COUNT(*) AS n FROM d_{table} WHERE {key[0]} IS NOT NULL GROUP BY {key[0]} HAVING COUNT(*) > 1" for table, key in keys)


register("domain_key_violations", _domain_keys_sql())(lambda t: quality.domain_key_violations(t))

register("duplicate_keys", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")(
    lambda t: quality.key_violations(t.raw("lineitem"), ["l_orderkey", "l_linenumber"]))


def _fk_sql() -> str:
    parts = []
    for child, fk, parent, pk, _ in FOREIGN_KEYS:
        parts.append(f"SELECT '{child}' AS child_table, '{fk}' AS fk_column, '{parent}' AS parent_table, "
                     f"COUNT(*) AS orphans FROM d_{child} c WHERE c.{fk} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM d_{parent} p WHERE p.{pk} = c.{fk})")
    return "\nUNION ALL\n".join(parts)


register("fk_orphans", _fk_sql())(lambda t: quality.fk_orphan_counts(t))

_ENTITY_KEYS_SQL = "\nUNION ALL ".join(
    f"SELECT '{et}' AS entity_type, {pk} AS entity_id FROM d_{tbl}"
    for et, (tbl, pk) in quality.ENTITY_TABLES.items())
register("risk_dangling_refs", f"""
SELECT r.risk_id, r.entity_type, r.entity_id, r.risk_type FROM d_risk_event r
WHERE NOT EXISTS (SELECT 1 FROM ({_ENTITY_KEYS_SQL}) k
                  WHERE k.entity_type = r.entity_type AND k.entity_id = r.entity_id)""")(
    lambda t: quality.risk_dangling_refs(t))


def _purge(t):
    ids = t.company.filter(F.col("company_id") == CID).select("company_id")
    p = quality.purge_companies(t, ids)
    counts = quality.table_counts(p, ["company", "supplier", "product", "inventory", "shipment", "orders",
                                      "app_user"])
    unassigned = p.app_user.filter(F.col("company_id").isNull()).agg(
        F.count(F.lit(1)).alias("row_count")).select(F.lit("app_user_without_company").alias("table_name"),
                                                     "row_count")
    return counts.unionByName(unassigned)


register("purge_company_counts", f"""
SELECT 'company' AS table_name, COUNT(*) AS row_count FROM d_company WHERE company_id IS DISTINCT FROM {CID}
UNION ALL SELECT 'supplier', COUNT(*) FROM d_supplier WHERE company_id IS DISTINCT FROM {CID}
UNION ALL SELECT 'product', COUNT(*) FROM d_product p
  WHERE NOT EXISTS (SELECT 1 FROM gs WHERE gs.supplier_id = p.supplier_id)
UNION ALL SELECT 'inventory', COUNT(*) FROM d_inventory i
  WHERE NOT EXISTS (SELECT 1 FROM gp WHERE gp.product_id = i.product_id)
UNION ALL SELECT 'shipment', COUNT(*) FROM d_shipment sh
  WHERE NOT EXISTS (SELECT 1 FROM gp WHERE gp.product_id = sh.product_id)
    AND NOT EXISTS (SELECT 1 FROM gs WHERE gs.supplier_id = sh.supplier_id)
UNION ALL SELECT 'orders', COUNT(*) FROM d_orders o
  WHERE o.company_id IS DISTINCT FROM {CID} AND NOT EXISTS (SELECT 1 FROM gp WHERE gp.product_id = o.product_id)
UNION ALL SELECT 'app_user', COUNT(*) FROM d_app_user
UNION ALL SELECT 'app_user_without_company', COUNT(*) FROM d_app_user
  WHERE company_id IS NULL OR company_id = {CID}""",
         ctes={"gs": f"SELECT supplier_id FROM d_supplier WHERE company_id = {CID}",
               "gp": "SELECT product_id FROM d_product JOIN gs USING (supplier_id)"})(_purge)

register("orders_json", f"""
SELECT order_id, CAST(order_date AS VARCHAR) AS j_order_date, CAST(order_quantity AS VARCHAR) AS j_order_quantity,
       company_name AS j_company_name, order_status AS j_order_status
FROM ({ORDERS_SQL}) o""")(
    lambda t: quality.to_json_rows(listings.list_orders(t, ordered=False), "order_id").select(
        "order_id", F.get_json_object("json", "$.order_date").alias("j_order_date"),
        F.get_json_object("json", "$.order_quantity").alias("j_order_quantity"),
        F.get_json_object("json", "$.company_name").alias("j_company_name"),
        F.get_json_object("json", "$.order_status").alias("j_order_status")))

# ---------------------------------------------------------------------------------
# P1–P3 — subscriptions
# ---------------------------------------------------------------------------------
register("active_subscription", """
SELECT us.*, sp.plan_name, sp.price_monthly, sp.max_suppliers, sp.max_products, sp.has_pipeline, sp.has_map,
       sp.has_ai_chat, sp.ai_chat_limit, sp.has_export
FROM (SELECT * FROM d_user_subscription WHERE status = 'active'
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST,
                                                                subscription_id DESC) = 1) us
     JOIN d_subscription_plan sp ON us.plan_id = sp.plan_id""")(lambda t: subscriptions.active_subscription(t))

register("assign_default_plan", """
SELECT u.user_id, sp.plan_id, 'active' AS status, CAST(0 AS DECIMAL(10,2)) AS amount_paid,
       CAST(NULL AS TIMESTAMP) AS expires_at
FROM d_app_user u CROSS JOIN (SELECT plan_id FROM d_subscription_plan WHERE plan_name = 'Starter') sp
WHERE NOT EXISTS (SELECT 1 FROM d_user_subscription us WHERE us.user_id = u.user_id AND us.status = 'active')""")(
    lambda t: subscriptions.assign_default_plan(t))

register("activate_subscriptions", """
SELECT s.subscription_id, s.user_id, s.plan_id,
       CASE WHEN m.pay_seq IS NOT NULL AND m.pay_seq = l.last_seq THEN 'active'
            WHEN m.pay_seq IS NOT NULL THEN 'expired'
            WHEN l.last_seq IS NOT NULL AND s.status = 'active' THEN 'expired'
            ELSE s.status END AS status,
       s.payment_order_id, s.amount_paid,
       CASE WHEN m.pay_seq IS NOT NULL THEN m.paid_at ELSE s.started_at END AS started_at,
       CASE WHEN m.pay_seq IS NOT NULL THEN m.paid_at + INTERVAL 30 DAY ELSE s.expires_at END AS expires_at,
       s.created_at
FROM d_user_subscription s LEFT JOIN matched m ON s.subscription_id = m.subscription_id
     LEFT JOIN last_pay l ON s.user_id = l.user_id""",
         ctes={"matched": """
SELECT p.subscription_id, p.user_id, MIN(pay.seq) AS pay_seq, arg_min(pay.paid_at, pay.seq) AS paid_at
FROM d_payment pay JOIN (SELECT * FROM d_user_subscription WHERE status = 'pending') p
  ON pay.user_id = p.user_id AND pay.payment_order_id = p.payment_order_id
GROUP BY p.subscription_id, p.user_id""",
               "last_pay": "SELECT user_id, MAX(pay_seq) AS last_seq FROM matched GROUP BY user_id"})(
    lambda t: subscriptions.activate_subscriptions(t))

# P2, free plan: every user with a pending payment turns to the Starter plan instead
_FREE_NOW = datetime.datetime(1998, 6, 15, 12, 0, 0)


def _free_plan(t):
    asks = (t.user_subscription.filter(F.col("status") == "pending").select("user_id").distinct()
            .select("user_id", F.lit(1).cast("bigint").alias("plan_id")))
    return subscriptions.activate_free_plan(t, asks, _FREE_NOW)


register("activate_free_plan", f"""
SELECT s.subscription_id, s.user_id, s.plan_id,
       CASE WHEN s.status = 'active' AND a.user_id IS NOT NULL THEN 'expired' ELSE s.status END AS status,
       s.payment_order_id, s.amount_paid, s.started_at, s.expires_at, s.created_at
FROM d_user_subscription s LEFT JOIN asked a ON a.user_id = s.user_id
UNION ALL
SELECT NULL, user_id, 1, 'active', NULL, CAST(0 AS DECIMAL(10, 2)), TIMESTAMP '{_FREE_NOW}', NULL, TIMESTAMP '{_FREE_NOW}'
FROM asked""", ctes={"asked": """
SELECT DISTINCT s.user_id FROM d_user_subscription s JOIN d_app_user u ON u.user_id = s.user_id
WHERE s.status = 'pending'"""})(_free_plan)

# ---------------------------------------------------------------------------------
# C1–C4 — context documents, conversation history
# ---------------------------------------------------------------------------------


def _v(col: str) -> str:
    return f"COALESCE(CAST({col} AS VARCHAR), 'None')"


CONTEXT_SECTION_SQL = {
    "companies": f"""
SELECT company_id, 1 AS section_order, 'companies' AS section, CAST(company_id AS BIGINT) AS line_key,
       '- ' || {_v('company_name')} || ' (' || {_v('industry')} || ', ' || {_v('country')} || ')' AS line
FROM d_company""",
    "suppliers": f"""
SELECT s.company_id, 2, 'suppliers', s.supplier_id,
       '- ' || {_v('s.supplier_name')} || ' (' || {_v('s.country')} || ') — reliability: '
       || CAST(CAST(ROUND(COALESCE(s.reliability_score, 0) * 100, 0) AS BIGINT) AS VARCHAR)
       || '%, lead time: ' || {_v('s.lead_time_days')} || 'd, company: ' || {_v('c.company_name')}
FROM d_supplier s JOIN d_company c ON s.company_id = c.company_id""",
    "low_stock": f"""
SELECT s.company_id, 3, 'low_stock', i.inventory_id,
       '- ' || {_v('p.product_name')} || ': ' || {_v('i.quantity_available')} || '/' || {_v('i.minimum_threshold')}
       || ' units at ' || {_v('w.warehouse_name')} || ' (status: ' || {_v('i.inventory_status')} || ')'
FROM d_inventory i JOIN d_product p ON i.product_id = p.product_id
     JOIN d_warehouse w ON i.warehouse_id = w.warehouse_id JOIN d_supplier s ON p.supplier_id = s.supplier_id
WHERE i.quantity_available < i.minimum_threshold""",
    "orders": f"""
SELECT company_id, 4, 'orders', rk,
       '- Order #' || {_v('order_id')} || ': ' || {_v('product_name')} || ' x' || {_v('order_quantity')}
       || ', status: ' || {_v('order_status')} || ', priority: ' || {_v('priority_level')} || ', date: '
       || {_v('order_date')} || ', company: ' || {_v('company_name')}
FROM (SELECT o.*, p.product_name, c.company_name,
             row_number() OVER (PARTITION BY o.company_id ORDER BY o.order_date DESC NULLS FIRST,
                                                                     o.order_id DESC) AS rk
      FROM d_orders o JOIN d_product p ON o.product_id = p.product_id
           JOIN d_company c ON o.company_id = c.company_id) x
WHERE rk <= 15""",
    "delayed": f"""
SELECT s.company_id, 5, 'delayed', sh.shipment_id,
       '- Shipment #' || {_v('sh.shipment_id')} || ': ' || {_v('p.product_name')} || ' from '
       || {_v('s.supplier_name')} || ', expected: ' || {_v('sh.expected_delivery_date')}
FROM d_shipment sh JOIN d_product p ON sh.product_id = p.product_id
     JOIN d_supplier s ON sh.supplier_id = s.supplier_id
WHERE sh.shipment_status = 'Delayed'""",
    "risks": f"""
SELECT company_id, 6, 'risks', rk,
       '- Risk #' || {_v('risk_id')} || ': ' || {_v('risk_type')} || ' (' || {_v('risk_severity')} || ') on '
       || {_v('entity_type')} || ' #' || {_v('entity_id')} || ' — ' || {_v('description')} || ' [status: '
       || {_v('resolution_status')} || ', detected: ' || {_v('detected_date')} || ']'
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY detected_date DESC NULLS FIRST,
                                                                   risk_id DESC) AS rk
      FROM rbc) x
WHERE rk <= 15""",
    "stats": """
SELECT company_id, 7, 'stats', 1, '- Your Suppliers: ' || CAST(suppliers AS VARCHAR) || ', Your Products: '
       || CAST(products AS VARCHAR) FROM cstats
UNION ALL
SELECT company_id, 7, 'stats', 2, '- Your Orders: ' || CAST(orders AS VARCHAR) || ', Your Shipments: '
       || CAST(shipments AS VARCHAR) FROM cstats""",
}
CONTEXT_STATS_SQL = """
SELECT c.company_id,
  (SELECT COUNT(*) FROM d_supplier s WHERE s.company_id = c.company_id) AS suppliers,
  (SELECT COUNT(*) FROM d_product p JOIN d_supplier s ON p.supplier_id = s.supplier_id
    WHERE s.company_id = c.company_id) AS products,
  (SELECT COUNT(*) FROM d_orders o WHERE o.company_id = c.company_id) AS orders,
  (SELECT COUNT(*) FROM d_shipment sh JOIN d_supplier s ON sh.supplier_id = s.supplier_id
    WHERE s.company_id = c.company_id) AS shipments
FROM d_company c"""
_CTX_CTES = {"rbc": RISKS_BY_COMPANY_SQL, "cstats": CONTEXT_STATS_SQL}


def _section_query(section: str):
    return lambda t: context.context_lines(t).filter(F.col("section") == section)


def _named_section(sql: str) -> str:
    return ("SELECT company_id, CAST(section_order AS INTEGER) AS section_order, section, "
            f"CAST(line_key AS BIGINT) AS line_key, line FROM ({sql}) "
            "AS x(company_id, section_order, section, line_key, line)")


for _sec in ("suppliers", "low_stock", "orders", "delayed", "risks", "stats"):
    register(f"context_{_sec}", _named_section(CONTEXT_SECTION_SQL[_sec]), ctes=_CTX_CTES)(_section_query(_sec))

register("context_stats_counts", CONTEXT_STATS_SQL)(lambda t: context.context_stats(t))

_ALL_LINES = "\nUNION ALL\n".join(_named_section(q) for q in CONTEXT_SECTION_SQL.values())
_TITLES = " ".join(f"WHEN {o} THEN '{title}'" for o, _, title in context.SECTIONS)
register("context_document", f"""
SELECT company_id, section_order, section, line_key, line FROM body
UNION ALL
SELECT company_id, section_order, section, -1, CASE section_order {_TITLES} END FROM present
UNION ALL
SELECT p.company_id, p.section_order, p.section, -2, '' FROM present p
WHERE p.section_order > (SELECT MIN(q.section_order) FROM present q WHERE q.company_id = p.company_id)
UNION ALL
SELECT company_id, 0, 'none', 0, '{context.NO_DATA}' FROM d_company
WHERE company_id NOT IN (SELECT company_id FROM present)""",
         ctes={**_CTX_CTES,
               "body": "SELECT company_id, section_order, section, CAST(line_key AS BIGINT) AS line_key, line "
                       f"FROM ({_ALL_LINES}) u",
               "present": "SELECT DISTINCT company_id, section_order, section FROM body"})(
    lambda t: context.context_document(t))

_DOCUMENT = f"""
SELECT company_id, section_order, section, line_key, line FROM body
UNION ALL
SELECT company_id, section_order, section, -1, CASE section_order {_TITLES} END FROM present
UNION ALL
SELECT p.company_id, p.section_order, p.section, -2, '' FROM present p
WHERE p.section_order > (SELECT MIN(q.section_order) FROM present q WHERE q.company_id IS NOT DISTINCT FROM p.company_id)"""

GLOBAL_STATS_SQL = """
SELECT (SELECT COUNT(*) FROM d_company) AS companies, (SELECT COUNT(*) FROM d_supplier) AS suppliers,
       (SELECT COUNT(*) FROM d_product) AS products, (SELECT COUNT(*) FROM d_warehouse) AS warehouses,
       (SELECT COUNT(*) FROM d_orders) AS orders, (SELECT COUNT(*) FROM d_shipment) AS shipments,
       (SELECT COUNT(*) FROM d_risk_event WHERE resolution_status IN ('Open', 'Investigating')) AS open_risks"""
register("context_stats_global", GLOBAL_STATS_SQL)(lambda t: context.context_stats_global(t))

_NEWEST_ORDERS = """
SELECT NULL AS company_id, x.* EXCLUDE (company_id), row_number() OVER (ORDER BY order_date DESC NULLS FIRST, order_id DESC) AS rk
FROM (SELECT o.*, product_name, company_name FROM d_orders o JOIN d_product USING (product_id)
      JOIN d_company USING (company_id)) x QUALIFY rk <= 15"""
_NEWEST_RISKS = """
SELECT NULL AS company_id, r.*, row_number() OVER (ORDER BY detected_date DESC NULLS FIRST, risk_id DESC) AS rk
FROM d_risk_event r QUALIFY rk <= 15"""


def _body_of(section: str, source: str) -> str:
    """The tenant form's line texts over another source of rows."""
    head, _, _ = CONTEXT_SECTION_SQL[section].partition("\nFROM ")
    return f"{head} FROM ({source}) g"


_GLOBAL_LINES = "\nUNION ALL\n".join(_named_section(q) for q in [
    *(CONTEXT_SECTION_SQL[n] for n in ("companies", "suppliers", "low_stock", "delayed")),
    _body_of("orders", _NEWEST_ORDERS), _body_of("risks", _NEWEST_RISKS), """
SELECT NULL, 7, 'stats', 1, format('- Companies: {}, Suppliers: {}, Products: {}', companies, suppliers, products) FROM gstats
UNION ALL
SELECT NULL, 7, 'stats', 2, format('- Warehouses: {}, Orders: {}, Shipments: {}', warehouses, orders, shipments) FROM gstats
UNION ALL
SELECT NULL, 7, 'stats', 3, format('- Open/Investigating Risks: {}', open_risks) FROM gstats"""])
register("context_document_global", _DOCUMENT.replace(context.SECTIONS[-1][2], context.GLOBAL_STATS_TITLE), ctes={
    "gstats": GLOBAL_STATS_SQL,
    "body": f"SELECT CAST(NULL AS BIGINT) AS company_id, section_order, section, line_key, line FROM ({_GLOBAL_LINES}) u",
    "present": "SELECT DISTINCT company_id, section_order, section FROM body"})(lambda t: context.context_document_global(t))

register("prompt_preamble", f"""
{_DOCUMENT}
UNION ALL
SELECT company_id, 0, 'none', 0, '{context.NO_DATA}' FROM d_company WHERE company_id NOT IN (SELECT company_id FROM present)
UNION ALL
SELECT company_id, f.o, f.section, f.k, f.line || CASE f.k WHEN 2 THEN company_id::VARCHAR ELSE '' END
FROM d_company, (VALUES (-1, 'heading', 0, '# Live Database Context'), (-1, 'heading', 1, ''), (99, 'role', 0, ''),
                        (99, 'role', 1, '---'), (99, 'role', 2, 'User''s role: company, Company ID: ')) f(o, section, k, line)""",
         ctes={**_CTX_CTES,
               "body": "SELECT company_id, section_order, section, CAST(line_key AS BIGINT) AS line_key, line "
                       f"FROM ({_ALL_LINES}) u",
               "present": "SELECT DISTINCT company_id, section_order, section FROM body"})(
    lambda t: context.prompt_preamble(t))

CONV_PAIRS_SQL = """
SELECT conv_id, user_turn, user_text, assistant_text, CAST(7 - r AS INTEGER) AS pair_no FROM (
  SELECT conv_id, turn AS user_turn, text AS user_text,
         CASE WHEN next_role = 'assistant' THEN COALESCE(next_text, '') ELSE '' END AS assistant_text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
  FROM (SELECT c.*, lead(c.role) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS next_role,
               lead(c.text) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS next_text
        FROM conversations c JOIN newmsg n ON c.conv_id = n.conv_id
        WHERE c.turn < n.new_turn) h
  WHERE role = 'user') p
WHERE r <= 6"""
_NEWMSG = "SELECT conv_id, MAX(turn) AS new_turn FROM conversations WHERE role = 'user' GROUP BY conv_id"
register("conversation_pairs", CONV_PAIRS_SQL, ctes={"newmsg": _NEWMSG})(
    lambda t: context.conversation_pairs(t.conversations))

register("prompt_turns", f"""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k) AS INTEGER) AS position, role, text
FROM (
  SELECT n.conv_id, CAST(0 AS BIGINT) AS k, 'user' AS role, '# Live Database Context' AS text FROM newmsg n
  UNION ALL SELECT n.conv_id, 1, 'model', '{context.ACKNOWLEDGEMENT}' FROM newmsg n
  UNION ALL SELECT conv_id, user_turn * 2 + 2, 'user', user_text FROM pairs
  UNION ALL SELECT conv_id, user_turn * 2 + 3, 'model', assistant_text FROM pairs
  UNION ALL SELECT c.conv_id, {1 << 40}, 'user', c.text FROM conversations c
            JOIN newmsg n ON c.conv_id = n.conv_id AND c.turn = n.new_turn) x
WHERE COALESCE(text, '') <> ''""", ctes={"newmsg": _NEWMSG, "pairs": CONV_PAIRS_SQL})(
    lambda t: context.prompt_turns(t.conversations))
