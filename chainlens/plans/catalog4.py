"""Registered queries, part 4: serial ids, document chunks and whole prompts, substring search by an
index, cascades over the key graph, checks beside the write, and the last texts and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlens.functions import scalars as X
from chainlens.operators import context, kpis, listings, observed, quality, risks, shipments
from chainlens.operators.cascade import cascade
from chainlens.operators.trigrams import SubstringIndex
from chainlens.plans import catalog2 as C2
from chainlens.plans.catalog import CID, ORDER_ROW_COLS, ORDERS_SQL
from chainlens.plans.registry import REGISTRY, register
from chainlens.schema import FOREIGN_KEYS, PRIMARY_KEYS, SHIPMENT_STATUSES
from chainlens.session import scratch_path

# ---------------------------------------------------------------------------------
# M6 — serial ids; M5 — the old status of each update
# ---------------------------------------------------------------------------------
register("detect_risks_numbered", """
SELECT (SELECT COALESCE(MAX(risk_id), 0) FROM d_risk_event)
       + row_number() OVER (ORDER BY entity_type, entity_id, risk_type, detected_date) AS risk_id, n.*
FROM new_risks n""", ctes={"new_risks": C2.DETECT_SQL})(lambda t: risks.number_risks(t.risk_event, risks.detect_risks(t)))

_VALID = ", ".join(f"'{s}'" for s in SHIPMENT_STATUSES)
register("shipment_status_changes", f"""
SELECT c.seq, c.shipment_id, COALESCE(lag(c.new_status) OVER (PARTITION BY c.shipment_id ORDER BY c.seq), s.shipment_status) AS old_status,
       c.new_status
FROM d_shipment_change c JOIN d_shipment s ON s.shipment_id = c.shipment_id WHERE c.new_status IN ({_VALID})""")(
    lambda t: shipments.status_changes(t.shipment, t.shipment_change))

# ---------------------------------------------------------------------------------
# C2 / X12 — documents as text in chunks; C4 — prompts with their context
# ---------------------------------------------------------------------------------
_DOCUMENT = REGISTRY["context_document"]
_PREAMBLE = REGISTRY["prompt_preamble"]
_TURNS = REGISTRY["prompt_turns"]


def _chunks_sql(lines: str, size: int = context.CHUNK) -> str:
    return f"""
SELECT company_id, CAST(floor(start / {size}) AS BIGINT) AS chunk_no,
       string_agg(line, chr(10) ORDER BY section_order, line_key, line) AS text, COUNT(*) AS n_lines
FROM (SELECT *, COALESCE(SUM(length(line) + 1) OVER (PARTITION BY company_id ORDER BY section_order, line_key, line
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {lines}) l
GROUP BY ALL"""


register("context_chunks", _chunks_sql("document"), ctes={**_DOCUMENT.ctes, "document": _DOCUMENT.sql})(
    lambda t: context.document_chunks(context.context_document(t)))


def _owners(t):
    """Stand-in input: a company for each conversation."""
    return t.conversations.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") % (t.company.agg(F.max("company_id")).scalar() + 2)).alias("company_id"))


register("prompt_contents", """
SELECT t.conv_id, t.position, COALESCE(c.chunk_no, 0) AS part, t.role, COALESCE(c.text, t.text) AS text
FROM turns t LEFT JOIN chunks c ON t.position = 1
     AND c.company_id = t.conv_id % ((SELECT MAX(company_id) FROM d_company) + 2)""",
         ctes={**_PREAMBLE.ctes, **_TURNS.ctes, "preamble": _PREAMBLE.sql, "chunks": _chunks_sql("preamble"), "turns": _TURNS.sql})(
    lambda t: context.prompt_contents(t, _owners(t)))

# ---------------------------------------------------------------------------------
# F7 / F9 — by an index
# ---------------------------------------------------------------------------------
register("search_products_indexed", REGISTRY["search_products"].sql)(
    lambda t: SubstringIndex(listings.list_products(t), "product_id", ["product_name"]).search("Red W"))
register("search_orders_indexed", REGISTRY["search_orders"].sql)(
    lambda t: SubstringIndex(listings.list_orders(t, ordered=False), "order_id", ["product_name", "company_name"]).search("N_1"))
register("row_search_orders_indexed", f"""
SELECT * FROM ({ORDERS_SQL}) x
WHERE contains(lower(concat_ws(' ', {', '.join(f'CAST({c} AS VARCHAR)' for c in ORDER_ROW_COLS)})), '1998-06')""")(
    lambda t: SubstringIndex(listings.list_orders(t, ordered=False), "order_id", ORDER_ROW_COLS, whole_row=True).search("1998-06"))

# ---------------------------------------------------------------------------------
# Q5 — a cascade from any table; Q2 / Q3 — beside the write
# ---------------------------------------------------------------------------------
_ALL = ["company", "supplier", "product", "warehouse", "inventory", "shipment", "orders", "app_user", "user_subscription",
        "subscription_plan"]


def _cascade_counts(t):
    """What stays of every table after tenant 7's users and suppliers and the warehouse 1 are deleted."""
    asked = {"supplier": t.supplier.filter(F.col("company_id") == CID), "warehouse": t.warehouse.filter("warehouse_id = 1"),
             "app_user": t.app_user.filter(F.col("company_id") == CID), "subscription_plan": t.subscription_plan.filter("plan_id = 1")}
    after, blocked = cascade({n: t[n] for n in _ALL}, FOREIGN_KEYS, {n: PRIMARY_KEYS[n][0] for n in _ALL}, asked)
    return quality.table_counts(after, sorted(after)).unionByName(
        blocked.select(F.concat(F.lit("blocked "), "child_table", F.lit("."), "fk_column").alias("table_name"),
                       F.col("rows").alias("row_count")))


register("cascade_counts", f"""
SELECT 'supplier' AS table_name, COUNT(*) AS row_count FROM d_supplier WHERE company_id <> {CID}
UNION ALL SELECT 'warehouse', COUNT(*) FROM d_warehouse WHERE warehouse_id <> 1
UNION ALL SELECT 'app_user', COUNT(*) FROM d_app_user WHERE company_id IS DISTINCT FROM {CID}
UNION ALL SELECT 'subscription_plan', COUNT(*) FROM d_subscription_plan WHERE plan_id <> 1
UNION ALL SELECT 'product', COUNT(*) FROM d_product WHERE product_id NOT IN (SELECT product_id FROM gone_product)
UNION ALL SELECT 'inventory', COUNT(*) FROM d_inventory
          WHERE warehouse_id <> 1 AND product_id NOT IN (SELECT product_id FROM gone_product)
UNION ALL SELECT 'shipment', COUNT(*) FROM d_shipment
          WHERE product_id NOT IN (SELECT product_id FROM gone_product) AND supplier_id NOT IN (SELECT supplier_id FROM gone_supplier)
UNION ALL SELECT 'orders', COUNT(*) FROM d_orders WHERE product_id NOT IN (SELECT product_id FROM gone_product)
UNION ALL SELECT 'user_subscription', COUNT(*) FROM d_user_subscription WHERE user_id NOT IN (SELECT user_id FROM gone_user)
UNION ALL SELECT 'blocked user_subscription.plan_id', COUNT(*) FROM d_user_subscription
          WHERE plan_id = 1 AND user_id NOT IN (SELECT user_id FROM gone_user)""",
         ctes={"gone_supplier": f"SELECT supplier_id FROM d_supplier WHERE company_id = {CID}",
               "gone_product": "SELECT product_id FROM d_product WHERE supplier_id IN (SELECT supplier_id FROM gone_supplier)",
               "gone_user": f"SELECT user_id FROM d_app_user WHERE company_id = {CID}"})(_cascade_counts)

_WRITTEN = list(quality.constraint_rules())
register("violations_on_write", REGISTRY["check_violations"].sql)(
    lambda t: observed.write_tables(t, _WRITTEN, scratch_path(t.spark, "checked"))[0])


def _keys_twice_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{','.join(key)}' AS key_columns, COUNT(*) AS keys_twice FROM (SELECT {key[0]} FROM d_{table} "
        f"WHERE {key[0]} IS NOT NULL GROUP BY {key[0]} HAVING COUNT(*) > 1) x"
        for table in PRIMARY_KEYS for key in observed.keys_of(table))


register("keys_on_write", _keys_twice_sql())(
    lambda t: observed.write_tables(t, list(PRIMARY_KEYS), scratch_path(t.spark, "checked"))[1])

# ---------------------------------------------------------------------------------
# S4 — whole JSON rows; R9, X11 — texts and the company page's badges
# ---------------------------------------------------------------------------------
_JSON = ["product_id", "product_name", "unit_price", "weight_kg", "active_status"]
register("products_json", """
SELECT product_id, format('{{"product_id":{},"product_name":{},"unit_price":{},"weight_kg":{},"active_status":{}}}', product_id,
         to_json(product_name), COALESCE(CAST(unit_price AS VARCHAR), 'null'), COALESCE(CAST(weight_kg AS VARCHAR), 'null'),
         COALESCE(CAST(active_status AS VARCHAR), 'null')) AS json
FROM d_product""")(lambda t: quality.to_json_rows(t.product.select(*_JSON), "product_id"))
_DATES = ["shipment_id", "expected_delivery_date", "actual_delivery_date", "transport_mode"]
register("shipments_json", """
SELECT shipment_id, format('{{"shipment_id":{},"expected_delivery_date":{},"actual_delivery_date":{},"transport_mode":{}}}', shipment_id,
         COALESCE(to_json(CAST(expected_delivery_date AS VARCHAR)), 'null'), COALESCE(to_json(CAST(actual_delivery_date AS VARCHAR)), 'null'),
         COALESCE(to_json(transport_mode), 'null')) AS json
FROM d_shipment""")(lambda t: quality.to_json_rows(t.shipment.select(*_DATES), "shipment_id"))


def _trend_sql(col: str) -> str:
    whens = {"up": f"{col} > 3", "neutral": f"{col} = 0", "down": "TRUE"}
    return "CASE " + " ".join(f"WHEN {cond} THEN {C2.message_sql(kpis.TREND_TEXT[k], n=col)}" for k, cond in whens.items()) + " END"


register("trend_texts", f"""
SELECT company_id, {_trend_sql('low_inventory_alerts')} AS low_text, {_trend_sql('delayed_shipment_alerts')} AS delayed_text,
       {_trend_sql('open_risks')} AS risks_text FROM kpi""", ctes={"kpi": C2.KPI_BY_COMPANY_SQL})(lambda t: kpis.trend_texts(t))


def _stage_sql(stage: str) -> str:
    text = C2.message_sql(kpis.STAGE_TEXT[stage], suppliers="suppliers", products="products", low="low", late="late")
    n = {"products": "low", "shipments": "late"}.get(stage)
    return f"CASE WHEN {n} > 0 THEN {text} ELSE '{kpis.STAGE_CLEAR[stage]}' END" if n else text


register("stage_texts", "\nUNION ALL\n".join(
    f"SELECT {i} AS stage_order, '{stage}' AS stage, {_stage_sql(stage)} AS stat_text FROM counts"
    for i, stage in enumerate(kpis.STAGE_TEXT, 1)), ctes={**REGISTRY["pipeline_stages"].ctes, "stages": REGISTRY["pipeline_stages"].sql, "counts": """
SELECT MAX(item_count) FILTER (WHERE stage = 'suppliers') AS suppliers, MAX(item_count) FILTER (WHERE stage = 'products') AS products,
       MAX(warning) FILTER (WHERE stage = 'products') AS low, MAX(critical) FILTER (WHERE stage = 'shipments') AS late FROM stages"""})(
    lambda t: kpis.stage_texts(t))

register("detail_badges", f"""
SELECT 'shipment' AS kind, shipment_id AS row_id, {C2._sql_lookup('shipment_status', X.DETAIL_BADGE, 'info')} AS badge FROM d_shipment
UNION ALL
SELECT 'risk', risk_id, {C2._sql_lookup('resolution_status', X.DETAIL_BADGE, 'info')} FROM d_risk_event""")(
    lambda t: t.shipment.select(F.lit("shipment").alias("kind"), F.col("shipment_id").alias("row_id"),
                                X.lookup("shipment_status", X.DETAIL_BADGE, "info").alias("badge")).unionByName(
        t.risk_event.select(F.lit("risk").alias("kind"), F.col("risk_id").alias("row_id"),
                            X.lookup("resolution_status", X.DETAIL_BADGE, "info").alias("badge"))))
