"""Edge-case semantics on the hand-made fixture (expected values derived by hand)."""

import pytest
from pyspark.sql import functions as F

from chainlens.functions import predicates as P
from chainlens.operators import alerts, allocation, context, kpis, listings, quality, risks, subscriptions
from chainlens.schema import SCHEMAS
from chainlens.streaming import risk_state, triggers
from tests.fixture import AS_OF, make_tables


@pytest.fixture(scope="module")
def t(spark):
    return make_tables(spark)


def col(df, c, order=None):
    return [r[c] for r in (df.orderBy(order) if order else df).collect()]


def test_low_inventory_nulls_threshold_zero_and_order(t):
    df = alerts.low_inventory(t)
    # NULL quantity and threshold 0 are not low; order = shortage gap desc, then id
    assert [r.inventory_id for r in df.collect()] == [1003, 1001, 1004]


def test_overdue_any_status_and_days(t):
    df = alerts.delayed_shipments(t)
    got = {r.shipment_id: r.days_overdue for r in df.collect()}
    assert got == {5000: 5, 5001: 10, 5002: 11}


def test_detect_risks_and_detect_twice(t):
    new = risks.detect_risks(t)
    got = {(r.entity_type, r.entity_id): r.risk_severity for r in new.collect()}
    # 1003 suppressed by open risk 1; 1004's open risk is 'Out of Stock' (other type) → not suppressed;
    # 5000's risk is Resolved → not suppressed; 5002 suppressed (Investigating)
    assert got == {("Inventory", 1001): "Medium", ("Inventory", 1004): "Critical",
                   ("Shipment", 5000): "Medium", ("Shipment", 5001): "High"}
    appended = quality.append_if_absent(
        t.risk_event, new.withColumn("risk_id", F.lit(None).cast("bigint")),
        ["entity_type", "entity_id", "risk_type", "detected_date"])
    assert risks.detect_risks(t.replace(risk_event=appended)).count() == 0
    # appending the same rows again is a no-op
    again = quality.append_if_absent(appended, new, ["entity_type", "entity_id", "risk_type", "detected_date"])
    assert again.count() == appended.count() == 10


def test_tenant_resolution_or_form_equals_coalesce_form(t, spark):
    got = {(r.risk_id, r.company_id) for r in risks.risks_by_company(t).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (6, 2)}
    for name in ("risk_event", "shipment", "inventory", "product", "supplier"):
        t[name].createOrReplaceTempView(f"fx_{name}")
    or_form = spark.sql("""
        SELECT DISTINCT r.risk_id, s.company_id FROM fx_risk_event r
        LEFT JOIN fx_shipment sh ON r.entity_type = 'Shipment' AND r.entity_id = sh.shipment_id
        LEFT JOIN fx_inventory inv ON r.entity_type = 'Inventory' AND r.entity_id = inv.inventory_id
        LEFT JOIN fx_product p ON inv.product_id = p.product_id
        LEFT JOIN fx_supplier s ON sh.supplier_id = s.supplier_id OR p.supplier_id = s.supplier_id
        WHERE s.company_id IS NOT NULL""")
    assert {(r.risk_id, r.company_id) for r in or_form.collect()} == got


def test_health_scores(t):
    h = {r.company_id: (r.health_score, r.health_class) for r in kpis.company_health(t).collect()}
    assert h == {1: (41, "health-critical"), 2: (55, "health-critical"), 3: (50, "health-critical")}
    d = {r.company_id: r.health_score for r in kpis.company_health_detail(t).collect()}
    assert d == {1: 51, 2: 65, 3: 50}


def test_supplier_performance_nulls_first_and_zero_shipments(t):
    rows = kpis.supplier_performance(t).collect()
    assert [r.supplier_id for r in rows] == [11, 10, 12]
    assert rows[0].total_shipments == 0


def test_kpis_scoped_keep_global_warehouses_and_risks(t):
    k = {r.company_id: r for r in kpis.kpi_by_company(t).collect()}
    assert k[1].total_warehouses == 3 and k[1].open_risks == 5     # global, as in the source
    assert k[1].open_risks_scoped == 1 and k[2].open_risks_scoped == 2
    assert k[1].low_inventory_alerts == 2 and k[2].low_inventory_alerts == 1
    assert k[3].total_suppliers == 0


def test_search_is_literal(t):
    p = listings.list_products(t)
    assert p.filter(P.search("T_%", "product_name")).count() == 1
    assert p.filter(P.search("t%", "product_name")).count() == 0
    assert p.filter(P.search(None, "product_name")).count() == 3


def test_allocation_fold(t):
    dec = {r.seq: (r.status, r.reason, r.inventory_id) for r in allocation.allocate_orders(t)[0].collect()}
    assert dec == {1: ("accepted", None, 1001), 2: ("accepted", None, 1007),
                   3: ("rejected", "insufficient stock", None), 4: ("rejected", "invalid request", None),
                   5: ("rejected", "invalid request", None), 6: ("rejected", "invalid request", None),
                   7: ("rejected", "no inventory", None), 8: ("accepted", None, 1005),
                   9: ("rejected", "no inventory", None), 10: ("rejected", "insufficient stock", None),
                   11: ("rejected", "no inventory", None)}
    assert len(dec) == t.order_request.count()
    _, orders, inv, _ = allocation.allocate_orders(t)
    assert {r.request_seq: r.priority_level for r in orders.collect()}[1] == "Medium"
    stock = {r.inventory_id: (r.quantity_available, r.inventory_status) for r in inv.collect()}
    assert stock[1001] == (1, "Low Stock") and stock[1007] == (0, "Out of Stock")
    assert stock[1005] == (0, "Out of Stock") and stock[1000] == (None, "In Stock")
    checks = {r.product_id: r.holds for r in allocation.allocation_invariants(t).collect()}
    assert checks == {100: True, 102: True}
    fired = allocation.allocation_risk_events(t).collect()
    assert {(r.entity_id, r.risk_severity) for r in fired} == {(1005, "Critical"), (1007, "Critical")}


def test_trigger_batch_twins(t):
    inv = triggers.inventory_risk_events(t.inventory_change, t.risk_event, AS_OF).collect()
    assert {(r.entity_id, r.seq, r.risk_severity) for r in inv} == {(1001, 1, "Medium"), (1004, 1, "Medium")}
    sh = triggers.shipment_delay_events(t.shipment_change, t.risk_event, AS_OF).collect()
    assert {(r.entity_id, r.seq) for r in sh} == {(5000, 1), (5004, 1)}


@pytest.mark.parametrize("slices", [1, 2, 4])
def test_stream_equals_batch(spark, t, slices):
    events = risk_state.trigger_events(t)
    init = risk_state.initial_open_counts(t.risk_event)
    streamed = risk_state.run_risk_state_stream(spark, events, init, AS_OF, slices=slices)
    batch = (triggers.inventory_risk_events(t.inventory_change, t.risk_event, AS_OF)
             .unionByName(triggers.shipment_delay_events(t.shipment_change, t.risk_event, AS_OF)))
    key = ["entity_type", "entity_id", "seq", "risk_severity", "description"]
    assert sorted(tuple(r) for r in streamed.select(*key).collect()) == \
        sorted(tuple(r) for r in batch.select(*key).collect())


def test_stream_carries_a_key_over_batches(spark):
    """One key, a close between crossings, every event in a micro-batch of its own."""
    key = ("Inventory", 1, "Low Stock")
    rows = [(10, *key, 0, "High", "first"), (20, *key, 1, None, None), (30, *key, 0, "Medium", "second"),
            (40, *key, 0, "High", "suppressed"), (50, *key, 2, None, None), (60, *key, 0, "High", "third"),
            (10, "Inventory", 2, "Low Stock", 0, "High", "open before")]
    events = spark.createDataFrame(rows, risk_state.EVENT_SCHEMA)
    initial = spark.createDataFrame([("Inventory", 2, "Low Stock", 2)], risk_state.COUNT_SCHEMA)
    out = risk_state.run_risk_state_stream(spark, events, initial, AS_OF, slices=6, rows_per_file=1).collect()
    assert sorted((r.seq, r.description) for r in out) == [(10, "first"), (30, "second"), (60, "third")]


def test_closes_let_a_later_crossing_fire(spark, t):
    resolution = spark.createDataFrame([(0, 1, "resolve"), (2, 1, "delete"), (1, 4, "resolve")], "seq long, risk_id long, action string")
    closes = risk_state.close_events(t.replace(risk_resolution=resolution))
    assert [(r.seq, r.entity_id, r.closes) for r in closes.collect()] == [(0, 1003, 1)]     # risk 4 is of no trigger
    events = risk_state.trigger_events(t).unionByName(closes)
    fired = risk_state.run_risk_state_stream(spark, events, risk_state.initial_open_counts(t.risk_event), AS_OF).collect()
    assert (1, 1003) in {(r.seq, r.entity_id) for r in fired}


def test_health_at_the_target_scale(spark):
    from pyspark.sql import functions as F
    one = spark.sql("SELECT 3600000000L AS rel, 40000000L AS n, 24000000000L AS total, 6000000000L AS late, 15 AS pen")
    out = kpis._health(one, F.col("rel"), F.col("n"), F.col("total"), F.col("late"), F.col("pen")).first()
    assert out.health_score == 68          # 100 * (0.5 * 0.90 + 0.5 * 0.75) - 15 = 67.5, half up


def test_sources_and_sinks(spark, t, tmp_path):
    from chainlens.sources.tables import load_tables
    t.company.write.parquet(f"{tmp_path}/company.parquet")
    loaded = load_tables(spark, str(tmp_path))
    assert loaded.names() == ["company"] and loaded.company.count() == 3
    risks.write_risks(t.risk_event, f"{tmp_path}/risks")
    back = spark.read.parquet(f"{tmp_path}/risks")
    assert back.count() == t.risk_event.count() and back.filter("entity_type = 'Shipment'").count() == 3
    quality.write_json(t.product.select("product_id", "unit_price"), f"{tmp_path}/json")
    assert {(r.product_id, r.unit_price) for r in spark.read.json(f"{tmp_path}/json").collect()} == {
        (100, 9.99), (101, 5.0), (102, 0.1)}
    ids = risks.detect_risks(t, with_id=True).select("risk_key")
    assert ids.distinct().count() == ids.count() > 0
    best = {r.product_id: r.inventory_id for r in allocation.best_stock_row(t.inventory, t.product).collect()}
    assert best == {100: 1001, 101: 1003, 102: 1005}


def test_free_plan(spark, t):
    import datetime
    subs = spark.createDataFrame([(1, 1, 2, "active", "o1", None, None, None, None), (2, 2, 2, "pending", "o2", None, None, None, None)],
                                 t.user_subscription.schema if "user_subscription" in t else SCHEMAS["user_subscription"])
    asks = spark.createDataFrame([(1, 1), (2, 3), (9, 1)], "user_id long, plan_id long")
    now = datetime.datetime(2026, 2, 15)
    out = subscriptions.activate_free_plan(t.replace(user_subscription=subs), asks, now).collect()
    assert sorted((r.user_id, r.plan_id, r.status, r.started_at) for r in out if r.user_id == 1) == [
        (1, 1, "active", now), (1, 2, "expired", None)]
    assert [(r.user_id, r.status) for r in out if r.user_id != 1] == [(2, "pending")]


def test_purge_leaves_orphans_and_null_keys(spark, t):
    extra = t.supplier.limit(0)
    orphan = spark.createDataFrame([(199, "Orphan", 99, "x", None, None, None, True)], SCHEMAS["product"])
    stock = spark.createDataFrame([(1099, 199, 1, 5, 0, None, 1, "In Stock")], SCHEMAS["inventory"])
    x = t.replace(product=t.product.unionByName(orphan), inventory=t.inventory.unionByName(stock), supplier=t.supplier.union(extra))
    purged = quality.purge_companies(x, t.company.filter("company_id = 1").select("company_id"))
    assert purged.product.filter("product_id = 199").count() == 1 and purged.inventory.filter("inventory_id = 1099").count() == 1


def test_conversation_pairs_and_prompt(t):
    pairs = context.conversation_pairs(t.conversations).orderBy("user_turn").collect()
    # new message of conv 1 is turn 5; history user turns 0, 2, 4; turn 2 is followed by a system turn
    assert [(r.conv_id, r.user_turn, r.assistant_text) for r in pairs] == [(1, 0, "hello"), (1, 2, ""), (1, 4, "")]
    turns = context.prompt_turns(t.conversations).filter("conv_id = 1").orderBy("position").collect()
    assert [(r.role, r.text) for r in turns][2:] == [("user", "hi"), ("model", "hello"), ("user", "stock?"),
                                                     ("user", "again"), ("user", "new question")]


def test_context_document_text(t):
    doc = {r.company_id: r.document for r in context.assemble_documents(context.context_document(t)).collect()}
    assert doc[3].startswith("## Companies\n- Gamma (Food, Kenya)\n\n## Summary Stats (Your Company)")
    assert "- Null Score Co (India) — reliability: 0%, lead time: 7d, company: Acme" in doc[1]
    assert "## Delayed Shipments\n- Shipment #5001: Widget_% from North Parts, expected: 2026-02-05" in doc[1]


def test_integrity_jobs(t):
    dangling = {r.risk_id for r in quality.risk_dangling_refs(t).collect()}
    assert dangling == {3}
    orphans = {(r.child_table, r.fk_column): r.orphans for r in quality.fk_orphan_counts(t).collect()}
    assert orphans[("orders", "product_id")] == 0
    viol = {(r.table_name, r.rule): r.violations for r in quality.check_violation_counts(t).collect()}
    assert viol[("company", "status in enum")] == 0 and viol[("inventory", "quantity_available >= 0")] == 0
    purged = quality.purge_companies(t, t.company.filter("company_id = 1").select("company_id"))
    assert purged.supplier.count() == 1 and purged.shipment.count() == 2 and purged.inventory.count() == 3   # with the orphan
    assert purged.app_user.count() == 3 and purged.app_user.filter("company_id IS NULL").count() == 2
