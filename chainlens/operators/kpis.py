"""A1–A9, R6, R7, R9 — KPI counts, supplier performance, rollups and health scores.

Facts are aggregated to the supplier (or product) grain *before* they meet the
dimension that carries the tenant, so the join that follows sees one row per
supplier instead of one per fact row, and partial aggregation absorbs hot tenants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions import scalars as X
from chainlens.functions.predicates import (ALL, is_delayed_status, is_low_stock, is_open, is_overdue,
                                            scope, search, value_in)
from chainlens.operators.risks import risks_by_company

KPI_COLS = ["total_companies", "total_suppliers", "total_products", "total_warehouses", "total_orders",
            "total_shipments", "low_inventory_alerts", "delayed_shipment_alerts", "open_risks"]



def _scalar(df: DataFrame, agg) -> F.Column:
    """A single aggregate of ``df`` as a scalar subquery (computed once, no join)."""
    return df.agg(agg).scalar()


def count(df: DataFrame, cond=None) -> F.Column:
    return _scalar(df, F.count(F.lit(1)) if cond is None else F.count_if(cond))


def single_row(t, **cols) -> DataFrame:
    """One row of scalar subqueries; conditional counts over one table share a scan
    (MergeScalarSubqueries), and no 1 × 1 cross join is planned."""
    return t.spark.range(1).select(*[c.alias(n) for n, c in cols.items()])


def kpi_summary(t, as_of=None) -> DataFrame:
    """A1 (global): the nine dashboard counts as one row.

    Differently filtered counts over one table are one conditional aggregate (one
    scan); every count is a scalar subquery of one row."""
    as_of = as_of if as_of is not None else t.as_of
    return single_row(
        t, total_companies=count(t.company), total_suppliers=count(t.supplier),
        total_products=count(t.product), total_warehouses=count(t.warehouse),
        total_orders=count(t.orders), total_shipments=count(t.shipment),
        low_inventory_alerts=count(t.inventory, is_low_stock()),
        delayed_shipment_alerts=count(t.shipment, is_overdue(as_of)),
        open_risks=count(t.risk_event, is_open())).select(*KPI_COLS)


def _per_supplier_shipments(t, as_of) -> DataFrame:
    st = F.col("shipment_status")
    return t.shipment.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("n_ship"),
        F.count_if(st == "Delivered").alias("n_delivered"),
        F.count_if(is_delayed_status()).alias("n_delayed_status"),
        F.count_if(F.coalesce(st != "Delivered", F.lit(True))).alias("n_active"),
        F.count_if(is_overdue(as_of)).alias("n_overdue"))


def _per_supplier_products(t) -> DataFrame:
    return t.product.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n_products"))


def _per_supplier_inventory(t) -> DataFrame:
    inv = t.inventory.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_inv"),
                                                F.count_if(is_low_stock()).alias("n_low"))
    return (inv.join(t.product.select("product_id", "supplier_id"), "product_id")
            .groupBy("supplier_id").agg(F.sum("n_inv").alias("n_inv"), F.sum("n_low").alias("n_low")))


def _per_company(sup_frame: DataFrame, t, cols) -> DataFrame:
    """Roll a per-supplier frame up to the tenant."""
    s = t.supplier.select("supplier_id", "company_id")
    return (sup_frame.join(s, "supplier_id").groupBy("company_id")
            .agg(*[F.sum(c).cast("bigint").alias(c) for c in cols]))


def _zero(df: DataFrame, cols) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def kpi_by_company(t, as_of=None) -> DataFrame:
    """A1 (tenant form) for every company in one job.

    As in the monitored system, warehouses and open_risks stay global in the tenant
    form (V8); ``open_risks_scoped`` is the truly tenant-scoped count."""
    as_of = as_of if as_of is not None else t.as_of
    ship = _per_company(_per_supplier_shipments(t, as_of), t, ["n_ship", "n_overdue"])
    prod = _per_company(_per_supplier_products(t), t, ["n_products"])
    inv = _per_company(_per_supplier_inventory(t), t, ["n_low"])
    sup = t.supplier.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_sup"))
    orders = t.orders.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_orders"))
    risks = (risks_by_company(t).filter(is_open()).groupBy("company_id")
             .agg(F.count(F.lit(1)).alias("n_open_scoped")))
    c = t.company.select("company_id")
    x = reduce(lambda a, b: a.join(b, "company_id", "left"), [c, sup, prod, orders, ship, inv, risks])
    x = _zero(x, ["n_sup", "n_products", "n_orders", "n_ship", "n_overdue", "n_low", "n_open_scoped"])
    return x.select(
        "company_id", F.lit(1).cast("bigint").alias("total_companies"),
        F.col("n_sup").alias("total_suppliers"), F.col("n_products").alias("total_products"),
        count(t.warehouse).alias("total_warehouses"), F.col("n_orders").alias("total_orders"),
        F.col("n_ship").alias("total_shipments"), F.col("n_low").alias("low_inventory_alerts"),
        F.col("n_overdue").alias("delayed_shipment_alerts"),
        count(t.risk_event, is_open()).alias("open_risks"),
        F.col("n_open_scoped").alias("open_risks_scoped"))


def supplier_performance(t, cid=ALL, ordered: bool = True) -> DataFrame:
    """A2: per supplier total / delivered / delayed shipments with its dimensions.

    Shipments are aggregated by supplier first, then left-joined (suppliers without
    shipments keep zeros).  Order: reliability descending with NULL first (PostgreSQL
    DESC), then supplier_id."""
    st = F.col("shipment_status")
    agg = t.shipment.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("total_shipments"),
        F.count_if(st == "Delivered").alias("delivered"),
        F.count_if(st == "Delayed").alias("delayed"))
    c = t.company.select("company_id", "company_name")
    s = scope(t.supplier, cid).join(c, "company_id")
    out = _zero(s.join(agg, "supplier_id", "left"), ["total_shipments", "delivered", "delayed"]).select(
        "supplier_id", "supplier_name", "country", "reliability_score", "lead_time_days", "active_status",
        "company_name", "company_id", "total_shipments", "delivered", "delayed")
    if ordered:
        out = out.orderBy(F.col("reliability_score").desc_nulls_first(), "supplier_id")
    return out


def _risk_rollup(t) -> DataFrame:
    r = risks_by_company(t)
    return r.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("risks_total"),
        F.count_if(is_open()).alias("risks_open"),
        F.count_if(F.col("resolution_status") == "Open").alias("risks_status_open"),
        F.count_if(F.col("risk_severity") == "Critical").alias("risks_critical"))


def _supplier_rollup(t) -> DataFrame:
    """A9 inputs: supplier count and Σ reliability in integer hundredths (NULL as 0)."""
    return t.supplier.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("suppliers"),
        F.sum((F.coalesce(F.col("reliability_score"), F.lit(0)) * 100).cast("bigint")).alias("rel_sum100"))


def company_rollup(t, as_of=None) -> DataFrame:
    """A4: per company suppliers; shipments total/delivered/delayed; risks total/open/critical."""
    as_of = as_of if as_of is not None else t.as_of
    ship = _per_company(_per_supplier_shipments(t, as_of), t,
                        ["n_ship", "n_delivered", "n_delayed_status"])
    x = (t.company.select("company_id", "company_name")
         .join(_supplier_rollup(t), "company_id", "left")
         .join(ship, "company_id", "left").join(_risk_rollup(t), "company_id", "left"))
    x = _zero(x, ["suppliers", "rel_sum100", "n_ship", "n_delivered", "n_delayed_status", "risks_total",
                  "risks_open", "risks_status_open", "risks_critical"])
    return x.select("company_id", "company_name", "suppliers", "rel_sum100",
                    F.col("n_ship").alias("shipments_total"), F.col("n_delivered").alias("shipments_delivered"),
                    F.col("n_delayed_status").alias("shipments_delayed"), "risks_total",
                    "risks_open", "risks_status_open", "risks_critical")


def company_detail(t, as_of=None) -> DataFrame:
    """A5: per company counts of suppliers, products, inventory rows, shipments, risks;
    active shipments (status other than Delivered, NULL included) and risks whose
    status is exactly Open."""
    as_of = as_of if as_of is not None else t.as_of
    ship = _per_company(_per_supplier_shipments(t, as_of), t, ["n_ship", "n_active"])
    prod = _per_company(_per_supplier_products(t), t, ["n_products"])
    inv = _per_company(_per_supplier_inventory(t), t, ["n_inv"])
    x = reduce(lambda a, b: a.join(b, "company_id", "left"),
               [t.company.select("company_id", "company_name"), _supplier_rollup(t), prod, inv, ship,
                _risk_rollup(t)])
    x = _zero(x, ["suppliers", "n_products", "n_inv", "n_ship", "n_active", "risks_total",
                  "risks_status_open"])
    return x.select("company_id", "company_name", "suppliers", F.col("n_products").alias("products"),
                    F.col("n_inv").alias("inventory_rows"), F.col("n_ship").alias("shipments"),
                    F.col("risks_total").alias("risks"), F.col("n_active").alias("active_shipments"),
                    F.col("risks_status_open").alias("open_risks"))


def _health(df: DataFrame, rel_sum100, n, total, delayed, penalty100) -> DataFrame:
    """Exact health score: 100·(0.5·avgRel + 0.5·onTime − penalty), half-up rounded and
    clamped to 0..100, in integer arithmetic.  x = num / den with
    num = R·T + 100·n·(T − D) − 2·n·T·pen and den = 2·n·T (R = Σ score·100, pen in %);
    no suppliers ⇒ avgRel 0, no shipments ⇒ onTime 1.  Rounding is
    (2·num + den) div (2·den); a negative numerator is clamped to 0 either way."""
    def big(c, digits):                       # the products below stay under 38 digits
        return c.cast(f"decimal({digits},0)")

    n1 = big(F.greatest(n, F.lit(1)), 13)
    r = big(F.when(n > 0, rel_sum100).otherwise(F.lit(0)), 15)
    t1 = big(F.when(total > 0, total).otherwise(F.lit(1)), 15)
    td = big(F.when(total > 0, total - delayed).otherwise(F.lit(1)), 15)
    den = big(F.lit(2), 1) * n1 * t1
    num = r * t1 + big(F.lit(100), 3) * n1 * td - den * big(penalty100, 2)
    out = df.withColumn("_num", num).withColumn("_den", den)
    score = F.expr("greatest(0, least(100, (2 * _num + _den) div (2 * _den)))").cast("int")
    return out.withColumn("health_score", score).drop("_num", "_den")


def health_class(score) -> F.Column:
    return F.when(score >= 80, "health-good").when(score >= 60, "health-warning").otherwise("health-critical")


def company_health(t, as_of=None) -> DataFrame:
    """R6 (map form): reliability, on-time rate (status Delayed) and open/critical risks."""
    x = company_rollup(t, as_of)
    pen = F.least(F.lit(30), F.lit(5) * F.col("risks_open") + F.lit(10) * F.col("risks_critical"))
    x = _health(x, F.col("rel_sum100"), F.col("suppliers"), F.col("shipments_total"),
                F.col("shipments_delayed"), pen)
    return x.select("company_id", "company_name", "health_score",
                    health_class(F.col("health_score")).alias("health_class"))


def company_health_detail(t, as_of=None) -> DataFrame:
    """R7 (detail page form): as R6 without the critical-risk term."""
    x = company_rollup(t, as_of)
    pen = F.least(F.lit(30), F.lit(5) * F.col("risks_open"))
    x = _health(x, F.col("rel_sum100"), F.col("suppliers"), F.col("shipments_total"),
                F.col("shipments_delayed"), pen)
    return x.select("company_id", "company_name", "health_score",
                    health_class(F.col("health_score")).alias("health_class"))


def pipeline_stages(t, cid=ALL, as_of=None, status=None, q=None) -> DataFrame:
    """Per pipeline stage the item count after filters and a health split.

    products: warning = low-stock alerts, shipments: critical = overdue alerts, healthy
    = count − that (not clamped; the source does not clamp either).  Alert counts come
    from the (scoped) KPI summary, not from the filtered lists."""
    as_of = as_of if as_of is not None else t.as_of
    comp = scope(t.company, cid).filter(search(q, "company_name"))
    sup = scope(t.supplier, cid).filter(search(q, "supplier_name"))
    ps = t.supplier.select("supplier_id", "company_id", "supplier_name")
    prod = scope(t.product.join(ps.select("supplier_id", "company_id"), "supplier_id"), cid) \
        .filter(search(q, "product_name"))
    pn = t.product.select("product_id", "product_name")
    ship = (scope(t.shipment.join(ps, "supplier_id"), cid).join(pn, "product_id", "left")
            .filter(value_in("shipment_status", status)).filter(search(q, "product_name", "supplier_name")))
    inv_low = scope(t.inventory.filter(is_low_stock()).join(t.product.select("product_id", "supplier_id"),
                                                            "product_id").join(ps, "supplier_id"), cid)
    overdue = scope(t.shipment.filter(is_overdue(as_of)).join(ps, "supplier_id"), cid)
    counts = single_row(t, companies=count(comp), suppliers=count(sup), products=count(prod),
                         warehouses=count(t.warehouse), shipments=count(ship), low=count(inv_low),
                         late=count(overdue))
    return counts.select(F.expr(
        "stack(5,"
        " 1, 'companies', companies, companies, 0L, 0L,"
        " 2, 'suppliers', suppliers, suppliers, 0L, 0L,"
        " 3, 'products', products, products - low, low, 0L,"
        " 4, 'warehouses', warehouses, warehouses, 0L, 0L,"
        " 5, 'shipments', shipments, shipments - late, 0L, late)")
        .alias("stage_order", "stage", "item_count", "healthy", "warning", "critical")).withColumn(
        "stage_order", F.col("stage_order").cast("int"))


def alert_counts(t, as_of=None, cid=ALL, status=None, severity=None, q=None) -> DataFrame:
    """Badge sizes of the dashboard lists after the client filters."""
    from chainlens.operators.alerts import delayed_shipments, low_inventory
    from chainlens.operators.listings import list_orders
    as_of = as_of if as_of is not None else t.as_of
    risks = t.risk_event if cid == ALL else risks_by_company(t, cid)
    low = low_inventory(t, cid, ordered=False).filter(search(q, "product_name"))
    late = delayed_shipments(t, as_of, cid, ordered=False).filter(search(q, "product_name", "supplier_name"))
    orders = list_orders(t, cid, ordered=False).filter(value_in("order_status", status)) \
        .filter(search(q, "product_name", "company_name"))
    rk = (risks.filter(value_in("risk_severity", severity)).filter(value_in("resolution_status", status))
          .filter(search(q, "description", "risk_type")))
    return single_row(t, low_stock=count(low), delayed=count(late), orders=count(orders),
                       risks=count(rk), open_risks=count(rk, is_open()))


# Fixed message texts of the dashboard insight banners.
LEGACY_INSIGHT = {
    "critical": "🚨 Critical — {d} delayed shipments & {l} low stock items need review",
    "delays": "🚨 {d} shipment delays detected — review supplier performance",
    "low_stock": "⚠️ {l} items below minimum stock — reorder recommended",
    "risks": "🛡️ {r} open risk events need attention",
    "normal": "✅ Supply chain operating normally — all systems green",
}
REACT_INSIGHT_WARN = "⚠️ {r} open risk(s) detected — {l} low inventory, {d} delayed shipments"
REACT_INSIGHT_OK = "✅ All supply chain metrics are healthy!"


def _fmt(template: str) -> F.Column:
    """Fill {d} {l} {r} placeholders from the KPI columns."""
    parts, rest = [], template
    cols = {"{d}": "delayed_shipment_alerts", "{l}": "low_inventory_alerts", "{r}": "open_risks"}
    while rest:
        idx = [(rest.find(k), k) for k in cols if rest.find(k) >= 0]
        if not idx:
            parts.append(F.lit(rest))
            break
        i, k = min(idx)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(F.col(cols[k]).cast("string"))
        rest = rest[i + len(k):]
    return F.concat(*parts)


def _trend(col: str) -> F.Column:
    v = F.col(col)
    return F.when(v > 3, "up").when(v == 0, "neutral").otherwise("down")


# Fixed texts of the trend marks and of the pipeline's stages.
TREND_TEXT = {"up": "↑ {n} active", "neutral": "— clear", "down": "↓ {n} only"}
STAGE_TEXT = {"companies": "{suppliers} suppliers linked", "suppliers": "{products} products supplied",
              "products": "⚠️ {low} low stock", "warehouses": "{products} products stored", "shipments": "🔴 {late} delayed"}
STAGE_CLEAR = {"products": "✅ All stocked", "shipments": "✅ All on time"}


def trend_texts(t, as_of=None) -> DataFrame:
    """The text beside each trend mark, per company."""
    def told(col: str) -> F.Column:
        n = F.col(col)
        return (F.when(_trend(col) == "up", X.filled(TREND_TEXT["up"], n=n)).when(_trend(col) == "neutral", TREND_TEXT["neutral"])
                .otherwise(X.filled(TREND_TEXT["down"], n=n)))

    return kpi_by_company(t, as_of).select("company_id", told("low_inventory_alerts").alias("low_text"),
                                           told("delayed_shipment_alerts").alias("delayed_text"), told("open_risks").alias("risks_text"))


def stage_texts(t, cid=ALL, as_of=None, status=None, q=None) -> DataFrame:
    """The line under each pipeline stage, from the counts of :func:`pipeline_stages`."""
    stages = pipeline_stages(t, cid, as_of, status, q)

    def of(stage: str, col: str) -> F.Column:
        return F.max(F.when(F.col("stage") == stage, F.col(col)))

    # five rows: their counts on one
    one = stages.agg(of("suppliers", "item_count").alias("suppliers"), of("products", "item_count").alias("products"),
                     of("products", "warning").alias("low"), of("shipments", "critical").alias("late"))
    values = {c: F.col(c) for c in ("suppliers", "products", "low", "late")}
    texts = []
    for i, (stage, template) in enumerate(STAGE_TEXT.items(), 1):
        text = X.filled(template, **values)
        count = {"products": "low", "shipments": "late"}.get(stage)
        if count:
            text = F.when(F.col(count) > 0, text).otherwise(STAGE_CLEAR[stage])
        texts.append(F.struct(F.lit(i).alias("stage_order"), F.lit(stage).alias("stage"), text.alias("stat_text")))
    return one.select(F.explode(F.array(*texts)).alias("x")).select("x.*")


def insight_by_company(t, as_of=None) -> DataFrame:
    """Banner level/text (legacy ladder and React banner) and trend flags per company."""
    k = kpi_by_company(t, as_of)
    d, l, r = F.col("delayed_shipment_alerts"), F.col("low_inventory_alerts"), F.col("open_risks")
    level = (F.when((d > 5) & (l > 5), "critical").when(d > 3, "delays").when(l > 3, "low_stock")
             .when(r > 3, "risks").otherwise("normal"))
    text = F.when(level == "critical", _fmt(LEGACY_INSIGHT["critical"]))
    for key in ("delays", "low_stock", "risks", "normal"):
        text = text.when(level == key, _fmt(LEGACY_INSIGHT[key]))
    banner = F.when(r > 0, _fmt(REACT_INSIGHT_WARN)).otherwise(F.lit(REACT_INSIGHT_OK))
    return k.select("company_id", level.alias("insight_level"), text.alias("insight_text"),
                    banner.alias("banner_text"), _trend("low_inventory_alerts").alias("trend_low"),
                    _trend("delayed_shipment_alerts").alias("trend_delayed"),
                    _trend("open_risks").alias("trend_risks"))
