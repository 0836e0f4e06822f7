"""S2 — map the driver's star-schema tables onto the domain tables.

The mapping is defined in FIXTURES.md §2; ``chainlens.plans.oracle`` holds the same
mapping as DuckDB SQL.  Row counts of the raw tables enter only as scalar subqueries
(``DataFrame.scalar()``), so the whole mapping stays one lazy plan.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.functions.scalars import stock_status
from chainlens.schema import RAW_SCHEMAS
from chainlens.sources.tables import Tables

AS_OF = datetime.date(1998, 6, 15)
STATUS_SLICE = 1_000_000     # events of one window of the status log
HOT_LINES = 1_000_000        # lines of a part beyond which its stock rows are summed in chunks


def _null(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def _case(col: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v)))
    return out if default is None else out.otherwise(F.lit(default))


def _priority(col: Column) -> Column:
    return (F.when(col.startswith("1-"), "Critical").when(col.startswith("2-"), "High")
            .when(col.startswith("3-"), "Medium").otherwise("Low"))


class StarMapping:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def n_rows(self, name: str) -> Column:
        """Row count of a raw table as a scalar subquery (answered from Parquet footers)."""
        return self.raw(name).select(F.count(F.lit(1))).scalar()

    # -- dimensions -------------------------------------------------------------------
    def company(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey").cast("bigint").alias("company_id"),
            F.col("n_name").alias("company_name"),
            F.col("r_name").alias("industry"),
            F.col("r_name").alias("country"),
            _null("string").alias("contact_email"),
            _null("string").alias("contact_phone"),
            _null("date").alias("created_at"),
            F.lit("Active").alias("status"))

    def supplier(self) -> DataFrame:
        s, n = self.raw("supplier"), self.raw("nation")
        k = F.col("s_suppkey")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            k.alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.col("s_nationkey").cast("bigint").alias("company_id"),
            F.col("n_name").alias("country"),
            (F.lit(5) + k % 21).cast("int").alias("lead_time_days"),
            ((F.lit(60) + (k * 37) % 40).cast("decimal(4,0)") / 100).cast("decimal(3,2)")
            .alias("reliability_score"),
            _null("string").alias("contact_email"),
            (F.col("s_acctbal") >= 0).alias("active_status"))

    def product(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            (F.col("p_partkey") % self.n_rows("supplier")).alias("supplier_id"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price"),
            F.col("p_size").alias("reorder_level"),
            _null("decimal(8,2)").alias("weight_kg"),
            F.lit(True).alias("active_status"))

    def warehouse(self) -> DataFrame:
        r = self.raw("region")
        return r.select(
            F.col("r_regionkey").cast("bigint").alias("warehouse_id"),
            F.col("r_name").alias("warehouse_name"),
            F.col("r_name").alias("location_city"),
            F.col("r_name").alias("location_country"),
            (F.lit(10000) * (F.col("r_regionkey") + 1)).cast("int").alias("capacity_units"),
            _null("string").alias("manager_name"),
            _null("string").alias("contact_number"),
            F.lit(True).alias("active_status"))

    # -- facts ------------------------------------------------------------------------
    def _lines_with_region(self, *cols: str) -> DataFrame:
        """lineitem ⋈ supplier ⋈ nation → the warehouse (region) that stocks each line."""
        s, n = self.raw("supplier"), self.raw("nation")
        sreg = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_regionkey")
        li = self.raw("lineitem").select("l_suppkey", *cols)
        return li.join(sreg, li.l_suppkey == sreg.s_suppkey)

    def inventory(self) -> DataFrame:
        lines = self._lines_with_region("l_partkey", "l_quantity", "l_shipdate")
        g = lines.groupBy("l_partkey", "n_regionkey").agg(
            F.sum("l_quantity").alias("qty_sum"), F.max("l_shipdate").alias("last_ship"))
        part = self.raw("part").select("p_partkey", "p_size")
        qty = (F.col("qty_sum").cast("bigint") % 97).cast("int")
        thr = (F.lit(2) * F.col("p_size")).cast("int")
        return (g.join(part, g.l_partkey == part.p_partkey)
                .select((F.col("l_partkey") * 5 + F.col("n_regionkey")).alias("inventory_id"),
                        F.col("l_partkey").alias("product_id"),
                        F.col("n_regionkey").cast("bigint").alias("warehouse_id"),
                        qty.alias("quantity_available"),
                        F.lit(0).alias("reserved_quantity"),
                        F.to_date("last_ship").alias("last_updated"),
                        thr.alias("minimum_threshold"))
                .withColumn("inventory_status",
                            stock_status(F.col("quantity_available"), F.col("minimum_threshold")))
                .select("inventory_id", "product_id", "warehouse_id", "quantity_available",
                        "reserved_quantity", "last_updated", "minimum_threshold", "inventory_status"))

    def shipment(self) -> DataFrame:
        # first row per (l_orderkey, l_linenumber): min over a struct keeps map-side
        # partial aggregation (no full sort of lineitem as row_number would need)
        li = self.raw("lineitem")
        first = li.groupBy("l_orderkey", "l_linenumber").agg(
            F.min(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
                           "l_quantity", "l_linestatus", "l_returnflag")).alias("r"))
        exp = F.to_date("r.l_shipdate")
        status = (F.when(F.col("r.l_linestatus") == "F", "Delivered")
                  .when(F.col("r.l_returnflag") == "R", "Cancelled")
                  .when(F.col("r.l_returnflag") == "A", "Delayed")
                  .when(F.col("r.l_returnflag") == "N", "In Transit"))
        return first.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("shipment_id"),
            F.col("r.l_partkey").alias("product_id"),
            F.col("r.l_suppkey").alias("supplier_id"),
            F.col("r.l_quantity").cast("int").alias("quantity_shipped"),
            exp.alias("expected_delivery_date"),
            F.when(F.col("r.l_linestatus") == "F",
                   F.date_add(exp, (F.col("r.l_partkey") % 11 - 5).cast("int")))
            .alias("actual_delivery_date"),
            status.alias("shipment_status"),
            _case(F.col("l_linenumber") % 4, {0: "Air", 1: "Sea", 2: "Road", 3: "Rail"})
            .alias("transport_mode"))

    def _orders_customers(self) -> DataFrame:
        o, c = self.raw("orders"), self.raw("customer")
        return o.join(c, o.o_custkey == c.c_custkey)

    def orders(self) -> DataFrame:
        od = F.to_date("o_orderdate")
        return self._orders_customers().select(
            F.col("o_orderkey").alias("order_id"),
            F.col("c_nationkey").cast("bigint").alias("company_id"),
            (F.col("o_orderkey") % self.n_rows("part")).alias("product_id"),
            (F.lit(1) + F.col("o_orderkey") % 50).cast("int").alias("order_quantity"),
            od.alias("order_date"),
            F.date_add(od, 14).alias("expected_fulfill_date"),
            _case(F.col("o_orderstatus"), {"F": "Delivered", "O": "Pending", "P": "Processing"})
            .alias("order_status"),
            _priority(F.col("o_orderpriority")).alias("priority_level"))

    def risk_event(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        n_orders, n_part, n_sup = self.n_rows("orders"), self.n_rows("part"), self.n_rows("supplier")
        x = e.select(
            eid, "ts", "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            _case(F.col("event_type"), {"view": "Shipment", "click": "Inventory", "purchase": "Order",
                                        "signup": "Supplier", "error": "Product"})
            .alias("entity_type"))
        et = F.col("entity_type")
        x = x.select(
            "*",
            F.when(et == "Shipment", (eid % n_orders) * 8 + 1)
            .when(et == "Inventory", (eid % n_part) * 5 + eid % 5)
            .when(et == "Order", eid % n_orders)
            .when(et == "Supplier", eid % n_sup)
            .when(et == "Product", eid % n_part).alias("entity_id"),
            F.when(et == "Shipment", "Delayed Delivery")
            .when(et == "Inventory", F.when(F.col("k") >= 90, "Out of Stock").otherwise("Low Stock"))
            .when(et == "Supplier", "Low Reliability").otherwise("Other").alias("risk_type"))
        v = F.col("value")
        return x.select(
            eid.alias("risk_id"), "entity_type", "entity_id", "risk_type",
            F.when(v >= 150, "Critical").when(v >= 80, "High").when(v >= 20, "Medium")
            .otherwise("Low").alias("risk_severity"),
            F.to_date("ts").alias("detected_date"),
            F.concat(F.col("risk_type"), F.lit(" on "), et, F.lit(" #"),
                     F.col("entity_id").cast("string")).alias("description"),
            _case(F.col("k") % 4, {0: "Open", 1: "Investigating", 2: "Resolved", 3: "Dismissed"})
            .alias("resolution_status"))

    # -- accounts and plans -----------------------------------------------------------
    def app_user(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lit("user_"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
            .alias("email"),
            F.col("c_name").alias("full_name"),
            F.lit("company").alias("role"),
            F.col("c_nationkey").cast("bigint").alias("company_id"),
            _null("timestamp_ntz").alias("created_at"),
            _null("timestamp_ntz").alias("last_login"))

    def subscription_plan(self) -> DataFrame:
        from chainlens.operators.subscriptions import plan_catalog
        return plan_catalog(self.spark)

    def user_subscription(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("subscription_id"),
            F.col("o_custkey").alias("user_id"),
            (F.lit(1) + F.col("o_orderkey") % 3).alias("plan_id"),
            _case(F.col("o_orderstatus"), {"F": "expired", "O": "active", "P": "pending"})
            .alias("status"),
            F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("payment_order_id"),
            _null("decimal(10,2)").alias("amount_paid"),
            F.col("o_orderdate").alias("started_at"),
            _null("timestamp_ntz").alias("expires_at"),
            F.col("o_orderdate").alias("created_at"))

    # -- request and change logs ------------------------------------------------------
    def order_request(self) -> DataFrame:
        """Every order replayed as a placement request, in order-key sequence."""
        return self._orders_customers().select(
            F.col("o_orderkey").alias("seq"),
            F.col("c_nationkey").cast("bigint").alias("company_id"),
            (F.col("o_orderkey") % self.n_rows("part")).alias("product_id"),
            (F.lit(1) + F.col("o_orderkey") % 37).cast("int").alias("quantity"),
            _priority(F.col("o_orderpriority")).alias("priority"))

    def inventory_change(self) -> DataFrame:
        """Stock updates: each lineitem moves its stock row's running level (mod 97).

        The first line of a row is its insert and carries no OLD values; it is not
        an update, so it is not part of the change log.

        A stock row is one part's.  Parts of ``HOT_LINES`` lines at most are dealt once, by part, and
        a row's lines are summed by a window.  The rows of the few parts beyond are a two-level prefix
        sum, so that no such row's lines must sit in one task: each (row, ship month) chunk is numbered
        and summed locally, and a per-row window over its (at most a few hundred) chunks gives every
        chunk its offset.  A stock row holding a third of all lines is thus spread over its months.
        """
        lines = self._lines_with_region("l_partkey", "l_quantity", "l_shipdate", "l_orderkey",
                                        "l_linenumber", "l_extendedprice")
        part = self.raw("part").select("p_partkey", "p_size")
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
        # at most one in HOT_LINES lines
        hot = (self.raw("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_LINES)
               .select(F.collect_list("l_partkey")).scalar())
        x = lines.withColumn("hot", F.array_contains(hot, F.col("l_partkey")))
        x = x.join(part, x.l_partkey == part.p_partkey).select(
            "hot", "l_partkey", (F.col("l_partkey") * 5 + F.col("n_regionkey")).alias("inventory_id"),
            F.col("l_quantity").cast("bigint").alias("q"), *order,
            (F.lit(2) * F.col("p_size")).cast("int").alias("thr"))
        out = ["inventory_id", "thr", "q", "rn_off", "local_rn", "sum_off", "local_sum"]

        def summed(df: DataFrame, *by: str) -> DataFrame:
            w = Window.partitionBy(*by).orderBy(*order)
            up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            known = F.last(F.when(F.col("q").isNotNull(), F.col("chunk")), ignorenulls=True)
            return df.select("*", F.row_number().over(w).alias("local_rn"), F.sum("q").over(up_to).alias("local_sum"),
                             known.over(up_to).alias("known"))

        # chunk = ship month: the leading ordering column, so a row's chunks are contiguous
        # runs of its order, and the split is a pure function of the data (re-runs and
        # retried tasks see the same chunks)
        x = x.withColumn("chunk", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
        # the join has dealt the lines by part already
        whole = summed(x.filter(~F.col("hot")), "l_partkey", "inventory_id").filter("inventory_id IS NOT NULL AND chunk IS NOT NULL")
        # as in a chunk, the level is not known before a line of the month has a quantity
        whole = whole.withColumn("local_sum", F.when(F.col("known") == F.col("chunk"), F.col("local_sum")))
        whole = whole.select("*", F.lit(0).alias("rn_off"), F.lit(0).alias("sum_off"))
        z = summed(x.filter("hot"), "inventory_id", "chunk")
        chunks = z.groupBy("inventory_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("total"))
        before = Window.partitionBy("inventory_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = chunks.select("inventory_id", "chunk",
                                F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rn_off"),
                                F.coalesce(F.sum("total").over(before), F.lit(0)).alias("sum_off"))
        y = whole.select(*out).union(z.join(offsets, ["inventory_id", "chunk"]).select(*out))
        running = F.col("sum_off") + F.col("local_sum")
        seq = (F.col("rn_off") + F.col("local_rn")).cast("bigint")
        return y.filter(seq > 1).select(
            seq.alias("seq"), "inventory_id",
            ((running - F.col("q")) % 97).cast("int").alias("old_quantity"),   # the previous line's level
            (running % 97).cast("int").alias("new_quantity"),
            F.col("thr").alias("old_threshold"), F.col("thr").alias("new_threshold"))

    def shipment_change(self) -> DataFrame:
        """Status updates from the event log (entity = user_id, order = event_id)."""
        e = self.raw("events")
        new = _case(F.col("event_type"), {"view": "In Transit", "click": "In Transit",
                                          "purchase": "Delivered", "error": "Delayed",
                                          "signup": "Cancelled"})
        x = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("shipment_id"),
                     new.alias("new_status"))
        # a user may hold a third of the log: windows span one slice of it, and the first row of
        # a slice takes the last status of the slice before
        x = x.withColumn("slice", F.floor(F.col("seq") / STATUS_SLICE))
        w = Window.partitionBy("shipment_id", "slice").orderBy("seq")
        inner = x.select("*", F.lag("new_status").over(w).alias("inner_old"), F.row_number().over(w).alias("rn"))
        ends = x.groupBy("shipment_id", "slice").agg(F.max_by("new_status", "seq").alias("last"))
        before = Window.partitionBy("shipment_id").orderBy("slice")
        starts = ends.select("shipment_id", "slice", F.lag("last").over(before).alias("outer_old"),
                             F.row_number().over(before).alias("slice_no"))
        y = inner.join(starts, ["shipment_id", "slice"]).filter("rn > 1 OR slice_no > 1")
        return y.select("seq", "shipment_id", F.when(F.col("rn") > 1, F.col("inner_old")).otherwise(F.col("outer_old"))
                        .alias("old_status"), "new_status")

    def risk_resolution(self) -> DataFrame:
        """Resolve/delete requests from the event log; about one in eleven ids dangles."""
        e = self.raw("events")
        n = self.n_rows("events")
        return e.select(
            F.col("event_id").alias("seq"),
            ((F.col("event_id") * 37 + 11) % (n + (n / 10).cast("bigint"))).alias("risk_id"),
            F.when(F.col("event_type") == "signup", "delete").otherwise("resolve").alias("action"))

    def payment(self) -> DataFrame:
        """A confirmed payment for every pending subscription, a day after it was created."""
        o = self.raw("orders").filter(F.col("o_orderstatus") == "P")
        return o.select(
            F.col("o_orderkey").alias("seq"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("payment_order_id"),
            (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("paid_at"))

    def conversations(self) -> DataFrame:
        return self.raw("conversations")

    def tables(self, as_of=AS_OF) -> Tables:
        names = ["company", "supplier", "product", "warehouse", "inventory", "shipment", "orders",
                 "risk_event", "app_user", "subscription_plan", "user_subscription", "order_request",
                 "inventory_change", "shipment_change", "risk_resolution", "payment", "conversations"]
        t = Tables(self.spark, {n: getattr(self, n) for n in names}, as_of)
        t.raw = self.raw
        return t


def star_to_domain(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> Tables:
    return StarMapping(spark, sf_dir).tables(as_of)
