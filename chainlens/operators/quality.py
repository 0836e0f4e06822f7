"""Q1–Q5, S3, S4 — the DDL constraints re-aimed as data-quality jobs, plus idempotent
appends and JSON rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.operators.cascade import cascade
from chainlens.schema import (COMPANY_STATUSES, DEFAULTS, ENTITY_TYPES, FOREIGN_KEYS, INVENTORY_STATUSES,
                              ORDER_STATUSES, PRIMARY_KEYS, PRIORITIES, RESOLUTION_STATUSES, SEVERITIES,
                              SHIPMENT_STATUSES, TRANSPORT_MODES)

# ---------------------------------------------------------------------------------
# Q1 — defaults for absent columns
# ---------------------------------------------------------------------------------


def apply_defaults(df: DataFrame, table: str, as_of=None, schema=None) -> DataFrame:
    """Fill every *absent* column with its DEFAULT (explicit NULLs stay NULL).

    Date columns defaulting to CURRENT_DATE take ``as_of``; other absent columns
    without a default are NULL.  The result has the table's column order."""
    from chainlens.functions.predicates import as_of_lit
    from chainlens.schema import SCHEMAS
    st = schema or SCHEMAS[table]
    date_defaults = {"company": ["created_at"], "inventory": ["last_updated"], "orders": ["order_date"],
                     "risk_event": ["detected_date"]}
    cols = []
    for f in st.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name in DEFAULTS.get(table, {}):
            cols.append(F.lit(DEFAULTS[table][f.name]).cast(f.dataType).alias(f.name))
        elif f.name in date_defaults.get(table, []):
            cols.append(as_of_lit(as_of).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------------
# Q2 — CHECK / NOT NULL / length rules
# ---------------------------------------------------------------------------------


# The longest text each column takes.
TEXT_LENGTHS = {
    "company": {"company_name": 150, "industry": 100, "country": 100, "contact_email": 150, "contact_phone": 30,
                "status": 30},
    "supplier": {"supplier_name": 150, "country": 100, "contact_email": 150},
    "product": {"product_name": 200, "category": 100},
    "warehouse": {"warehouse_name": 150, "location_city": 100, "location_country": 100, "manager_name": 100,
                  "contact_number": 30},
    "inventory": {"inventory_status": 30},
    "shipment": {"shipment_status": 30, "transport_mode": 30},
    "orders": {"order_status": 30, "priority_level": 20},
    "risk_event": {"entity_type": 50, "risk_type": 50, "risk_severity": 20, "resolution_status": 30},
}


def _enum(col: str, values) -> str:
    return f"{col} IN ({', '.join(repr(v) for v in values)})"


def constraint_rules() -> dict[str, list[tuple[str, str]]]:
    """(rule name, SQL condition that must hold) per table — the DDL's NOT NULL, length
    and CHECK clauses as SQL text, evaluated by Spark (``expr``) and usable verbatim in
    any SQL engine.  A row violates a rule when the condition is FALSE; NULL passes a
    CHECK (three-valued logic)."""
    def nn(*cols):
        return [(f"{x} not null", f"{x} IS NOT NULL") for x in cols]

    rules = _check_rules(nn)
    for table, lengths in TEXT_LENGTHS.items():
        rules[table] += [(f"{c} length <= {n}", f"length({c}) <= {n}") for c, n in lengths.items()]
    return rules


def _check_rules(nn) -> dict[str, list[tuple[str, str]]]:
    return {
        "company": nn("company_id", "company_name") + [
            ("status in enum", _enum("status", COMPANY_STATUSES))],
        "supplier": nn("supplier_id", "supplier_name", "company_id") + [
            ("lead_time_days >= 0", "lead_time_days >= 0"),
            ("reliability_score between 0 and 1", "reliability_score BETWEEN 0 AND 1")],
        "product": nn("product_id", "product_name", "supplier_id") + [
            ("unit_price >= 0", "unit_price >= 0"),
            ("reorder_level >= 0", "reorder_level >= 0")],
        "warehouse": nn("warehouse_id", "warehouse_name") + [
            ("capacity_units > 0", "capacity_units > 0")],
        "inventory": nn("inventory_id", "product_id", "warehouse_id") + [
            ("quantity_available >= 0", "quantity_available >= 0"),
            ("reserved_quantity >= 0", "reserved_quantity >= 0"),
            ("minimum_threshold >= 0", "minimum_threshold >= 0"),
            ("inventory_status in enum", _enum("inventory_status", INVENTORY_STATUSES))],
        "shipment": nn("shipment_id", "product_id", "supplier_id", "expected_delivery_date") + [
            ("quantity_shipped > 0", "quantity_shipped > 0"),
            ("shipment_status in enum", _enum("shipment_status", SHIPMENT_STATUSES)),
            ("transport_mode in enum", _enum("transport_mode", TRANSPORT_MODES))],
        "orders": nn("order_id", "company_id", "product_id") + [
            ("order_quantity > 0", "order_quantity > 0"),
            ("order_status in enum", _enum("order_status", ORDER_STATUSES)),
            ("priority_level in enum", _enum("priority_level", PRIORITIES))],
        "risk_event": nn("risk_id", "entity_type", "entity_id", "risk_type") + [
            ("entity_type in enum", _enum("entity_type", ENTITY_TYPES)),
            ("risk_severity in enum", _enum("risk_severity", SEVERITIES)),
            ("resolution_status in enum", _enum("resolution_status", RESOLUTION_STATUSES))],
    }


def violated_sql(cond: str) -> str:
    return f"coalesce(NOT ({cond}), false)"


def check_violation_counts(t) -> DataFrame:
    """Q2 summary: one row per (table, rule) with its violation count (zeros kept).

    One conditional aggregate per table (one scan), unpivoted with ``stack``."""
    frames = []
    for table, rules in constraint_rules().items():
        one = t[table].agg(*[F.count_if(F.expr(violated_sql(cond))).alias(f"r{i}")
                             for i, (_, cond) in enumerate(rules)])
        pairs = ", ".join(f"'{name}', r{i}" for i, (name, _) in enumerate(rules))
        frames.append(one.select(F.lit(table).alias("table_name"),
                                 F.expr(f"stack({len(rules)}, {pairs})").alias("rule", "violations")))
    return reduce(lambda a, b: a.unionByName(b), frames)


def check_violations(t) -> DataFrame:
    """Q2 detail: (table, rule, key) for every failing row; each table is read once,
    failing rule names are collected per row and exploded."""
    frames = []
    for table, rules in constraint_rules().items():
        pk = PRIMARY_KEYS[table][0]
        names = F.array(*[F.when(F.expr(violated_sql(cond)), F.lit(name)) for name, cond in rules])
        df = t[table].select(F.col(pk).alias("row_key"), F.filter(names, lambda x: x.isNotNull()).alias("_f"))
        frames.append(df.filter(F.size("_f") > 0).select(F.lit(table).alias("table_name"),
                                                         F.explode("_f").alias("rule"), "row_key"))
    return reduce(lambda a, b: a.unionByName(b), frames)


# ---------------------------------------------------------------------------------
# Q3 / Q4 — keys
# ---------------------------------------------------------------------------------


def key_violations(df: DataFrame, key) -> DataFrame:
    """Q3: key values occurring more than once, with their multiplicity."""
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


# Keys of the domain tables beside their primary keys.
UNIQUE_KEYS = {"app_user": [["email"]], "subscription_plan": [["plan_name"]]}


def domain_key_violations(t) -> DataFrame:
    """Q3 for every domain table: (table, key columns, key value, n) of keys that occur twice or more.

    A NULL in a unique key is no violation; in a primary key it is one of Q2's."""
    frames = []
    for table, key in [*PRIMARY_KEYS.items(), *((n, k) for n, ks in UNIQUE_KEYS.items() for k in ks)]:
        keyed = t[table].select(F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("key_value"),
                                *[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
        keyed = keyed.filter(" AND ".join(f"k{i} IS NOT NULL" for i in range(len(key))))
        frames.append(keyed.groupBy("key_value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            F.lit(table).alias("table_name"), F.lit(",".join(key)).alias("key_columns"), "key_value", "n"))
    return reduce(lambda a, b: a.unionByName(b), frames)


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Q4: child rows whose non-NULL foreign key has no parent (left anti join)."""
    return child.filter(F.col(fk).isNotNull()).join(
        parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def fk_orphan_counts(t) -> DataFrame:
    """Q4 summary: orphan count for every foreign key of the business tables."""
    frames = []
    for child, fk, parent, pk, _ in FOREIGN_KEYS:
        if child not in t or parent not in t:
            continue
        o = orphans(t[child], t[parent], fk, pk)
        frames.append(o.agg(F.count(F.lit(1)).alias("orphans")).select(
            F.lit(child).alias("child_table"), F.lit(fk).alias("fk_column"), F.lit(parent).alias("parent_table"),
            "orphans"))
    return reduce(lambda a, b: a.unionByName(b), frames)


ENTITY_TABLES = {"Supplier": ("supplier", "supplier_id"), "Product": ("product", "product_id"),
                 "Shipment": ("shipment", "shipment_id"), "Inventory": ("inventory", "inventory_id"),
                 "Warehouse": ("warehouse", "warehouse_id"), "Order": ("orders", "order_id")}


def risk_dangling_refs(t) -> DataFrame:
    """Q4 for the polymorphic reference: risks whose (entity_type, entity_id) names no row.

    The six entity key sets are unioned into one (entity_type, entity_id) frame so a
    single anti join checks every risk.  Only keys are looked at, so no entity table is built for them."""
    keys = reduce(lambda a, b: a.unionByName(b), [
        t.keys(tbl, pk).select(F.lit(et).alias("entity_type"), F.col(pk).alias("entity_id"))
        for et, (tbl, pk) in ENTITY_TABLES.items()])
    return (t.risk_event.join(keys, ["entity_type", "entity_id"], "left_anti")
            .select("risk_id", "entity_type", "entity_id", "risk_type"))


# ---------------------------------------------------------------------------------
# Q5 — cascade delete
# ---------------------------------------------------------------------------------


# The tables that a purge of companies can reach.
PURGED = ["company", "supplier", "product", "inventory", "shipment", "orders", "app_user"]


def purge_companies(t, ids: DataFrame):
    """Delete companies ``ids(company_id)`` and cascade down the foreign-key tree;
    users of a deleted company keep their row with company_id NULL; risks are left
    dangling.  A row goes only with a parent that is deleted, so orphans and rows with a
    NULL key stay.  Returns the new table bundle."""
    after, _ = cascade({n: t[n] for n in PURGED}, FOREIGN_KEYS, {n: PRIMARY_KEYS[n][0] for n in PURGED}, {"company": ids})
    return t.replace(**after)


def table_counts(t, names) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [
        t[n].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n in names])


# ---------------------------------------------------------------------------------
# S3 / S4 — idempotent append, JSON rendering
# ---------------------------------------------------------------------------------


def append_if_absent(target: DataFrame, rows: DataFrame, key) -> DataFrame:
    """S3: ``target`` plus the ``rows`` whose key is not present yet (re-running is a no-op)."""
    key = [key] if isinstance(key, str) else list(key)
    new = rows.join(target.select(*key).distinct(), key, "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def to_json_rows(df: DataFrame, key: str) -> DataFrame:
    """One JSON object per row (decimal → number, date → ISO string, NULL → null; no key is left out)."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
