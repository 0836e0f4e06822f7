"""J4, M2–M4, M6 — tenant resolution of risks, bulk detection, resolve / dismiss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions import scalars as X
from chainlens.functions.predicates import ALL, as_of_lit, is_low_stock, is_open, is_overdue, scope
from chainlens.operators.slices import numbered
from chainlens.schema import OPEN_STATUSES, RISK_DELAYED, RISK_LOW_STOCK, SCAN_LOW_STOCK, SCAN_OVERDUE

RISK_COLS = ["risk_id", "entity_type", "entity_id", "risk_type", "risk_severity", "detected_date",
             "description", "resolution_status"]


def risks_by_company(t, cid=ALL) -> DataFrame:
    """Risks visible to a tenant, with the tenant's ``company_id``.

    A Shipment risk resolves through the shipment's own supplier, an Inventory risk
    through inventory → product → supplier.  Each entity type is a branch of its own with
    plain equi-joins on primary keys, so no row of one type is shuffled by the other's
    (NULL) key, and the ``entity_type`` filter prunes the partitions of ``risk_event``.
    Risks of other entity types, and dangling ones, have no tenant and are dropped.
    """
    r = t.risk_event
    sup = scope(t.supplier, cid).select(F.col("supplier_id").alias("_s_id"), "company_id")
    sh = t.shipment.select(F.col("shipment_id").alias("entity_id"), F.col("supplier_id").alias("_s_id"))
    inv = t.inventory.select(F.col("inventory_id").alias("entity_id"), F.col("product_id").alias("_p_id"))
    prod = t.product.select(F.col("product_id").alias("_p_id"), F.col("supplier_id").alias("_s_id"))
    late = r.filter(F.col("entity_type") == "Shipment").join(sh, "entity_id")
    low = r.filter(F.col("entity_type") == "Inventory").join(inv, "entity_id").join(prod, "_p_id")
    x = late.select(*RISK_COLS, "_s_id").unionByName(low.select(*RISK_COLS, "_s_id")).join(sup, "_s_id")
    return x.select(*RISK_COLS, "company_id")


def list_risks_scoped(t, cid) -> DataFrame:
    """L8 tenant form: newest first."""
    return risks_by_company(t, cid).orderBy(F.col("detected_date").desc_nulls_first(),
                                            F.col("risk_id").desc())


def risk_severity_counts(t) -> DataFrame:
    """A3: counts of the four fixed severities (zero-filled; unknown values ignored)."""
    sev = F.col("risk_severity")
    one = t.risk_event.agg(*[F.count_if(sev == s).alias(s) for s in ("Critical", "High", "Medium", "Low")])
    return one.select(F.expr("stack(4, 'Critical', Critical, 'High', High, 'Medium', Medium, 'Low', Low)")
                      .alias("risk_severity", "risk_count"))


def _open_keys(risks: DataFrame, entity_type: str, risk_type: str) -> DataFrame:
    return (risks.filter((F.col("entity_type") == entity_type) & (F.col("risk_type") == risk_type)
                         & F.col("resolution_status").isin(*OPEN_STATUSES))
            .select(F.col("entity_id").alias("_eid")).distinct())


NEW_RISK_COLS = ["entity_type", "entity_id", "risk_type", "risk_severity", "detected_date", "description",
                 "resolution_status"]


def detect_risks(t, as_of=None, with_id: bool = False) -> DataFrame:
    """M2: the risk rows a bulk scan creates.

    Low-stock rows without an open 'Low Stock' risk on that inventory row, plus overdue
    shipments without an open 'Delayed Delivery' risk; both NOT EXISTS become left-anti
    joins against the (small, deduplicated) open-risk keys.  Severity by R3 / R4.
    The natural key (entity_type, entity_id, risk_type, detected_date) identifies a row
    (M6): ``with_id`` adds a stable 64-bit hash of it, :func:`number_risks` a serial number.
    """
    as_of = as_of if as_of is not None else t.as_of
    day = as_of_lit(as_of)
    risks = t.risk_event
    inv = (t.inventory.filter(is_low_stock())
           .join(_open_keys(risks, "Inventory", RISK_LOW_STOCK),
                 F.col("inventory_id") == F.col("_eid"), "left_anti"))
    q, th = F.col("quantity_available"), F.col("minimum_threshold")
    low = inv.select(
        F.lit("Inventory").alias("entity_type"), F.col("inventory_id").alias("entity_id"),
        F.lit(RISK_LOW_STOCK).alias("risk_type"), X.stock_severity(q, th).alias("risk_severity"),
        day.alias("detected_date"),
        X.filled(SCAN_LOW_STOCK, quantity=q, threshold=th).alias("description"),
        F.lit("Open").alias("resolution_status"))
    sh = (t.shipment.filter(is_overdue(as_of))
          .join(_open_keys(risks, "Shipment", RISK_DELAYED),
                F.col("shipment_id") == F.col("_eid"), "left_anti")
          .withColumn("_days", X.days_between(day, F.col("expected_delivery_date"))))
    late = sh.select(
        F.lit("Shipment").alias("entity_type"), F.col("shipment_id").alias("entity_id"),
        F.lit(RISK_DELAYED).alias("risk_type"), X.overdue_severity(F.col("_days")).alias("risk_severity"),
        day.alias("detected_date"),
        X.filled(SCAN_OVERDUE, shipment=F.col("shipment_id"), days=F.col("_days")).alias("description"),
        F.lit("Open").alias("resolution_status"))
    out = low.unionByName(late)
    if with_id:
        out = out.withColumn("risk_key", F.xxhash64("entity_type", "entity_id", "risk_type", "detected_date"))
    return out


def number_risks(risks: DataFrame, new: DataFrame) -> DataFrame:
    """M6: ``new`` risks with serial ids that continue from the largest of ``risks``, without gaps, in the
    order of their natural key; a rerun over the same tables gives the same ids."""
    last = F.coalesce(risks.agg(F.max("risk_id")).scalar(), F.lit(0))
    return numbered(new, ["entity_type", "entity_id", "risk_type", "detected_date"], "risk_id", last)


def detect_risks_count(t, as_of=None) -> DataFrame:
    """M2 return value: number of new risks, split by kind and severity."""
    return (detect_risks(t, as_of).groupBy("risk_type", "risk_severity")
            .agg(F.count(F.lit(1)).alias("new_risks")))


def resolve_risks(risks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: set Open/Investigating risks named in ``requests(risk_id)`` to Resolved.

    Returns (new risk table, report of requested ids that were not found or already
    closed).  Requests are deduplicated first; the update is a left join + CASE.
    """
    ids = requests.select("risk_id").distinct().withColumn("_req", F.lit(True))
    joined = risks.join(ids, "risk_id", "left")
    hit = F.col("_req").isNotNull() & is_open()
    new = joined.select(*[F.when(hit, F.lit("Resolved")).otherwise(F.col(c)).alias(c)
                          if c == "resolution_status" else F.col(c) for c in risks.columns])
    changed = risks.filter(is_open()).select("risk_id")
    not_found = ids.join(changed, "risk_id", "left_anti").select("risk_id")
    return new, not_found


def dismiss_risks(risks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4: physically delete the named risks, whatever their status.

    Returns (remaining risks, requested ids that did not exist)."""
    ids = requests.select("risk_id").distinct()
    remaining = risks.join(ids, "risk_id", "left_anti")
    missing = ids.join(risks.select("risk_id"), "risk_id", "left_anti")
    return remaining, missing


def write_risks(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append generated risks, laid out by entity_type so tenant resolution and the
    open-risk anti joins read only their entity's files (partition pruning)."""
    df.write.mode(mode).partitionBy("entity_type").parquet(path)
