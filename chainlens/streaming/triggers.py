"""E1 / E2 — the two AFTER UPDATE row triggers as jobs over change logs (batch twins).

Both triggers create a risk only when no *open* risk of the same kind exists for the
row.  Without resolutions inside the batch, the risk created by the first crossing
stays open and suppresses every later crossing of that row, so the batch result is:
the first crossing per row (by seq), minus rows that already have an open risk.  The
first crossing is a min-by aggregate per key (partial aggregation, no sort), and the
open-risk suppression is a left-anti join against the (small) open-risk key set.
The streaming job with explicit state (:mod:`chainlens.streaming.risk_state`) must
produce exactly these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.functions.predicates import as_of_lit
from chainlens.functions.scalars import stock_severity
from chainlens.schema import OPEN_STATUSES, RISK_DELAYED, RISK_LOW_STOCK

EVENT_COLS = ["seq", "entity_type", "entity_id", "risk_type", "risk_severity", "detected_date", "description",
              "resolution_status"]


def inventory_crossing() -> Column:
    """E1 condition: new qty < new threshold AND (old qty ≥ old threshold OR old qty IS NULL)."""
    new_low = F.col("new_quantity") < F.col("new_threshold")
    was_ok = (F.col("old_quantity") >= F.col("old_threshold")) | F.col("old_quantity").isNull()
    return F.coalesce(new_low & was_ok, F.lit(False))


def delay_transition() -> Column:
    """E2 condition: new status Delayed and old status not Delayed (old NULL ⇒ no fire)."""
    return F.coalesce((F.col("new_status") == "Delayed") & (F.col("old_status") != "Delayed"), F.lit(False))


def open_risk_keys(risks: DataFrame, entity_type: str, risk_type: str) -> DataFrame:
    return (risks.filter((F.col("entity_type") == entity_type) & (F.col("risk_type") == risk_type)
                         & F.col("resolution_status").isin(*OPEN_STATUSES))
            .select(F.col("entity_id").alias("_eid")).distinct())


def inventory_candidates(changes: DataFrame) -> DataFrame:
    """Every change that satisfies the E1 crossing condition, as a risk row."""
    q, th = F.col("new_quantity"), F.col("new_threshold")
    return changes.filter(inventory_crossing()).select(
        F.col("seq").cast("bigint").alias("seq"), F.lit("Inventory").alias("entity_type"),
        F.col("inventory_id").alias("entity_id"), F.lit(RISK_LOW_STOCK).alias("risk_type"),
        stock_severity(q, th).alias("risk_severity"),
        F.concat(F.lit("Auto-detected: Stock at "), q.cast("string"), F.lit(" units, below threshold of "),
                 th.cast("string"), F.lit(" units")).alias("description"))


def shipment_candidates(changes: DataFrame) -> DataFrame:
    """Every change that satisfies the E2 transition condition, as a risk row."""
    return changes.filter(delay_transition()).select(
        F.col("seq").cast("bigint").alias("seq"), F.lit("Shipment").alias("entity_type"),
        F.col("shipment_id").alias("entity_id"), F.lit(RISK_DELAYED).alias("risk_type"),
        F.lit("High").alias("risk_severity"),
        F.concat(F.lit("Auto-detected: Shipment #"), F.col("shipment_id").cast("string"),
                 F.lit(" status changed to Delayed")).alias("description"))


def _first_unsuppressed(cands: DataFrame, risks: DataFrame, entity_type: str, risk_type: str,
                        as_of) -> DataFrame:
    first = cands.groupBy("entity_type", "entity_id", "risk_type").agg(
        F.min(F.struct("seq", "risk_severity", "description")).alias("f"))
    first = first.join(open_risk_keys(risks, entity_type, risk_type),
                       F.col("entity_id") == F.col("_eid"), "left_anti")
    return first.select(F.col("f.seq").alias("seq"), "entity_type", "entity_id", "risk_type",
                        F.col("f.risk_severity").alias("risk_severity"),
                        as_of_lit(as_of).alias("detected_date"), F.col("f.description").alias("description"),
                        F.lit("Open").alias("resolution_status"))


def inventory_risk_events(changes: DataFrame, risks: DataFrame, as_of) -> DataFrame:
    """E1 batch twin over ``changes(seq, inventory_id, old/new quantity, old/new threshold)``."""
    return _first_unsuppressed(inventory_candidates(changes), risks, "Inventory", RISK_LOW_STOCK, as_of)


def shipment_delay_events(changes: DataFrame, risks: DataFrame, as_of) -> DataFrame:
    """E2 batch twin over ``changes(seq, shipment_id, old_status, new_status)``."""
    return _first_unsuppressed(shipment_candidates(changes), risks, "Shipment", RISK_DELAYED, as_of)
