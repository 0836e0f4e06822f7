"""M5 — apply a batch of shipment status updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions.predicates import as_of_lit
from chainlens.operators.slices import in_slices, previous
from chainlens.schema import SHIPMENT_STATUSES


def status_changes(shipments: DataFrame, updates: DataFrame) -> DataFrame:
    """The changes (seq, shipment_id, old_status, new_status) that M5 makes for ``updates``: the old
    status of a shipment's update is what its previous valid update left, first the table's.

    They feed the delay trigger (E2).  A shipment may hold a third of the updates: they are worked off in
    ordered slices, each of which takes the last status of the slice before."""
    valid = updates.filter(F.col("new_status").isin(*SHIPMENT_STATUSES)).select("seq", "shipment_id", "new_status")
    x = valid.join(shipments.select("shipment_id", "shipment_status"), "shipment_id")
    x = previous(in_slices(x, "shipment_id", "seq", name="status-changes"), "shipment_id", "new_status", "_before")
    old = F.coalesce("_before", "shipment_status")       # a valid status is never NULL
    return x.select("seq", "shipment_id", old.alias("old_status"), "new_status")


def update_shipments(shipments: DataFrame, updates: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Apply ``updates(seq, shipment_id, new_status)`` to ``shipments``.

    Per update: the status must be one of the four known ones (others are rejected);
    'Delivered' also sets actual_delivery_date to ``as_of`` (overwriting); leaving
    Delivered keeps the date.  For a batch this folds to: final status = status of the
    last valid update (by seq); actual date = ``as_of`` if any valid update was
    'Delivered', else unchanged.  One aggregate per shipment (partial aggregation),
    then one left join.  Returns (new shipment table, rejected/unknown updates).
    """
    valid = updates.filter(F.col("new_status").isin(*SHIPMENT_STATUSES))
    agg = valid.groupBy("shipment_id").agg(
        F.max_by("new_status", "seq").alias("_last_status"),
        F.max(F.col("new_status") == "Delivered").alias("_delivered"))
    out = shipments.join(agg, "shipment_id", "left").select(
        *[(F.coalesce(F.col("_last_status"), F.col(c)).alias(c) if c == "shipment_status" else
           F.when(F.coalesce(F.col("_delivered"), F.lit(False)), as_of_lit(as_of)).otherwise(F.col(c)).alias(c)
           if c == "actual_delivery_date" else F.col(c)) for c in shipments.columns])
    known = updates.join(shipments.select("shipment_id", F.lit(True).alias("_known")), "shipment_id", "left")
    reason = (F.when(F.col("_known").isNull(), "not found")
              .when(~F.coalesce(F.col("new_status").isin(*SHIPMENT_STATUSES), F.lit(False)), "invalid status"))
    rejected = known.select(*updates.columns, reason.alias("reason")).filter("reason IS NOT NULL")
    return out, rejected
