"""M1 / E4 — allocate a batch of order requests against stock.

Semantics per request, in ``seq`` order: take the product's stock row with the highest
quantity (lowest inventory_id on ties); no row → reject; fewer units than requested →
reject (no split across rows); otherwise create the order (status Pending, ordered on
``as_of``, fulfilment ``as_of`` + 7 days, priority Medium when omitted) and reduce that
row.  Requests failing a constraint (quantity not positive or NULL, unknown priority,
unknown company) are rejected and consume nothing.  All-or-nothing per request.

Rejected requests do not consume stock, so there is no prefix-sum shortcut: the fold is
sequential per product.  Different products never interact, so the plan is: stock rows
and requests → one frame, hash-partitioned by product, sorted by (product, kind, seq)
inside each partition, then a ``mapInPandas`` generator that keeps only the current
product's stock rows in memory (a heap of at most #warehouses rows) while requests
stream through.  No group is ever materialised (unlike ``applyInPandas``).

Stock only falls, so a request for more than its product's fullest row held at the start is
rejected whatever came before it; so is one without stock rows, without a product or with a
quantity that no order may have.  These are answered in the JVM, and the fold sees only
requests that could still be accepted.

A hot product (more than ``BLOCK`` such requests) is worked off in rounds: its requests lie in
ordered slices and blocks, a round folds the next ``BLOCK`` at most, and the fullest row that is left
bounds all that follows, so the JVM rejects what exceeds it before the next round.  No task folds
more than ``BLOCK`` requests of a product, and requests that come after the stock is gone are never folded.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.predicates import as_of_lit
from chainlens.functions.scalars import stock_status
from chainlens.operators.slices import PLACE, SLICE, in_slices
from chainlens.schema import DEFAULT_PRIORITY, ORDER_FULFIL_DAYS, PRIORITIES
from chainlens.session import written as table_written

#: Requests of one product that a task folds at most.
BLOCK = 200_000
#: Requests that a task of the fold sorts with their products' stock rows, about.
PER_TASK = 100_000
#: Shuffled bytes of a task that joins requests to their product's best row.
JOIN_BYTES = "8MB"

_OUT_SCHEMA = ("record string, seq long, product_id long, inventory_id long, status string, reason string, "
               "stock_before int, stock_after int, minimum_threshold int, company_id long, quantity int, "
               "priority string")
_INTS = {"seq": "Int64", "product_id": "Int64", "inventory_id": "Int64", "stock_before": "Int32", "stock_after": "Int32",
         "minimum_threshold": "Int32", "company_id": "Int64", "quantity": "Int32"}


def _fold(batches):
    cur = None
    heap: list = []          # (-quantity, inventory_id, threshold)
    final: dict = {}         # inventory_id -> (quantity, threshold) for touched rows

    def flush(product):
        if product is None:
            return None
        if not final:
            return None
        ids = list(final)
        return {"record": ["stock"] * len(ids), "seq": [None] * len(ids), "product_id": [product] * len(ids),
                "inventory_id": ids, "status": [None] * len(ids), "reason": [None] * len(ids),
                "stock_before": [None] * len(ids), "stock_after": [final[i][0] for i in ids],
                "minimum_threshold": [final[i][1] for i in ids], "company_id": [None] * len(ids),
                "quantity": [None] * len(ids), "priority": [None] * len(ids)}

    cols = ["record", "seq", "product_id", "inventory_id", "status", "reason", "stock_before", "stock_after",
            "minimum_threshold", "company_id", "quantity", "priority"]
    for pdf in batches:
        out = {c: [] for c in cols}
        prod = pdf["product_id"].to_numpy()
        kind = pdf["kind"].to_numpy()
        seq = pdf["seq"].to_numpy()
        qty = pdf["qty"].to_numpy(dtype="float64", na_value=np.nan)
        thr = pdf["thr"].to_numpy(dtype="float64", na_value=np.nan)
        valid = pdf["valid"].to_numpy()
        company = pdf["company_id"].to_numpy(dtype="float64", na_value=np.nan)
        priority = pdf["priority"].to_numpy()
        for j in range(len(pdf)):
            p = int(prod[j])
            if p != cur:
                fl = flush(cur)
                if fl:
                    for c in cols:
                        out[c].extend(fl[c])
                cur, heap, final = p, [], {}
            if kind[j] == 0:                       # a stock row (seq = inventory_id)
                if not np.isnan(qty[j]):           # NULL stock is not allocatable
                    t = None if np.isnan(thr[j]) else int(thr[j])
                    heapq.heappush(heap, (-int(qty[j]), int(seq[j]), t))
                continue
            want = None if np.isnan(qty[j]) else int(qty[j])
            s = int(seq[j])
            if not heap:
                status, reason, inv, before, after, t = "rejected", "no inventory", None, None, None, None
            elif want is not None and -heap[0][0] < want:
                status, reason, inv, before, after, t = "rejected", "insufficient stock", None, None, None, None
            elif not valid[j]:
                status, reason, inv, before, after, t = "rejected", "invalid request", None, None, None, None
            else:
                negq, inv, t = heap[0]
                before, after = -negq, -negq - want
                heapq.heapreplace(heap, (-after, inv, t))
                final[inv] = (after, t)
                status, reason = "accepted", None
            out["record"].append("request")
            out["seq"].append(s)
            out["product_id"].append(p)
            out["inventory_id"].append(inv)
            out["status"].append(status)
            out["reason"].append(reason)
            out["stock_before"].append(before)
            out["stock_after"].append(after)
            out["minimum_threshold"].append(t)
            out["company_id"].append(None if np.isnan(company[j]) else int(company[j]))
            out["quantity"].append(want)
            out["priority"].append(priority[j])
        if out["record"]:                          # a frame without rows has no kinds of columns
            yield pd.DataFrame(out, columns=cols).astype(_INTS)
    fl = flush(cur)
    if fl:
        yield pd.DataFrame(fl, columns=cols).astype(_INTS)


def _validated(requests: DataFrame, companies: DataFrame) -> DataFrame:
    known = companies.select("company_id").distinct().withColumn("_known", F.lit(True))
    prio = F.coalesce(F.col("priority"), F.lit(DEFAULT_PRIORITY))
    return (requests.join(known, "company_id", "left")
            .withColumn("priority", prio)
            .withColumn("valid", F.coalesce(F.col("quantity") > 0, F.lit(False))
                        & prio.isin(*PRIORITIES) & F.coalesce(F.col("_known"), F.lit(False)))
            .drop("_known"))


def best_stock_row(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """The stock row a request of each product is served from: the fullest, then the lowest id.

    Rows of a product that does not exist, and rows without a quantity, serve nobody.
    """
    known = inventory.filter("quantity_available IS NOT NULL").join(
        products.select("product_id"), "product_id", "left_semi")
    return known.groupBy("product_id").agg(
        F.max(F.struct(F.col("quantity_available").alias("q"), (-F.col("inventory_id")).alias("nid"))).alias("b")).select(
        "product_id", (-F.col("b.nid")).alias("inventory_id"), F.col("b.q").alias("quantity_available"))


def _rejected(requests: DataFrame, reason) -> DataFrame:
    """Records of requests that no fold has to see."""
    none = F.lit(None)
    return requests.select(
        F.lit("request").alias("record"), "seq", "product_id", none.cast("bigint").alias("inventory_id"),
        F.lit("rejected").alias("status"), reason.alias("reason"), none.cast("int").alias("stock_before"),
        none.cast("int").alias("stock_after"), none.cast("int").alias("minimum_threshold"), "company_id", "quantity",
        "priority")


def _folded(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """The fold of ``requests`` over ``stock`` (product_id, inventory_id, quantity, threshold); its tasks
    follow the number of requests."""
    tasks = max(requests.sparkSession.sparkContext.defaultParallelism, -(-requests.count() // PER_TASK))
    none = F.lit(None)
    rows = stock.select("product_id", F.lit(0).alias("kind"), F.col("inventory_id").alias("seq"), F.col("quantity_available").alias("qty"),
                        F.col("minimum_threshold").alias("thr"), F.lit(True).alias("valid"), none.cast("bigint").alias("company_id"),
                        none.cast("string").alias("priority"))
    asks = requests.select("product_id", F.lit(1).alias("kind"), "seq", F.col("quantity").alias("qty"),
                           none.cast("int").alias("thr"), "valid", "company_id", "priority")
    ordered = rows.unionByName(asks).repartition(tasks, "product_id").sortWithinPartitions("product_id", "kind", "seq")
    return ordered.mapInPandas(_fold, _OUT_SCHEMA)


def next_blocks(pending: DataFrame, block: int) -> DataFrame:
    """(product_id, block) of the blocks a round folds: a product's first ones with ``block`` requests at most in all."""
    counts = pending.groupBy("product_id", "block").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("product_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("n", F.sum("n").over(upto)).filter(F.col("n") <= block).select("product_id", "block")


def _fold_in_rounds(requests: DataFrame, stock: DataFrame, block: int) -> DataFrame:
    """:func:`_folded` for products with any number of requests."""
    spark = requests.sparkSession
    own = in_slices(requests, "product_id", "seq", name="hot-requests")
    pending = own.withColumn("block", F.col(SLICE).cast("bigint") * F.lit(1 << 32) + F.floor(F.col(PLACE) / block).cast("bigint"))
    done = []
    while not pending.isEmpty():
        best = stock.groupBy("product_id").agg(F.max("quantity_available").alias("_best"))
        known = pending.drop("_best").join(best, "product_id")
        done.append(_rejected(known.filter(F.col("quantity") > F.col("_best")), F.lit("insufficient stock")))
        able = table_written(spark, known.filter(F.col("quantity") <= F.col("_best")), "hot-able")
        now = table_written(spark, next_blocks(able, block), "hot-blocks")
        result = table_written(spark, _folded(able.join(now, ["product_id", "block"], "left_semi"), stock), "hot-folded")
        done.append(result.filter("record = 'request'"))
        final = result.filter("record = 'stock'").select("inventory_id", F.col("stock_after").alias("_left"))
        stock = table_written(spark, stock.join(final, "inventory_id", "left").select(
            "product_id", "inventory_id", F.coalesce("_left", "quantity_available").alias("quantity_available"), "minimum_threshold",
            (F.col("_left").isNotNull() | F.col("touched")).alias("touched")), "hot-stock")
        pending = able.join(now, ["product_id", "block"], "left_anti")
    none = F.lit(None)
    done.append(stock.filter("touched").select(
        F.lit("stock").alias("record"), none.cast("bigint").alias("seq"), "product_id", "inventory_id", none.cast("string").alias("status"),
        none.cast("string").alias("reason"), none.cast("int").alias("stock_before"), F.col("quantity_available").alias("stock_after"),
        "minimum_threshold", none.cast("bigint").alias("company_id"), none.cast("int").alias("quantity"),
        none.cast("string").alias("priority")))
    return reduce(lambda a, b: a.unionByName(b), done)


def run_allocation(requests: DataFrame, inventory: DataFrame, companies: DataFrame, products: DataFrame,
                   block: int = BLOCK) -> DataFrame:
    """One 'request' record per request and one 'stock' record per stock row whose quantity
    changed (its final quantity)."""
    spark = requests.sparkSession
    best = best_stock_row(inventory, products).select("product_id", F.col("quantity_available").alias("_best"))
    req = _validated(requests, companies).join(best, "product_id", "left")
    wants = F.col("quantity")
    reason = (F.when(F.col("_best").isNull(), "no inventory").when(wants > F.col("_best"), "insufficient stock")
              .when(F.coalesce(wants, F.lit(0)) <= 0, "invalid request"))
    # written, so that the fold's tasks follow the number of rows and hold none of this join's sorts
    req = table_written(spark, req.select("seq", "company_id", "product_id", "quantity", "priority", "valid", reason.alias("_reason")),
                        "requests", JOIN_BYTES)
    early = _rejected(req.filter("_reason IS NOT NULL"), F.col("_reason"))
    open_ = req.filter("_reason IS NULL")
    stock = inventory.select("product_id", "inventory_id", "quantity_available", "minimum_threshold")
    hot = open_.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("product_id")
    hot = table_written(spark, hot, "hot-products")
    if hot.isEmpty():
        asked = open_.select("product_id").distinct()
        return early.unionByName(_folded(open_, stock.join(asked, "product_id", "left_semi")))
    cold = open_.join(hot, "product_id", "left_anti")
    asked = cold.select("product_id").distinct()
    rounds = _fold_in_rounds(open_.join(hot, "product_id", "left_semi").select(
        "seq", "company_id", "product_id", "quantity", "priority", "valid"),
        stock.join(hot, "product_id", "left_semi").withColumn("touched", F.lit(False)), block)
    return early.unionByName(_folded(cold, stock.join(asked, "product_id", "left_semi"))).unionByName(rounds)


def allocate_orders(t, requests: DataFrame | None = None, as_of=None, written: bool = False, block: int = BLOCK):
    """Returns (decisions, new orders, new inventory, stock changes); ``written`` runs the fold
    once for all of them."""
    as_of = as_of if as_of is not None else t.as_of
    requests = requests if requests is not None else t.order_request
    folded = run_allocation(requests, t.inventory, t.company, t.product, block)
    if written:
        folded = table_written(t.spark, folded, "allocation")
    decisions = folded.filter(F.col("record") == "request").select(
        "seq", "company_id", "product_id", "quantity", "priority", "status", "reason", "inventory_id", "stock_before",
        "stock_after")
    day = as_of_lit(as_of)
    orders = decisions.filter(F.col("status") == "accepted").select(
        F.col("seq").alias("request_seq"), "company_id", "product_id", F.col("quantity").alias("order_quantity"),
        day.alias("order_date"), F.date_add(day, ORDER_FULFIL_DAYS).alias("expected_fulfill_date"),
        F.lit("Pending").alias("order_status"), F.col("priority").alias("priority_level"))
    final = folded.filter(F.col("record") == "stock").select(
        "inventory_id", F.col("stock_after").alias("_new_qty"))
    inv = t.inventory.join(final, "inventory_id", "left")
    changed = F.col("_new_qty").isNotNull()
    new_inventory = inv.select(
        *[F.when(changed, F.col("_new_qty")).otherwise(F.col(c)).alias(c) if c == "quantity_available"
          else F.when(changed, day).otherwise(F.col(c)).alias(c) if c == "last_updated"
          else F.when(changed, stock_status(F.col("_new_qty"), F.col("minimum_threshold"))).otherwise(F.col(c))
          .alias(c) if c == "inventory_status" else F.col(c) for c in t.inventory.columns])
    changes = folded.filter((F.col("record") == "request") & (F.col("status") == "accepted")).select(
        "seq", "inventory_id", F.col("stock_before").alias("old_quantity"),
        F.col("stock_after").alias("new_quantity"), F.col("minimum_threshold").alias("old_threshold"),
        F.col("minimum_threshold").alias("new_threshold"))
    return decisions, orders, new_inventory, changes


def allocation_invariants(t, as_of=None) -> DataFrame:
    """Checks on the fold, one row per product with an accepted request: the accepted units
    equal the fall of its stock, and none of its stock rows ends below zero (``holds``)."""
    decisions, _, new_inv, _ = allocate_orders(t, as_of=as_of, written=True)
    acc = (decisions.filter(F.col("status") == "accepted").groupBy("product_id")
           .agg(F.sum("quantity").cast("bigint").alias("accepted_units")))
    before = t.inventory.groupBy("product_id").agg(F.sum("quantity_available").cast("bigint").alias("before_units"))
    after = new_inv.groupBy("product_id").agg(F.sum("quantity_available").cast("bigint").alias("after_units"),
                                              F.min("quantity_available").alias("least"))
    x = acc.join(before, "product_id").join(after, "product_id")
    holds = (F.col("before_units") - F.col("after_units") == F.col("accepted_units")) & (F.col("least") >= 0)
    return x.select("product_id", "accepted_units", "before_units", "after_units", holds.alias("holds"))


def allocation_summary(t, as_of=None) -> DataFrame:
    decisions = allocate_orders(t, as_of=as_of)[0]
    return decisions.groupBy("status", "reason").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("quantity").cast("bigint").alias("units"))


def allocation_risk_events(t, as_of=None) -> DataFrame:
    """The stock reductions of the allocation feed the inventory trigger (E1): a row
    fires on its first crossing below threshold, unless an open 'Low Stock' risk exists."""
    from chainlens.streaming.triggers import inventory_risk_events
    as_of = as_of if as_of is not None else t.as_of
    changes = allocate_orders(t, as_of=as_of)[3]
    return inventory_risk_events(changes, t.risk_event, as_of)

