"""P1–P4 — plan catalogue, active subscription, activation, default plan."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.schema import SCHEMAS, STARTER_PLAN, SUBSCRIPTION_DAYS

# The three plan tiers (id, name, monthly price, max suppliers,
# max products, pipeline, map, AI chat, chat limit, export).  NULL limit = unlimited,
# chat limit -1 = unlimited, 0 = none.
PLAN_ROWS = [
    (1, "Starter", Decimal("0.00"), 3, 10, False, False, False, 0, False),
    (2, "Professional", Decimal("999.00"), 25, 100, True, True, True, 50, False),
    (3, "Enterprise", Decimal("2999.00"), None, None, True, True, True, -1, True),
]

ENTITLEMENT_COLS = ["plan_name", "price_monthly", "max_suppliers", "max_products", "has_pipeline",
                    "has_map", "has_ai_chat", "ai_chat_limit", "has_export"]


def plan_catalog(spark: SparkSession) -> DataFrame:
    rows = [r + (True, None) for r in PLAN_ROWS]
    return spark.createDataFrame(rows, SCHEMAS["subscription_plan"])


def list_plans(t) -> DataFrame:
    """Active plans by price ascending."""
    return (t.subscription_plan.filter(F.coalesce(F.col("is_active"), F.lit(False)))
            .orderBy("price_monthly", "plan_id"))


def list_plans_with_users(t) -> DataFrame:
    """L10 with the number of users whose subscription to the plan is active."""
    users = (t.user_subscription.filter(F.col("status") == "active").groupBy("plan_id")
             .agg(F.countDistinct("user_id").alias("active_users")))
    plans = t.subscription_plan.filter(F.coalesce(F.col("is_active"), F.lit(False)))
    return (plans.join(users, "plan_id", "left").withColumn("active_users", F.coalesce("active_users", F.lit(0)))
            .select(*t.subscription_plan.columns, "active_users").orderBy("price_monthly", "plan_id"))


def active_subscription(t) -> DataFrame:
    """Newest 'active' row per user (by created_at, then id) with its plan's
    entitlement columns.  Expiry is not checked."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc_nulls_first(),
                                              F.col("subscription_id").desc())
    latest = (t.user_subscription.filter(F.col("status") == "active")
              .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn"))
    plans = t.subscription_plan.select("plan_id", *ENTITLEMENT_COLS)
    return latest.join(plans, "plan_id")


def assign_default_plan(t) -> DataFrame:
    """A Starter row (amount 0, no expiry) for every user with no active row."""
    active = t.user_subscription.filter(F.col("status") == "active").select("user_id")
    # plan_name is unique, so this is at most one id: a scalar subquery, not a join
    starter = t.subscription_plan.filter(F.col("plan_name") == STARTER_PLAN).agg(F.min("plan_id")).scalar()
    users = t.app_user.select("user_id").join(active, "user_id", "left_anti")
    return users.select("user_id", starter.alias("plan_id")).filter(F.col("plan_id").isNotNull()).select(
        "user_id", "plan_id", F.lit("active").alias("status"),
        F.lit(0).cast("decimal(10,2)").alias("amount_paid"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"))


def activate_subscriptions(t, payments: DataFrame | None = None, now=None) -> DataFrame:
    """Apply confirmed payments to the subscription table.

    For each payment matching a 'pending' row (same user and payment order id): every
    'active' row of that user expires, the pending row becomes active, started at the
    payment time and expiring 30 days later.  With several activations for one user the
    last one (by payment seq) is the one left active; earlier ones end expired.
    Returns the full new subscription table.
    """
    subs = t.user_subscription
    pays = payments if payments is not None else t.payment
    pending = subs.filter(F.col("status") == "pending").select("subscription_id", "user_id",
                                                                "payment_order_id")
    # a payment confirms at most one pending row; first payment per pending row wins
    matched = (pays.join(pending, ["user_id", "payment_order_id"])
               .groupBy("subscription_id", "user_id")
               .agg(F.min(F.struct("seq", "paid_at")).alias("p")))
    matched = matched.select("subscription_id", "user_id", F.col("p.seq").alias("pay_seq"),
                             F.col("p.paid_at").alias("paid_at"))
    per_user = matched.groupBy("user_id").agg(F.max("pay_seq").alias("last_seq"))
    started = F.coalesce(F.col("paid_at"), F.lit(now).cast("timestamp_ntz")) if now is not None \
        else F.col("paid_at")
    out = (subs.join(matched.select("subscription_id", "pay_seq", "paid_at"), "subscription_id", "left")
           .join(per_user, "user_id", "left"))
    activated = F.col("pay_seq").isNotNull()
    is_last = activated & (F.col("pay_seq") == F.col("last_seq"))
    new_status = (F.when(is_last, "active")
                  .when(activated, "expired")
                  .when(F.col("last_seq").isNotNull() & (F.col("status") == "active"), "expired")
                  .otherwise(F.col("status")))
    return out.select(
        "subscription_id", "user_id", "plan_id", new_status.alias("status"), "payment_order_id",
        "amount_paid",
        F.when(activated, started).otherwise(F.col("started_at")).alias("started_at"),
        F.when(activated, started + F.expr(f"INTERVAL {SUBSCRIPTION_DAYS} DAYS"))
        .otherwise(F.col("expires_at")).alias("expires_at"),
        "created_at")


def activate_free_plan(t, requests: DataFrame, now) -> DataFrame:
    """P2, free plan: for every user of ``requests(user_id, plan_id)`` who asks for a plan without
    a price, active rows expire and a new active row starts at ``now`` that never expires.

    Of several requests of one user the one with the smallest plan id counts; unknown users,
    unknown plans and priced plans change nothing.  New rows have no ``subscription_id`` yet
    (the sink numbers rows).  Returns the full new subscription table.
    """
    # the plans of the catalogue as a scalar: requests that all name one plan would make a join
    # on ``plan_id`` a join without a key
    free = t.subscription_plan.filter(F.col("price_monthly") == 0).agg(F.collect_set("plan_id")).scalar()
    ask = (requests.filter(F.array_contains(free, F.col("plan_id"))).join(t.app_user.select("user_id"), "user_id", "left_semi")
           .groupBy("user_id").agg(F.min("plan_id").alias("plan_id")))
    subs, at = t.user_subscription, F.lit(now).cast("timestamp_ntz")
    old = subs.join(ask.select("user_id", F.lit(True).alias("_asked")), "user_id", "left").select(
        *[F.when(F.col("_asked") & (F.col("status") == "active"), "expired").otherwise(F.col("status")).alias(c)
          if c == "status" else F.col(c) for c in subs.columns])
    new = {"user_id": F.col("user_id"), "plan_id": F.col("plan_id"), "status": F.lit("active"),
           "amount_paid": F.lit(0), "started_at": at, "created_at": at}
    return old.unionByName(ask.select(
        *[new.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in subs.schema.fields]))
