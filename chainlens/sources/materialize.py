"""Build the derived domain tables once per input snapshot and reuse them.

The mapping from the driver tables (S2) aggregates ``lineitem`` and windows over
``events``; every query that reads ``inventory`` or ``shipment`` would redo that work.
Here a derived table is written into the shared folder named by ``spark.checkpoint.dir``
when a query first reads it (a written table cuts the lineage: a lost executor re-reads
files instead of recomputing the mapping), and later queries read the files.  The folder
name is a fingerprint of the input tables (modification time, bytes and number of files),
so changed inputs get a new snapshot.

A table is written under a name of its own and published by a rename, so two sessions
that build the same table never write to one path and a reader never sees half a table.
Snapshots of former inputs stay until the folder's owner removes them.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from chainlens.schema import SCHEMAS
from chainlens.session import checkpoint_root, shuffles_removed
from chainlens.sources.star import star_to_domain
from chainlens.sources.tables import Tables, file_system

DERIVED = ["company", "supplier", "product", "warehouse", "inventory", "shipment", "orders", "risk_event",
           "app_user", "user_subscription", "order_request", "inventory_change", "shipment_change",
           "risk_resolution", "payment"]

#: How derived tables are laid out: risks are always read for some entity types.
PARTITIONED = {"risk_event": ["entity_type"]}


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """One listing of the input folder and one summary per table, however many files they have."""
    fs, root = file_system(spark, sf_dir)
    parts = [sf_dir]
    for st in fs.listStatus(root):
        sums = fs.getContentSummary(st.getPath())
        parts.append(f"{st.getPath().toString()}|{st.getModificationTime()}|{sums.getLength()}|{sums.getFileCount()}")
    return hashlib.sha1("\n".join(sorted(parts)).encode()).hexdigest()[:16]


def published(spark: SparkSession, root: str, name: str, build) -> DataFrame:
    """The table ``name`` of the snapshot ``root``, written by ``build`` if it isn't there."""
    path = f"{root}/{name}"
    fs, final = file_system(spark, path)
    if not fs.exists(final):
        own = f"{root}/_{name}-{uuid.uuid4().hex}"
        table = build()
        with shuffles_removed(spark):
            table.write.partitionBy(*PARTITIONED.get(name, [])).parquet(own)
        mine = file_system(spark, own)[1]
        # renaming onto a folder that another session published meanwhile moves ours into it
        if fs.exists(final) or not fs.rename(mine, final):
            fs.delete(mine, True)
    schema = SCHEMAS[name]
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def present(spark: SparkSession, root: str, name: str) -> bool:
    fs, path = file_system(spark, f"{root}/{name}")
    return fs.exists(path)


def materialized_domain(spark: SparkSession, sf_dir: str, names=DERIVED) -> Tables:
    """The domain tables; a derived one is built when a query asks for it."""
    t = star_to_domain(spark, sf_dir)
    root = f"{checkpoint_root(spark).rstrip('/')}/domain-{_fingerprint(spark, sf_dir)}"
    built = {n: (lambda n=n: published(spark, root, n, lambda: t[n])) for n in names}
    return t.with_factories(built, {n: (lambda n=n: built[n]() if present(spark, root, n) else t[n]) for n in names})
