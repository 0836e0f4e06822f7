"""E3 — the shared risk state machine as a Structured Streaming job.

Key: (entity_type, entity_id, risk_type).  State: the number of open risks of that
kind on that row (a count, not a flag: several can be open).  Events, in ``seq`` order
per key, closes before crossings of the same ``seq``:

* ``close`` — an open risk of the key was resolved or deleted; count − 1, floor 0;
* ``crossing`` — the trigger condition held (E1 / E2); a risk is created when the
  count is 0, and the count goes up by one.

The initial counts are the open risks in ``risk_event``.  State never expires (the
source system keeps open risks forever).

Each micro-batch is a plan of built-in functions without a fold: only the first crossing between
two closes of a key can create a risk, and it does so once the closes so far reach the count
before the batch.  Counts and created risks are written under the batch's number
(``foreachBatch``; a replayed batch writes the same folders again, so every risk is emitted
once).

Counts lie in hash buckets of about ``KEYS_PER_BUCKET`` keys, and a bucket has a version per batch that
touched it (:class:`OpenCounts`).  A batch reads and writes the buckets of its own events only, so
what it writes follows its events and not the state.  No key's events are gathered in one task: a hot key is
a sum over ordered slices and grouped aggregates.

The change log is written in slices of ``seq``, one after the other, so a key crosses
micro-batches and its state carries over.  Within a slice a key's events lie in one file;
how many slices and files there are follows from the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.functions.predicates import as_of_lit
from chainlens.operators.slices import in_slices, sum_before
from chainlens.schema import OPEN_STATUSES, RISK_DELAYED, RISK_LOW_STOCK
from chainlens.session import scratch_path, written
from chainlens.streaming.triggers import inventory_candidates, shipment_candidates

KEY = ["entity_type", "entity_id", "risk_type"]
EVENT_SCHEMA = ("seq long, entity_type string, entity_id long, risk_type string, closes int, "
                "risk_severity string, description string")
EPOCH_SCHEMA = ("entity_type string, entity_id long, risk_type string, epoch long, "
                "e struct<seq:bigint,risk_severity:string,description:string>")
COUNT_SCHEMA = "entity_type string, entity_id long, risk_type string, open_risks long"
OUT_SCHEMA = "seq long, entity_type string, entity_id long, risk_type string, risk_severity string, description string"
SLICES = 3                 # micro-batches at least, so that state is always carried
ROWS_PER_FILE = 2_000_000
KEYS_PER_BUCKET = 10_000


def is_tracked() -> F.Column:
    """The two kinds of risk that triggers create."""
    return (((F.col("entity_type") == "Inventory") & (F.col("risk_type") == RISK_LOW_STOCK))
            | ((F.col("entity_type") == "Shipment") & (F.col("risk_type") == RISK_DELAYED)))


def initial_open_counts(risks: DataFrame) -> DataFrame:
    return (risks.filter(is_tracked() & F.col("resolution_status").isin(*OPEN_STATUSES))
            .groupBy(*KEY).agg(F.count(F.lit(1)).alias("open_risks")))


def trigger_events(t) -> DataFrame:
    """Crossing events of both triggers from the change logs, in the stream's schema."""
    inv = inventory_candidates(t.inventory_change)
    sh = shipment_candidates(t.shipment_change)
    return inv.unionByName(sh).select("seq", *KEY, F.lit(0).alias("closes"), "risk_severity", "description")


def close_events(t) -> DataFrame:
    """One close per open risk that a request resolves or deletes, at its first request."""
    first = t.risk_resolution.groupBy("risk_id").agg(F.min("seq").alias("seq"))
    risks = t.risk_event.filter(is_tracked() & F.col("resolution_status").isin(*OPEN_STATUSES))
    closed = risks.select("risk_id", *KEY).join(first, "risk_id")
    # requests of one seq close together
    return closed.groupBy("seq", *KEY).agg(F.count(F.lit(1)).cast("int").alias("closes")).select(
        "seq", *KEY, "closes", F.lit(None).cast("string").alias("risk_severity"),
        F.lit(None).cast("string").alias("description"))


def _epochs(events: DataFrame) -> DataFrame:
    """(KEY, epoch, e): the closes of the key up to then, and the first crossing of that epoch or NULL.

    An epoch lies between two closes.  A key with closes alone, or crossings alone, has one row, and takes
    one grouped aggregate.  Only the events of the other keys are put in order: the closes before an event
    are a two-level sum over ordered slices, so a key with a third of a batch's events is spread over them."""
    crossing = F.when(F.col("closes") > 0, None).otherwise(F.struct("seq", "risk_severity", "description"))
    x = events.select(F.struct(*KEY).alias("key"), "seq", "closes", "risk_severity", "description")
    keys = written(x.sparkSession, x.groupBy("key").agg(F.sum("closes").alias("epoch"), F.min(crossing).alias("e")), "risk-keys")
    both = (F.col("epoch") > 0) & F.col("e").isNotNull()
    mixed = keys.filter(both).select(F.col("key").alias("_mixed"))
    kind = F.when(F.col("closes") > 0, F.lit(0)).otherwise(F.lit(1))
    x = x.join(mixed, F.col("key").eqNullSafe(F.col("_mixed")), "left_semi").withColumn("kind", kind)
    x = sum_before(in_slices(x, "key", "seq", "kind", name="risk-events"), "key", F.col("closes"), "before")
    x = x.groupBy("key", (F.col("before") + F.col("closes")).alias("epoch")).agg(F.min(crossing).alias("e"))
    return keys.filter(~both).unionByName(x).select("key.*", "epoch", "e")


def _created(epochs: DataFrame, counts: DataFrame) -> DataFrame:
    """The crossings that create a risk: the first of each epoch that the count enters at 0.

    A key's count is 0 once its closes reach what was open before; from there each close leaves 0."""
    return (epochs.filter("e IS NOT NULL").join(counts, KEY, "left")
            .filter(F.col("epoch") >= F.coalesce("open_risks", F.lit(0)))
            .select("e.seq", *KEY, "e.risk_severity", "e.description"))


def _counted(epochs: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts (KEY, open_risks) after the batch of ``epochs``, from those before it."""
    last = epochs.groupBy(*KEY).agg(F.max("epoch").alias("closed"),
                                    F.max_by(F.col("e").isNotNull(), "epoch").alias("crossed"))
    before = F.coalesce("open_risks", F.lit(0))
    after = (F.when(F.col("closed").isNull(), before).when(F.col("closed") < before, before - F.col("closed"))
             .otherwise(F.col("crossed").cast("long")))
    return counts.join(last, KEY, "full_outer").select(*KEY, after.cast("bigint").alias("open_risks"))


def _advance(events: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts (KEY, open_risks) after one batch of events."""
    return _counted(_epochs(events), counts)


def write_log(events: DataFrame, path: str, slices: int = SLICES, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write ``events`` in slices of ``seq``, oldest first; returns the files of a slice."""
    spark = events.sparkSession
    staged = scratch_path(spark, "risk-log")
    events.write.parquet(staged)
    log = spark.read.schema(EVENT_SCHEMA).parquet(staged)
    stats = log.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("seq", [i / slices for i in range(1, slices)],
                                                                       10_000).alias("cuts")).first()
    files = max(1, -(-stats.n // (slices * rows_per_file)))
    edges = [None, *sorted(set(stats.cuts or [])), None]
    for low, high in zip(edges, edges[1:]):
        part = log if low is None else log.filter(F.col("seq") > low)
        part = part if high is None else part.filter(F.col("seq") <= high)
        # appended one after the other: the stream reads files in the order they appeared
        part.repartition(files, *KEY).write.mode("append").parquet(path)
    return files


class OpenCounts:
    """The open counts under ``root``: hash buckets, each in the folder of the batch that wrote it last.

    ``versions/v=n`` names, for the state before batch n, the batch of every bucket; it is written
    after the buckets, so a batch that is replayed starts from what it started from before.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root, buckets

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int").alias("bucket")

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.root}/buckets/v={version}/bucket={bucket}"

    def versions(self, number: int) -> dict[int, int]:
        """The batch that wrote each bucket last, before batch ``number``; one entry per bucket."""
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.root}/versions/v={number}").collect()
        return {r.bucket: r.version for r in rows}

    def touched(self, df: DataFrame) -> list[int]:
        return [r.bucket for r in df.select(self.bucket()).distinct().collect()]

    def read(self, number: int, buckets) -> DataFrame:
        """The counts of ``buckets`` before batch ``number``."""
        known = self.versions(number)
        paths = [self._folder(b, known[b]) for b in sorted(buckets) if b in known]
        return self.spark.read.schema(COUNT_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], COUNT_SCHEMA)

    def write(self, counts: DataFrame, number: int, known: dict[int, int]) -> None:
        """``counts`` of whole buckets as the state before batch ``number``; the others stay as in ``known``."""
        rows = counts.select(*KEY, "open_risks", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/buckets/v={number}")
        new = known | {b: number for b in self.touched(counts)}
        (self.spark.createDataFrame(sorted(new.items()), "bucket int, version int").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/versions/v={number}"))


def run_risk_state_stream(spark: SparkSession, events: DataFrame, initial: DataFrame, as_of,
                          slices: int = SLICES, rows_per_file: int = ROWS_PER_FILE,
                          keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """Run the stream over the change log to completion (``availableNow``) and return the
    created risks as a batch frame."""
    root = scratch_path(spark, "risk-state")
    src, out, ckpt = (f"{root}/{d}" for d in ("source", "output", "checkpoint"))
    files = write_log(events, src, slices, rows_per_file)
    log = spark.read.schema(EVENT_SCHEMA).parquet(src).select(*KEY)
    keys = log.unionByName(initial.select(*KEY)).select(F.approx_count_distinct(F.xxhash64(*KEY))).first()[0]
    state = OpenCounts(spark, f"{root}/counts", max(1, -(-keys // keys_per_bucket)))
    state.write(initial.select(*KEY, F.col("open_risks").cast("bigint")), 0, {})

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        own = OpenCounts(session, state.root, state.buckets)
        step = f"{root}/steps/v={number}"
        _epochs(df).write.mode("overwrite").parquet(f"{step}/epochs")
        epochs, before = session.read.schema(EPOCH_SCHEMA).parquet(f"{step}/epochs"), own.read(number, own.touched(df))
        _counted(epochs, before).write.mode("overwrite").parquet(f"{step}/counts")
        own.write(session.read.schema(COUNT_SCHEMA).parquet(f"{step}/counts"), number + 1, own.versions(number))
        _created(epochs, before).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(src)
    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    spark.createDataFrame([], OUT_SCHEMA).write.mode("overwrite").parquet(f"{out}/batch=-1")
    return spark.read.schema(OUT_SCHEMA).parquet(out).select(
        "seq", *KEY, "risk_severity", as_of_lit(as_of).alias("detected_date"), "description",
        F.lit("Open").alias("resolution_status"))


def risk_state_stream(spark: SparkSession, t, as_of=None) -> DataFrame:
    """Both triggers with the resolutions of the request log."""
    as_of = as_of if as_of is not None else t.as_of
    events = trigger_events(t).unionByName(close_events(t))
    return run_risk_state_stream(spark, events, initial_open_counts(t.risk_event), as_of)
