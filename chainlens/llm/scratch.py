"""Written tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.session import scratch_path, shuffles_removed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Row groups of written tables: a task's writer holds one, a reader one per column.
ROW_GROUP = 16 << 20


#: Rows up to which a table is worked off at once, and the slices of a larger one: a slice's shuffles
#: are gone before those of the next.
FEW, SLICES = 200_000, 5


def keep(spark: SparkSession, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to a fresh folder of ``spark.checkpoint.dir`` and read it back."""
    return keep_all(spark, [df], name, codec)


def keep_all(spark: SparkSession, parts: Iterable[DataFrame], name: str, codec: str = "snappy") -> DataFrame:
    """Write the frames ``parts``, one after the other, as one table like :func:`keep`."""
    path = scratch_path(spark, f"llm-{name}")
    for df in parts:
        with shuffles_removed(spark):
            df.write.mode("append").option("parquet.block.size", ROW_GROUP).option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(df: DataFrame, most: int = SLICES) -> int:
    """In how many slices the written ``df`` is worked off."""
    return most if df.count() > FEW else 1


def in_slice(value: Column, k: int, n: int) -> Column:
    """Whether the hash ``value`` belongs to slice ``k`` of ``n``."""
    return F.pmod(value, F.lit(n)) == k if n > 1 else F.lit(True)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of :func:`keep` that no later plan reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def anything(df: DataFrame) -> bool:
    return not df.isEmpty()
