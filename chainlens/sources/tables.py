"""S1 — domain table bundle and full-table scans with a fixed schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainlens.schema import SCHEMAS


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Spark resolves them: schemes and default file system included."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Tables:
    """Lazily built domain DataFrames, keyed by table name.

    A factory is called at most once per bundle, so every operator that asks for
    ``t.inventory`` gets the same logical plan and Spark can reuse its exchanges.
    """

    def __init__(self, spark: SparkSession, factories: dict[str, Callable[[], DataFrame]],
                 as_of=None):
        self.spark = spark
        self._factories = dict(factories)
        self._cache: dict[str, DataFrame] = {}
        self._unbuilt: dict[str, Callable[[], DataFrame]] = {}
        self.as_of = as_of

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name not in self._factories:
                raise KeyError(f"no table {name!r}; have {sorted(self._factories)}")
            self._cache[name] = self._factories[name]()
        return self._cache[name]

    def __contains__(self, name: str) -> bool:
        return name in self._factories

    def names(self) -> list[str]:
        return sorted(self._factories)

    def keys(self, name: str, column: str) -> DataFrame:
        """One key column of a table.  Of a table that nobody built yet the column alone is derived,
        and the table is not built for it."""
        if name in self._cache or name not in self._unbuilt:
            return self[name].select(column)
        return self._unbuilt[name]().select(column)

    def with_factories(self, factories: dict[str, Callable[[], DataFrame]],
                       unbuilt: dict[str, Callable[[], DataFrame]] | None = None) -> "Tables":
        """A new bundle that builds the given tables by other factories, still lazily; ``unbuilt`` gives
        their rows without building them, for :meth:`keys`."""
        out = Tables(self.spark, {**self._factories, **factories}, self.as_of)
        out._unbuilt = {**{n: f for n, f in self._unbuilt.items() if n not in factories}, **(unbuilt or {})}
        if "raw" in self.__dict__:
            out.raw = self.raw
        return out

    def replace(self, **frames: DataFrame) -> "Tables":
        """A new bundle where the given tables are swapped for new frames."""
        fac = dict(self._factories)
        for k, df in frames.items():
            fac[k] = (lambda d=df: d)
        out = Tables(self.spark, fac, self.as_of)
        out._unbuilt = {n: f for n, f in self._unbuilt.items() if n not in frames}
        for k, v in self._cache.items():
            if k not in frames:
                out._cache[k] = v
        return out


def load_tables(spark: SparkSession, path: str, names=None, as_of=None) -> Tables:
    """Read ``<path>/<table>.parquet`` (file or folder) for every domain table present.

    The schema is fixed (``SCHEMAS``): Parquet column pruning and filter pushdown
    apply, and a file with a drifted schema fails at read instead of silently
    re-typing.
    """
    names = names or list(SCHEMAS)
    fac = {}
    for n in names:
        p = f"{path.rstrip('/')}/{n}.parquet"
        fs, at = file_system(spark, p)
        if fs.exists(at):
            fac[n] = (lambda p=p, n=n: spark.read.schema(SCHEMAS[n]).parquet(p))
    return Tables(spark, fac, as_of)


def tables_from_frames(spark: SparkSession, frames: dict[str, DataFrame], as_of=None) -> Tables:
    return Tables(spark, {k: (lambda d=v: d) for k, v in frames.items()}, as_of)
