"""Materialised relations.

Every relation is a function of other relations. A workspace writes a relation once as Parquet under the shared
checkpoint folder and hands out scans of it, so that lineage is cut by a table that survives the loss of an executor
and later queries get column pruning and filter pushdown.
"""
from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BUILDERS: dict[str, tuple[Callable[["Workspace"], DataFrame], tuple[str, ...]]] = {}
VIEWS: set[str] = set()
LARGE_ROWS: set[str] = set()
ROWS_PER_TASK = 150_000  # rows of a ball, through several sorts at once, that fit the memory of one task

# A writer holds a whole row group, whose size is counted compressed, and a reader decodes up to 4,096 rows of one at a time, however long they are
SMALL_GROUPS = {"parquet.block.row.count.limit": 64, "parquet.page.size.row.check.min": 8}

METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")  # bytes of a method that HotSpot still compiles
# Rows in memory are some forty times their files (an innings takes 7 bytes there), and Spark takes the size of the files for the
# size of a broadcast, which the driver holds
ROWS_TO_FILES = ("spark.sql.sources.fileCompressionFactor", "40.0")
_writing: dict = {"n": 0, "before": {}}
_writing_guard = threading.Lock()


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """While a relation is written, leave no generated method so long that the JVM interprets it, and judge tables by their rows in memory.

    Rows of a ball have some eighty columns, and one method for a whole stage of them is never compiled by the JVM. Under this limit Spark
    runs such a stage operator by operator instead. Relations are written side by side: the last one out puts the settings back.
    """
    with _writing_guard:
        if _writing["n"] == 0:
            for name, value in (METHOD_LIMIT, ROWS_TO_FILES):
                _writing["before"][name] = spark.conf.get(name)
                spark.conf.set(name, value)
        _writing["n"] += 1
    try:
        yield
    finally:
        with _writing_guard:
            _writing["n"] -= 1
            if _writing["n"] == 0:
                for name, value in _writing["before"].items():
                    spark.conf.set(name, value)


def relation(name: str, partition_by: tuple[str, ...] = (), written: bool = True, large_rows: bool = False):
    """Register the builder of a relation; one that only renames or casts columns of a written one need not be written again.

    One with large rows, as whole documents, is written in small row groups."""
    def wrap(fn: Callable[["Workspace"], DataFrame]):
        BUILDERS[name] = (fn, partition_by)
        if not written:
            VIEWS.add(name)
        if large_rows:
            LARGE_ROWS.add(name)
        return fn
    return wrap


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where none is set and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="inswing-")


class Workspace:
    def __init__(self, spark: SparkSession, inputs: str, given: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.inputs = inputs
        self.given = dict(given or {})
        self.root = f"{shared_folder(spark)}/inswing-{uuid.uuid4().hex[:12]}"
        self._ready: dict[str, DataFrame] = {}
        self._guard = threading.Lock()
        self._locks: dict[str, threading.RLock] = {}

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.inputs}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.given:
            return self.given[name]
        with self._guard:
            lock = self._locks.setdefault(name, threading.RLock())
        with lock:  # relations depend on each other without cycles, so locks are always taken in one order
            if name not in self._ready:
                builder, parts = BUILDERS[name]
                if name in VIEWS:
                    self._ready[name] = builder(self)
                    return self._ready[name]
                path = f"{self.root}/{name}"
                writer = builder(self).write.mode("overwrite").option("compression", "zstd")
                if name in LARGE_ROWS:
                    writer = writer.options(**{k: str(v) for k, v in SMALL_GROUPS.items()})
                with compiled(self.spark):
                    (writer.partitionBy(*parts) if parts else writer).parquet(path)
                self._ready[name] = self.spark.read.parquet(path)
            return self._ready[name]

    def prepare(self, names: list[str], threads: int = 4) -> None:
        """Build several relations side by side: while one waits for its last tasks, another uses the free slots."""
        with ThreadPoolExecutor(threads) as pool:
            for done in [pool.submit(self.__getitem__, n) for n in names]:
                done.result()

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """Shuffle a scan by keys into tasks that sort in memory.

        Spark sizes shuffle partitions by their compressed bytes, and rows of a ball are many times that in memory, so large
        tables are dealt by their number of rows; small ones are left to Spark.
        """
        tasks = -(-df.count() // ROWS_PER_TASK)
        if tasks <= self.spark.sparkContext.defaultParallelism:
            return df.repartition(*keys)
        return df.repartition(max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), *keys)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write an intermediate result that several branches of a query read, and return a scan of it."""
        path = f"{self.root}/stage/{name}-{uuid.uuid4().hex[:12]}"
        with compiled(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, inputs: str) -> Workspace:
    """One workspace per application and input folder."""
    key = (spark.sparkContext.applicationId, inputs.rstrip("/"))
    if key not in _open:
        _open[key] = Workspace(spark, key[1])
    return _open[key]
