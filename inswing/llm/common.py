"""Helpers that several operators share."""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inswing.plans.workspace import shared_folder

SPACE = r"[\x20\x09-\x0D]+"  # ASCII white space; everything else belongs to a word
_FOLDERS: dict[str, str] = {}


def text_of(column: Column | str) -> Column:
    """The text; an empty one where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters that are not ASCII white space, as an array."""
    return F.array_remove(F.split(text, SPACE), "")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark)}/llm-{app}"
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return a scan of it: lineage ends at files that survive a lost executor,
    and later joins know the size of what they read."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: later steps read the table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def empty(df: DataFrame) -> bool:
    return not df.head(1)
