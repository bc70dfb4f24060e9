"""Named queries: a DataFrame function, its columns, and the SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from inswing.catalog.oracle import with_tables
from inswing.plans.workspace import Workspace, workspace


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[Workspace], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, inputs: str) -> DataFrame:
        df = self.fn(workspace(spark, inputs))
        return df.select(*[_spark(name, kind) for name, kind in self.columns]) if self.columns else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.columns:
            return with_tables(self.sql)
        out = ", ".join(_duck(name, kind) for name, kind in self.columns)
        text = self.sql.strip()
        return with_tables(f"SELECT {out} FROM (\n{text}\n) AS answer")


QUERIES: dict[str, Query] = {}


def _spark(name: str, kind: str):
    col = F.col(name)
    if kind == "f":  # whole multiples of 1e-6; adding zero removes the sign of a negative zero
        col = F.round(col.cast("double"), 6) + F.lit(0.0)
    else:
        col = col.cast({"i": "bigint", "s": "string", "d": "date", "b": "boolean"}[kind])
    return col.alias(name)


def _duck(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    if kind == "f":
        return f"round({quoted}::DOUBLE, 6) + 0.0::DOUBLE AS {quoted}"
    kind = {"i": "BIGINT", "s": "VARCHAR", "d": "DATE", "b": "BOOLEAN"}[kind]
    return f"CAST({quoted} AS {kind}) AS {quoted}"


def columns(spec: str) -> tuple[tuple[str, str], ...]:
    """'a b:i c:f' gives a string, a long and a double column."""
    return tuple((x.split(":") + ["s"])[:2] for x in spec.replace(",", " ").split()) if spec else ()


def query(name: str, spec: str = "", sql: str | None = None):
    def wrap(fn):
        add(name, spec, sql, fn)
        return fn
    return wrap


def add(name: str, spec: str, sql: str | None, fn: Callable[[Workspace], DataFrame]) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = Query(name, fn, tuple(tuple(x) for x in columns(spec)), sql)
