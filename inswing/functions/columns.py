"""Small column helpers shared by the operators."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, Window, functions as F

from inswing.schema import TEAM_RENAMES


def c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def total(value: str | Column, when: Column | None = None) -> Column:
    """Sum as a long, optionally over the rows where a condition holds."""
    v = c(value)
    return F.sum(v if when is None else F.when(when, v))


def tally(when: Column) -> Column:
    return F.count_if(when)


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """scale * num / den, null when the denominator is zero."""
    return F.lit(scale) * num / F.nullif(den, F.lit(0))


def lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*mapping.items())])
    return F.coalesce(table[key], key if default is None else default)


def canonical_team(team: str | Column) -> Column:
    return lookup(TEAM_RENAMES, c(team))


def before(*keys: str, order: str = "seq") -> Window:
    """Rows of the group strictly before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def upto(*keys: str, order: str = "seq") -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def ranked(df, keys: list[str], order: list[Column], k: int, name: str = "rank"):
    """First k rows of each group; the row_number filter lets Spark limit each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def top(df, order: list[Column], k: int, name: str = "rank"):
    """Global top k: the sort stops at k rows per task, and only those k rows are numbered."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)))
