"""Registration, and pieces of SQL that many queries share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PATH = "with " + adapters.PRICE_PATH_SQL
SEGMENTS = "with " + adapters.SEGMENT_SQL
W = "(partition by symbol order by date)"


def add(name: str, sql: str | None = None):
    """Register a query under a name."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def frame(n: int) -> str:
    return f"(partition by symbol order by date rows between {n - 1} preceding and current row)"


def rolled(agg: str, value: str, n: int, count: str | None = None) -> str:
    """SQL of an aggregate over the last n rows, NULL unless all n have the value."""
    return f"case when count({count or value}) over {frame(n)} = {n} then {agg}({value}) over {frame(n)} end"


def smoothed(value: str, alpha: float, n: int) -> str:
    """SQL of exponential smoothing from the first value, NULL below n values."""
    upto = "(partition by symbol order by date rows between unbounded preceding and current row)"
    return f"case when count({value}) over {upto} >= {n} then list_reduce(list({value}) filter ({value} is not null) over {upto}, lambda acc, x: acc * {1 - alpha!r} + x * {alpha!r}) end"


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for output."""
    return df.select(*[F.round(c, special.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


ANNUAL = repr(math.sqrt(252))
