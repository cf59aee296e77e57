"""Registry of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vayuspark.catalog.ctes import build
from vayuspark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS, NUDGE = 6, 1e-9


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)`; `sql` may use the shared tables of `ctes` by name."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = build(sql)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a few digits for the comparison; the nudge decides exact ties alike everywhere."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[
            F.round(F.col(c).cast("double") + F.lit(NUDGE), digits).alias(c) if c in doubles else F.col(c)
            for c in df.columns
        ]
    )


def r(*cols: str, digits: int = DIGITS) -> str:
    """SQL twin of `rounded`. `expr as name` or a plain column."""
    out = []
    for c in cols:
        expr, _, name = c.rpartition(" as ")
        expr, name = (expr, name) if expr else (c, c.split(".")[-1])
        out.append(f"round(cast({expr} as double) + {NUDGE}, {digits}) as {name}")
    return ", ".join(out)
