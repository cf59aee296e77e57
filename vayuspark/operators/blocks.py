"""Bounded window groups.

A window over one node needs that whole node in one task. Cutting the axis into blocks and copying
the few rows that a neighbouring block looks back (or ahead) at keeps every group small, however
long a series is, and lets the work spread beyond the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK, CORE = "_block", "_core"


def with_halo(df: DataFrame, pos: Column, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Add `_block` and `_core`; copy rows into the blocks whose core rows see them.

    `pos` is an integer position; a core row sees positions [pos - before, pos + after].
    """
    first = F.floor((pos - F.lit(after)) / size)
    last = F.floor((pos + F.lit(before)) / size)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(
        CORE, F.col(BLOCK) == F.floor(pos / size)
    )


def core_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORE)).drop(BLOCK, CORE)


def block_window(keys: list[str], order: str):
    return Window.partitionBy(*keys, BLOCK).orderBy(order)


def running_before(
    df: DataFrame, groups: list[str], bucket: Column, order: list, weight: Column | None = None,
    out: str = "before",
) -> DataFrame:
    """Total weight of the rows ordered before each row of its group.

    `bucket` must not fall while the order rises; groups and bucket are never null. Bucket totals are added up first (a table as small
    as the number of buckets), rows are then counted only inside their bucket, so neither a whole
    group nor a whole table is ever ordered in one task.
    """
    weight = F.lit(1) if weight is None else weight
    df = df.withColumn("_bucket", bucket).withColumn("_weight", weight.cast("long"))
    keys = groups + ["_bucket"]
    totals = df.groupBy(*keys).agg(F.sum("_weight").alias("_in_bucket"))
    across = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_bucket")
    offsets = totals.select(
        *keys,
        F.coalesce(
            F.sum("_in_bucket").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(offsets, keys)       # leaves the rows partitioned as the window needs them
    return joined.withColumn(
        out, F.col("_offset") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    ).drop("_bucket", "_weight", "_offset")


def order_bucket(x: Column, fineness: int = 177) -> Column:
    """A bucket number that never falls as the number rises: relative at every magnitude, 0 for 0."""
    size = F.floor(F.log2(F.abs(x.cast("double"))) * fineness) + 1100 * fineness
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x.cast("double")) * size).cast("long")


def exact_quantiles(df: DataFrame, groups: list[str], value: str, quantiles: list[float], names: list[str]) -> DataFrame:
    """Exact quantiles (linear between neighbours) per group, without gathering a group.

    Equal values collapse to a count first; only the distinct values next to a wanted rank are kept.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = running_before(counts, groups, order_bucket(F.col(value)), [value], F.col("_n"), "_before")
    sizes = counts.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    if groups:
        placed = placed.join(sizes, groups)
    else:
        placed = placed.withColumn("_size", sizes.select("_size").scalar())
    aggs, outs = [], [F.col(g) for g in groups]
    v = F.col(value).cast("double")
    for q, name in zip(quantiles, names):
        rank = F.lit(float(q)) * (F.col("_size") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))
        aggs += [
            F.max(F.when(holds(low), v)).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), v)).alias(f"_hi_{name}"),
            F.max(rank - low).alias(f"_part_{name}"),
        ]
        outs.append(
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_part_{name}")).alias(name)
        )
    return placed.groupBy(*groups).agg(*aggs).select(*outs)
