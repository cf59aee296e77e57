"""CPCB index arithmetic as column expressions (one text for the DataFrame and the SQL side)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession, functions as F

from vayuspark.vocab import (
    AVERAGES, BREAKPOINTS, CATEGORIES, INDEX_LEVELS, LABELS, NO_DATA_CATEGORY, POLLUTANTS,
    SUB_INDICES, TOP_CATEGORY,
)


def sub_index_text(name: str, pollutant: str) -> str:
    """SQL text of the piecewise-linear index of an averaged concentration column."""
    points, known = BREAKPOINTS[pollutant], f"`{name}` IS NOT NULL AND NOT isnan(`{name}`)"
    arms = [f"WHEN {known} AND `{name}` < {points[0]}D THEN {INDEX_LEVELS[0]}D"]
    for i in range(len(points) - 1):
        slope = (INDEX_LEVELS[i + 1] - INDEX_LEVELS[i]) / (points[i + 1] - points[i])
        arms.append(f"WHEN `{name}` < {points[i + 1]}D THEN {INDEX_LEVELS[i]}D + (`{name}` - {points[i]}D) * {slope!r}D")
    return f"CASE {' '.join(arms)} WHEN {known} THEN {INDEX_LEVELS[-1]}D END"


def sub_index(name: str, pollutant: str) -> Column:
    """Index of a column by name; null stays null, below 0 is 0, the top is 500."""
    return F.expr(sub_index_text(name, pollutant))


def settled_index(name: str, pollutant: str, digits: int = 6) -> Column:
    return F.expr(f"round(({sub_index_text(name, pollutant)}) + 1e-9D, {digits})")


def category(aqi: Column) -> Column:
    out = F.when(aqi.isNull(), F.lit(None).cast("string"))
    for upper, name in CATEGORIES:
        out = out.when(aqi <= upper, F.lit(name))
    return out.otherwise(F.lit(TOP_CATEGORY))


def category_index(aqi: Column) -> Column:
    """0 (Good) to 5 (Severe) of a rounded index."""
    return sum((aqi > upper).cast("int") for upper, _ in CATEGORIES)


def settle(x: Column, digits: int = 6) -> Column:
    """Round so that noise of the summation order cannot move a value: exact ties go up."""
    return F.round(x + F.lit(1e-9), digits)


def half_even(x: Column) -> Column:
    return F.bround(settle(x), 0).cast("int")


def index_columns(averages: dict[str, str] | None = None) -> dict[str, Column]:
    """Sub-index column per pollutant from the averaged columns."""
    averages = averages or AVERAGES
    return {SUB_INDICES[p]: settled_index(averages[p], p) for p in POLLUTANTS}


def prominent(subs: dict[str, Column], top: Column) -> Column:
    """First pollutant, in the fixed order, whose sub-index equals the top."""
    place = F.array_position(F.array(*[subs[p] for p in POLLUTANTS]), top).cast("int")
    return F.element_at(F.array(*[F.lit(LABELS[p]) for p in POLLUTANTS]), place)


def with_aqi(df, averages: dict[str, str] | None = None):
    """Add sub-indices, aqi, prominent_pollutant, aqi_category; hours without any index go away."""
    subs = {p: F.col(SUB_INDICES[p]) for p in POLLUTANTS}
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c in (averages or AVERAGES).values()]
    df = df.where(reduce(or_, known))       # asked of the averages, so that no index is worked out twice
    # the top index is asked of the same expressions: used twice, they become methods of their own in the
    # generated code, which keeps every method small enough for the JIT
    exprs = index_columns(averages)
    return (
        df.withColumns({**exprs, "_top": F.greatest(*exprs.values())})
        .withColumns({
            "aqi": half_even(F.col("_top")),
            "prominent_pollutant": prominent(subs, F.col("_top")),
        })
        .withColumn("aqi_category", category(F.col("aqi")))
        .drop("_top")
    )


def composite(df, columns: dict[str, str]):
    """Row-wise index of already averaged values: sub-indices to 2 digits, label, category."""
    subs = {SUB_INDICES[p]: settled_index(c, p, 2) for p, c in columns.items()}
    df = df.withColumns({**subs, "_top": F.greatest(*subs.values())})
    label = F.lit(None).cast("string")
    for p in reversed(list(columns)):
        label = F.when(F.col(SUB_INDICES[p]) == F.col("_top"), F.lit(LABELS[p])).otherwise(label)
    return (
        df.withColumns({"aqi": half_even(F.col("_top")), "prominent_pollutant": label})
        .withColumn("aqi_category", F.coalesce(category(F.col("aqi")), F.lit(NO_DATA_CATEGORY)))
        .drop("_top")
    )


def register_sql_functions(spark: SparkSession) -> None:
    """`cpcb_sub_index(c, bp)` and `cpcb_category(aqi)` as SQL functions, inlined by Catalyst."""
    arms = " ".join(
        f"WHEN greatest(c, 0D) < bp[{i + 1}] THEN {lo}D + (greatest(c, 0D) - bp[{i}]) * {hi - lo}D / (bp[{i + 1}] - bp[{i}])"
        for i, (lo, hi) in enumerate(zip(INDEX_LEVELS, INDEX_LEVELS[1:]))
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cpcb_sub_index(c DOUBLE, bp ARRAY<DOUBLE>) RETURNS DOUBLE "
        f"RETURN CASE WHEN c IS NULL THEN NULL WHEN c >= bp[{len(INDEX_LEVELS) - 1}] THEN {INDEX_LEVELS[-1]}D {arms} END"
    )
    names = " ".join(f"WHEN aqi <= {upper} THEN '{name}'" for upper, name in CATEGORIES)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cpcb_category(aqi DOUBLE) RETURNS STRING "
        f"RETURN CASE WHEN aqi IS NULL THEN NULL {names} ELSE '{TOP_CATEGORY}' END"
    )
