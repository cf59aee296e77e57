"""Joins of series, nodes and place candidates.

No side is forced into a broadcast: Spark does that at run time for sides it has measured as small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from vayuspark.functions.calendar import floor_hour
from vayuspark.functions.geo import in_box
from vayuspark.vocab import LOOKBACK, SATELLITE

KEYS = ["location_hash", "timestamp"]


def join_weather_air(weather: DataFrame, air: DataFrame) -> DataFrame:
    return weather.join(air, KEYS, "full_outer")


def hourly_median(series: DataFrame, value: str = "value") -> DataFrame:
    """Median per series and hour. A group is one hour of one place: what is kept of it are its distinct values and their counts."""
    hourly = series.withColumn("timestamp", floor_hour(F.col("timestamp"))).where(F.col(value).isNotNull())
    return hourly.groupBy("location_hash", "variable", "timestamp").agg(F.percentile(value, 0.5).alias(value))


def merge_satellite(series: DataFrame, variables: list[str] = SATELLITE) -> DataFrame:
    """Long hourly series (location_hash, timestamp, variable, value) as one row per hour.

    A pivot needs one shuffle where an outer join per product needs one each.
    """
    return series.groupBy(*KEYS).pivot("variable", variables).agg(F.max("value"))


def with_nodes(df: DataFrame, nodes: DataFrame) -> DataFrame:
    return df.join(nodes, "location_hash", "inner")


def patch_columns(left: DataFrame, right: DataFrame, columns: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Known values of `right` replace those of `left`."""
    new = right.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = left.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*left.columns)


def known_long_series(obs: DataFrame, nodes: DataFrame, min_rows: int = LOOKBACK + 1) -> DataFrame:
    """Rows of known nodes that have enough of them; counted by a grouped sum, not over whole nodes."""
    enough = obs.groupBy("location_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    keep = enough.join(nodes.select("location_hash"), "location_hash", "left_semi").select("location_hash")
    return obs.join(keep, "location_hash", "left_semi")


def resolve_places(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """First candidate inside the country per query, by rank; else why there is none."""
    typed = candidates.withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})
    inside = in_box(F.col("lat"), F.col("lon"))
    best = typed.groupBy("query").agg(
        F.min_by(F.struct("display_name", "lat", "lon"), F.when(inside, F.col("rank"))).alias("hit")
    )
    status = (
        F.when(F.col("hit").isNotNull(), "ok").when(F.col("seen"), "outside").otherwise("none found")
    )
    return (
        queries.select("query").distinct()
        .join(best.withColumn("seen", F.lit(True)), "query", "left")
        .select("query", "hit.display_name", "hit.lat", "hit.lon", status.alias("status"))
    )


def concat_parts(parts: list[DataFrame]) -> DataFrame:
    """Batches under each other by column name; a column some lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
